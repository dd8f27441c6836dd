"""Random Fourier features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def frequencies(d: int, n: int, gamma: float, seed: int) -> np.ndarray:
    """d x n draws of N(0, gamma^2); the same for a seed on every machine."""
    if d < 1 or n < 1 or gamma <= 0:
        raise ValueError("dimensions and gamma must be positive")
    return np.random.default_rng(seed).standard_normal((d, n)) * gamma


def expand(x: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """[sin(x omega), cos(x omega)], 2n columns."""
    angle = x @ omega
    return np.hstack([np.sin(angle), np.cos(angle)])


def gram(x: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Inner products of expanded rows without expanding: sum of cos over frequencies."""
    a, b = x @ omega, y @ omega
    return np.cos(a) @ np.cos(b).T + np.sin(a) @ np.sin(b).T


def rff(columns: list[str], gamma: float = 2.0, n_features: int = 6000, seed: int = 0) -> Column:
    """array<double> of 2 * n_features values; frequencies are drawn again in each task from the seed."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        omega = frequencies(len(columns), n_features, gamma, seed)
        for batch in batches:
            yield pd.Series(list(expand(batch.to_numpy(dtype=float), omega)))

    return features(F.struct(*columns))


def expand_panel(df, columns: list[str], gamma: float, n_features: int, seed: int, prefix: str = "f", as_array: bool | None = None):
    """df with its columns replaced by one fixed map's 2 * n_features features, the same for all months and windows.

    as_array: one array column named by the prefix instead of a column each; the default beyond a hundred features.
    """
    made = df.withColumn("__f", rff(columns, gamma, n_features, seed))
    if as_array if as_array is not None else n_features > 50:
        return made.select(*(c for c in df.columns if c not in columns), F.col("__f").alias(prefix))
    return made.select(*(c for c in df.columns if c not in columns), *(F.col("__f")[i].alias(f"{prefix}_{i:03d}") for i in range(2 * n_features)))


def with_intercept(df, name: str = "const"):
    return df.withColumn(name, F.lit(1.0))
