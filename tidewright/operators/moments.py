"""Month moments: what instrumented factor models need of a panel, in one aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Beyond this many characteristics moments are summed in numpy: as expressions they would be too many to compile.
MOST_EXPRESSIONS = 40


def month_moments(df: DataFrame, chars: list[str], target: str = "y", month: str = "month", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, month, n, sy, yy, sz, b, a): counts, sums, Z'y and the packed upper triangle of Z'Z, over complete rows.

    One exchange of a row per task and month: partial sums in the JVM, or of many characteristics in numpy per task.
    """
    rows = df.dropna(subset=[*chars, target, month])
    if len(chars) > MOST_EXPRESSIONS:
        return wide_moments(rows.select(*by, month, F.col(target).cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in chars)).alias("z")), len(chars), (*by, month))
    y, z = F.col(target), [F.col(c) for c in chars]
    return rows.groupBy(*by, month).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy"), F.array(*(F.sum(c) for c in z)).alias("sz"),
        F.array(*(F.sum(c * y) for c in z)).alias("b"), F.array(*(F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z)))).alias("a"),
    )


def wide_moments(df: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """month_moments() of rows (keys, y, z), z an array of `size` numbers: each task sums a key's rows, and a key's sums
    meet in one group, a row per task."""
    up = np.triu_indices(size)
    names = ["n", "sy", "yy", "sz", "b", "a"]
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "n long, sy double, yy double, sz array<double>, b array<double>, a array<double>"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key, rows in batch.groupby(list(keys), sort=False):
                z, y = np.stack(rows["z"].to_numpy()), rows["y"].to_numpy(dtype=float)
                new = [len(y), y.sum(), (y * y).sum(), z.sum(axis=0), z.T @ y, (z.T @ z)[up]]
                held[key] = [a + b for a, b in zip(held[key], new, strict=True)] if key in held else new
        if held:
            yield pd.DataFrame([(*key, *row) for key, row in held.items()], columns=[*keys, *names])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        whole = {c: [np.sum(np.stack(rows[c].to_numpy()), axis=0)] for c in ("sz", "b", "a")}
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, **{c: [rows[c].sum()] for c in ("n", "sy", "yy")}, **whole})

    return df.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(total, schema)


def managed_portfolios(df: DataFrame, chars: list[str], target: str = "y", month: str = "month") -> DataFrame:
    """(month, n, q, w): Z'y / n and the packed upper triangle of Z'Z / n."""
    m = month_moments(df, chars, target, month)
    return m.select(month, "n", F.transform("b", lambda v: v / F.col("n")).alias("q"), F.transform("a", lambda v: v / F.col("n")).alias("w"))


@dataclass
class Moments:
    """A: T x L x L, b: T x L, yy, n, sz, sy per month, in month order; small whatever the panel."""

    months: list
    A: np.ndarray
    b: np.ndarray
    yy: np.ndarray
    n: np.ndarray
    sz: np.ndarray
    sy: np.ndarray

    def part(self, keep: np.ndarray) -> Moments:
        return Moments([m for m, k in zip(self.months, keep, strict=True) if k], self.A[keep], self.b[keep], self.yy[keep], self.n[keep], self.sz[keep], self.sy[keep])


def collect(moments: DataFrame, size: int, month: str = "month") -> Moments:
    """T rows of about L^2 / 2 numbers come to the driver."""
    return packed(moments.collect(), size, month)


def packed(rows: list, size: int, month: str = "month") -> Moments:
    """Moments from rows of month_moments()."""
    rows = sorted(rows, key=lambda r: r[month])
    up = np.triu_indices(size)
    a = np.zeros((len(rows), size, size))
    for i, r in enumerate(rows):
        a[i][up] = r["a"]
        a[i] = a[i] + np.triu(a[i], 1).T
    get = lambda c: np.array([r[c] for r in rows], dtype=float)
    shape = (len(rows), size)
    return Moments([r[month] for r in rows], a, get("b").reshape(shape), get("yy"), get("n"), get("sz").reshape(shape), get("sy"))
