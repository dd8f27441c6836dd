"""Rolling ridge backtests in the dual: with T rows and P features, T x T systems, one eigendecomposition for all penalties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import rff

RESULT = "month date, coefficient_norm double, forecast double, timing_return double, market_return double"


def backtest(kernel: np.ndarray, y: np.ndarray, penalty: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(forecast, coefficient norm) per row, NaN for the first `window`; kernel: inner products of all rows' features.

    Row t is forecast from rows t - window to t - 1 with penalty * window on the squared coefficients, no intercept.
    """
    n = len(y)
    forecast, norm = np.full(n, np.nan), np.full(n, np.nan)
    for t in range(window, n):
        k = kernel[t - window : t, t - window : t]
        if np.isnan(y[t - window : t]).any():
            continue
        values, vectors = np.linalg.eigh(k)
        alpha = vectors @ ((vectors.T @ y[t - window : t]) / (np.maximum(values, 0) + penalty * window))
        forecast[t] = kernel[t, t - window : t] @ alpha
        norm[t] = np.sqrt(max(alpha @ k @ alpha, 0))
    return forecast, norm


def backtests(kernel: np.ndarray, y: np.ndarray, penalties: list[float], window: int) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """backtest() for many penalties; every window is decomposed once."""
    n = len(y)
    out = {z: (np.full(n, np.nan), np.full(n, np.nan)) for z in penalties}
    for t in range(window, n):
        past = slice(t - window, t)
        if np.isnan(y[past]).any():
            continue
        values, vectors = np.linalg.eigh(kernel[past, past])
        values, turned = np.maximum(values, 0), vectors.T @ y[past]
        for z in penalties:
            a = turned / (values + z * window)
            out[z][0][t] = kernel[t, past] @ (vectors @ a)
            out[z][1][t] = np.sqrt((a * a * values).sum())
    return out


def rolling_ridge(df: DataFrame, features: list[str], target: str, penalty: float = 1000.0, window: int = 12, month: str = "month", by: tuple[str, ...] = ()) -> DataFrame:
    """Backtest of every series; each row's window is gathered with a bounded frame, so long series stay distributed by `by`."""
    w = Window.partitionBy(*by).orderBy(month) if by else Window.orderBy(month)
    past = F.collect_list(F.struct(F.array(*features).alias("x"), F.col(target).alias("y"))).over(w.rowsBetween(-window, -1))
    rows = df.dropna(subset=[*features, target]).select(*by, month, F.array(*features).alias("x"), F.col(target).alias("y"), past.alias("past"))

    @F.pandas_udf("forecast double, coefficient_norm double")
    def solve(x: pd.Series, past: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 2), np.nan)
        for i, (now, rows) in enumerate(zip(x, past, strict=True)):
            s, y = np.stack([r["x"] for r in rows]), np.array([r["y"] for r in rows])
            k = s @ s.T
            alpha = np.linalg.solve(k + penalty * window * np.eye(len(k)), y)
            out[i] = now @ (s.T @ alpha), np.sqrt(max(alpha @ k @ alpha, 0))
        return pd.DataFrame(out, columns=["forecast", "coefficient_norm"])

    full = rows.filter(F.size("past") == window).withColumn("r", solve("x", "past"))
    return full.select(*by, month, "r.coefficient_norm", "r.forecast", (F.col("r.forecast") * F.col("y")).alias("timing_return"), F.col("y").alias("market_return"))


def penalty_grid(df: DataFrame, features: list[str], target: str, penalties: list[float], window: int = 12, month: str = "month") -> DataFrame:
    """rolling_ridge() for many penalties, with a column z: windows are gathered and decomposed once for all of them."""
    past = F.collect_list(F.struct(F.array(*features).alias("x"), F.col(target).alias("y"))).over(Window.orderBy(month).rowsBetween(-window, -1))
    rows = df.dropna(subset=[*features, target]).select(month, F.array(*features).alias("x"), F.col(target).alias("y"), past.alias("past"))
    zs = np.array(penalties, dtype=float)

    @F.pandas_udf("array<struct<z double, forecast double, coefficient_norm double>>")
    def solve(x: pd.Series, past: pd.Series) -> pd.Series:
        out = []
        for now, rows in zip(x, past, strict=True):
            s, y = np.stack([r["x"] for r in rows]), np.array([r["y"] for r in rows])
            values, vectors = np.linalg.eigh(s @ s.T)
            values, turned, seen = np.maximum(values, 0), vectors.T @ y, (now @ s.T) @ vectors
            a = turned[None, :] / (values[None, :] + zs[:, None] * window)
            out.append([{"z": z, "forecast": f, "coefficient_norm": n} for z, f, n in zip(zs, a @ seen, np.sqrt((a * a * values).sum(axis=1)), strict=True)])
        return pd.Series(out)

    each = rows.filter(F.size("past") == window).withColumn("r", F.explode(solve("x", "past")))
    return each.select(F.col("r.z").alias("z"), month, "r.coefficient_norm", "r.forecast", (F.col("r.forecast") * F.col("y")).alias("timing_return"), F.col("y").alias("market_return"))


def grid(spark: SparkSession, gammas: list[float], sizes: list[int], penalties: list[float], seeds: list[int]) -> DataFrame:
    """(gamma, p, z, seed) of every run; p is an even number of features. Runs are numbers taken apart by division, so
    that a grid of millions is made in parallel and a small one in one task."""
    n = len(gammas) * len(sizes) * len(penalties) * len(seeds)
    pick = lambda values, kind, step: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), (F.floor(F.col("id") / step) % len(values) + 1).cast("int"))
    runs = spark.range(0, n, 1, max(1, min(spark.sparkContext.defaultParallelism, n // 1000)))
    s, z = len(seeds), len(penalties)
    return runs.select(
        pick(gammas, "double", len(sizes) * s * z).alias("gamma"), pick(sizes, "int", s * z).alias("p"), pick(penalties, "double", 1).alias("z"), pick(seeds, "int", z).alias("seed")
    )


def complexity_grid(spark: SparkSession, seeds: int = 500) -> DataFrame:
    """The grid of the main study: p = c * T rounded to even numbers, c in 4 x 25 log-spaced points."""
    c = np.concatenate([np.logspace(a, a + 1, 25) for a in (-1, 0, 1, 2)])
    sizes = sorted({max(2, int(2 * round(x * 12 / 2))) for x in c})
    return grid(spark, [0.25, 0.5, 1.0, 2.0, 4.0], sizes, [float(z) for z in np.logspace(-3, 6, 10)], list(range(seeds)))


def sweep(configs: DataFrame, series: DataFrame, features: list[str], target: str, window: int = 12, month: str = "month") -> DataFrame:
    """Backtest rows for each (gamma, p, z, seed): one task per (gamma, p, seed) group shares features across penalties.

    series is one row per month (a few thousand at most) and travels with the tasks.
    """
    local = series.dropna(subset=[*features, target]).orderBy(month).select(month, *features, target).toPandas()
    months, x, y = list(local[month]), local[features].to_numpy(dtype=float), local[target].to_numpy(dtype=float)

    def run(config: pd.DataFrame) -> pd.DataFrame:
        g, p, s = config[["gamma", "p", "seed"]].iloc[0]
        kernel = rff.gram(x, x, rff.frequencies(len(features), int(p) // 2, float(g), int(s)))
        out = []
        for z, (forecast, norm) in backtests(kernel, y, [float(v) for v in config["z"].unique()], window).items():
            keep = ~np.isnan(forecast)
            out.append(pd.DataFrame({"gamma": float(g), "p": int(p), "z": z, "seed": int(s), "month": np.array(months, dtype=object)[keep], "coefficient_norm": norm[keep], "forecast": forecast[keep], "timing_return": forecast[keep] * y[keep], "market_return": y[keep]}))
        return pd.concat(out)

    return configs.groupBy("gamma", "p", "seed").applyInPandas(run, f"gamma double, p int, z double, seed int, {RESULT}")


def map_configs(configs: DataFrame, run, schema: str) -> DataFrame:
    """One pandas row per configuration, dealt over tasks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, config in batch.iterrows():
                yield run(config)

    return configs.mapInPandas(each, schema)
