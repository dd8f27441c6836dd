"""Rolling neural backtest: a small perceptron in numpy, refitted from scratch on each window."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewright.operators.ridge import RESULT, map_configs

_erf = np.vectorize(math.erf, otypes=[float])


def _phi(a: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    return 0.5 * (1 + _erf(a / math.sqrt(2)))


_ACT = {
    "relu": (lambda a: np.maximum(a, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - np.tanh(a) ** 2),
    "gelu": (lambda a: a * _phi(a), lambda a: _phi(a) + a * np.exp(-a * a / 2) / math.sqrt(2 * math.pi)),
}


class Perceptron:
    """Dense layers with dropout, trained by Adam on squared error."""

    def __init__(self, d_in: int, hidden: tuple[int, ...] = (64, 32), act: str = "tanh", dropout: float = 0.5, seed: int = 0):
        if act not in _ACT or not hidden or not 0 <= dropout <= 1:
            raise ValueError("an activation of relu, tanh or gelu, a hidden layer, and dropout in [0, 1]")
        self.rng, self.act, self.dropout = np.random.default_rng(seed), act, dropout
        sizes = (d_in, *hidden, 1)
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        self.w = [self.rng.uniform(-b, b, (x, y)) for b, x, y in zip(bound, sizes[:-1], sizes[1:], strict=True)]
        self.b = [self.rng.uniform(-b, b, y) for b, y in zip(bound, sizes[1:], strict=True)]

    def _forward(self, x: np.ndarray, train: bool):
        outs, pres, masks = [x], [], []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            a = outs[-1] @ w + b
            if i == len(self.w) - 1:
                return a[:, 0], outs, pres, masks
            h = _ACT[self.act][0](a)
            keep = 1 - self.dropout
            mask = ((self.rng.random(h.shape) < keep) / keep if keep > 0 else np.zeros(h.shape)) if train else np.ones(h.shape)
            pres.append(a)
            masks.append(mask)
            outs.append(h * mask)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 100, batch: int = 32, rate: float = 1e-3) -> Perceptron:
        m = [np.zeros_like(p) for p in (*self.w, *self.b)]
        v = [np.zeros_like(p) for p in (*self.w, *self.b)]
        step = 0
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                out, outs, pres, masks = self._forward(x[rows], True)
                delta = (2 * (out - y[rows]) / len(rows))[:, None]
                gw, gb = [], []
                for i in range(len(self.w) - 1, -1, -1):
                    gw.append(outs[i].T @ delta)
                    gb.append(delta.sum(axis=0))
                    if i:
                        delta = (delta @ self.w[i].T) * masks[i - 1] * _ACT[self.act][1](pres[i - 1])
                step += 1
                for j, (p, g) in enumerate(zip((*self.w, *self.b), (*gw[::-1], *gb[::-1]), strict=True)):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    p -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, False)[0]


def static_return(pred: np.ndarray, ret: np.ndarray) -> float:
    """Cumulative return of holding the prediction."""
    return float(np.prod(1 + pred * ret) - 1)


#: Columns of a configuration beside the window's: what a row may leave out, and its value then.
DEFAULTS = {"act": "tanh", "epochs": 100, "batch": 32, "rate": 1e-3, "seed": 0}


def config_grid(spark: SparkSession, dropouts=(0.1, 0.25, 0.5, 1.0), layers=(1, 2, 4, 8), windows=(12, 36, 60), widths=(32, 64, 128)) -> DataFrame:
    """(dropout, layers, window, width) of the study's grid, 144 runs."""
    return spark.createDataFrame(list(itertools.product(dropouts, layers, windows, widths)), "dropout double, layers int, window int, width int")


def rolling_nn(configs: DataFrame, series: DataFrame, features: list[str], target: str, month: str = "month") -> DataFrame:
    """Backtests of configurations (width, layers, dropout, window, and any of DEFAULTS), a configuration per task; the
    series is short and travels with the tasks."""
    local = series.dropna(subset=[*features, target]).orderBy(month).select(month, *features, target).toPandas()
    months, x, y = np.array(list(local[month]), dtype=object), local[features].to_numpy(dtype=float), local[target].to_numpy(dtype=float)

    def run(given) -> pd.DataFrame:
        c = DEFAULTS | dict(given)
        t0, out = int(c["window"]), []
        for t in range(t0, len(y)):
            net = Perceptron(x.shape[1], (int(c["width"]),) * int(c["layers"]), str(c["act"]), float(c["dropout"]), int(c["seed"]))
            net.fit(x[t - t0 : t], y[t - t0 : t], int(c["epochs"]), int(c["batch"]), float(c["rate"]))
            out.append(float(net.predict(x[t : t + 1])[0]))
        f, m = np.array(out), y[t0:]
        return pd.DataFrame({
            "width": int(c["width"]), "layers": int(c["layers"]), "dropout": float(c["dropout"]), "window": t0, "act": str(c["act"]), "batch": int(c["batch"]), "rate": float(c["rate"]), "seed": int(c["seed"]),
            "month": months[t0:], "coefficient_norm": np.nan, "forecast": f, "timing_return": f * m, "market_return": m,
        })

    dealt = configs.repartition(max(1, min(configs.count(), 1000)))
    return map_configs(dealt, run, f"width int, layers int, dropout double, window int, act string, batch int, rate double, seed int, {RESULT}")
