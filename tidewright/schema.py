"""Checks at the library's boundaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in set(without)]


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; raises when a key occurs twice. One aggregation with partial counts."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate rows for {keys}")
    return df


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL, which aggregates skip."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    floats = [c for c, kind in df.dtypes if kind in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in floats})
