"""Connected components by contraction, for links of any number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import spread_join, stage

#: So many edges, whatever the input, are taken to their ends by one task: each round saved is a dozen plans less for the driver.
LAST_EDGES = 10_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reached) of all ends of edges, by hooking roots to smaller neighbours."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0), x.column(1)) for x in batches]
    if held:
        a, b = (np.concatenate([x[i].to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(a, b)], names=["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges (a, b), component the smallest id reached.

    Each round sends every vertex to the neighbour (or itself) of least hash, drawn anew each round, and keeps the edges
    between different targets: a constant share of vertices goes whatever the shape, so rounds grow with the logarithm.
    Neighbours meet in aggregates with partial sums, never in lists, and the edges of a star's centre don't meet in one
    task. Each round's table is written to the shared folder. The last LAST_EDGES edges, a fixed number, are joined in one task.
    Null ends are dropped; repeated edges and loops change nothing.
    """
    ends = edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    levels: list[DataFrame] = []
    left = stage(ends.distinct(), "edges")
    while n_edges := left.filter("a <> b").count():
        if n_edges <= LAST_EDGES and (levels or left.count() <= LAST_EDGES):
            kind = left.schema["a"].dataType.simpleString()
            levels.append(stage(left.select("a", "b").coalesce(1).mapInArrow(kernels.trimmed(_last), f"a {kind}, to {kind}"), "targets"))
            break
        rank = lambda c, turn=len(levels): F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c).alias("id"))
        both = left.select("a", rank("b").alias("n")).unionByName(left.select(F.col("b").alias("a"), rank("a").alias("n")))
        to = both.groupBy("a").agg(F.min("n").alias("n"), F.count("*").alias("degree")).select("a", F.least("n", rank("a"))["id"].alias("to"), "degree")
        to = stage(to, "targets")
        levels.append(to)
        ta, tb = to.select("a", F.col("to").alias("x"), F.col("degree").alias("da")), to.select(F.col("a").alias("b"), F.col("to").alias("y"), F.col("degree").alias("db"))
        moved = spread_join(spread_join(left, ta, "a", "da", n_edges), tb, "b", "db", n_edges).filter("x <> y")
        left = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not levels:
        return left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    root = levels[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for to in levels[1:]:
        root = root.join(to, root["root"] == to["a"], "left").select("id", F.coalesce("to", "root").alias("root"))
    root = stage(root, "roots")
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return stage(root.join(least, "root").select("id", "component"), "components")
