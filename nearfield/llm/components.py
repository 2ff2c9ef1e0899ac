"""Connected components of an edge table, by alternating large and small stars.

Each round keeps connectivity and moves edges towards the least node of a component; it ends when every edge points at a
component's least node. Every step is an aggregation with partial minima and an equi-join that deals a hub's edges over many
tasks (skew.py); rounds are written to the shared folder, and a round's table goes when the next one is there. A table of up to
MOST_LOCAL edges is one task's work of a second or two, in place of some ten shuffles a round; that bound doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, free
from nearfield.llm.skew import LEAST_ROWS, join_hot

MOST_ROUNDS = 60
MOST_LOCAL = 1 << 20


def least_of_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the edges (a[i], b[i])."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        # a greater root goes below a lesser one, so the least node of a part is its root
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, further := up[up]):
            up = further
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[up]


def _local(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((2, 0), np.int64), *(np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches)]
        a, b = np.concatenate(parts, axis=1)
        node, label = least_of_parts(a[a != b], b[a != b])
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(label, pa.int64())], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def _star(rows: DataFrame, floor: bool, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """rows(u, v) with m, the least v of u (u itself, if `floor` and it is less); and (u, m)."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = cut(least, "least") if hubs else least
    made = least.select("u", F.least("u", "m").alias("m") if floor else F.col("m"))
    return join_hot(rows, made, "u", counts=least) if hubs else rows.join(made, "u"), least


def _large_star(edges: DataFrame, hubs: bool) -> tuple[DataFrame, DataFrame]:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined, least = _star(both, True, hubs)
    return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), least


def _small_star(edges: DataFrame, hubs: bool) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined, least = _star(down, False, hubs)
    moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), a written table -> (node, label) of each node with an edge; label is the component's least node."""
    if edges.count() <= MOST_LOCAL:
        return _local(edges)
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        # a table of that size is one task's work, hubs or not
        hubs = 2 * state[0] > LEAST_ROWS
        before, (wide, one) = now, _large_star(now, hubs)
        wide = cut(wide, "wide") if hubs else wide
        star, two = _small_star(wide, hubs)
        now = cut(star, "stars")
        free(before, one, wide, two)
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
