"""Maintenance of an index: append, delete, compact, split, merge.

Changes come in batches and only add files, which count once the metadata names them; a change that failed can be made again.
Appends add rows of a new generation, deletes add ids that searches leave out up to the generation in use. rebalance() adds the rows
of clusters out of their size limits once more, under cluster ids that were never used, and the centroid table no longer
names the old ones; it works in rounds, until all are healthy or the cap of rounds is reached. compact() alone rewrites the
postings. Clusters out of limits are few and small by construction, so each one fits a task; rows never pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators.index import VectorIndex, assign, centroid_frame, cluster_means, encode, group_centroids, meso_frame
from nearfield.operators.prepare import check_vectors, prepare
from nearfield.plans.config import capacity
from nearfield.plans.scratch import cut

NEIGHBOURS = 32
SPLIT_ITERS = 4
MOST_ROUNDS = 20
LARGE_GROUP = 8


def _nearest_clusters(index: VectorIndex, prepared: DataFrame, fraction: float | None = None) -> DataFrame:
    """cluster_id for each prepared row. A tree looks at the share of meso clusters that appends probe."""
    ids, centroids, meso = index.centroid_arrays()
    if not index.config.tree or fraction is None:
        return assign(prepared, ids, centroids)
    meso_ids, meso_centroids = index.meso_arrays()
    m = max(1, int(len(meso_ids) * fraction))
    sent = index.spark.sparkContext.broadcast((ids, centroids, meso, meso_ids, meso_centroids))
    d = index.num_dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centroids, meso, meso_ids, meso_centroids = sent.value
        for b in batches:
            rows = K.matrix(b.column(1), d)
            near = np.argsort(K.pairwise(rows, meso_centroids, "l2sq"), axis=1, kind="stable")[:, :m]
            distances = K.pairwise(rows, centroids, "l2sq")
            for i, chosen in enumerate(near):
                allowed = np.isin(meso, meso_ids[chosen])
                if allowed.any():
                    distances[i, ~allowed] = np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids[distances.argmin(axis=1)] if len(rows) else np.zeros(0, np.int64)), b.column(0), b.column(1)], names=["cluster_id", "vec_id", "embedding"])

    return prepared.select("vec_id", "embedding").mapInArrow(run, "cluster_id long, vec_id long, embedding array<float>")


def append(index: VectorIndex, rows: DataFrame, rebalance_after: bool = True, commit: bool = True) -> None:
    """Add rows(vec_id, embedding). An id that the index has, or that comes twice, is a ValueError; so is a bad vector."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    check_vectors(rows, index.num_dimensions)
    if rows.groupBy("vec_id").count().filter("count > 1 OR vec_id IS NULL").limit(1).count():
        raise ValueError("an id comes twice, or is null")
    if rows.join(index.postings.select("vec_id"), "vec_id", "left_semi").limit(1).count():
        raise ValueError("an id is in the index")
    placed = encode(_nearest_clusters(index, prepare(rows, index.config), index.config.append_probe_fraction), index.quantizer)
    index.meta["gen"] += 1
    index._append("postings", placed.withColumn("gen", F.lit(index.meta["gen"]).cast("long")))
    if commit:
        index._commit()
    if rebalance_after:
        rebalance(index)


def delete(index: VectorIndex, row_ids: DataFrame, missing: str = "error", rebalance_after: bool = True, commit: bool = True) -> None:
    """Take out row_ids(vec_id). Ids that the index lacks are a ValueError unless missing="ignore"."""
    ids = row_ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    live = index.postings.select("vec_id")
    if missing != "ignore" and ids.join(live, "vec_id", "left_anti").limit(1).count():
        raise ValueError("an id is not in the index")
    index._append("deletes", ids.join(live, "vec_id", "left_semi").withColumn("gen", F.lit(index.meta["gen"]).cast("long")))
    index.meta["has_deletes"] = True
    if commit:
        index._commit()
    if rebalance_after:
        rebalance(index)


def compact(index: VectorIndex) -> None:
    """Rewrite the postings without deleted rows and replaced clusters."""
    rows = index.postings
    index._write("postings", rows.repartitionByRange("cluster_id", "vec_id").sortWithinPartitions("cluster_id", "vec_id"))
    index._write("deletes", index._table("deletes").limit(0))
    index.meta |= {"has_deletes": False, "has_retired": False}
    index._commit()


def health(index: VectorIndex) -> DataFrame:
    """cluster_id, n, least, most, state ("split", "merge" or "ok") of each cluster, by its size when it was made."""
    sizes = index.cluster_sizes().join(index.centroids.select("cluster_id", "meso_id", "made_with"), "cluster_id")
    least = F.floor(F.col("made_with") / 2)
    most = F.greatest(F.floor(F.col("made_with") * 1.3), F.lit(capacity(0)[1]))
    state = F.when(F.col("n") > most, "split").when((F.col("made_with") > 1) & (F.col("n") <= least), "merge").otherwise("ok")
    return sizes.select("cluster_id", "meso_id", "n", least.alias("least"), most.alias("most"), state.alias("state"))


def _rewrite(index: VectorIndex, old: list[int], moved: DataFrame, ids: np.ndarray, meso: np.ndarray, centroids: np.ndarray) -> None:
    """Put `moved`, all live rows of clusters `old`, in their place. ids, meso, centroids are the clusters from now on; those
    of `old` and new ones get fresh ids, others keep theirs and may gain rows."""
    gained = {r["cluster_id"]: r["n"] for r in moved.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = {r["cluster_id"]: r["made_with"] for r in index.centroids.select("cluster_id", "made_with").collect()}
    kept = set(before) - set(old)
    fresh = {int(i): index.meta["next_cluster"] + k for k, i in enumerate(i for i in ids if int(i) not in kept)}
    names = index.spark.createDataFrame([*fresh.items()] or [(-1, -1)], "cluster_id long, fresh long")
    renamed = moved.join(F.broadcast(names), "cluster_id", "left").select(F.coalesce("fresh", "cluster_id").alias("cluster_id"), "vec_id", "embedding")
    index._append("postings", encode(renamed, index.quantizer).withColumn("gen", F.lit(index.meta["gen"]).cast("long")))
    index.meta["next_cluster"] += len(fresh)
    index.meta["has_retired"] = True
    out_ids = [fresh.get(int(i), int(i)) for i in ids]
    made = [before[int(i)] if int(i) in kept else gained.get(int(i), 0) for i in ids]
    index._write("centroids", centroid_frame(index.spark, out_ids, meso, centroids, made))
    index._commit()


def split(index: VectorIndex, cluster_ids: list[int]) -> None:
    """Two-means of each given cluster; then rows of the two halves and of up to 32 neighbours of the same meso cluster go to
    the nearest centroid among them, if it is strictly nearer than their own."""
    ids, centroids, meso = index.centroid_arrays()
    iters, seed, angular = SPLIT_ITERS, index.config.seed, index.config.normalizes

    def halve(key, rows):
        data = np.stack(rows["embedding"].to_numpy()).astype(np.float32)
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        two = K.kmeans(data[order], 2, iters, seed, angular)
        return pd.DataFrame({"cluster_id": [key[0]] * len(two), "half": range(len(two)), "centroid": [c.tolist() for c in two]})

    source = index.vectors()
    halves = source.filter(F.col("cluster_id").isin(cluster_ids)).groupBy("cluster_id").applyInPandas(halve, "cluster_id long, half int, centroid array<float>").collect()
    new_ids, new_meso, new = ids.tolist(), meso.tolist(), [c for c in centroids]
    touched = set(cluster_ids)
    for r in sorted(halves, key=lambda r: (r["cluster_id"], r["half"])):
        at = int(np.flatnonzero(ids == r["cluster_id"])[0])
        if r["half"] == 0:
            new[at] = np.array(r["centroid"], np.float32)
            near = np.flatnonzero(meso == meso[at])
            near = near[np.argsort(K.pairwise(centroids[at][None], centroids[near], "l2sq")[0], kind="stable")]
            touched |= set(ids[near[: NEIGHBOURS + 1]].tolist())
        else:
            new_ids.append(max(new_ids) + 1)
            new_meso.append(int(meso[at]))
            new.append(np.array(r["centroid"], np.float32))
    out_ids, out_meso, out = np.array(new_ids), np.array(new_meso), np.stack(new)
    moved = cut(_move(index, sorted(touched), out_ids, out_meso, out), "moved")
    place = {int(i): k for k, i in enumerate(out_ids)}
    for r in cluster_means(moved).collect():  # the true means of the clusters that gave or took rows
        mean = np.array(r["mean"])
        out[place[r["cluster_id"]]] = K.unit(mean[None])[0] if angular else mean
    _rewrite(index, sorted(touched), moved, out_ids, out_meso, out)


def merge(index: VectorIndex, cluster_ids: list[int]) -> None:
    """Dissolve the given clusters: their rows go to the nearest centroid left in their meso cluster, or anywhere if none is."""
    ids, centroids, meso = index.centroid_arrays()
    gone = np.isin(ids, cluster_ids)
    if gone.all():
        gone[np.argmax(gone)] = False
    left = ~gone
    dissolved = ids[gone].tolist()
    moved = _move(index, dissolved, ids[left], meso[left], centroids[left], meso_of_old=dict(zip(ids.tolist(), meso.tolist(), strict=True)))
    moved = cut(moved, "moved")
    _rewrite(index, dissolved, moved, ids[left], meso[left], centroids[left])


def _move(index: VectorIndex, old: list[int], ids: np.ndarray, meso: np.ndarray, centroids: np.ndarray, meso_of_old: dict | None = None) -> DataFrame:
    """Rows of clusters `old` with the nearest centroid of their meso cluster; a row stays where its own is as near."""
    sent = index.spark.sparkContext.broadcast((ids, meso, centroids, meso_of_old or dict(zip(ids.tolist(), meso.tolist(), strict=True))))
    d = index.num_dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, meso, centroids, meso_of = sent.value
        place = {int(i): k for k, i in enumerate(ids)}
        for b in batches:
            own, rows = np.asarray(b.column(0)), K.matrix(b.column(2), d)
            to = own.copy()
            for m in {meso_of[int(c)] for c in np.unique(own)}:
                here = np.array([meso_of[int(c)] == m for c in own])
                among = np.flatnonzero(meso == m)
                among = among if len(among) else np.arange(len(ids))
                best, far = K.nearest(rows[here], centroids[among])
                found = ids[among[best]]
                at = np.array([place.get(int(c), -1) for c in own[here]])
                mine = ((rows[here] - centroids[at]) ** 2).sum(axis=1)
                to[here] = np.where((at < 0) | (far < mine - 1e-9), found, own[here])
            yield pa.RecordBatch.from_arrays([pa.array(to), b.column(1), b.column(2)], names=["cluster_id", "vec_id", "embedding"])

    rows = index.vectors().filter(F.col("cluster_id").isin(old)).select("cluster_id", "vec_id", "embedding")
    return rows.mapInArrow(run, "cluster_id long, vec_id long, embedding array<float>")


def rebalance_meso(index: VectorIndex) -> None:
    """Group the centroids anew where a meso cluster is empty or holds LARGE_GROUP times the mean."""
    if not index.config.tree:
        return
    ids, centroids, meso = index.centroid_arrays()
    meso_ids, _ = index.meso_arrays()
    sizes = np.array([(meso == m).sum() for m in meso_ids])
    want = index.config.num_meso_clusters or max(1, math.isqrt(len(ids)))
    if len(meso_ids) == min(want, len(ids)) and sizes.min() > 0 and sizes.max() <= LARGE_GROUP * sizes.mean():
        return
    groups, label = group_centroids(centroids, index.config)
    made = {r["cluster_id"]: r["made_with"] for r in index.centroids.select("cluster_id", "made_with").collect()}
    index._write("meso", meso_frame(index.spark, groups))
    index._write("centroids", centroid_frame(index.spark, ids, label, centroids, [made[int(i)] for i in ids]))
    index._commit()


def rebalance(index: VectorIndex) -> int:
    """Split and merge until all clusters are within their limits; the number of rounds that changed something."""
    for done in range(MOST_ROUNDS):
        sick = health(index).filter("state <> 'ok'").select("cluster_id", "state").collect()
        to_split = [r["cluster_id"] for r in sick if r["state"] == "split"]
        to_merge = [r["cluster_id"] for r in sick if r["state"] == "merge"]
        if to_split:
            split(index, to_split)
        elif to_merge and index.num_clusters > 1:
            merge(index, to_merge)
        else:
            return done
        rebalance_meso(index)
    return MOST_ROUNDS


def run_workload(index_of, vectors: DataFrame, steps: list[tuple[str, float]]) -> VectorIndex:
    """Play (BUILD | INSERT | DELETE, share of the rows) in order of vec_id; shares must end at 1. index_of(rows) builds."""
    net = reduce(lambda t, s: t + (s[1] if s[0] != "DELETE" else -s[1]), steps, 0.0)
    if abs(net - 1.0) > 1e-9:
        raise ValueError("the shares of a workload must add to 1")
    total = vectors.count()
    by_order = vectors.select("vec_id", "embedding")
    bounds = vectors.selectExpr("percentile(vec_id, array(0, 1)) AS p").first()["p"]
    low, span = bounds[0], bounds[1] - bounds[0] + 1
    at = 0.0
    dropped = 0.0
    index = None
    for kind, share in steps:
        if kind == "DELETE":
            ids = by_order.filter((F.col("vec_id") >= low + span * dropped) & (F.col("vec_id") < low + span * (dropped + share))).select("vec_id")
            delete(index, ids)
            dropped += share
            continue
        rows = by_order.filter((F.col("vec_id") >= low + span * at) & (F.col("vec_id") < low + span * (at + share)))
        if at + share > 1 + 1e-9:  # rows that were deleted come again
            back = by_order.filter((F.col("vec_id") >= low) & (F.col("vec_id") < low + span * (at + share - 1)))
            compact(index)
            rows = rows.unionByName(back)
        at += share
        if kind == "BUILD":
            index = index_of(rows)
        else:
            append(index, rows)
    if total and index is None:
        raise ValueError("a workload begins with BUILD")
    return index
