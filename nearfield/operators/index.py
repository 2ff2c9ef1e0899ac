"""Inverted-file indexes over vectors, of one or two centroid levels, in 32-bit floats or 8-bit codes.

An index is a folder of Parquet tables: postings (cluster_id, vec_id, embedding or code, gen), sorted by cluster_id so that row
groups can be skipped; centroids (cluster_id, meso_id, centroid, made_with); meso centroids; deletes (vec_id, gen), which hold
for rows of up to that generation. The metadata names the folders of each table; a change writes new folders and then the
metadata, so what a failed change wrote is never read. A build is a chain of one-pass projections and one shuffle by cluster.
A search takes queries in broadcast blocks, ranks centroids, and scans the postings once; a partition yields at most k rows a
query.

Distances of a search are squared L2 in the prepared space: for normalised vectors 2 - 2 cos.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators.exact import PARTIAL, partial_batches, query_blocks, top_k
from nearfield.operators.prepare import Quantizer, check_vectors, prepare, prepare_rows, rotation
from nearfield.plans.config import EPSILON, IndexConfig, auto_meso_clusters, auto_sampling
from nearfield.plans.scratch import cut, free, scratch_path

MOST_TRAIN_BYTES = 1 << 30
PROBED_LITERALS = 1000


class VectorIndex:
    """An index on disk. build() and load_index() make one."""

    def __init__(self, spark: SparkSession, config: IndexConfig, path: str, meta: dict):
        self.spark, self.config, self.path, self.meta = spark, config, path, meta
        self._centroids: tuple | None = None

    # --- tables -----------------------------------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{d}" for d in self.meta["tables"][name]])

    def _write(self, name: str, rows: DataFrame) -> None:
        """A table anew. Like all changes it counts from the next _commit() on."""
        self.meta["tables"][name] = []
        self._append(name, rows)

    def _append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table; what is there is neither read nor written."""
        folder = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{folder}")
        self.meta["tables"][name] = [*self.meta["tables"][name], folder]

    def _commit(self) -> None:
        text = json.dumps({"config": self.config.as_dict(), **self.meta})
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta.json")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._centroids = None

    @property
    def postings(self) -> DataFrame:
        """Live rows: cluster_id, vec_id and embedding or code. Rows of clusters that maintenance replaced are left out."""
        rows = self._table("postings")
        if self.meta["has_retired"]:
            rows = rows.join(F.broadcast(self.centroids.select("cluster_id")), "cluster_id", "left_semi")
        if not self.meta["has_deletes"]:
            return rows
        gone = self._table("deletes").select(F.col("vec_id").alias("_gone"), F.col("gen").alias("_gen"))
        return rows.join(gone, (F.col("vec_id") == F.col("_gone")) & (F.col("gen") <= F.col("_gen")), "left_anti")

    @property
    def centroids(self) -> DataFrame:
        return self._table("centroids")

    @property
    def quantizer(self) -> Quantizer | None:
        q = self.meta.get("quantizer")
        return Quantizer(*q) if q else None

    # --- facts ------------------------------------------------------------------------------------------------------

    @property
    def num_dimensions(self) -> int:
        return self.config.num_dimensions

    @property
    def num_clusters(self) -> int:
        return self.centroids.count()

    @property
    def num_meso_clusters(self) -> int:
        return self._table("meso").count() if self.config.tree else 0

    def cluster_sizes(self) -> DataFrame:
        sizes = self.postings.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        return self.centroids.select("cluster_id").join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))

    def cluster_row_ids(self, cluster_id: int) -> DataFrame:
        return self.postings.filter(F.col("cluster_id") == cluster_id).select("vec_id")

    def cluster_accesses(self, probes: DataFrame) -> DataFrame:
        """cluster_id, n_accessed, n_inserted, n_deleted of all clusters: the queries of probes(query_id, cluster_id) that probe
        it, the rows added since the build, and the stored rows that deletes hide."""
        asked = probes.select("query_id", F.col("cluster_id").cast("long").alias("cluster_id")).distinct()
        rows, gone = self._table("postings"), self._table("deletes").groupBy("vec_id").agg(F.max("gen").alias("_gen"))
        hidden = rows.join(gone, "vec_id").filter(F.col("gen") <= F.col("_gen"))
        counts = [
            asked.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_accessed")),
            rows.filter("gen > 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_inserted")),
            hidden.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_deleted")),
        ]
        out = self.centroids.select("cluster_id")
        for one in counts:
            out = out.join(one, "cluster_id", "left")
        return out.na.fill(0, ["n_accessed", "n_inserted", "n_deleted"])

    def cluster_filter(self, n: int, one_of_others: bool = False) -> DataFrame:
        """vec_id of the rows of the n clusters with the least ids, and with one_of_others the least id of each other cluster:
        filters that agree with the clusters, to measure filtered searches by."""
        rows = self.postings
        first = F.broadcast(self.centroids.select("cluster_id").orderBy("cluster_id").limit(n))
        ids = rows.join(first, "cluster_id", "left_semi").select("vec_id")
        if one_of_others:
            ids = ids.union(rows.join(first, "cluster_id", "left_anti").groupBy("cluster_id").agg(F.min("vec_id").alias("vec_id")).select("vec_id"))
        return ids

    def vectors(self) -> DataFrame:
        """vec_id and prepared vector of all live rows (decoded, if the index holds codes)."""
        q = self.quantizer
        if q is None:
            return self.postings.select("vec_id", "cluster_id", "embedding")
        decode = F.transform("code", lambda x: (x / q.scale + q.base).cast("float"))
        return self.postings.select("vec_id", "cluster_id", decode.alias("embedding"))

    @property
    def size_bytes(self) -> int:
        conf, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        total = 0
        for name, folders in self.meta["tables"].items():
            for folder in folders:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{folder}")
                total += at.getFileSystem(conf).getContentSummary(at).getLength()
        return total

    # --- search -----------------------------------------------------------------------------------------------------

    def centroid_arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster ids, centroids, meso ids); their number grows with the root of the rows."""
        if self._centroids is None:
            t = self.centroids.orderBy("cluster_id").toArrow().combine_chunks()
            ids = np.asarray(t.column("cluster_id").combine_chunks())
            self._centroids = ids, K.matrix(t.column("centroid").combine_chunks(), self.num_dimensions), np.asarray(t.column("meso_id").combine_chunks())
        return self._centroids

    def meso_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        t = self._table("meso").orderBy("meso_id").toArrow().combine_chunks()
        return np.asarray(t.column("meso_id").combine_chunks()), K.matrix(t.column("centroid").combine_chunks(), self.num_dimensions)

    def _ranking(self, flat: bool = False, fraction: float | None = None) -> tuple:
        """What rank() needs besides rows and nprobe."""
        ids, centroids, meso = self.centroid_arrays()
        if not self.config.tree or flat:
            return ids, centroids, meso, None, None, 0
        meso_ids, meso_centroids = self.meso_arrays()
        return ids, centroids, meso, meso_ids, meso_centroids, max(1, int(len(meso_ids) * (self.config.meso_probe_fraction if fraction is None else fraction)))

    def rank_clusters(self, rows: np.ndarray, nprobe: int, flat: bool = False, fraction: float | None = None) -> list[np.ndarray]:
        """Cluster ids to probe for each prepared query, nearest first. nprobe 0 or more than there are: all."""
        ranking = self._ranking(flat, fraction)
        step = max(1, K.BLOCK_BYTES // (8 * max(1, len(ranking[0]))))
        return [ids for at in range(0, len(rows), step) for ids, _ in rank(rows[at : at + step], nprobe, *ranking)]

    def probes(self, queries: DataFrame, nprobe: int = 32, flat: bool = False) -> DataFrame:
        """query_id, rank, cluster_id, distance of the clusters that a search of queries(query_id, embedding) probes; one Arrow
        pass with broadcast centroids."""
        matrix, config = rotation(self.config), self.config
        sent = self.spark.sparkContext.broadcast((matrix, self._ranking(flat)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, ranking = sent.value
            for b in batches:
                found = rank(prepare_rows(K.matrix(b.column(1), config.num_dimensions), config, matrix), nprobe, *ranking)
                n = [len(ids) for ids, _ in found]
                none = [np.zeros(0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(b.column(0)), n), pa.int64()),
                        pa.array(np.concatenate([np.arange(1, k + 1) for k in n] or none).astype(np.int32)),
                        pa.array(np.concatenate([ids for ids, _ in found] or none).astype(np.int64)),
                        pa.array(np.concatenate([d for _, d in found] or none)),
                    ],
                    names=["query_id", "rank", "cluster_id", "distance"],
                )

        return queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(run, "query_id long, rank int, cluster_id long, distance double")

    def search(self, queries: DataFrame, k: int, nprobe: int = 32, row_ids: DataFrame | None = None, pruning: str = "exact", probes: DataFrame | None = None, seed: bool = False, epsilon: float | None = None) -> DataFrame:
        """query_id, rank, vec_id, distance of queries(query_id, embedding).

        row_ids(vec_id) restricts the rows within the probed clusters, which are chosen before, so fewer than k may remain.
        pruning: "none", "exact" (the same result, fewer components read) or "adsampling" (approximate; epsilon tells how far).
        probes(query_id, cluster_id) takes the place of the ranking of clusters. With `seed`, the nearest cluster of each query
        is searched first, and the distance of its k-th row bounds the search in all partitions; worth it where the scan is long.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        if pruning not in ("none", "exact", "adsampling"):
            raise ValueError("pruning must be none, exact or adsampling")
        postings = self.postings
        if row_ids is not None:
            postings = postings.join(row_ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
        parts: DataFrame | None = None
        matrix = rotation(self.config)
        epsilon = self.config.epsilon if epsilon is None else epsilon
        for ids, raw in query_blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"), self.num_dimensions):
            rows = prepare_rows(raw, self.config, matrix)
            every = probes is None and not 0 < nprobe < len(self.centroid_arrays()[0])
            asked = self._given(probes, ids) if probes is not None else None if every else self.rank_clusters(rows, nprobe, flat=row_ids is not None)
            bound = None
            if seed and (every or any(len(c) > 1 for c in asked)):
                first = self.rank_clusters(rows, 1, flat=True) if every else [c[:1] for c in asked]
                bound = self._bounds(self._scan(postings, ids, rows, first, k, "none", epsilon), ids, k)
            found = self._scan(postings, ids, rows, asked, k, pruning, epsilon, bound)
            parts = found if parts is None else parts.union(found)
        return top_k(parts if parts is not None else self.spark.createDataFrame([], PARTIAL), k)

    def filtered_search(self, queries: DataFrame, k: int, row_ids: DataFrame, nprobe: int = 32, pruning: str = "exact") -> DataFrame:
        return self.search(queries, k, nprobe, row_ids, pruning)

    def _given(self, probes: DataFrame, ids: np.ndarray) -> list[np.ndarray]:
        """The clusters to probe of a block's queries."""
        block = F.broadcast(self.spark.createDataFrame(pa.table({"query_id": pa.array(ids)})))
        t = probes.select(F.col("query_id").cast("long").alias("query_id"), F.col("cluster_id").cast("long").alias("cluster_id")).distinct().join(block, "query_id").toArrow()
        query, cluster = np.asarray(t.column("query_id").combine_chunks()), np.asarray(t.column("cluster_id").combine_chunks())
        return [np.sort(cluster[query == i]) for i in ids]

    def _bounds(self, partial: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
        """The distance of the k-th row that was found for each query, infinite where there are fewer; a row a query."""
        worst = top_k(partial, k).groupBy("query_id").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        bound = np.full(len(ids), np.inf)
        for r in worst.select("query_id", "d").collect():
            bound[np.searchsorted(ids, r["query_id"])] = r["d"]
        return bound

    def _scan(self, postings: DataFrame, ids: np.ndarray, rows: np.ndarray, probes: list[np.ndarray] | None, k: int, pruning: str, epsilon: float = EPSILON, bound: np.ndarray | None = None) -> DataFrame:
        """Partial results of one block of queries, whose rows a partition meets cluster by cluster. Where several queries probe a
        cluster its distances are one matrix product, unless pruning is approximate; a lone query prunes. Without probes, each query
        probes all clusters, which needs no list."""
        clusters = starts = asked = None
        if probes is not None:
            flat = np.concatenate([*probes, np.zeros(0, np.int64)]).astype(np.int64)
            order = np.argsort(flat, kind="stable")
            asked = np.repeat(np.arange(len(probes), dtype=np.int32), [len(c) for c in probes])[order]
            clusters, starts = np.unique(flat[order], return_index=True)
            starts = np.append(starts, len(flat))
        quantizer = self.quantizer
        working = K.quantize(rows, quantizer.base, quantizer.scale).astype(np.float64) if quantizer else rows.astype(np.float64)
        rescale = 1 / quantizer.scale**2 if quantizer else 1.0
        column = "code" if quantizer else "embedding"
        d = self.num_dimensions
        if clusters is not None and len(clusters) <= PROBED_LITERALS and len(clusters) < len(self.centroid_arrays()[0]):
            postings = postings.filter(F.col("cluster_id").isin(clusters.tolist()))
        # distances beyond a bound can't enter; rounding is allowed for
        limit = None if bound is None else bound / rescale * (1 + 1e-9) + 1e-12
        sent = self.spark.sparkContext.broadcast((ids, working, clusters, starts, asked, limit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, working, probed, first, queries, limit = sent.value
            top = K.TopK(len(ids), k, bound=limit)
            everybody, nobody = np.arange(len(ids)), np.zeros(0, np.int64)

            def asking(cluster: int) -> np.ndarray:
                if probed is None:
                    return everybody
                at = np.searchsorted(probed, cluster)
                return queries[first[at] : first[at + 1]] if at < len(probed) and probed[at] == cluster else nobody

            for b in batches:
                if not b.num_rows:
                    continue
                clusters, vec_ids, data = np.asarray(b.column(0)), np.asarray(b.column(1)), K.matrix(b.column(2), d)
                order = np.argsort(clusters, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(clusters[order]) != 0]))
                for at, to in zip(starts, [*starts[1:], len(order)], strict=True):
                    own = order[at:to]
                    asked = asking(int(clusters[own[0]]))
                    if not len(asked):
                        continue
                    block = data[own]
                    if pruning != "adsampling" and (pruning == "none" or len(asked) > 1):
                        top.offer_block(working if probed is None else working[asked], vec_ids[own], block, "l2sq", asked)
                        continue
                    for q in asked.tolist():
                        places, distances, _ = K.pruned_l2sq(working[q], block, top.worst(q), pruning, epsilon)
                        top.offer(q, vec_ids[own[places]], distances)
            top.keys *= rescale
            yield partial_batches(ids, top)

        return postings.select("cluster_id", "vec_id", column).mapInArrow(run, PARTIAL)

    def save(self, path: str) -> VectorIndex:
        """Copy the index, with compaction of deletes, to a folder."""
        out = VectorIndex(self.spark, self.config, path, {**self.meta, "tables": {}, "has_deletes": False, "has_retired": False})
        for name in self.meta["tables"]:
            out._write(name, self._table(name).limit(0) if name == "deletes" else self.postings if name == "postings" else self._table(name))
        out._commit()
        return out


def rank(rows: np.ndarray, nprobe: int, ids: np.ndarray, centroids: np.ndarray, meso: np.ndarray, meso_ids, meso_centroids, near: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cluster ids, distances) to probe for each prepared row, nearest first. With meso clusters only those of the `near` nearest
    ones count, unless half of all clusters or more are asked for."""
    n = len(ids)
    nprobe = n if nprobe <= 0 or nprobe > n else nprobe
    distances = K.pairwise(rows, centroids, "l2sq")
    if meso_ids is not None and nprobe < n // 2:
        first = np.argsort(K.pairwise(rows, meso_centroids, "l2sq"), axis=1, kind="stable")[:, :near]
        for q, chosen in enumerate(first):
            distances[q, ~np.isin(meso, meso_ids[chosen])] = np.inf
    order = np.argsort(distances, axis=1, kind="stable")[:, :nprobe]
    return [(ids[o[np.isfinite(d[o])]], d[o[np.isfinite(d[o])]]) for o, d in zip(order, distances, strict=True)]


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index in a folder; its metadata tells the type."""
    try:
        meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta.json").collect()))
        config = IndexConfig(**meta.pop("config"))
    except (AnalysisException, json.JSONDecodeError, KeyError, TypeError) as cause:
        raise ValueError(f"no index at {path}") from cause
    return VectorIndex(spark, config, path, meta)


def _sample(prepared: DataFrame, share: float, seed: int) -> DataFrame:
    if share >= 1:
        return prepared
    return prepared.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))


def _on_driver(prepared: DataFrame, config: IndexConfig) -> np.ndarray:
    t = prepared.select("vec_id", "embedding").toArrow().combine_chunks()
    order = np.argsort(np.asarray(t.column("vec_id").combine_chunks()), kind="stable")
    return K.matrix(t.column("embedding").combine_chunks(), config.num_dimensions)[order]


def train_centroids(prepared: DataFrame, config: IndexConfig, rows: int, clusters: int) -> np.ndarray:
    """As many centroids as asked, from a sample by a hash of the id: the share of the configuration, or else at most
    train_rows_per_cluster rows a cluster; never less than two rows a cluster, if there are so many.

    A sample of up to MOST_TRAIN_BYTES is clustered on the driver, with many rows first coarsely and then cell by cell. A larger one
    stays on the cluster: only the coarse centroids are trained on the driver, and each cell in a task of its own.
    """
    at_once = max(1, MOST_TRAIN_BYTES // (4 * config.num_dimensions))
    wanted = rows * config.sampling if config.sampling else min(rows * auto_sampling(rows), config.train_rows_per_cluster * clusters)
    wanted = min(rows, max(wanted, 2.2 * clusters))
    if wanted > at_once:
        return _train_in_cells(prepared, config, rows, clusters, wanted, at_once)
    data = _on_driver(_sample(prepared, wanted / rows, config.seed), config)
    if len(data) < clusters:  # as few as that differ from what is expected by chance only
        data = _on_driver(prepared, config)
    if config.hierarchical and len(data) >= 30_720 and clusters > 64:
        coarse = K.kmeans(data, math.isqrt(clusters), 3, config.seed, config.normalizes)
        label, _ = K.nearest(data, coarse)
        parts = allot(np.bincount(label, minlength=len(coarse)), clusters)
        return np.concatenate([K.kmeans(data[label == i], int(n), 5, config.seed + i, config.normalizes) for i, n in enumerate(parts) if n])
    return K.kmeans(data, clusters, config.kmeans_iters, config.seed, config.normalizes)


def allot(sizes: np.ndarray, total: int) -> np.ndarray:
    """total split over cells in proportion to their sizes: one at least to each that has rows, to none more than it has rows.
    The sizes add to total at least."""
    sizes = np.asarray(sizes, np.int64)
    out = np.minimum(sizes, np.maximum(sizes > 0, np.floor(sizes / sizes.sum() * total).astype(np.int64)))
    while (left := total - out.sum()) != 0:
        owed = sizes / sizes.sum() * total - out
        able = np.flatnonzero(out < sizes) if left > 0 else np.flatnonzero(out > 1)
        if not len(able):  # more cells than centroids
            able = np.flatnonzero(out)
        able = able[np.argsort(-owed[able] if left > 0 else owed[able], kind="stable")][: abs(left)]
        out[able] += 1 if left > 0 else -1
    return out


def _train_in_cells(prepared: DataFrame, config: IndexConfig, rows: int, clusters: int, wanted: float, at_once: int) -> np.ndarray:
    cells = max(1, min(math.isqrt(clusters), at_once // 2))
    coarse = K.kmeans(_on_driver(_sample(prepared, min(1.0, at_once / 2 / rows), config.seed + 1), config), cells, config.kmeans_iters, config.seed, config.normalizes)
    placed = cut(assign(_sample(prepared, wanted / rows, config.seed), np.arange(len(coarse)), coarse), "cells")
    sizes = np.zeros(len(coarse), np.int64)
    for r in placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        sizes[r["cluster_id"]] = r["n"]
    parts = allot(sizes, clusters)
    # a cell's task has a bounded number of rows: as many as the driver took, or some for each centroid
    shares = [float(min(1.0, max(at_once / 8, 4 * n + 50) / max(1, size))) for n, size in zip(parts, sizes, strict=True)]
    plan = prepared.sparkSession.createDataFrame([(i, int(n), x) for i, (n, x) in enumerate(zip(parts, shares, strict=True))], "cluster_id long, k int, share double")
    seed, angular = config.seed, config.normalizes

    def fit(key, cell):
        cell = cell.sort_values("vec_id")
        data = np.stack(cell["embedding"].to_numpy()).astype(np.float32)
        found = K.kmeans(data, int(cell["k"].iloc[0]), 5, seed + int(key[0]), angular)
        return pd.DataFrame({"cluster_id": int(key[0]), "at": range(len(found)), "centroid": [c.tolist() for c in found]})

    chosen = placed.join(F.broadcast(plan), "cluster_id").filter(F.pmod(F.xxhash64("vec_id", F.lit(seed + 2)), F.lit(1 << 40)) < F.ceil(F.col("share") * (1 << 40)))
    made = chosen.filter("k > 0").groupBy("cluster_id").applyInPandas(fit, "cluster_id long, at int, centroid array<float>")
    t = made.orderBy("cluster_id", "at").toArrow().combine_chunks()  # the centroids, which a search holds on the driver, too
    free(placed)
    if t.num_rows != clusters:
        raise RuntimeError(f"{t.num_rows} centroids instead of {clusters}: a larger sampling is needed")
    return K.matrix(t.column("centroid").combine_chunks(), config.num_dimensions)


def assign(prepared: DataFrame, ids: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """cluster_id, vec_id, embedding: each row with its nearest centroid; one Arrow pass with broadcast centroids."""
    sent = prepared.sparkSession.sparkContext.broadcast((ids, centroids))
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centroids = sent.value
        for b in batches:
            place, _ = K.nearest(K.matrix(b.column(1), d), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[place]), b.column(0), b.column(1)], names=["cluster_id", "vec_id", "embedding"])

    return prepared.select("vec_id", "embedding").mapInArrow(run, "cluster_id long, vec_id long, embedding array<float>")


def encode(rows: DataFrame, quantizer: Quantizer | None) -> DataFrame:
    """Postings as stored: floats, or codes."""
    if quantizer is None:
        return rows.select("cluster_id", "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = K.quantize(K.matrix(b.column(2)), quantizer.base, quantizer.scale).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), K.lists(codes, pa.int16())], names=["cluster_id", "vec_id", "code"])

    return rows.select("cluster_id", "vec_id", "embedding").mapInArrow(run, "cluster_id long, vec_id long, code array<smallint>")


def centroid_frame(spark: SparkSession, ids, meso, centroids: np.ndarray, made_with) -> DataFrame:
    columns = {"cluster_id": ids, "meso_id": meso, "centroid": np.asarray(centroids), "made_with": made_with}
    return spark.createDataFrame(pa.table({k: K.lists(v, pa.float64()) if k == "centroid" else pa.array([int(x) for x in v], pa.int64()) for k, v in columns.items()}))


def meso_frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"meso_id": pa.array(range(len(centroids)), pa.int64()), "centroid": K.lists(np.asarray(centroids), pa.float64())}))


def group_centroids(centroids: np.ndarray, config: IndexConfig, groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(meso centroids, meso id of each centroid): a second k-means, over the centroids."""
    groups = min(groups or config.num_meso_clusters or auto_meso_clusters(len(centroids)), len(centroids))
    meso = K.kmeans(centroids, groups, 10, config.seed, config.normalizes)
    return meso, K.nearest(centroids, meso)[0]


def cluster_means(rows: DataFrame) -> DataFrame:
    """(cluster_id, n, mean) of rows(cluster_id, embedding), in double: partial sums in one Arrow pass, then one small aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            clusters, data = np.asarray(b.column(0)), K.matrix(b.column(1))
            for c in np.unique(clusters).tolist():
                own = data[clusters == c].astype(np.float64)
                sums[c] = sums.get(c, 0.0) + own.sum(axis=0)
                counts[c] = counts.get(c, 0) + len(own)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(counts.values()), pa.int64()), K.lists(np.stack(list(sums.values())), pa.float64())], names=["cluster_id", "n", "sums"])

    parts = rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), "embedding").mapInArrow(run, "cluster_id long, n long, sums array<double>")
    means = parts.select("cluster_id", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("m"))
    return means.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def build(vectors: DataFrame, config: IndexConfig, path: str | None = None, centroids: np.ndarray | None = None) -> VectorIndex:
    """Index vectors(vec_id, embedding); ids are any distinct longs. path: a folder on a shared store. centroids, in the prepared
    space, are taken as they are; else they are trained."""
    spark = vectors.sparkSession
    check_vectors(vectors, config.num_dimensions)
    path = path or scratch_path(spark, "index")
    rows = vectors.count()
    if rows == 0:
        raise ValueError("no vectors to index")
    clusters = config.clusters_for(rows)
    # normalised and rotated once; training, quantisation and postings read this
    prepared = cut(prepare(vectors, config), "prepared")
    quantizer = Quantizer.fit(prepared) if config.quantized else None
    if centroids is None:
        centroids = train_centroids(prepared, config, rows, clusters)
    ids = np.arange(len(centroids))
    index = VectorIndex(spark, config, path, {"tables": {}, "gen": 0, "applied": {}, "has_deletes": False, "has_retired": False, "next_cluster": len(ids), "quantizer": [quantizer.base, quantizer.scale] if quantizer else None})
    placed = encode(assign(prepared, ids, centroids), quantizer).withColumn("gen", F.lit(0).cast("long"))
    index._write("postings", placed.repartitionByRange("cluster_id", "vec_id").sortWithinPartitions("cluster_id", "vec_id"))
    free(prepared)
    sizes = {r["cluster_id"]: r["n"] for r in index._table("postings").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    meso_of = np.zeros(len(ids), np.int64)
    if config.tree:
        meso, meso_of = group_centroids(centroids, config)
        index._write("meso", meso_frame(spark, meso))
    index._write("centroids", centroid_frame(spark, ids, meso_of, centroids, [sizes.get(int(i), 0) for i in ids]))
    index._write("deletes", spark.createDataFrame([], "vec_id long, gen long"))
    index._commit()
    return index


class _Facade:
    """An index of one type behind a small object: build, search, append, delete, save."""

    index_type = ""

    def __init__(self, spark: SparkSession, num_dimensions: int, **options):
        self.spark = spark
        self.config = IndexConfig(num_dimensions=num_dimensions, index_type=self.index_type, **options)
        self.index: VectorIndex | None = None
        self.nprobe = 32

    def set_nprobe(self, nprobe: int) -> None:
        """Clusters that a search probes where it doesn't say; 0: all."""
        self.nprobe = nprobe

    def get_cluster_size(self, cluster_id: int) -> int:
        return self._built().cluster_row_ids(cluster_id).count()

    def get_cluster_row_ids(self, cluster_id: int) -> DataFrame:
        return self._built().cluster_row_ids(cluster_id)

    def build(self, data: DataFrame, path: str | None = None):
        self.index = build(data, self.config, path)
        return self

    def _built(self) -> VectorIndex:
        if self.index is None:
            raise ValueError("build the index first")
        return self.index

    def search(self, queries: DataFrame, knn: int, nprobe: int | None = None) -> DataFrame:
        return self._built().search(queries, knn, self.nprobe if nprobe is None else nprobe)

    def filtered_search(self, queries: DataFrame, knn: int, row_ids: DataFrame, nprobe: int | None = None) -> DataFrame:
        return self._built().filtered_search(queries, knn, row_ids, self.nprobe if nprobe is None else nprobe)

    def append(self, rows: DataFrame) -> None:
        from nearfield.operators import maintain

        maintain.append(self._built(), rows)

    def delete(self, row_ids: DataFrame) -> None:
        from nearfield.operators import maintain

        maintain.delete(self._built(), row_ids)

    def save(self, path: str) -> VectorIndex:
        return self._built().save(path)

    @property
    def num_dimensions(self) -> int:
        return self.config.num_dimensions

    @property
    def num_clusters(self) -> int:
        return self._built().num_clusters

    @property
    def size_bytes(self) -> int:
        return self._built().size_bytes


class IndexIvf(_Facade):
    index_type = "ivf_f32"


class IndexIvfSq8(_Facade):
    index_type = "ivf_u8"


class IndexIvfTree(_Facade):
    index_type = "tree_f32"


class IndexIvfTreeSq8(_Facade):
    index_type = "tree_u8"


def with_options(config: IndexConfig, **options) -> IndexConfig:
    return replace(config, **options)
