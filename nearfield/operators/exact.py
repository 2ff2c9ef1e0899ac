"""Exact k nearest neighbours, by scan.

knn() is the fast path: queries are taken in blocks of a fixed number of bytes, each block is broadcast, every partition of
the vectors is scanned once a block with one matrix product an Arrow batch, and at most k rows a query leave a partition.
knn_sql() is the same in built-in functions, by packed codes first. Ties are broken by vec_id; ranks start at 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions import kernels as K
from nearfield.plans.scratch import setting

QUERY_BLOCK_BYTES = 32 << 20
PARTIAL = "query_id long, vec_id long, distance double"
METRICS = ("l2sq", "cosine", "ip", "l1")
BOUND_SHARE = 4
#: The greatest of the least keys of {0} buckets, or no bound where a bucket is empty.
_BOUND = "CASE WHEN count(*) = {0} THEN max(m) ELSE double('Infinity') END"


def _check(k: int, metric: str) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def query_blocks(queries: DataFrame, dimensions: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of queries(query_id, embedding), block by block; at most one block is on the driver. With `dimensions`,
    queries that are no vectors of that width are a ValueError."""
    bad = F.lit(False) if dimensions is None else ~F.coalesce(D.valid(F.col("embedding"), dimensions), F.lit(False))
    width, total, bad = queries.agg(F.max(F.size("embedding")), F.count(F.lit(1)), F.max(bad)).first()
    if bad:
        raise ValueError(f"vectors must have {dimensions} components, none of them null or NaN")
    if not width:
        return
    most = max(1, QUERY_BLOCK_BYTES // (8 * width))
    parts = -(-total // most)
    chosen = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_part"))
    for i in range(parts):
        block = (chosen.filter(F.col("_part") == i) if parts > 1 else queries).select("query_id", "embedding").toArrow().combine_chunks()
        if block.num_rows:
            ids = np.asarray(block.column("query_id").combine_chunks()).astype(np.int64)
            rows = K.matrix(block.column("embedding").combine_chunks(), width)
            order = np.argsort(ids, kind="stable")
            yield ids[order], rows[order]


def partial_batches(ids: np.ndarray, top: K.TopK) -> pa.RecordBatch:
    q, v, d = top.arrays()
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[q]), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "distance"])


def top_k(partial: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """The k best of each query with their rank: a window that Spark limits before its shuffle."""
    order = F.desc("distance") if descending else F.asc_nulls_last("distance")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", where: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance. queries(query_id, embedding), vectors(vec_id, embedding); `where` filters vectors
    before the distance and reaches the scan."""
    _check(k, metric)
    if where is not None:
        vectors = vectors.filter(where)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    spark, parts = queries.sparkSession, []
    for ids, rows in query_blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")):
        sent = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, rows = sent.value
            top = K.TopK(len(ids), k, metric == "ip")
            for b in batches:
                if b.num_rows:
                    top.offer_block(rows, np.asarray(b.column(0)), K.matrix(b.column(1), rows.shape[1]), metric)
            yield partial_batches(ids, top)

        parts.append(vectors.mapInArrow(run, PARTIAL))
    if not parts:
        return top_k(spark.createDataFrame([], PARTIAL), k)
    return top_k(reduce(DataFrame.union, parts), k, metric == "ip")


def _limits(vectors: DataFrame, k: int) -> tuple[int, int]:
    """(width of the vectors, share): each share-th vector bounds a search, or all where they are few."""
    width, rows = vectors.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    return width or 0, max(1, min(BOUND_SHARE, rows // (32 * k)))


def _dealt(spark: SparkSession) -> int:
    """Parts to deal vectors over that are compared with many queries; the files may have few."""
    return 4 * max(1, spark.sparkContext.defaultParallelism)


def _plain_pairs(queries: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    pairs = vectors.select("vec_id", F.col("embedding").alias("_v")).join(queries.select("query_id", F.col("embedding").alias("_q")))
    return pairs.select("query_id", "vec_id", D.DISTANCES[metric](F.col("_q"), F.col("_v")).alias("distance"))


def _near_pairs(queries: DataFrame, vectors: DataFrame, k: int, width: int, share: int, low: float, step: float) -> DataFrame:
    """The pairs of ordinary vectors with their squared L2, without those that are surely not among a query's k.

    All pairs are compared as packed codes, in one short compiled loop. Each share-th vector is dealt over k buckets; the greatest of
    the buckets' least distances is one that k vectors don't exceed. A distance differs from that of codes by how far the two vectors
    are from theirs at most, so no neighbour is lost whatever `low` and `step` are."""
    spark = queries.sparkSession
    parts = _dealt(spark)

    def coded(df: DataFrame, key: str, side: str) -> DataFrame:
        codes, columns = D.packed_text(side, width, low, step, side == "q")
        names = [*(f"{side}{i}" for i in range(len(columns) - 2)), f"{side}_squares", f"{side}_off"]
        df = df.selectExpr(key, f"embedding AS {side}").selectExpr("*", f"{codes} AS codes")
        return df.selectExpr(key, side, *(f"{c} AS {n}" for c, n in zip(columns, names, strict=True)))

    every = coded(vectors.repartition(parts), "vec_id", "e")
    some = coded(vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).repartition(parts), "vec_id", "e")
    some = some.withColumn("bucket", F.expr(f"pmod(xxhash64(vec_id) div {share}, {k})"))
    blocks = max(1, -(-queries.count() * 8 * width // QUERY_BLOCK_BYTES))
    made = []
    far = D.packed_l2sq_text(width)
    # what overflows is meant to: see packed_text(); an expression keeps the mode in which it was made
    with setting(spark, "spark.sql.ansi.enabled", "false"):
        for i in range(blocks):
            block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
            asked = coded(block, "query_id", "q")
            near = some.join(F.broadcast(asked)).groupBy("query_id", "bucket").agg(F.expr(f"min(sqrt({far}) + e_off)").alias("m"))
            bounds = near.groupBy(F.col("query_id").alias("_id")).agg(F.expr(_BOUND.format(k)).alias("bound"))
            asked = asked.join(bounds, F.col("query_id").eqNullSafe(F.col("_id")), "left").drop("_id")
            asked = asked.selectExpr("*", "coalesce(bound, double('Infinity')) + 2 * q_off AS reach")
            pairs = every.join(F.broadcast(asked), F.expr(f"{far} <= (reach + e_off) * (reach + e_off)"))
            made.append(pairs.select("query_id", "vec_id", D.l2sq(F.col("q"), F.col("e")).alias("distance")))
    return reduce(DataFrame.union, made)


def knn_sql(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", where: Column | None = None) -> DataFrame:
    """knn() as a nested-loop join with built-in functions. For l2sq, queries are broadcast in blocks, all pairs are compared as codes,
    and distances are computed and ranked of those within a bound: work grows with queries times vectors, memory and shuffles don't.
    Vectors with null, NaN or huge components, of another width than the widest or of over D.UNROLLED components, and other
    metrics are compared pair by pair."""
    _check(k, metric)
    if where is not None:
        vectors = vectors.filter(where)
    queries, vectors = queries.select("query_id", "embedding"), vectors.select("vec_id", "embedding")
    if metric != "l2sq":
        return top_k(_plain_pairs(queries, vectors, metric), k, metric == "ip")
    good = ~F.exists("embedding", lambda x: ~F.coalesce(F.abs(x.cast("double")) < 1e100, F.lit(False)))
    total = lambda f: F.sum(F.when(good, F.aggregate("embedding", F.lit(0.0), lambda t, x: t + f(x.cast("double")))))
    facts = [F.max(F.size("embedding")), F.min(F.coalesce(F.size("embedding"), F.lit(-1))), F.min(F.coalesce(good, F.lit(False)))]
    asked_width, asked_least, asked_good = queries.agg(*facts).first()
    width, least, all_good, rows, sum_of, squares = vectors.agg(*facts, F.count(F.lit(1)), total(lambda x: x), total(lambda x: x * x)).first()
    width = max(width or 0, asked_width or 0)
    if not 0 < width <= D.UNROLLED:
        return top_k(_plain_pairs(queries, vectors, metric), k)
    mean = (sum_of or 0.0) / (rows * width or 1)
    spread = max(0.0, (squares or 0.0) / (rows * width or 1) - mean * mean) ** 0.5
    # vectors for the bound, and pairs within it, are about the root of rows * k for each query
    share = max(1, math.isqrt(rows // (50 * k)))
    # the codes span the mean and four deviations on either side
    known = width, share, mean - 4 * spread, 8 * spread / D.most_code(width) or 1.0
    if all_good and asked_good and least == asked_least == width:
        return top_k(_near_pairs(queries, vectors, k, *known), k)
    good = F.coalesce((F.size("embedding") == width) & good, F.lit(False))
    pairs = _near_pairs(queries.filter(good), vectors.filter(good), k, *known)
    pairs = pairs.union(_plain_pairs(queries.filter(good), vectors.filter(~good), metric)).union(_plain_pairs(queries.filter(~good), vectors, metric))
    return top_k(pairs, k)


def register_knn(spark: SparkSession, name: str, view: str, k: int, metric: str = "l2sq") -> None:
    """A table function for SQL: name(query) gives rank, vec_id, distance of the k nearest of view(vec_id, embedding), also as
    `FROM queries q, LATERAL name(q.embedding)`: the distinct queries are broadcast.

    Pairs are neither sorted nor shuffled: a share of the vectors is dealt over k buckets, and the greatest of the buckets' least
    distances is one that k vectors don't exceed; of all pairs those within it are ranked. The width of the vectors is that of
    the view now; a vector whose distance is null or NaN is no neighbour."""
    _check(k, metric)
    D.register(spark)
    vectors = spark.table(view)
    width, share = _limits(vectors, k)
    least, most = D.key_text(metric, width)
    # a string, as arrays of numbers are costly keys, and a query is the key of its pairs
    q = f"SELECT *, {', '.join(D.parts_text('query', 'q', width))} FROM (SELECT from_json(code, 'ARRAY<DOUBLE>') AS query)"
    v = f"SELECT *, {', '.join(D.parts_text('embedding', 'e', width))} FROM (SELECT /*+ REPARTITION({_dealt(spark)}) */ CAST(vec_id AS BIGINT) AS vec_id, embedding FROM {view})"
    some = f"SELECT *, pmod(xxhash64(vec_id) div {share}, {k}) AS bucket FROM ({v}) WHERE pmod(xxhash64(vec_id), {share}) = 0"
    near = f"SELECT /*+ BROADCAST(q) */ min({most}) AS m FROM ({q}) q CROSS JOIN ({some}) v GROUP BY bucket"
    asked = f"SELECT * FROM ({q}) CROSS JOIN (SELECT {_BOUND.format(k)} AS bound FROM ({near}))"
    pairs = f"SELECT /*+ BROADCAST(q) */ vec_id, {D.distance_text(metric, 'query', 'embedding')} AS distance FROM ({asked}) q CROSS JOIN ({v}) v WHERE {least} <= bound"
    order = "distance DESC" if metric == "ip" else "distance"
    ranked = f"SELECT *, row_number() OVER (ORDER BY {order}, vec_id) AS rank FROM ({pairs}) WHERE distance <= double('Infinity')"
    found = f"SELECT rank, vec_id, distance FROM ({ranked}) WHERE rank <= {int(k)}"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>) RETURNS TABLE(rank INT, vec_id BIGINT, distance DOUBLE) "
        f"RETURN SELECT n.rank, n.vec_id, n.distance FROM (SELECT CAST(query AS STRING) AS code) c, LATERAL ({found}) n"
    )


def knn_view(spark: SparkSession, name: str, queries: str, vectors: str, k: int, metric: str = "l2sq") -> None:
    """The result of knn() over the views queries(query_id, embedding) and vectors(vec_id, embedding) as a view for SQL."""
    knn(spark.table(queries), spark.table(vectors), k, metric).createOrReplaceTempView(name)


def within(queries: DataFrame, vectors: DataFrame, radius: float, metric: str = "l2sq") -> DataFrame:
    """All (query_id, vec_id, distance) with distance below the radius."""
    spark, parts = queries.sparkSession, []
    if metric not in ("l2sq", "cosine", "l1"):
        raise ValueError("within() needs a distance")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    for ids, rows in query_blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")):
        sent = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, rows = sent.value
            for b in batches:
                x = K.matrix(b.column(1), rows.shape[1])
                # as many queries at once as give BLOCK_BYTES of distances
                step = max(1, K.BLOCK_BYTES // (8 * max(1, len(x))))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    q, v = np.nonzero(K.pairwise(some, x, metric) <= radius + 1e-6)
                    if not len(q):
                        continue
                    edges = np.flatnonzero(np.diff(q, prepend=-1, append=len(rows)))
                    exact = np.concatenate([K.exact_pairs(some[q[i]], x[v[i:j]], metric) for i, j in zip(edges[:-1], edges[1:], strict=True)])
                    good = exact < radius
                    vec = np.asarray(b.column(0))[v]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + q[good]]), pa.array(vec[good]), pa.array(exact[good])], names=["query_id", "vec_id", "distance"])

        parts.append(vectors.mapInArrow(run, PARTIAL))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], PARTIAL)
