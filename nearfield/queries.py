"""Queries over the tables of a data folder, one for each operator, and DuckDB SQL for those that SQL can express.

Queries of a search are the vectors whose id is divisible by 50; all rows are searched. Where clustering depends on a seed,
the index is checked by invariants in the tests and by recall columns here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions import kernels
from nearfield.operators import evaluate, exact, maintain
from nearfield.operators import index as index_of
from nearfield.operators.index import IndexConfig, VectorIndex, build, load_index
from nearfield.operators.prepare import Quantizer, prepare
from nearfield.plans import config as C
from nearfield.plans.scratch import cut, scratch_path
from nearfield.sources import vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
K = 10
DIMS = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _scaled(vectors: DataFrame) -> DataFrame:
    """The same directions with lengths of 1 to 7, so that metrics differ."""
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 7).cast("float")))


_L2 = "list_sum(list_transform(range(1, 65), lambda i: pow(q[i]::DOUBLE - v[i]::DOUBLE, 2)))"
_IP = "list_sum(list_transform(range(1, 65), lambda i: q[i]::DOUBLE * v[i]::DOUBLE))"
_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(q[i]::DOUBLE - v[i]::DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
_COS = f"CASE WHEN {_NORM.format('q')} * {_NORM.format('v')} = 0 THEN 1.0 ELSE greatest(0.0::DOUBLE, 1 - {_IP} / ({_NORM.format('q')} * {_NORM.format('v')})) END"
_SCALED = "SELECT vec_id, list_transform(embedding, lambda x: x * (1 + vec_id % 7)::FLOAT) AS embedding, label FROM embeddings"


def _knn_sql(distance: str, where: str = "true", order: str = "ASC", source: str = "embeddings", k: int = K, pairs: str = "true") -> str:
    return f"""
WITH s AS (SELECT * FROM ({source if source.startswith("SELECT") else "SELECT * FROM " + source})),
d AS (SELECT a.vec_id AS query_id, b.vec_id, {distance} AS distance
  FROM (SELECT vec_id, embedding AS q FROM s WHERE vec_id % 50 = 0) a, (SELECT vec_id, label, embedding AS v FROM s) b WHERE ({where}) AND ({pairs}))
SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, vec_id) AS rank FROM d) WHERE rank <= {k}"""


# --- exact search ---------------------------------------------------------------------------------------------------


@query(_knn_sql(_L2))
def knn_l2_exact(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K))


@query(_knn_sql(_L2))
def knn_l2_builtin(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn_sql(_asked(v), v, K))


@query(_knn_sql(_COS))
def knn_cosine_exact(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, "cosine"))


@query(_knn_sql(_IP, order="DESC"))
def knn_ip_exact(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, "ip"))


@query(_knn_sql(_L1))
def knn_l1_exact(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, "l1"))


@query(_knn_sql(_L2, source=_SCALED))
def knn_unnormalized_l2(spark, d):
    v = _scaled(_vectors(spark, d))
    return _shown(exact.knn(_asked(v), v, K))


@query(_knn_sql(_IP, order="DESC", source=_SCALED))
def knn_unnormalized_ip(spark, d):
    v = _scaled(_vectors(spark, d))
    return _shown(exact.knn(_asked(v), v, K, "ip"))


@query(_knn_sql(_COS, source=_SCALED))
def knn_unnormalized_cosine(spark, d):
    v = _scaled(_vectors(spark, d))
    return _shown(exact.knn(_asked(v), v, K, "cosine"))


@query(_knn_sql(_L2, "label = 3"))
def knn_filtered_label(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, where=F.col("label") == 3))


@query(_knn_sql(_L2, "b.vec_id % 2 = 0"))
def knn_filtered_half(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, where=F.col("vec_id") % 2 == 0))


@query(_knn_sql(_L2, "b.vec_id = 7"))
def knn_filtered_single(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, where=F.col("vec_id") == 7))


@query(_knn_sql(_L2, "b.vec_id < 20", k=30))
def knn_filtered_tiny(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, 30, where=F.col("vec_id") < 20))


@query(_knn_sql(_L2, "b.vec_id IN (SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':1'), vec_id LIMIT 100)"))
def knn_filtered_sample(spark, d):
    """Among 100 vectors drawn uniformly."""
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v.join(F.broadcast(vectors.sample_ids(v, 100, 1)), "vec_id", "left_semi"), K))


@query(_knn_sql(_L2))
def knn_lateral_sql(spark, d):
    """Asked in SQL, by a lateral join with a table function."""
    _vectors(spark, d).createOrReplaceTempView("nearfield_vectors")
    exact.register_knn(spark, "nearfield_knn", "nearfield_vectors", K)
    found = spark.sql("SELECT q.vec_id AS query_id, n.* FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding FROM nearfield_vectors WHERE vec_id % 50 = 0) q, LATERAL nearfield_knn(q.embedding) n")
    return _shown(found)


@query(_knn_sql(_COS))
def knn_view_sql(spark, d):
    """Asked in SQL, of a view over the block scan."""
    v = _vectors(spark, d)
    v.createOrReplaceTempView("nearfield_vectors")
    _asked(v).createOrReplaceTempView("nearfield_asked")
    exact.knn_view(spark, "nearfield_found", "nearfield_asked", "nearfield_vectors", K, "cosine")
    return _shown(spark.sql("SELECT * FROM nearfield_found"))


@query(_knn_sql(_L2, "false"))
def knn_filtered_empty(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K, where=F.lit(False)))


@query(_knn_sql(_L2, pairs="b.vec_id <> a.vec_id"))
def knn_exclude_self(spark, d):
    v = _vectors(spark, d)
    found = exact.knn(_asked(v), v, K + 1).filter("vec_id <> query_id")
    return _shown(exact.top_k(found.drop("rank"), K))


@query(_knn_sql(_L2, "b.vec_id < 5", k=100))
def knn_k_gt_n(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v.filter("vec_id < 5"), 100))


@query(
    f"""SELECT a.vec_id AS query_id, b.vec_id, round({_L2}, 6) AS distance
FROM (SELECT vec_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, embedding AS v FROM embeddings) b WHERE {_L2} < 1.4"""
)
def range_search(spark, d):
    v = _vectors(spark, d)
    return exact.within(_asked(v), v, 1.4).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, rank, vec_id, label, distance FROM ({_knn_sql(_L2)}) JOIN embeddings USING (vec_id)")
def knn_join_label(spark, d):
    v = _vectors(spark, d)
    return _shown(exact.knn(_asked(v), v, K)).join(v.select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "label", "distance")


# --- projections ----------------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round({_NORM.format('embedding')}, 6) AS norm FROM ({_SCALED})")
def vector_norms(spark, d):
    return _scaled(_vectors(spark, d)).select("vec_id", F.round(D.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT vec_id, i::INT AS dim, round(embedding[i + 1]::DOUBLE / n, 6) AS value FROM (SELECT *, {_NORM.format('embedding')} AS n, unnest(range(64)) AS i FROM ({_SCALED}))")
def normalize_vectors(spark, d):
    unit = D.normalize(F.col("embedding"))
    return _scaled(_vectors(spark, d)).select("vec_id", F.posexplode(unit).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("value"))


_QUANT = "SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings"


@query(f"SELECT round(lo, 6) AS base, round(255.0 / (hi - lo), 6) AS scale FROM ({_QUANT})")
def quant_params(spark, d):
    v = _vectors(spark, d)
    lo, hi = F.min(F.array_min("embedding")).cast("double"), F.max(F.array_max("embedding")).cast("double")
    return v.agg(F.round(lo, 6).alias("base"), F.round(255.0 / (hi - lo), 6).alias("scale"))


_CODES = f"SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, round((x::DOUBLE - lo) * (255.0::DOUBLE / (hi - lo)))))::INT) AS code FROM embeddings, ({_QUANT})"


@query(f"SELECT vec_id, i::INT AS dim, code[i + 1]::SMALLINT AS code FROM (SELECT *, unnest(range(64)) AS i FROM ({_CODES}))")
def quantize_codes(spark, d):
    v = _vectors(spark, d)
    q = Quantizer.fit(v)
    return v.select("vec_id", F.posexplode(D.quantize(F.col("embedding"), q.base, q.scale)).alias("dim", "code"))


@query(f"SELECT c.vec_id, round(max(abs(code[i + 1] * (hi - lo) / 255.0::DOUBLE + lo - embedding[i + 1]::DOUBLE)), 6) AS worst FROM (SELECT *, unnest(range(64)) AS i FROM ({_CODES})) c JOIN embeddings USING (vec_id), ({_QUANT}) GROUP BY 1")
def dequantize_error(spark, d):
    v = _vectors(spark, d)
    q = Quantizer.fit(v)
    back = D.dequantize(D.quantize(F.col("embedding"), q.base, q.scale), q.base, q.scale)
    return v.select("vec_id", F.round(F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double")))), 6).alias("worst"))


@query(
    f"""WITH c AS ({_CODES}), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: (a.code[i] - b.code[i]) * (a.code[i] - b.code[i])))::BIGINT AS distance
FROM c a, c b WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10"""
)
def knn_u8_exact(spark, d):
    v = _vectors(spark, d)
    codes = _codes(v)
    return exact.knn(_asked(codes), codes, K).withColumn("distance", F.col("distance").cast("long"))


_L2_16 = _L2.replace("range(1, 65)", "range(1, 17)")


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({_L2_16}, 6) AS partial FROM (SELECT vec_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, embedding AS v FROM embeddings) b")
def partial_l2_prefix(spark, d):
    """The distance over the first 16 dimensions of each query and every vector."""
    # component by component, which is compiled; the same sum as D.partial_l2sq(), null where a component is
    v = _vectors(spark, d).select(F.col("vec_id").cast("long").alias("vec_id"), F.slice("embedding", 1, 16).alias("embedding"))
    v = v.repartition(4 * spark.sparkContext.defaultParallelism)
    whole = "size({0}) = 16 AND NOT exists({0}, x -> x IS NULL) AS {1}_whole"
    v = v.selectExpr("vec_id", whole.format("embedding", "e"), *D.parts_text("embedding", "e", 16)[:-1])
    total = " + ".join(f"(q{i} - e{i}) * (q{i} - e{i})" for i in range(16))
    # to 6 places; round() would go by way of decimal numbers
    near = "(rint(x * 1e6D) + CASE WHEN x * 1e6D - rint(x * 1e6D) = 0.5D THEN 1D ELSE 0D END) / 1e6D"
    out = spark.createDataFrame([], "query_id long, vec_id long, partial double")
    for ids, rows in exact.query_blocks(_asked(_vectors(spark, d))):
        block = spark.createDataFrame(pa.table({"query_id": pa.array(ids), "embedding": kernels.lists(rows, pa.float32())}))
        block = block.withColumn("query", F.slice("embedding", 1, 16)).selectExpr("query_id", whole.format("query", "q"), *D.parts_text("query", "q", 16)[:-1])
        pairs = v.join(F.broadcast(block)).selectExpr("query_id", "vec_id", f"CASE WHEN q_whole AND e_whole THEN {total} END AS x")
        out = out.union(pairs.selectExpr("query_id", "vec_id", f"{near} AS partial"))
    return out


partial_l2_prefix_all = partial_l2_prefix


def _u8_knn(distance: str, order: str, dims: int = 64) -> str:
    return f"""WITH c AS ({_CODES}), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, {dims + 1}), lambda i: {distance}))::BIGINT AS distance
FROM c a, c b WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, vec_id) AS rank FROM p) WHERE rank <= 10"""


def _codes(v: DataFrame, dims: int = 64) -> DataFrame:
    q = Quantizer.fit(v)
    return v.withColumn("embedding", F.slice(D.quantize(F.col("embedding"), q.base, q.scale), 1, dims))


@query(_u8_knn("a.code[i] * b.code[i]", "DESC"))
def knn_u8_ip(spark, d):
    codes = _codes(_vectors(spark, d))
    return exact.knn(_asked(codes), codes, K, "ip").withColumn("distance", F.col("distance").cast("long"))


@query(_u8_knn("(a.code[i] - b.code[i]) * (a.code[i] - b.code[i])", "ASC", 16))
def knn_u8_partial(spark, d):
    codes = _codes(_vectors(spark, d), 16)
    return exact.knn(_asked(codes), codes, K).withColumn("distance", F.col("distance").cast("long"))


@query(_knn_sql(_L2_16))
def knn_partial_prefix(spark, d):
    v = _vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 16))
    return _shown(exact.knn(_asked(v), v, K))


@query("SELECT vec_id, i::INT AS dim, (CASE WHEN i % 3 = 0 THEN -1 ELSE 1 END * embedding[i + 1])::FLOAT AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)")
def flip_signs(spark, d):
    signs = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.when(i % 3 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)).cast("float"))
    return _vectors(spark, d).select("vec_id", F.posexplode(D.flip_signs(F.col("embedding"), signs)).alias("dim", "value"))


#: Shares of the vectors that pass a filter.
SELECTIVITIES = (0.0001, 0.000135, 0.00015, 0.001, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS selectivity, * FROM ({_knn_sql(_L2, f'b.vec_id * 7919 % 1000000 < {round(p * 1000000)}')})" for p in SELECTIVITIES))
def knn_selectivities(spark, d):
    v = _vectors(spark, d)
    parts = [_shown(exact.knn(_asked(v), v, K, where=F.col("vec_id") * 7919 % 1000000 < round(p * 1000000))).withColumn("selectivity", F.lit(p)) for p in SELECTIVITIES]
    return reduce(DataFrame.union, parts)


@query(_knn_sql(_L2))
def results_as_csv(spark, d):
    v = _vectors(spark, d)
    path = scratch_path(spark, "csv")
    vectors.write_results(_shown(exact.knn(_asked(v), v, K)), path)
    return spark.read.schema("query_id long, rank int, vec_id long, distance double").option("header", True).csv(path)


@query(_knn_sql(_L2))
def truth_saved_and_read(spark, d):
    v = _vectors(spark, d)
    path = scratch_path(spark, "truth")
    vectors.write_truth(_shown(exact.knn(_asked(v), v, K)), path)
    return spark.read.parquet(path)


# --- rules ----------------------------------------------------------------------------------------------------------


@query("SELECT t::INT AS t, round(CASE WHEN t = 0 OR t = 64 THEN 1.0 ELSE t / 64.0::DOUBLE * pow(1 + 1.5 / sqrt(t), 2) END, 6) AS ratio FROM range(65) r(t)")
def adsampling_ratio(spark, d):
    return spark.createDataFrame([(t, round(C.prune_ratio(t, DIMS), 6)) for t in range(DIMS + 1)], "t int, ratio double")


@query(
    """WITH d AS (SELECT d::INT AS d, CASE WHEN d <= 64 THEN 0 ELSE (floor(CASE WHEN d <= 128 THEN 0.25 * d ELSE 0.75 * d END)::INT + 32) // 64 * 64 END AS h FROM range(1, 2049) r(d))
SELECT d, (CASE WHEN h = d THEN d - 64 ELSE d - h END)::INT AS vertical, (CASE WHEN h = d THEN 64 ELSE h END)::INT AS horizontal FROM d"""
)
def dim_split(spark, d):
    return spark.createDataFrame([(n, *C.dimension_split(n)) for n in range(1, 2049)], "d int, vertical int, horizontal int")


@query("SELECT n, ceil((CASE WHEN n < 500000 THEN 2 WHEN n < 2500000 THEN 4 ELSE 8 END) * sqrt(n))::INT AS clusters FROM (SELECT unnest([1, 4, 100, 2000, 499999, 500000, 2499999, 2500000, 10000000])::BIGINT AS n)")
def num_clusters_rule(spark, d):
    sizes = (1, 4, 100, 2000, 499_999, 500_000, 2_499_999, 2_500_000, 10_000_000)
    return spark.createDataFrame([(n, C.auto_clusters(n)) for n in sizes], "n long, clusters int")


# --- clusters that SQL can make: the means of labels ---------------------------------------------------------------


_MEANS = "SELECT label AS cluster_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1"
_TO_C = "list_sum(list_transform(range(1, 65), lambda i: pow(v[i]::DOUBLE - c[i], 2)))"
_NEAREST = f"SELECT vec_id, cluster_id, dc FROM (SELECT vec_id, cluster_id, {_TO_C} AS dc FROM (SELECT vec_id, embedding AS v FROM embeddings), ({_MEANS})) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dc, cluster_id) = 1"


def _label_index(spark: SparkSession, d: str, kind: str = "ivf_f32") -> VectorIndex:
    """An index whose clusters are about the means of the labels, so that SQL knows them."""
    v = _vectors(spark, d)
    means = index_of.cluster_means(v.select(F.col("label").alias("cluster_id"), "embedding")).orderBy("cluster_id").collect()  # a row a label
    return build(v, _config(kind, rotation="none", normalize=False, meso_probe_fraction=1.0), centroids=np.array([r["mean"] for r in means]))


def _placed(index: VectorIndex) -> DataFrame:
    return index.postings.select(F.col("cluster_id").cast("int").alias("cluster_id"), "vec_id", "embedding")


@query(f"SELECT vec_id, cluster_id, round(dc, 6) AS dc FROM ({_NEAREST})")
def nearest_centroid_assign(spark, d):
    index = _label_index(spark, d)
    near = _placed(index).join(F.broadcast(index.centroids.select(F.col("cluster_id").cast("int").alias("cluster_id"), "centroid")), "cluster_id")
    return near.select("vec_id", "cluster_id", F.round(D.l2sq(F.col("embedding"), F.col("centroid")), 6).alias("dc"))


@query(f"SELECT cluster_id, count(*) AS n FROM ({_NEAREST}) GROUP BY 1")
def cluster_sizes(spark, d):
    return _label_index(spark, d).cluster_sizes().filter("n > 0").select(F.col("cluster_id").cast("int").alias("cluster_id"), "n")


_PROBES = f"SELECT query_id, cluster_id, v AS q, dc, row_number() OVER (PARTITION BY query_id ORDER BY dc, cluster_id) AS rank FROM (SELECT vec_id AS query_id, v, cluster_id, {_TO_C} AS dc FROM (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), ({_MEANS}))"


@query(f"SELECT query_id, rank::INT AS rank, cluster_id, round(dc, 6) AS dc FROM ({_PROBES}) WHERE rank <= 3")
def ivf_probe_topn(spark, d):
    found = _label_index(spark, d).probes(_asked(_vectors(spark, d)), 3)
    return found.select("query_id", "rank", F.col("cluster_id").cast("int").alias("cluster_id"), F.round("distance", 6).alias("dc"))


def _ivf_sql(where: str) -> str:
    return f"""
WITH p AS (SELECT * FROM ({_PROBES}) WHERE rank <= 3), a AS ({_NEAREST}),
m AS (SELECT query_id, vec_id, {_L2} AS distance FROM p JOIN a USING (cluster_id) JOIN (SELECT vec_id, label, embedding AS v FROM embeddings) USING (vec_id) WHERE {where})
SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM m) WHERE rank <= 10"""


@query(_ivf_sql("true"))
def ivf_search_label_centroids(spark, d):
    return _shown(_label_index(spark, d).search(_asked(_vectors(spark, d)), K, nprobe=3))


@query(_ivf_sql("true"))
def ivf_search_of_a_tree(spark, d):
    """Three probes through the meso level, of which all groups are looked at."""
    return _shown(_label_index(spark, d, "tree_f32").search(_asked(_vectors(spark, d)), K, nprobe=3, pruning="none"))


@query(_ivf_sql("true"))
def ivf_search_seeded(spark, d):
    """With a first search of the nearest cluster, whose k-th distance bounds the rest."""
    return _shown(_label_index(spark, d).search(_asked(_vectors(spark, d)), K, nprobe=3, seed=True))


@query(_ivf_sql("label = 3"))
def ivf_filtered_label_centroids(spark, d):
    v = _vectors(spark, d)
    return _shown(_label_index(spark, d).filtered_search(_asked(v), K, v.filter("label = 3").select("vec_id"), nprobe=3))


@query(
    f"""WITH a AS ({_NEAREST}), m AS (SELECT query_id, vec_id, {_L2} AS distance FROM (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), a
  JOIN (SELECT vec_id, embedding AS v FROM embeddings) USING (vec_id) WHERE cluster_id IN (query_id % 10, (query_id + 3) % 10, (query_id // 50) % 10))
SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM m) WHERE rank <= 10"""
)
def ivf_given_probes(spark, d):
    """Clusters that the caller names for each query."""
    asked = _asked(_vectors(spark, d))
    named = F.array(F.col("query_id") % 10, (F.col("query_id") + 3) % 10, F.floor(F.col("query_id") / 50) % 10)
    return _shown(_label_index(spark, d).search(asked, K, probes=asked.select("query_id", F.explode(named).alias("cluster_id"))))


_PART = f"SELECT vec_id FROM ({_NEAREST}) WHERE cluster_id = 0 UNION SELECT min(vec_id) AS vec_id FROM ({_NEAREST}) GROUP BY cluster_id"


@query(_knn_sql(_L2, f"b.vec_id IN ({_PART})"))
def ivf_filtered_by_cluster(spark, d):
    """Of the passing rows all but a few are one whole cluster; of each other cluster there is one."""
    index, v = _label_index(spark, d), _vectors(spark, d)
    return _shown(index.filtered_search(_asked(v), K, index.cluster_filter(1, one_of_others=True), nprobe=0))


@query(f"SELECT c.cluster_id::BIGINT AS cluster_id, count(query_id) AS n_accessed, 0::BIGINT AS n_inserted, 0::BIGINT AS n_deleted FROM ({_MEANS}) c LEFT JOIN (SELECT * FROM ({_PROBES}) WHERE rank <= 3) p ON p.cluster_id = c.cluster_id GROUP BY 1")
def cluster_accesses(spark, d):
    index = _label_index(spark, d)
    return index.cluster_accesses(index.probes(_asked(_vectors(spark, d)), 3))


@query(f"SELECT cluster_id, i::INT AS dim, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM (SELECT *, unnest(range(64)) AS i FROM ({_NEAREST}) JOIN embeddings USING (vec_id)) GROUP BY 1, 2")
def lloyd_one_step(spark, d):
    means = index_of.cluster_means(_placed(_label_index(spark, d)))
    return means.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.posexplode("mean").alias("dim", "x")).select("cluster_id", "dim", F.round("x", 6).alias("mean"))


@query(f"WITH f AS ({_ivf_sql('true')}), t AS ({_knn_sql(_L2)}) SELECT t.query_id, round(count(f.vec_id) / 10.0, 6) AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.vec_id = t.vec_id GROUP BY 1")
def recall_at_k(spark, d):
    v = _vectors(spark, d)
    found = evaluate.recall(_label_index(spark, d).search(_asked(v), K, nprobe=3), exact.knn(_asked(v), v, K), K)
    return found.select("query_id", F.round("recall", 6).alias("recall"))


@query(
    """WITH q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)
SELECT count(*) AS n, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events, q
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
)
def latency_iqr_mean(spark, d):
    found = evaluate.trimmed_latency(spark.read.parquet(f"{d}/events.parquet"), "value")
    return found.withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT query_id, vec_id, n FROM (SELECT vec_id % 7 AS query_id, label::BIGINT AS vec_id, count(*) AS n FROM embeddings GROUP BY 1, 2) WHERE n > 1")
def duplicate_results(spark, d):
    v = _vectors(spark, d).select((F.col("vec_id") % 7).alias("query_id"), F.col("label").cast("long").alias("vec_id"))
    return evaluate.duplicate_results(v)


# --- indexes --------------------------------------------------------------------------------------------------------


def _config(kind: str, **options) -> IndexConfig:
    return IndexConfig(num_dimensions=DIMS, index_type=kind, **options)


def _index(spark: SparkSession, d: str, kind: str = "ivf_f32", **options) -> VectorIndex:
    return build(_vectors(spark, d), _config(kind, **options))


@query(_knn_sql(_L2))
def index_exhaustive_f32(spark, d):
    """All clusters probed, no rotation: the exact result through the index."""
    return _shown(_index(spark, d, rotation="none", normalize=False).search(_asked(_vectors(spark, d)), K, nprobe=0))


@query(_knn_sql(_L2))
def index_exhaustive_tree(spark, d):
    return _shown(_index(spark, d, "tree_f32", rotation="none", normalize=False).search(_asked(_vectors(spark, d)), K, nprobe=0, pruning="none"))


@query(_knn_sql(_L2, "label = 3"))
def index_filtered_exhaustive(spark, d):
    v = _vectors(spark, d)
    return _shown(_index(spark, d, "tree_f32", rotation="none", normalize=False).filtered_search(_asked(v), K, v.filter("label = 3").select("vec_id"), nprobe=0))


@query(_knn_sql(_L2, "b.vec_id % 10 <> 3"))
def knn_after_delete(spark, d):
    v = _vectors(spark, d)
    index = _index(spark, d, "tree_f32", rotation="none", normalize=False)
    maintain.delete(index, v.filter("vec_id % 10 = 3").select("vec_id"))
    return _shown(index.search(_asked(v), K, nprobe=0))


@query(_knn_sql(_L2))
def knn_after_append(spark, d):
    v = _vectors(spark, d)
    index = build(v.filter("vec_id % 2 = 0"), _config("tree_f32", rotation="none", normalize=False))
    maintain.append(index, v.filter("vec_id % 2 = 1"))
    return _shown(index.search(_asked(v), K, nprobe=0))


@query(_knn_sql(_L2))
def index_saved_and_loaded(spark, d):
    path = scratch_path(spark, "saved")
    _index(spark, d, rotation="none", normalize=False).save(path)
    return _shown(load_index(spark, path).search(_asked(_vectors(spark, d)), K, nprobe=0))


@query("SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings")
def index_covers_all_rows(spark, d):
    return _index(spark, d, "tree_u8").postings.agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def _recalls(spark: SparkSession, d: str, kind: str, pruning: str) -> DataFrame:
    """nprobe, recall at 10 of an index for some numbers of probes."""
    v = _vectors(spark, d)
    index, asked = _index(spark, d, kind), _asked(v)
    truth = exact.knn(asked, v, K)
    rows = None
    for nprobe in (1, 4, 16, 64, 0):
        one = evaluate.recall(index.search(asked, K, nprobe, pruning=pruning), truth, K).agg(F.round(F.avg("recall"), 4).alias("recall")).select(F.lit(nprobe).alias("nprobe"), "recall")
        rows = one if rows is None else rows.union(one)
    return rows


@query()
def index_recall_f32(spark, d):
    return _recalls(spark, d, "ivf_f32", "exact")


@query()
def index_recall_u8(spark, d):
    return _recalls(spark, d, "ivf_u8", "exact")


@query()
def index_recall_tree(spark, d):
    return _recalls(spark, d, "tree_f32", "exact")


@query()
def index_recall_tree_u8(spark, d):
    return _recalls(spark, d, "tree_u8", "none")


@query()
def index_recall_adsampling(spark, d):
    return _recalls(spark, d, "ivf_f32", "adsampling")


@query(f"SELECT vec_id, round({_NORM.format('embedding')}, 4) AS before, round({_NORM.format('embedding')}, 4) AS after FROM embeddings")
def rotated_norms(spark, d):
    """Rotation keeps lengths: each vector's length before and after."""
    v = _vectors(spark, d)
    after = prepare(v, _config("ivf_f32", normalize=False, rotation="dct")).select("vec_id", F.round(D.norm(F.col("embedding")), 4).alias("after"))
    return v.select("vec_id", F.round(D.norm(F.col("embedding")), 4).alias("before")).join(after, "vec_id")


@query(f"SELECT cluster_id::BIGINT AS cluster_id, count(*) AS n, count(*) // 2 AS least, greatest(floor(count(*) * 1.3)::BIGINT, 256) AS most, 'ok' AS state FROM ({_NEAREST}) GROUP BY 1")
def index_health(spark, d):
    found = maintain.health(_label_index(spark, d, "tree_f32")).drop("meso_id")
    return found.withColumns({c: F.col(c).cast("long") for c in ("least", "most")}).filter("n > 0")


@query(_knn_sql(_L2))
def index_tree_saved_and_loaded(spark, d):
    path = scratch_path(spark, "saved")
    _index(spark, d, "tree_f32", rotation="none", normalize=False).save(path)
    return _shown(load_index(spark, path).search(_asked(_vectors(spark, d)), K, nprobe=0))


@query(_knn_sql(_L2))
def knn_after_delete_and_append(spark, d):
    """Rows that were deleted come again."""
    v = _vectors(spark, d)
    index = _index(spark, d, "ivf_f32", rotation="none", normalize=False)
    gone = v.filter("vec_id % 10 = 3")
    maintain.delete(index, gone.select("vec_id"), rebalance_after=False)
    maintain.append(index, gone.select("vec_id", "embedding"))
    return _shown(index.search(_asked(v), K, nprobe=0))


@query()
def pruning_reads(spark, d):
    """Share of the components that exact and sampled pruning read, over threefold vectors of 192 dimensions.

    A threefold vector is followed by those of the two ids before it, in a ring (by itself, where there is no such id). The threshold of a query is the distance of its K-th neighbour among all vectors, so the share doesn't depend on their order.
    """
    kinds = ("none", "exact", "adsampling")

    def turned(batches):
        turn = kernels.rotation_matrix(3 * DIMS, 42).astype(np.float64)
        for b in batches:
            rows = kernels.matrix(b.column(1), 3 * DIMS) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), kernels.lists(rows.astype(np.float32), pa.float32())], names=["vec_id", "embedding"])

    v = _vectors(spark, d).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = v.agg(F.max("vec_id") + 1).first()[0]
    wide = v.withColumn("own", F.col("embedding"))
    for k in (1, 2):
        back = v.select(F.pmod(F.col("vec_id") + k, F.lit(n)).alias("vec_id"), F.col("embedding").alias("back"))
        wide = wide.join(back, "vec_id", "left").select("vec_id", "own", F.concat("embedding", F.coalesce("back", "own")).alias("embedding"))
    wide = cut(wide.select("vec_id", "embedding").mapInArrow(turned, "vec_id long, embedding array<float>"), "wide")
    near = exact.knn(_asked(wide), wide, K).groupBy("query_id").agg(F.max("distance").alias("threshold"))
    # the threshold goes along as one more component
    asked = _asked(wide).join(near, "query_id").select("query_id", F.concat(F.col("embedding").cast("array<double>"), F.array("threshold")).alias("embedding"))
    out = spark.createDataFrame([(x, 0, 0) for x in kinds], "pruning string, read long, size long")
    for _, block in exact.query_blocks(cut(asked, "asked")):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            read, size = dict.fromkeys(kinds, 0), 0
            for b in batches:
                rows = kernels.matrix(b.column(0), 3 * DIMS)
                size += rows.size * len(sent.value)
                for x in kinds:
                    read[x] += kernels.components_read(sent.value[:, :-1], sent.value[:, -1], rows, x)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([read[x] for x in kinds], pa.int64()), pa.array([size] * len(kinds), pa.int64())], names=["pruning", "read", "size"])

        out = out.union(wide.select("embedding").mapInArrow(run, "pruning string, read long, size long"))
    return out.groupBy("pruning").agg(F.round(F.sum("read") / F.sum("size"), 4).alias("share_read"))
