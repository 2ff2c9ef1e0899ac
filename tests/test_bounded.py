"""What a search holds or moves at once doesn't grow with queries times vectors."""

import pickle
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators import exact
from nearfield.operators import index as I
from nearfield.plans.config import IndexConfig
from nearfield.sources import vectors as S


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def asked_of(v, every=40):
    return v.filter(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def found(df):
    return [(r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric", exact.METRICS[:3])
def test_top_k_of_many_queries_takes_little_memory(metric):
    rows = np.random.default_rng(1).normal(size=(8000, 8)).astype(np.float32)
    top = K.TopK(2500, 5, metric == "ip")
    _, mb = peak_mb(lambda: top.offer_block(rows[:2500], np.arange(8000), rows, metric))
    assert mb < 80
    if metric != "ip":
        assert (top.ids[:, 0] == np.arange(2500)).all()


def test_range_search_of_many_queries_takes_little_memory(spark, monkeypatch):
    rows = np.random.default_rng(1).normal(size=(8000, 4)).astype(np.float32)
    monkeypatch.setattr(exact, "query_blocks", lambda q: [(np.arange(2500) * 3, rows[:2500])])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), K.lists(rows, pa.float32())], names=["vec_id", "embedding"])
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    queries = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), select=lambda *c: None)
    vectors = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run(iter([batch]))))
    got, mb = peak_mb(lambda: list(exact.within(queries, vectors, 0.05)))
    assert mb < 80
    got = {(q, v) for b in got for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    far = K.pairwise(rows[:2500], rows, "l2sq")
    assert got == {(3 * q, v) for q, v in zip(*map(np.ndarray.tolist, np.nonzero(far < 0.05)), strict=True)}


def test_a_search_of_all_clusters_sends_no_list_of_them(spark, monkeypatch):
    v = S.random_vectors(spark, 600, 4, seed=5)
    index = I.build(v, IndexConfig(num_dimensions=4, num_clusters=60, rotation="none", normalize=False))
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(len(pickle.dumps(x))) or send(self, x))
    asked = asked_of(v, 1)
    got = found(index.search(asked, 3, 0))
    assert max(sent) < 60_000
    sent.clear()
    index.search(asked, 3, 59)
    assert max(sent) < 300_000
    monkeypatch.undo()
    assert got == found(exact.knn(asked, v, 3)) == found(index.search(asked, 3, 0, seed=True))


@pytest.mark.parametrize("metric", exact.METRICS)
def test_lateral_search_ranks_only_pairs_within_a_bound(spark, metric):
    v = S.random_vectors(spark, 900, 5, seed=3).withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.array(*[F.lit(0.5).cast("float")] * 5)).otherwise(F.col("embedding")))
    v.createOrReplaceTempView("bounded_vectors")
    asked_of(v).createOrReplaceTempView("bounded_asked")
    exact.register_knn(spark, "bounded_knn", "bounded_vectors", 4, metric)
    lateral = spark.sql("SELECT q.query_id, n.* FROM bounded_asked q, LATERAL bounded_knn(CAST(q.embedding AS ARRAY<DOUBLE>)) n")
    assert "bound" in lateral._jdf.queryExecution().optimizedPlan().toString()
    assert found(lateral) == found(exact.knn(asked_of(v), v, 4, metric))


@pytest.mark.parametrize("low, step", [(-4.0, 8.0 / 178), (0.0, 1.0 / 178), (0.4, 1e-3), (-1e6, 1.0)])
def test_built_in_search_loses_no_neighbour_whatever_the_codes(spark, low, step):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(1200, 64)).astype(np.float32)
    rows[::7] = rng.integers(0, 2, size=(172, 64))
    rows[::50] *= 1000
    v = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(1200)), "embedding": K.lists(rows, pa.float32())}))
    pairs = exact._near_pairs(asked_of(v), v, 5, 64, 3, low, step)
    assert found(exact.top_k(pairs, 5)) == found(exact.knn(asked_of(v), v, 5))


def test_built_in_search_ranks_only_pairs_within_a_bound(spark, monkeypatch):
    v = S.random_vectors(spark, 3000, 20, seed=3).withColumn("embedding", F.when(F.col("vec_id") % 90 == 0, F.array(*[F.lit(0.5).cast("float")] * 20)).otherwise(F.col("embedding")))
    expected, near, seen = found(exact.knn(asked_of(v), v, 4)), exact._near_pairs, []
    monkeypatch.setattr(exact, "_near_pairs", lambda *a: seen.append(near(*a)) or seen[-1])
    assert found(exact.knn_sql(asked_of(v), v, 4)) == expected
    assert seen[0].count() < 3000 * 75 // 5
    monkeypatch.setattr(exact, "QUERY_BLOCK_BYTES", 30 * 8 * 20)
    assert found(exact.knn_sql(asked_of(v), v, 4)) == expected


@pytest.mark.parametrize("few", [False, True])
def test_built_in_search_of_odd_vectors(spark, few):
    rows = np.random.default_rng(6).normal(size=(400, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1e200, 0.0, 0.0], [1.0, 2.0]]
    v = spark.createDataFrame([*enumerate(rows[:2] if few else rows), *((1000 + i, x) for i, x in enumerate(odd))], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 40 = 0 OR vec_id > 1000").select(F.col("vec_id").alias("query_id"), "embedding")
    got, expected = exact.knn_sql(q, v, 5), exact.top_k(exact._plain_pairs(q, v, "l2sq"), 5)
    assert [str(r) for r in got.orderBy("query_id", "rank").collect()] == [str(r) for r in expected.orderBy("query_id", "rank").collect()]
    assert got.filter("query_id = 0 AND rank <= 2 AND distance IS NULL").count() == 0
    assert exact.knn_sql(q, v.limit(0), 5).count() == exact.knn_sql(q.limit(0), v, 5).count() == 0


@pytest.mark.parametrize("pruning", ["none", "exact", "adsampling"])
def test_components_read_of_many_queries(pruning):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 192)).astype(np.float32)
    rows[:100] *= 0.05
    rows[100:120] = rows[0]
    q = rows[::20].astype(np.float64)
    t = np.array([np.sort(((rows - x) ** 2).sum(axis=1))[9] for x in q])
    t[3] = np.inf
    assert K.components_read(q, t, rows, pruning) == sum(K.pruned_l2sq(x, rows, float(y), pruning)[2] for x, y in zip(q, t, strict=True))
