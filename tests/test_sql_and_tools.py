import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import exact, maintain
from nearfield.operators import index as I
from nearfield.plans.config import IndexConfig
from nearfield.plans.profile import Profiler
from nearfield.sources import vectors as S


def rows_of(df):
    return [(r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric", exact.METRICS)
def test_knn_of_sql_is_knn(spark, metric):
    v = S.random_vectors(spark, 300, 8, seed=3)
    v.createOrReplaceTempView("tools_vectors")
    asked = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    asked.createOrReplaceTempView("tools_asked")
    expected = rows_of(exact.knn(asked, v, 4, metric))
    exact.register_knn(spark, "tools_knn", "tools_vectors", 4, metric)
    assert rows_of(spark.sql("SELECT q.query_id, n.* FROM tools_asked q, LATERAL tools_knn(CAST(q.embedding AS ARRAY<DOUBLE>)) n")) == expected
    exact.knn_view(spark, "tools_found", "tools_asked", "tools_vectors", 4, metric)
    assert rows_of(spark.table("tools_found")) == expected


def test_knn_of_sql_with_no_vectors_and_bad_k(spark):
    S.random_vectors(spark, 10, 4).filter("false").createOrReplaceTempView("tools_none")
    exact.register_knn(spark, "tools_knn_none", "tools_none", 3)
    assert spark.sql("SELECT * FROM tools_knn_none(array(1D, 2D, 3D, 4D))").count() == 0
    with pytest.raises(ValueError):
        exact.register_knn(spark, "tools_knn_none", "tools_none", 0)


def test_random_vectors_depend_on_seed_and_id_alone(spark):
    def values(df):
        return {r["vec_id"]: list(r["embedding"]) for r in df.collect()}

    some = values(S.random_vectors(spark, 1500, 6, seed=1))
    assert sorted(some) == list(range(1500))
    more = values(S.random_vectors(spark, 3000, 6, seed=1))
    assert all(more[i] == x for i, x in some.items())
    assert values(S.random_vectors(spark, 10, 6, seed=2))[0] != some[0]
    assert S.random_vectors(spark, 0, 6).count() == 0
    data = np.array(list(values(S.random_vectors(spark, 2000, 6, seed=1, groups=5, spread=0.01)).values()))
    assert len(np.unique(data.round(0), axis=0)) < 200


def test_samples_of_ids(spark):
    v = S.random_vectors(spark, 2000, 2)
    ids = {r[0] for r in S.sample_ids(v, 50, 7).collect()}
    assert len(ids) == 50 and ids == {r[0] for r in S.sample_ids(v.repartition(7), 50, 7).collect()}
    assert ids != {r[0] for r in S.sample_ids(v, 50, 8).collect()}
    assert S.sample_ids(v, 5000).count() == 2000
    assert S.share_ids(v, 0.0).count() == 0 and S.share_ids(v, 1.0).count() == 2000
    assert 400 < S.share_ids(v, 0.25).count() < 600


def test_accesses_inserts_and_deletes_by_cluster(spark):
    v = S.random_vectors(spark, 400, 8, seed=5)
    index = I.build(v, IndexConfig(num_dimensions=8, num_clusters=6))
    asked = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = index.probes(asked, 2)
    sizes = {r["cluster_id"]: r["n"] for r in index.cluster_sizes().collect()}
    maintain.append(index, S.random_vectors(spark, 430, 8, seed=5).filter("vec_id >= 400"), rebalance_after=False)
    maintain.delete(index, v.filter("vec_id < 25").select("vec_id"), rebalance_after=False)
    got = {r["cluster_id"]: r for r in index.cluster_accesses(probes.union(probes)).collect()}
    assert sorted(got) == sorted(sizes)
    assert sum(r["n_accessed"] for r in got.values()) == 40
    assert sum(r["n_inserted"] for r in got.values()) == 30 and sum(r["n_deleted"] for r in got.values()) == 25
    for r in index.cluster_sizes().collect():
        one = got[r["cluster_id"]]
        assert r["n"] == sizes[r["cluster_id"]] + one["n_inserted"] - one["n_deleted"]


def test_filters_of_clusters(spark):
    index = I.build(S.random_vectors(spark, 400, 8, seed=5), IndexConfig(num_dimensions=8, num_clusters=6))
    place = {r["vec_id"]: r["cluster_id"] for r in index.postings.collect()}
    first = sorted(set(place.values()))[:2]
    part = sorted(i for i, c in place.items() if c in first)
    assert sorted(r[0] for r in index.cluster_filter(2).collect()) == part
    others = [min(i for i, c in place.items() if c == x) for x in set(place.values()) - set(first)]
    assert sorted(r[0] for r in index.cluster_filter(2, one_of_others=True).collect()) == sorted(part + others)
    assert index.cluster_filter(0).count() == 0 and index.cluster_filter(99).count() == 400


def test_profiler_adds_up_and_nests(spark):
    p = Profiler()
    for _ in range(3):
        with p.scope("build"), p.scope("train"):
            pass
    with pytest.raises(KeyError), p.scope("build"):
        raise KeyError
    with p.scope("train"), p.scope("train"):
        pass
    assert p.calls == {("build",): 4, ("build", "train"): 3, ("train",): 1, ("train", "train"): 1}
    flat = p.flat()
    assert flat["train"][0] == 5 and flat["train"][1] <= sum(p.seconds.values())
    assert p.tree().splitlines()[1].startswith("  train: ")
    assert {r["path"]: r["calls"] for r in p.frame(spark).collect()}["build/train"] == 3
