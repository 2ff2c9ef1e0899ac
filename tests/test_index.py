import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.operators import evaluate, exact, maintain
from nearfield.operators import index as I
from nearfield.plans.config import IndexConfig
from nearfield.sources import vectors as S
from nearfield.streaming import ingest

TYPES = ["ivf_f32", "ivf_u8", "tree_f32", "tree_u8"]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").cache()


@pytest.fixture(scope="module")
def asked(table):
    return table.filter("vec_id < 25").select(F.col("vec_id").alias("query_id"), "embedding").cache()


@pytest.fixture(scope="module")
def truth(asked, table):
    return exact.knn(asked, table, 10).cache()


@pytest.fixture(scope="module")
def indexes(table):
    return {t: I.build(table, IndexConfig(num_dimensions=64, index_type=t)) for t in TYPES}


def found(df):
    return [(r["query_id"], r["rank"], r["vec_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_exact_matches_numpy(table, asked):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = exact.knn(asked, table, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    for q, own in by.items():
        want = sorted((((rows[q] - x) ** 2).sum(), i) for i, x in rows.items())[:10]
        assert [(i, round(d, 9)) for _, i, d in sorted(own)] == [(i, round(d, 9)) for d, i in want]
    assert found(exact.knn(asked, table, 10)) == found(exact.knn_sql(asked, table, 10))
    with pytest.raises(ValueError):
        exact.knn(asked, table, 0)
    assert exact.knn(asked.limit(0), table, 3).count() == 0 and exact.knn(asked, table.limit(0), 3).count() == 0


@pytest.mark.parametrize("d", [3, 17, 63])
def test_uncommon_dimensions(spark, table, asked, d):
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, d))
    want = exact.knn(cut(asked), cut(table), 10)
    index = I.build(cut(table), IndexConfig(num_dimensions=d, normalize=False))
    assert evaluate.mean_recall(index.search(cut(asked), 10, 0), want, 10) > 0.99


@pytest.mark.parametrize("kind", TYPES)
def test_index_invariants(indexes, table, asked, truth, kind):
    index = indexes[kind]
    assert index.num_dimensions == 64 and index.num_clusters == 45 and index.size_bytes > 0
    ids = [r[0] for r in index.postings.select("vec_id").collect()]
    assert sorted(ids) == list(range(500))
    assert sum(r["n"] for r in index.cluster_sizes().collect()) == 500
    recalls = [evaluate.mean_recall(index.search(asked, 10, n), truth, 10) for n in (1, 8, 0)]
    assert recalls[0] <= recalls[1] + 0.01 <= recalls[2] + 0.02 and recalls[2] >= (0.95 if "f32" in kind else 0.9)
    got = index.search(asked, 10, 8).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got}) == len(got)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["distance"])
    assert all(v == sorted(v) for v in by.values())
    assert found(index.search(asked, 10, 45)) == found(index.search(asked, 10, 46)) == found(index.search(asked, 10, 0))
    assert index.search(asked, 600, 0).count() == 25 * 500
    with pytest.raises(ValueError):
        index.search(asked, 0)


@pytest.mark.parametrize("kind", ["ivf_f32", "tree_u8"])
def test_pruning_keeps_the_result(indexes, asked, truth, kind):
    want = found(indexes[kind].search(asked, 10, 16, pruning="none"))
    assert found(indexes[kind].search(asked, 10, 16, pruning="exact")) == want
    assert evaluate.mean_recall(indexes[kind].search(asked, 10, 0, pruning="adsampling"), truth, 10) > 0.9


@pytest.mark.parametrize("kind", TYPES)
def test_filtered_search(indexes, table, asked, kind):
    index = indexes[kind]
    half = table.filter("vec_id % 2 = 0").select("vec_id")
    got = index.filtered_search(asked, 10, half.union(half), 0).collect()
    assert all(r["vec_id"] % 2 == 0 for r in got) and len(got) == 250
    assert found(index.filtered_search(asked, 10, table.select("vec_id"), 0)) == found(index.search(asked, 10, 0))
    assert index.filtered_search(asked, 10, half.limit(0), 0).count() == 0
    assert {r["vec_id"] for r in index.filtered_search(asked, 10, table.filter("vec_id = 7").select("vec_id"), 0).collect()} == {7}
    assert index.filtered_search(asked, 30, table.filter("vec_id < 20").select("vec_id"), 0).count() == 25 * 20


@pytest.mark.parametrize("kind", TYPES)
def test_saved_index_is_the_same_and_changes(spark, indexes, asked, table, tmp_path, kind):
    path = f"{tmp_path}/{kind}"
    indexes[kind].save(path)
    again = I.load_index(spark, path)
    assert again.config == indexes[kind].config
    assert found(again.search(asked, 10, 8)) == found(indexes[kind].search(asked, 10, 8))
    maintain.delete(again, table.filter("vec_id = 3").select("vec_id"))
    assert again.postings.filter("vec_id = 3").count() == 0


def test_seeds_and_metrics(table, asked):
    build = lambda **o: I.build(table, IndexConfig(num_dimensions=64, **o))
    a, b, c = (found(build(seed=s).search(asked, 10, 2)) for s in (1, 1, 2))
    assert a == b and a != c
    scaled = table.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 7).cast("float")))
    want = exact.knn(asked, scaled, 10, "cosine")
    got = I.build(scaled, IndexConfig(num_dimensions=64, metric="cosine", normalize=False)).search(asked, 10, 0)
    assert evaluate.mean_recall(got, want, 10) > 0.99


@pytest.mark.parametrize("n", [1, 5])
def test_tiny_indexes(table, asked, n):
    for kind in TYPES:
        index = I.build(table.filter(F.col("vec_id") < n), IndexConfig(num_dimensions=64, index_type=kind))
        assert index.search(asked.limit(2), 10).count() == 2 * n


def test_bad_vectors_are_refused(spark, table):
    with pytest.raises(ValueError):
        I.build(table, IndexConfig(num_dimensions=65))
    with pytest.raises(ValueError):
        I.build(table, IndexConfig(num_dimensions=64, num_clusters=501))
    nan = spark.createDataFrame([(1, [float("nan")])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        I.build(nan, IndexConfig(num_dimensions=1))


def coverage(index, want):
    assert sorted(r[0] for r in index.postings.select("vec_id").collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["ivf_f32", "tree_u8"])
def test_append_delete_split_merge(table, asked, kind, monkeypatch):
    monkeypatch.setattr(maintain, "capacity", lambda rows: (rows // 2, 20))
    config = IndexConfig(num_dimensions=64, index_type=kind, num_clusters=6, num_meso_clusters=2 if "tree" in kind else 0)
    index = I.build(table.filter("vec_id < 60"), config)
    maintain.append(index, table.filter("vec_id between 60 and 259"))
    coverage(index, range(260))
    assert index.num_clusters > 6 and maintain.health(index).filter("state = 'split'").count() == 0
    want = exact.knn(asked, table.filter("vec_id < 260"), 10)
    assert evaluate.mean_recall(index.search(asked, 10, 0), want, 10) >= 0.9
    with pytest.raises(ValueError):
        maintain.append(index, table.filter("vec_id = 5"))
    maintain.delete(index, table.filter("vec_id < 150").select("vec_id"))
    coverage(index, range(150, 260))
    assert index.search(asked, 400, 0).filter("vec_id < 150").count() == 0
    with pytest.raises(ValueError):
        maintain.delete(index, table.filter("vec_id = 5").select("vec_id"))
    maintain.delete(index, table.filter("vec_id = 5").select("vec_id"), missing="ignore")
    maintain.compact(index)
    coverage(index, range(150, 260))


def test_workload(table, asked):
    build = lambda rows: I.build(rows, IndexConfig(num_dimensions=64, index_type="tree_f32"))
    index = maintain.run_workload(build, table, [("BUILD", 0.6), ("INSERT", 0.4), ("DELETE", 0.2), ("INSERT", 0.2)])
    coverage(index, range(500))
    with pytest.raises(ValueError):
        maintain.run_workload(build, table, [("BUILD", 0.5)])


def test_facades(spark, table, asked, truth, tmp_path):
    for made in (I.IndexIvf, I.IndexIvfSq8, I.IndexIvfTree, I.IndexIvfTreeSq8):
        one = made(spark, 64)
        with pytest.raises(ValueError):
            one.search(asked, 1)
        one.build(table.filter("vec_id < 450"))
        one.append(table.filter("vec_id >= 450"))
        one.delete(table.filter("vec_id = 499").select("vec_id"))
        assert one.filtered_search(asked, 5, table.filter("vec_id >= 498").select("vec_id"), 0).select("vec_id").distinct().collect()[0][0] == 498
        assert one.num_dimensions == 64 and one.num_clusters > 1 and one.size_bytes > 0


def test_stream_of_changes(spark, table, asked, tmp_path):
    index = I.build(table.filter("vec_id < 100"), IndexConfig(num_dimensions=64, index_type="tree_f32"))
    add = table.filter("vec_id between 100 and 119").select(F.lit("append").alias("op"), "vec_id", "embedding", F.lit(1).cast("long").alias("seq"))
    gone = table.filter("vec_id between 110 and 112").select(F.lit("delete").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(2).cast("long").alias("seq"))
    old = table.filter("vec_id = 7").select(F.lit("delete").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(3).cast("long").alias("seq"))
    add.union(gone).union(old).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    ingest.maintain_stream(index, stream, f"{tmp_path}/check").awaitTermination()
    want = [i for i in range(120) if i not in (7, 110, 111, 112)]
    coverage(index, want)
    ingest.apply_batch(index, spark.read.parquet(f"{tmp_path}/in"))
    coverage(index, want)


def test_sources(spark, tmp_path):
    rows = np.random.default_rng(1).normal(size=(37, 5)).astype("<f4")
    (tmp_path / "v.bin").write_bytes(rows.tobytes())
    got = S.read_float_file(spark, f"{tmp_path}/v.bin", 5).orderBy("vec_id").collect()
    assert np.allclose([r["embedding"] for r in got], rows) and [r["vec_id"] for r in got] == list(range(37))
    (tmp_path / "q.bin").write_bytes(S.query_file_bytes(rows[:4]))
    assert np.allclose([r["embedding"] for r in S.read_query_file(spark, f"{tmp_path}/q.bin").orderBy("query_id").collect()], rows[:4])
    (tmp_path / "ids.bin").write_bytes(struct.pack("<I", 3) + np.array([5, 1, 9], "<u4").tobytes())
    assert sorted(r[0] for r in S.read_id_file(spark, f"{tmp_path}/ids.bin").collect()) == [1, 5, 9]
    (tmp_path / "t.json").write_text(json.dumps({"0": [3, 1], "2": [7]}))
    assert sorted(map(tuple, S.read_truth_json(spark, f"{tmp_path}/t.json").collect())) == [(0, 1, 3), (0, 2, 1), (2, 1, 7)]
    S.write_results(spark.createDataFrame([("a", 1.5)], "name string, ms double"), f"{tmp_path}/csv")
    S.write_results(spark.createDataFrame([("b", 2.5)], "name string, ms double"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    with pytest.raises(ValueError):
        S.from_matrix(spark, np.zeros(3))


def test_sql_functions(spark):
    D.register(spark)
    r = spark.sql("SELECT l2sq(array(1, 2), array(3, 5)) AS a, ip(array(1, 2), array(3, 5)) AS b, l1(array(1, 2), array(3, 5)) AS c, cosine_distance(array(1, 0), array(0, 2)) AS d, cosine_distance(array(0, 0), array(1, 2)) AS e").first()
    assert tuple(r) == (13.0, 13.0, 5.0, 1.0, 1.0)


def test_filters_reach_the_scan(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    q = v.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = exact.knn(q, v, 3, where=F.col("label") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "WindowGroupLimit" in plan


CHANGES = "op string, vec_id long, embedding array<float>, seq long"


def small_index(spark, n=60, **options):
    rows = np.random.default_rng(3).normal(size=(n, 8)).astype(np.float32)
    return I.build(S.from_matrix(spark, rows), IndexConfig(num_dimensions=8, normalize=False, rotation="none", **options)), rows


def nearest_of(spark, index, vector):
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<float>")
    r = index.search(query, 1, nprobe=0).first()
    return r["vec_id"], r["distance"]


def test_streamed_updates_replace_and_reruns_change_nothing(spark):
    index, rows = small_index(spark)
    new = [9.0] * 8
    one = spark.createDataFrame([("append", 5, new, 1), ("delete", 6, None, 2), ("append", 200, [-9.0] * 8, 3)], CHANGES)
    ingest.apply_batch(index, one, batch_id=0)
    assert nearest_of(spark, index, new) == (5, 0.0) and nearest_of(spark, index, [-9.0] * 8) == (200, 0.0)
    again = spark.createDataFrame([("append", 6, [float(x) for x in rows[6]], 4), ("append", 200, [7.0] * 8, 5)], CHANGES)
    ingest.apply_batch(index, again, batch_id=1)
    assert nearest_of(spark, index, rows[6])[0] == 6 and nearest_of(spark, index, [7.0] * 8) == (200, 0.0)
    ingest.apply_batch(I.load_index(spark, index.path), one, batch_id=0)
    after = I.load_index(spark, index.path)
    assert nearest_of(spark, after, [7.0] * 8) == (200, 0.0)
    ids = [r[0] for r in after.postings.select("vec_id").collect()]
    assert sorted(ids) == [*range(60), 200]


def test_a_change_that_fails_leaves_no_trace(spark, monkeypatch):
    index, rows = small_index(spark)
    batch = spark.createDataFrame([("append", 300, [1.0] * 8, 1), ("delete", 3, None, 1)], CHANGES)

    def crash(self):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(I.VectorIndex, "_commit", crash)
        ingest.apply_batch(index, batch, batch_id=4)
    for state in (index, I.load_index(spark, index.path)):
        assert sorted(r[0] for r in state.postings.select("vec_id").collect()) == [*range(60)]
    ingest.apply_batch(index, batch, batch_id=4)
    assert sorted(r[0] for r in index.postings.select("vec_id").collect()) == [i for i in range(60) if i != 3] + [300]


def test_no_index_is_a_clear_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        I.load_index(spark, f"{tmp_path}/nothing")


def test_centroids_of_a_table_too_large_for_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 16))).astype(np.float32)
    prepared = S.from_matrix(spark, rows)
    config = IndexConfig(num_dimensions=16, normalize=False, rotation="none")
    near = I.train_centroids(prepared, config, 4000, 120)
    monkeypatch.setattr(I, "MOST_TRAIN_BYTES", 4 * 16 * 600)
    taken = []
    on_driver = I._on_driver
    monkeypatch.setattr(I, "_on_driver", lambda p, c: taken.append(p.count()) or on_driver(p, c))
    far = I.train_centroids(prepared, config, 4000, 120)
    assert far.shape == near.shape == (120, 16) and taken and max(taken) < 400
    from nearfield.functions import kernels as K

    assert K.nearest(rows, far)[1].mean() < 1.15 * K.nearest(rows, near)[1].mean()


@pytest.mark.parametrize(("sizes", "total"), [([10, 0, 5], 7), ([1, 1, 100], 50), ([3, 3, 3], 9), ([5, 5, 5], 2), ([1000, 1, 1], 4)])
def test_centroids_are_allotted_to_cells(sizes, total):
    got = I.allot(np.array(sizes), total)
    assert got.sum() == total and (got <= sizes).all() and (got >= 0).all()


def test_facade_facts_and_epsilon(spark):
    rows = np.random.default_rng(4).normal(size=(80, 8)).astype(np.float32)
    index = I.IndexIvf(spark, 8, normalize=False, num_clusters=5).build(S.from_matrix(spark, rows))
    assert sum(index.get_cluster_size(c) for c in range(5)) == 80
    assert sorted(r[0] for c in range(5) for r in index.get_cluster_row_ids(c).collect()) == [*range(80)]
    asked = S.from_matrix(spark, rows[:9]).withColumnRenamed("vec_id", "query_id")
    index.set_nprobe(0)
    assert found(index.search(asked, 4)) == found(exact.knn(asked, S.from_matrix(spark, rows), 4))
    loose = index.index.search(asked, 4, nprobe=0, pruning="adsampling", epsilon=50.0)
    assert found(loose) == found(index.search(asked, 4))
    with pytest.raises(ValueError, match="epsilon"):
        IndexConfig(num_dimensions=8, epsilon=-1)
