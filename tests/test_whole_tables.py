import numpy as np
import pytest

from nearfield import queries
from nearfield.functions import kernels
from nearfield.operators import exact


@pytest.fixture
def fixture(spark, tmp_path):
    """1,300 vectors, of which those with the least ids are close together."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1300, 64)).astype(np.float32)
    rows[:600] *= 0.1
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), rows


def test_pruning_reads_of_all_vectors(spark, fixture):
    d, rows = fixture
    got = {r["pruning"]: r["share_read"] for r in queries.pruning_reads(spark, d).collect()}
    wide = (np.concatenate([rows, np.roll(rows, 1, 0), np.roll(rows, 2, 0)], axis=1) @ kernels.rotation_matrix(192, 42).astype(np.float64)).astype(np.float32)
    for pruning in ("none", "exact", "adsampling"):
        read = 0
        for q in wide[::50].astype(np.float64):
            threshold = np.sort(((wide - q) ** 2).sum(axis=1))[9]
            read += kernels.pruned_l2sq(q, wide, float(threshold), pruning)[2]
        assert got[pruning] == round(read / (26 * 1300 * 192), 4)


def test_partial_distances_of_all_vectors(spark, fixture, monkeypatch):
    d, rows = fixture
    monkeypatch.setattr(exact, "QUERY_BLOCK_BYTES", 8 * 64 * 10)
    got = {(r["query_id"], r["vec_id"]): r["partial"] for r in queries.partial_l2_prefix_all(spark, d).collect()}
    wide = rows[:, :16].astype(np.float64)
    want = {(q, v): ((wide[q] - wide[v]) ** 2).sum() for q in range(0, 1300, 50) for v in range(1300)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_k_above_the_count_gives_all_rows(spark, fixture):
    d, rows = fixture
    v = queries._vectors(spark, d)
    got = exact.knn(queries._asked(v).filter("query_id < 100"), v, 2000).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in (0, 50) for k in range(1, 1301)]
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, v) for q in (0, 50) for v in range(1300)}
