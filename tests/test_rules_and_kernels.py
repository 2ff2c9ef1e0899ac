import math

import numpy as np
import pytest

from nearfield.functions import kernels as K
from nearfield.plans import config as C

DIMS = [1, 7, 8, 15, 16, 31, 32, 63, 64, 128, 256, 384]


@pytest.mark.parametrize(("d", "want"), [(64, (64, 0)), (100, (100, 0)), (127, (127, 0)), (128, (64, 64)), (256, (64, 192)), (1024, (256, 768)), (1028, (260, 768))])
def test_dimension_split(d, want):
    assert C.dimension_split(d) == want


def test_configuration_is_validated():
    for bad in ({"num_dimensions": 0}, {"num_dimensions": 16_385}, {"num_dimensions": 4, "sampling": 1.5}, {"num_dimensions": 4, "sampling": -0.1}, {"num_dimensions": 4, "num_clusters": 5, "num_meso_clusters": 5}, {"num_dimensions": 4, "kmeans_iters": 0}, {"num_dimensions": 4, "kmeans_iters": 100}, {"num_dimensions": 4, "metric": "l7"}, {"num_dimensions": 4, "index_type": "x"}):
        with pytest.raises(ValueError):
            C.IndexConfig(**bad)
    config = C.IndexConfig(num_dimensions=4, num_clusters=9, num_meso_clusters=3)
    assert config.normalizes and config.clusters_for(100) == 9
    with pytest.raises(ValueError):
        config.clusters_for(8)
    assert C.IndexConfig(num_dimensions=4, normalize=False).normalizes is False
    assert C.IndexConfig(num_dimensions=4, normalize=False, metric="ip").normalizes
    assert [C.IndexConfig(num_dimensions=4).clusters_for(n) for n in (1, 2, 3, 4, 100)] == [1, 2, 3, 4, 20]


def test_rules():
    assert C.auto_clusters(2000) == 90 and C.auto_meso_clusters(90) == 9
    assert C.auto_sampling(30_719) == 1.0 and C.auto_sampling(30_720) == 0.3
    assert C.capacity(1000) == (500, 1300) and C.capacity(10) == (5, 256)
    assert C.prune_ratio(0, 64) == C.prune_ratio(64, 64) == 1.0
    assert math.isclose(C.prune_ratio(48, 64), 0.75 * (1 + 1.5 / math.sqrt(48)) ** 2)
    for d in (1, 16, 64, 100, 200, 4096):
        steps = C.prune_steps(d)
        assert steps[-1] == d and steps == sorted(set(steps))


@pytest.mark.parametrize("d", DIMS)
def test_distances(d):
    r = np.random.default_rng(42)
    q, x = r.uniform(-10, 10, (4, d)).astype(np.float32), r.uniform(-10, 10, (9, d)).astype(np.float32)
    want = ((q[:, None].astype(float) - x[None]) ** 2).sum(axis=2)
    assert np.allclose(K.pairwise(q, x, "l2sq"), want, rtol=1e-9)
    assert np.allclose(K.pairwise(q, x, "ip"), q.astype(float) @ x.T.astype(float))
    assert np.allclose(K.pairwise(q, x, "l1"), np.abs(q[:, None].astype(float) - x[None]).sum(axis=2))
    assert K.exact_pairs(q[0], q[:1], "l2sq")[0] == 0
    codes = r.integers(0, 256, (9, d)).astype(np.uint8)
    assert K.pairwise(codes[:2], codes, "l2sq").astype(int).tolist() == [[int(((a.astype(int) - b.astype(int)) ** 2).sum()) for b in codes] for a in codes[:2]]
    assert K.pairwise(np.zeros((1, d)), x, "cosine").tolist() == [[1.0] * 9]


@pytest.mark.parametrize("pruning", ["none", "exact", "adsampling"])
def test_pruned_scan_keeps_what_is_near(pruning):
    r = np.random.default_rng(1)
    rows = (K.unit(r.normal(size=(400, 192))) @ K.rotation_matrix(192, 7)).astype(float)
    lost = 0
    for q in rows[:20]:
        want = ((rows - q) ** 2).sum(axis=1)
        threshold = float(np.sort(want)[9]) + 1e-9
        places, distances, read = K.pruned_l2sq(q.astype(float), rows, threshold, pruning)
        near = np.flatnonzero(want <= threshold)
        lost += len(set(near.tolist()) - set(places.tolist()))
        assert np.allclose(distances, want[places], atol=1e-5) and read <= rows.size
    assert lost == 0 if pruning != "adsampling" else lost <= 4


@pytest.mark.parametrize("make", [K.rotation_matrix, K.dct_matrix])
def test_rotations_are_orthogonal_and_seeded(make):
    m = make(96, 5)
    assert np.allclose(m @ m.T, np.eye(96), atol=1e-5)
    assert np.array_equal(m, make(96, 5)) and not np.array_equal(m, make(96, 6))


def test_quantiser():
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 8)).astype(np.float32)
    lo, hi = float(x.min()), float(x.max())
    codes = K.quantize(x, lo, 255 / (hi - lo))
    assert codes.min() == 0 and codes.max() == 255
    assert np.abs(K.dequantize(codes, lo, 255 / (hi - lo)) - x).max() <= (hi - lo) / 255 / 2 + 1e-6
    assert K.quantize(np.array([[-9.0, 9.0]]), -1.0, 100.0).tolist() == [[0, 255]]
    assert K.quantize(np.array([[0.5, 1.5, 2.5]]), 0.0, 1.0).tolist() == [[1, 2, 3]]


def test_top_k_and_ties():
    top = K.TopK(1, 3)
    top.offer(0, np.array([9, 4, 7]), np.array([1.0, 1.0, 0.5]))
    top.offer(0, np.array([2, 1]), np.array([1.0, 2.0]))
    assert [(i, d) for _, i, d in top.rows()] == [(7, 0.5), (2, 1.0), (4, 1.0)] and top.worst(0) == 1.0


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 5), (200, 1), (300, 12)])
def test_kmeans(n, k):
    r = np.random.default_rng(3)
    rows = K.unit(r.normal(size=(n, 6)))
    c = K.kmeans(rows, k, 5, 42, True)
    assert len(c) == min(n, k) and np.isfinite(c).all()
    assert np.array_equal(c, K.kmeans(rows, k, 5, 42, True))
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)
    label, far = K.nearest(rows, c)
    assert np.allclose(far, ((rows - c[label]) ** 2).sum(axis=1), atol=1e-5)
