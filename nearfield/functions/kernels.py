"""Numeric kernels on blocks of vectors, for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from nearfield.plans.config import EPSILON, GROUP, WARMUP_SHARE, WARMUP_STEPS, prune_ratio


BLOCK_BYTES = 8 << 20


def matrix(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """A list column as rows of a matrix, in its own number type; no copy where Arrow holds plain values."""
    flat = np.asarray(column.flatten())
    n = len(column)
    if n == 0:
        return flat.reshape(0, dimensions or 0)
    if len(flat) % n or (dimensions is not None and len(flat) != n * dimensions):
        raise ValueError("vectors differ in width")
    return flat.reshape(n, -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def pairwise(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries x rows) in double; ip is the product itself, of which the greatest is nearest."""
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(axis=1) for v in q]) if len(q) else np.zeros((0, len(x)))
    product = q @ x.T
    if metric == "ip":
        return product
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if metric == "cosine":
        scale = np.sqrt(qq)[:, None] * np.sqrt(xx)
        none = scale == 0
        scale[none] = 1
        product /= scale
        np.subtract(1, product, out=product)
        np.maximum(product, 0.0, out=product)
        product[none] = 1.0
        return product
    out = qq[:, None] + xx
    product *= 2
    out -= product
    return np.maximum(out, 0, out=out)


def exact_pairs(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query to rows, by subtraction, so that near-zero distances lose nothing."""
    q, x = query.astype(np.float64), rows.astype(np.float64)
    if metric == "l2sq":
        return ((x - q) ** 2).sum(axis=1)
    return pairwise(q[None, :], x, metric)[0]


class TopK:
    """The k nearest rows of each query so far, ties by id. Places that are not taken yet have an infinite key."""

    def __init__(self, queries: int, k: int, descending: bool = False, bound: np.ndarray | None = None):
        self.k, self.sign = k, -1.0 if descending else 1.0
        self.keys = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.bound = np.full(queries, np.inf) if bound is None else bound

    def worst(self, q: int) -> float:
        """The distance beyond which a row of query q can't enter; infinite while nothing is known."""
        return float(min(self.keys[q, -1], self.bound[q]))

    def offer(self, q: int, ids: np.ndarray, distances: np.ndarray) -> None:
        keys = distances * self.sign
        near = keys <= self.worst(q)
        if near.any():
            self._merge(np.array([q]), ids[near][None], keys[near][None])

    def _merge(self, places: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """ids and keys: a row for each of the places."""
        keys, ids = np.concatenate([self.keys[places], keys], axis=1), np.concatenate([self.ids[places], ids], axis=1)
        order = np.lexsort((ids, keys), axis=1)[:, : self.k]
        self.keys[places], self.ids[places] = np.take_along_axis(keys, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def offer_block(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, metric: str, places: np.ndarray | None = None) -> None:
        """Queries (those at `places` of this object; all, if None) against a block: one product for as many queries as give
        BLOCK_BYTES of distances, then the candidates by subtraction."""
        places = np.arange(len(queries)) if places is None else places
        rows = rows.astype(np.float64)
        take = min(len(ids), self.k + 8)
        step = max(1, BLOCK_BYTES // (8 * max(len(ids), take * rows.shape[1])))
        for at in range(0, len(queries), step):
            self._offer(queries[at : at + step], ids, rows, metric, places[at : at + step], take)

    def _offer(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, metric: str, places: np.ndarray, take: int) -> None:
        rough = pairwise(queries, rows, metric)
        rough *= self.sign
        if take < len(ids):
            chosen = np.argpartition(rough, take - 1, axis=1)[:, :take]
            edge = np.take_along_axis(rough, chosen, axis=1).max(axis=1)
            # where rounding can't tell the last from others, all of these are looked at
            tied = (rough <= (edge + 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]).sum(axis=1) > take
            for i in np.flatnonzero(tied):
                near = np.flatnonzero(rough[i] <= edge[i] + 1e-9 * max(1.0, abs(edge[i])))
                self.offer(int(places[i]), ids[near], exact_pairs(queries[i], rows[near], metric))
            if tied.all():
                return
            queries, chosen, rough, places = queries[~tied], chosen[~tied], rough[~tied], places[~tied]
        else:
            chosen = np.broadcast_to(np.arange(len(ids)), rough.shape)
        if metric == "l2sq":
            diff = rows[chosen] - queries.astype(np.float64)[:, None, :]
            keys = np.einsum("qrd,qrd->qr", diff, diff)
        else:
            keys = np.take_along_axis(rough, chosen, axis=1)
        self._merge(places, ids[chosen], keys)

    def rows(self):
        for q, i in zip(*np.nonzero(np.isfinite(self.keys)), strict=True):
            yield int(q), int(self.ids[q, i]), float(self.keys[q, i] * self.sign)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of all that was found."""
        q, i = np.nonzero(np.isfinite(self.keys))
        return q, self.ids[q, i], self.keys[q, i] * self.sign


def pruned_l2sq(query: np.ndarray, rows: np.ndarray, threshold: float, pruning: str, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, distances, component reads) of rows that may lie within the threshold.

    Partial sums over growing numbers of dimensions drop rows, and over 64 at a time once few are left: beyond the threshold
    itself ("exact", loses nothing), or beyond threshold * ratio ("adsampling", for rotated data). "none" reads everything.
    """
    d = rows.shape[1]
    places = np.arange(len(rows))
    if pruning == "none" or not np.isfinite(threshold):
        diff = rows.astype(np.float64) - query
        return places, (diff * diff).sum(axis=1), rows.size
    partial = np.zeros(len(rows))
    at = read = step = 0
    while at < d and len(places):
        to = min(d, at + (WARMUP_STEPS[min(step, len(WARMUP_STEPS) - 1)] if len(places) > WARMUP_SHARE * len(rows) else GROUP))
        step += 1
        diff = rows[places, at:to].astype(np.float64) - query[at:to]
        partial += (diff * diff).sum(axis=1)
        read += diff.size
        at = to
        keep = partial <= threshold * (prune_ratio(to, d, epsilon) if pruning == "adsampling" else 1.0)
        if not keep.all():
            places, partial = places[keep], partial[keep]
    return places, partial, read


def components_read(queries: np.ndarray, thresholds: np.ndarray, rows: np.ndarray, pruning: str, epsilon: float = EPSILON) -> int:
    """What pruned_l2sq() reads for all queries together. Partial sums are matrix products, of as many queries at once as give
    BLOCK_BYTES; where rounding can't tell whether a row is within the threshold, its sum is made by subtraction."""
    n, d = rows.shape
    if pruning == "none" or not n:
        return len(queries) * rows.size
    finite = np.isfinite(thresholds)
    read = int((~finite).sum()) * rows.size
    queries, thresholds, x = queries[finite].astype(np.float64), thresholds[finite], rows.astype(np.float64)
    most = (x * x).sum(axis=1).max()
    size = max(1, BLOCK_BYTES // (8 * n))
    for start in range(0, len(queries), size):
        q, threshold = queries[start : start + size], thresholds[start : start + size]
        slack = 1e-12 * ((q * q).sum(axis=1) + most)
        work = [(np.arange(len(q)), 0, 0, np.zeros((len(q), n)), np.ones((len(q), n), bool))]
        while work:
            group, at, step, partial, alive = work.pop()
            left = alive.sum(axis=1)
            many = left > WARMUP_SHARE * n
            for part, wide in ((many, WARMUP_STEPS[min(step, len(WARMUP_STEPS) - 1)]), (~many & (left > 0), GROUP)):
                if not part.any():
                    continue
                to, own = min(d, at + wide), group[part]
                read += int(left[part].sum()) * (to - at)
                if to == d:
                    continue
                sums = partial[part] + pairwise(q[own, at:to], x[:, at:to], "l2sq")
                limit = threshold[own] * (prune_ratio(to, d, epsilon) if pruning == "adsampling" else 1.0)
                keep = sums <= limit[:, None]
                unsure = (np.abs(sums - limit[:, None]) <= slack[own][:, None]) & alive[part]
                for i, j in zip(*np.nonzero(unsure), strict=True):
                    diff = rows[j, :to].astype(np.float64) - q[own[i], :to]
                    keep[i, j] = (diff * diff).sum() <= limit[i]
                work.append((own, to, step + 1, sums, keep & alive[part]))
    return read


def rotation_matrix(dimensions: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def dct_matrix(dimensions: int, seed: int) -> np.ndarray:
    """Random signs, then an orthonormal cosine transform, as one matrix."""
    n = np.arange(dimensions)
    c = np.cos(np.pi * (n[:, None] + 0.5) * n[None, :] / dimensions) * np.sqrt(2 / dimensions)
    c[:, 0] /= np.sqrt(2)
    signs = np.where(np.random.default_rng(seed).random(dimensions) < 0.5, -1.0, 1.0)
    return (signs[:, None] * c).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    n = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (rows / np.where(n == 0, 1, n)).astype(np.float32)


def quantize(rows: np.ndarray, base: float, scale: float) -> np.ndarray:
    return np.clip(np.floor((rows.astype(np.float64) - base) * scale + 0.5), 0, 255).astype(np.uint8)


def dequantize(codes: np.ndarray, base: float, scale: float) -> np.ndarray:
    return codes.astype(np.float64) / scale + base


def nearest(rows: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centroid, squared distance) of each row; ties go to the first."""
    best, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for at in range(0, len(rows), block):
        d = pairwise(rows[at : at + block], centroids, "l2sq")
        best[at : at + block] = d.argmin(axis=1)
        far[at : at + block] = d.min(axis=1)
    return best, far


def kmeans(rows: np.ndarray, k: int, iters: int, seed: int, angular: bool) -> np.ndarray:
    """Lloyd's centroids; on the unit sphere where `angular`. An empty cluster takes the row farthest from its centroid."""
    r = np.random.default_rng(seed)
    rows = rows.astype(np.float32)
    if k >= len(rows):
        return rows[:k].copy()
    if k == 1 and not angular:
        return rows.mean(axis=0, keepdims=True).astype(np.float32)
    centroids = rows[np.sort(r.choice(len(rows), k, replace=False))].copy()
    for _ in range(iters):
        label, far = nearest(rows, centroids)
        count = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(rows[order].astype(np.float64), np.cumsum(count)[full] - count[full], axis=0)
        new = centroids.astype(np.float64)
        new[full] = sums / count[full][:, None]
        for c, i in zip(np.flatnonzero(count == 0), np.argsort(-far, kind="stable"), strict=False):
            new[c] = rows[i]
        centroids = unit(new) if angular else new.astype(np.float32)
    return centroids
