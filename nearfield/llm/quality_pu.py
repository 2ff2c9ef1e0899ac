"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives P (label 1) and unlabelled web text U train a small network; labels of value 0 are never read. With class
prior pi, the risk is pi R_P(+) + max(0, R_U(-) - pi R_P(-)); where the second part falls below zero its gradient is
reversed, so a flexible model can't win by calling all of P positive. The loss is logistic, so scores are probabilities of
label 1. The prior is estimated by best bin: a classifier of P against U ranks both, and the least ratio of U's share to P's
share above a threshold (with a bound for sampling error) is the share of positives in U.

Features are shape statistics of the whole text, one Arrow pass. The model is fitted on the driver from at most
`most_positive` and `most_unlabelled` feature rows, those of the least hashes: a bound, not a share.

Defined cases: null text is empty text, which has a score like others; null ids are never labelled; of several labels of an
id the greatest counts; without positives or unlabelled rows every score is the prior guess 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, held_out

MOST_POSITIVE = 20_000
MOST_UNLABELLED = 40_000
THRESHOLD = 0.7
HIDDEN = 16
# Classes of bytes.
_CLASSES = np.zeros(256, np.int64)
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-()", b"!?", b"#$%&*@^~+=<>", b"|/\\_{}[]`")):
    _CLASSES[list(_bytes)] = _i + 1
_CLASSES[128:] = 10
_SPACE, _LINE = 4, 5
_CLASSES_BYTES = _CLASSES.astype(np.uint8).tobytes()


def features(text: str) -> list[float]:
    """Shape statistics of a whole text, each of order 1: shares of byte classes, also at the words' first and last bytes;
    length; how often words and lines repeat; how far the text compresses."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    kinds = np.frombuffer(data.translate(_CLASSES_BYTES), np.uint8)
    gap = np.concatenate([[True], (kinds == _SPACE) | (kinds == _LINE), [True]])
    first = kinds[gap[:-2] & ~gap[1:-1]]
    last = kinds[gap[2:] & ~gap[1:-1]]
    m = len(first)
    counts = Counter(data.split())
    distinct = len(counts)
    lines = data.split(b"\n")
    return [
        *(np.bincount(kinds, minlength=11) / max(1, n)).tolist(),
        *(np.bincount(first, minlength=11) / max(1, m)).tolist(),
        *(np.bincount(last, minlength=11) / max(1, m)).tolist(),
        math.log1p(n) / 10,
        math.log1p(m) / 10,
        distinct / max(1, m),
        math.log1p(distinct) / math.log1p(m) if m else 0.0,
        max(counts.values(), default=0) / max(1, m),
        len(lines) / max(1, m),
        len(set(lines)) / len(lines),
        n / max(1, m) / 10,
        min(len(zlib.compress(data, 1)) / n, 2.0) if n else 0.0,
        float(n == 0),
    ]


WIDTH = len(features(""))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, f): one Arrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float32()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<float>")


class Network:
    """One hidden layer; z(x) is the log-odds of the positive class."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = [r.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.steps = 0

    def standardise(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def z(self, raw: np.ndarray) -> np.ndarray:
        return self.forward(self.standardise(raw))[0]

    def step(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray, rate: float, decay: float = 1e-3) -> None:
        dh = dz[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]
        self.steps += 1
        for i, g in enumerate(grads):
            g = g + decay * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[i] / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 100) -> float:
    """The share of positives in U by best bin: a classifier of P against U, trained on one half of the rows, ranks the other
    half; the cut with the least ratio of U's share above it to P's, allowing for sampling error, gives the estimate. Mean of
    both ways round."""
    found = []
    for half in (0, 1):
        p, u = positive[half::2], unlabelled[half::2]
        rest_p, rest_u = positive[1 - half :: 2], unlabelled[1 - half :: 2]
        if not min(map(len, (p, u, rest_p, rest_u))):
            return 0.5
        net = Network(seed=11 + half)
        both = np.concatenate([p, u])
        net.mean, net.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        x = net.standardise(both)
        target = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
        weight = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
        for _ in range(rounds):
            z, h = net.forward(x)
            net.step(x, h, weight * (_sigmoid(z) - target), 0.01)
        p, u = np.sort(net.z(rest_p)), np.sort(net.z(rest_u))
        cuts = np.quantile(p, 1 - np.linspace(0.1, 1.0, 91))
        above_p = np.maximum(1 - np.searchsorted(p, cuts) / len(p), 1e-9)
        above_u = 1 - np.searchsorted(u, cuts) / len(u)
        slack = math.sqrt(math.log(20) / (2 * len(u))) + math.sqrt(math.log(20) / (2 * len(p)))
        best = int(np.argmin((above_u + slack) / above_p))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 200, rate: float = 0.01) -> Network:
    """Minimise the non-negative risk; all rows in each round, so the result is the same for the same rows in any order
    but for rounding."""
    net = Network()
    net.mean, net.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    x = net.standardise(np.concatenate([positive, unlabelled]))
    n, m = len(positive), len(unlabelled)
    for _ in range(rounds):
        z, h = net.forward(x)
        s = _sigmoid(z)
        softplus = np.logaddexp(0, np.clip(z, -30, 30))
        negative = softplus[n:].mean() - prior * softplus[:n].mean()
        dz = np.empty(n + m)
        if negative >= 0:
            dz[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
            dz[n:] = s[n:] / m
        else:  # undo what drove the estimate below zero
            dz[:n] = prior * s[:n] / n
            dz[n:] = -s[n:] / m
        net.step(x, h, dz, rate)
    return net


def _bounded(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` feature rows, those of the least hashes, in a fixed order. Of a larger table only little more than these
    pass the filter on the hash, so the sort that follows is small; it can't come out empty."""
    n = rows.count()
    rows = rows.select(F.shiftrightunsigned(F.xxhash64("doc_id", "f"), 12).alias("part"), "doc_id", "f")
    if n > most:
        rows = rows.filter(F.col("part") < F.lit(int((1 << 52) * min(1.0, (1.2 * most + 1000) / n))))
    got = rows.orderBy("part", "doc_id").limit(most).toArrow()
    f = got.column("f").combine_chunks()
    return np.asarray(f.flatten(), dtype=np.float64).reshape(-1, WIDTH)


def score(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels(doc_id, quality) of rows not held out teach."""
    rows = cut(feature_rows(docs), "features")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taught = rows.filter(~held_out(F.col("doc_id")))
    positive = _bounded(taught.join(known.filter("quality = 1"), "doc_id", "left_semi"), most_positive)
    unlabelled = _bounded(taught.join(known, "doc_id", "left_anti"), most_unlabelled)
    net = fit(positive, unlabelled, estimate_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(-1, WIDTH)
            s = _sigmoid(net.z(f)) if net is not None else np.full(len(f), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = rows.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
