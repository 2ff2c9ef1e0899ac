"""Near-duplicate components by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts: distinct word shingles of a document as 64-bit hashes, 128 minima, 32 band keys of four minima
   each, and the low 4 bits of each minimum packed into 64 bytes. Equal sets become one node, so copies cost nothing later.
2. Band candidates: within a bucket of at most MOST_BUCKET nodes all pairs are compared by counting bits of the packed
   signatures, similarity corrected for chance agreement; pairs that reach the threshold less MARGIN are kept, and of these
   a spanning forest is emitted. A larger bucket emits one edge a node to its least node, if at least half of its nodes are
   like that one; a large bucket of unlike texts (that share a passage, say) is dealt anew by the next SPREAD bands of each
   node, where such texts part, up to MOST_DEPTH times. The candidate graph joins all pairs of a bucket that may be links,
   with few edges.
3. Candidate components become cells. In a cell, pairs are confirmed on full sets in order of estimated similarity, and pairs
   that are connected already are skipped. Large components are cut into blocks, each with the same few hubs; after that
   nodes outside the component's largest confirmed part meet the other blocks as signatures, and only nodes that have a
   likely partner there bring their texts. Work is linear in a group's size where the group has a centre, and no task holds
   more than a block. A group without one costs a comparison of 64 bytes for each pair of an outside node and another node.
4. Components of confirmed links. Pairs are never expanded, and nothing is collected to the driver. Joins on keys that many rows
   share (copies of a text, large groups, hubs) are dealt out (skew.py).

A link of similarity s shares no bucket with probability (1 - s^4)^32: 2e-10 at 0.85, 5e-8 at 0.8. An estimate errs by
more than MARGIN (over 5 standard deviations) about as rarely. A link whose buckets are all large and unlike is missed if none of
its shared bands is followed by another one within SPREAD, 1e-6 at most.

Defined cases: null text or text without words has the empty set and no links; fewer words than a shingle make one shingle
of them all; null ids take part but never name a component; repeated rows are equal texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, free, mix64, sub_batches, text_buffer
from nearfield.llm.components import components
from nearfield.llm.membership import Membership
from nearfield.llm.skew import join_hot

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
MARGIN = 0.2
MOST_BUCKET, SPREAD, MOST_DEPTH = 512, 8, 6
BLOCK, HUBS = 128, 16
BATCH_BYTES = 2 << 20
_RANDOM = np.random.default_rng(20240607)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1B
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text) for texts in one buffer; A-Z lower-cased."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_GAP[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & np.concatenate([~word[1:] | edge[1:-1], [True]])) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[flat]] * power[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, offsets = text_buffer(column)
    words, counts = word_hashes(flat, offsets)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * _PLACE[i]
    rolled = mix64(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            out.append(mix64((words[end - n : end] * _PLACE[:n]).sum(keepdims=True) * np.uint64(2) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def pack_bits(least: np.ndarray) -> bytes:
    """The low 4 bits of each minimum, two to a byte."""
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return mix64((rows * _PLACE[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS]).view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (uint64 words in the last axis), corrected for fields that agree by chance."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    schema = "doc_id long, doc_key string, set_id binary, n_shingles long, signature binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sub_batches(whole, "text", BATCH_BYTES):
                ids, sizes, packed, bands = [], [], [], []
                for s in shingle_sets(b.column("text"), width):
                    sizes.append(len(s))
                    if len(s):
                        least = minima(s)
                        ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        packed.append(pack_bits(least))
                        bands.append(band_keys(least))
                    else:
                        ids.append(None)
                        packed.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("doc_key"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "doc_key", "set_id", "n_shingles", "signature", "bands"],
                )

    return docs.select("doc_id", "doc_key", "text").mapInArrow(run, schema)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix joins, one fewer than nodes of each part."""
    seen, edges = np.zeros(len(near), bool), []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & ~seen).tolist():
                seen[j] = True
                edges.append((i, j))
                front.append(j)
    return edges


def _bucket_edges(members: DataFrame, least: float) -> DataFrame:
    """members(key, node, signature), rows of a key together in a partition -> candidate edges."""

    def groups(keys: np.ndarray, nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        pair = starts[sizes == 2]
        good = pair[estimate(words[pair], words[pair + 1]) >= least] if len(pair) else pair
        left, right = [nodes[good]], [nodes[good + 1]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = words[at : at + n]
            near = np.stack([estimate(own[i], own) >= least for i in range(n)])
            if edges := _forest(near):
                i, j = np.array(edges).T
                left.append(nodes[at + i])
                right.append(nodes[at + j])
        a, b = np.concatenate(left), np.concatenate(right)
        unique = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return unique[0], unique[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _then_none(batches):
            if b is None:
                keys, nodes, words = rest if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 8), np.uint64))
                cut_at = len(keys)
            else:
                keys, nodes = np.asarray(b.column(0)), np.asarray(b.column(1))
                words = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, MINIMA * BITS // 64)
                if rest:
                    keys, nodes, words = np.concatenate([rest[0], keys]), np.concatenate([rest[1], nodes]), np.concatenate([rest[2], words])
                cut_at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut_at:
                a, z = groups(keys[:cut_at], nodes[:cut_at], words[:cut_at])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
            rest = (keys[cut_at:], nodes[cut_at:], words[cut_at:])

    return members.mapInArrow(run, "a long, b long")


def _then_none(items):
    yield from items
    yield None


def _buckets(rows: DataFrame) -> DataFrame:
    """rows(key, node, ...) of keys with several nodes, with their number n and the least node lo; written."""
    full = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo")).filter("n > 1"), "full")
    members = cut(join_hot(rows, full, "key", counts=full), "members")
    free(full)
    return members


def _likely(rows: DataFrame, least: float) -> DataFrame:
    """rows(key, signature, other) -> (key, like): whether two signatures may be those of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (_signature_words(b.column(i)) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(estimate(one, two) >= least)], names=["key", "like"])

    return rows.select("key", "signature", "other").mapInArrow(run, "key long, like boolean")


def _signature_words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, MINIMA * BITS // 64)


def _stars(members: DataFrame) -> DataFrame:
    return members.filter((F.col("n") > MOST_BUCKET) & (F.col("node") > F.col("lo"))).select(F.col("node").alias("a"), F.col("lo").alias("b"))


def _pairs(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    small = members.filter(F.col("n") <= MOST_BUCKET).select("key", "node").join(nodes.select("node", "signature"), "node")
    return _bucket_edges(small.select("key", "node", "signature").repartition("key").sortWithinPartitions("key"), least)


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the candidate graph, written."""
    parts, made, dealt = [], [], []
    members = _buckets(nodes.select(F.posexplode("bands").alias("band", "key"), "node"))
    for depth in range(MOST_DEPTH + 1):
        dealt.append(members.select("key", "node", "n"))
        big = cut(members.filter(F.col("n") > MOST_BUCKET), "big")
        made += [members, big]
        if big.isEmpty():
            break
        if depth == MOST_DEPTH:
            parts.append(_stars(big))
            break
        signed = cut(big.select("key", "node", "lo").join(nodes.select("node", "signature"), "node").select("key", "lo", "signature"), "signed")
        tops = big.select("lo").distinct().join(nodes.select(F.col("node").alias("lo"), F.col("signature").alias("other")), "lo")
        alike = _likely(join_hot(signed, tops, "lo"), least).groupBy("key").agg((F.avg(F.col("like").cast("double")) >= 0.5).alias("alike"), F.count(F.lit(1)).alias("n"))
        alike = cut(alike, "alike")
        judged = cut(join_hot(big, alike.select("key", "alike"), "key", counts=alike), "judged")
        free(signed)
        parts.append(_stars(judged.filter("alike")))
        following = F.array(*[F.get("bands", F.pmod(F.col("band") + j, F.lit(BANDS))) for j in range(1, SPREAD + 1)])
        parted = judged.filter("NOT alike").select("key", "band", "node").join(nodes.select("node", "bands"), "node")
        parted = parted.select("node", "band", F.col("key").alias("first"), F.posexplode(following).alias("at", "next"))
        parted = cut(parted.select("node", F.pmod(F.col("band") + F.col("at") + 1, F.lit(BANDS)).alias("band"), F.xxhash64("first", "at", "next").alias("key")), "spread")
        members = _buckets(parted)
        made += [alike, judged, parted]
    # the buckets of all depths in one pass
    parts.append(_pairs(reduce(DataFrame.union, dealt), nodes, least))
    edges = cut(reduce(DataFrame.union, parts).distinct(), "candidates")
    free(*made)
    return edges


class _Union:
    def __init__(self, labels):
        self.up = list(range(len(labels)))
        first: dict = {}
        for i, label in enumerate(labels):
            if label is not None:
                self.join(i, first.setdefault(label, i))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def confirm_cell(nodes, sets: list[np.ndarray], words: np.ndarray, labels, old: np.ndarray, percent: int, least: float) -> list[tuple[int, int]]:
    """Confirmed edges that join all links of a cell. Pairs of two `old` members are skipped, as are those joined by labels."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    union = _Union(labels)
    pairs = []
    for i in range(n - 1):
        e = estimate(words[i], words[i + 1 :])
        z = sizes[i + 1 :]
        ok = (e >= least) & (np.minimum(z, sizes[i]) * 100 >= percent * np.maximum(z, sizes[i]))
        if old[i]:
            ok &= ~old[i + 1 :]
        j = np.flatnonzero(ok)
        if len(j):
            pairs.append(np.stack([np.full(len(j), i), j + i + 1, e[j]]))
    edges = []
    if pairs:
        i, j, e = np.concatenate(pairs, axis=1)
        for k in np.argsort(-e, kind="stable"):
            a, b = int(i[k]), int(j[k])
            if union.find(a) == union.find(b):
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
                edges.append((nodes[a], nodes[b]))
    return edges


def _confirm(cells: DataFrame, docs: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """cells(cell, node, doc_key, set_id, signature, label, old), written, with the texts of docs -> confirmed edges, written.

    Only texts of these nodes move, each once; that of a hub, which many cells have, is dealt out.
    """
    keys = cut(cells.select(F.xxhash64("doc_key").alias("key")).distinct(), "keys")
    asked = Membership(keys, "key")
    texts = docs.filter(asked.may_hold(F.xxhash64("doc_key"))).groupBy("doc_key").agg(F.first("text").alias("text"))
    both = join_hot(cells, texts, "doc_key")
    rows = both.select("cell", "node", "set_id", "signature", "label", "old", "text").repartition("cell").sortWithinPartitions("cell")

    def one(rows: list) -> list:
        known, kept = {}, []
        sets = shingle_sets(pa.array([r[5] for r in rows], pa.large_string()), width)
        for r, s in zip(rows, sets, strict=True):
            if r[0] not in known and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == r[1]:
                known[r[0]] = True
                kept.append((r, s))
        words = np.frombuffer(b"".join(r[2] for r, _ in kept), np.uint64).reshape(-1, MINIMA * BITS // 64)
        edges = confirm_cell([r[0] for r, _ in kept], [s for _, s in kept], words, [r[3] for r, _ in kept], np.array([r[4] for r, _ in kept], bool), percent, least)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for b in _then_none(batches):
            edges: list = []
            if b is None:
                edges += one(rows) if len(rows) > 1 else []
            else:
                for key, *row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                    if key != cell:
                        edges += one(rows) if len(rows) > 1 else []
                        cell, rows = key, []
                    rows.append(row)
            if edges:
                a, z = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    links = cut(rows.mapInArrow(run, "a long, b long"), "links")
    free(keys)
    asked.free()
    return links


def _partners(cells: DataFrame, least: float) -> DataFrame:
    """cells(cell, node, signature, label, old) -> (cell, node) of the nodes with a likely partner of another part in their cell."""

    def one(rows: list) -> list:
        words = np.frombuffer(b"".join(r[1] for r in rows), np.uint64).reshape(-1, MINIMA * BITS // 64)
        label, old = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], bool)
        found = np.zeros(len(rows), bool)
        for i in np.flatnonzero(~old):
            near = (estimate(words[i], words) >= least) & (label != label[i])
            found |= near
            found[i] |= near.any()
        return [rows[i][0] for i in np.flatnonzero(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for b in _then_none(batches):
            out: list = []
            if b is None:
                out += [(cell, n) for n in one(rows)] if rows else []
            else:
                for key, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if key != cell:
                        out += [(cell, n) for n in one(rows)] if rows else []
                        cell, rows = key, []
                    rows.append(row)
            if out:
                names, nodes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(nodes, pa.int64())], names=["cell", "node"])

    return cells.select("cell", "node", "signature", "label", "old").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell string, node long")


def _salted(column: str, seed: int):
    return F.xxhash64(column, F.lit(seed))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: sets of `width`-word shingles are linked where
    100 * intersection >= percent * union."""
    least = percent / 100 - MARGIN
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("doc_key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.xxhash64("text").cast("string")))
    rows = cut(_signatures(docs, width), "signatures")
    nodes = rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("doc_key").alias("doc_key"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    facts = nodes.select("node", "doc_key", "set_id", "signature")
    narrow = cut(rows.select("doc_id", "n_shingles", "set_id"), "sets")
    free(rows)
    candidates = _candidates(nodes, least)
    groups = cut(components(candidates), "groups")
    free(candidates)
    counts = cut(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "counts")
    sized = cut(join_hot(groups, counts, "label", counts=counts), "sized")
    free(groups, counts)
    nothing = F.lit(None).cast("long").alias("label")
    small = sized.filter(F.col("n") <= BLOCK).select(F.concat(F.lit("s"), F.col("label")).alias("cell"), "node", nothing, F.lit(False).alias("old"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = cut(sized.filter(F.col("n") > BLOCK).withColumn("block", F.pmod(_salted("node", 1), blocks).cast("int")), "large")
    hub = F.pmod(_salted("node", 2), F.ceil(F.col("n") / HUBS)) == 0
    first = large.select("label", "node", F.explode(F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("block"))).alias("block"))
    first = first.select(F.concat_ws("/", F.lit("b"), "label", "block").alias("cell"), "node", nothing, F.lit(False).alias("old"))
    cells = cut(small.union(first).join(facts, "node"), "cells")
    links = _confirm(cells, docs, width, percent, least)
    free(sized, cells)
    if not large.isEmpty():
        more = _second_round(large, links, facts, docs, width, percent, least)
        links = cut(links.union(more), "links")
        free(more)
    parts = cut(components(links), "parts")
    named = cut(parts.join(nodes.select("node", "doc_id"), "node"), "named")
    counts = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "counts")
    named = join_hot(named, counts.select("label", "component_id"), "label", counts=counts).select("node", "component_id")
    sets = cut(nodes.select("node", "set_id", "doc_id", "n").join(named, "node", "left").select("set_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    free(nodes, large, parts, counts)
    full = join_hot(narrow, sets.select("set_id", "component_id"), "set_id", "left", counts=sets)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _second_round(large: DataFrame, links: DataFrame, facts: DataFrame, docs: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """Confirmed edges, written, of nodes of large groups outside their group's largest confirmed part, against all blocks of the group."""
    parts = cut(components(links).withColumnRenamed("label", "part"), "parts")
    state = cut(large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "state")
    sizes = state.groupBy("label", "part").agg(F.count(F.lit(1)).alias("k"))
    # of a group, its largest part and how many nodes are outside of it
    main = sizes.groupBy("label").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("n"))
    main = cut(main.select("label", F.col("top.part").alias("main"), (F.col("n") - F.col("top.k")).alias("outside"), "n"), "main")
    state = join_hot(state, main.filter("outside > 0").select("label", "main", "outside"), "label", counts=main)
    state = cut(state.withColumn("rows", F.ceil(F.col("outside") / BLOCK).cast("int")), "state")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cell = F.concat_ws("/", F.lit("r"), "label", "row", "block")
    common = ["node", F.col("part").alias("label")]
    every = state.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    lone = state.filter("part <> main").withColumn("row", F.pmod(_salted("node", 3), F.col("rows")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = every.select(cell.alias("cell"), *common, F.lit(True).alias("old")).union(lone.select(cell.alias("cell"), *common, F.lit(False).alias("old")))
    cells = cut(cells.groupBy("cell", "node", "label").agg(F.min("old").alias("old")).join(facts, "node"), "cells")
    met = cut(cells.join(_partners(cells, least), ["cell", "node"], "left_semi"), "met")
    free(parts, main, cells, state)
    links = _confirm(met, docs, width, percent, least)
    free(met)
    return links
