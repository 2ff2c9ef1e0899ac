"""Exact deduplication with a minimal perfect hash over historical distinct digests.

The history (distinct 32-byte digests, each with the locator of its winner and its count) is cut by digest into shards of
bounded size. Each shard gets a minimal perfect hash by hash-and-displace: digests fall into small buckets, and a bucket's
displacement sends its digests to free slots, so n digests take n slots and about 1 byte a digest of displacements. A slot
holds the full digest and the locator; a lookup compares all 32 bytes, so a digest outside the history is always seen.
Batches are looked up as distinct digests: one task gets one shard and the batch's digests of that shard; the greater side sets
the number of shards, so both are bounded.

dedup_documents() takes the rows with the greater half of the ids as the history, whose winners therefore stay, and the others as
the batch: members among the batch are found by the hash alone and add to their slot's count, nonmembers are grouped separately.

Defined cases: null text is empty text; of rows with one text and one doc_id each is marked alike; null ids never win over
others; an empty history makes every digest a nonmember; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, free, mix64
from nearfield.llm.skew import join_hot

SHARD_DIGESTS = 20_000
BUCKET_DIGESTS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
INDEX = "shard int, size long, displacements binary, digests binary, locators binary, counts binary, has_locator binary"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8 after lower-casing A-Z. One Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.ascii_lower(b.column(1).fill_null("")).cast(pa.large_binary())
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in text]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, digest binary")


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _slots(base: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    return (mix64(base + displacement.astype(np.uint64) * _STEP) % np.uint64(size)).astype(np.int64)


def build_mph(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacements by bucket, slot of each digest) of a minimal perfect hash over distinct digests.

    Buckets are placed from the largest to the smallest. A bucket of one digest takes the next free slot directly, which
    its displacement tells as -(slot + 1).
    """
    n = len(digests)
    words = _words(digests)
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    bucket = (words[:, 1] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    displacements = np.zeros(buckets, np.int32)
    slots = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    tries = np.arange(64, dtype=np.uint64)[:, None]
    singles = []
    for b in np.argsort(-sizes, kind="stable"):
        k = sizes[b]
        if k == 0:
            break
        own = order[starts[b] : starts[b] + k]
        if k == 1:
            singles.append((b, own[0]))
            continue
        at = 0
        while True:
            found = _slots(words[own, 2][None, :], tries + np.uint64(at), n)
            good = ~taken[found].any(axis=1)
            if k > 1:
                ordered = np.sort(found, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                d = int(np.argmax(good))
                displacements[b] = at + d
                slots[own] = found[d]
                taken[found[d]] = True
                break
            at += len(tries)
    for (b, i), slot in zip(singles, np.flatnonzero(~taken), strict=True):
        displacements[b] = -(slot + 1)
        slots[i] = slot
    return displacements, slots


def lookup_mph(displacements: np.ndarray, size: int, digests: list[bytes]) -> np.ndarray:
    """The one slot where each digest can be; the caller compares its bytes."""
    words = _words(digests)
    d = displacements[(words[:, 1] % np.uint64(len(displacements))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _slots(words[:, 2], np.maximum(d, 0), size))


def _shard(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard from history(digest, locator, n), whose digests are distinct."""

    def run(key, rows):
        digests = [bytes(x) for x in rows["digest"]]
        displacements, slots = build_mph(digests)
        order = np.argsort(slots)
        has = rows["locator"].notna().to_numpy()
        locators = np.array([0 if pd.isna(x) else int(x) for x in rows["locator"]], dtype="<i8")[order]
        return pd.DataFrame([[rows["shard"].iloc[0], len(rows), displacements.astype("<i4").tobytes(), b"".join(digests[i] for i in order), locators.tobytes(), rows["n"].to_numpy(dtype="<i8")[order].tobytes(), has[order].astype(np.uint8).tobytes()]], columns=["shard", "size", "displacements", "digests", "locators", "counts", "has_locator"])

    return history.select("digest", "locator", "n", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(run, INDEX)


class Shard:
    """A shard of the index in memory: digests, locators (with a mark of those that are not null) and counts by slot."""

    def __init__(self, row):
        self.size, self.held = int(row["size"]), bytes(row["digests"])
        self.displacements = np.frombuffer(row["displacements"], "<i4")
        self.locators, self.counts = np.frombuffer(row["locators"], "<i8").copy(), np.frombuffer(row["counts"], "<i8").copy()
        self.has = np.frombuffer(row["has_locator"], np.uint8).astype(bool)

    def find(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether the slot holds this very digest) of each digest."""
        slots = lookup_mph(self.displacements, self.size, digests)
        return slots, np.array([self.held[32 * k : 32 * k + 32] == d for k, d in zip(slots.tolist(), digests, strict=True)], dtype=bool)


def _found(digests: list[bytes], member, locators: np.ndarray, has: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None) -> pd.DataFrame:
    n = pd.array(counts, dtype="Int64")
    if known is not None:
        n[~known] = pd.NA
    where = pd.array(locators, dtype="Int64")
    where[~has] = pd.NA
    return pd.DataFrame({"digest": digests, "member": member, "locator": where, "n": n})


def lookup(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """batch(digest, ...) of distinct digests -> digest, member, locator, n (null for nonmembers)."""

    def run(key, rows, shard):
        digests = [bytes(x) for x in rows["digest"]]
        if not len(shard) or not len(rows):
            none = np.zeros(len(rows), bool)
            return _found(digests, none, np.zeros(len(rows), np.int64), none, np.zeros(len(rows), np.int64), none)
        s = Shard(shard.iloc[0])
        slots, same = s.find(digests)
        return _found(digests, same, s.locators[slots], same & s.has[slots], s.counts[slots], same)

    left = batch.select("digest", _shard(shards).alias("shard")).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInPandas(run, "digest binary, member boolean, locator long, n long")


def absorb(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """batch(digest, locator, n) of distinct digests added to an index: digest, member, locator, n of every digest of either.

    Members add their count to their slot, and their locator counts if it is greater; nonmembers come as they are, with member
    false. Digests of the index that the batch lacks come from their slots.
    """

    def run(key, rows, shard):
        digests = [bytes(x) for x in rows["digest"]]
        has = rows["locator"].notna().to_numpy(dtype=bool)
        locators = rows["locator"].fillna(0).to_numpy(dtype=np.int64)
        counts = rows["n"].to_numpy(dtype=np.int64)
        if not len(shard):
            return _found(digests, False, locators, has, counts)
        s = Shard(shard.iloc[0])
        slots, same = s.find(digests) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, bool))
        own = slots[same]
        s.counts[own] += counts[same]
        better = has[same] & (~s.has[own] | (locators[same] > s.locators[own]))
        s.locators[own] = np.where(better, locators[same], s.locators[own])
        s.has[own] |= has[same]
        held = [s.held[32 * k : 32 * k + 32] for k in range(s.size)]
        new = [d for d, known in zip(digests, same.tolist(), strict=True) if not known]
        return _found(held + new, np.arange(s.size + len(new)) < s.size, np.concatenate([s.locators, locators[~same]]), np.concatenate([s.has, has[~same]]), np.concatenate([s.counts, counts[~same]]))

    left = batch.select("digest", "locator", "n", _shard(shards).alias("shard")).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInPandas(run, "digest binary, member boolean, locator long, n long")


def history_of(keys: DataFrame) -> DataFrame:
    """The distinct digests of keys(doc_id, digest) with the largest id as locator and the number of rows; partial sums first."""
    return keys.groupBy("digest").agg(F.max("doc_id").alias("locator"), F.count(F.lit(1)).alias("n"))


def deduplicate(keys: DataFrame, history: DataFrame) -> DataFrame:
    """keys(doc_id, digest) resolved against history(digest, locator, n): digest, keep_id, group_size, member by distinct digest.

    Members take winner and count of their slot; nonmembers are grouped among themselves.
    """
    own = cut(history_of(keys), "own")
    # both sides of the lookup are dealt by shard, so the greater one decides
    shards = shards_for(history, own)
    index = cut(build_index(history, shards), "mph")
    found = lookup(own, index, shards)
    return own.join(found.withColumnRenamed("locator", "winner").withColumnRenamed("n", "winner_n"), "digest").select(
        "digest",
        F.when(F.col("member"), F.col("winner")).otherwise(F.col("locator")).alias("keep_id"),
        F.when(F.col("member"), F.col("winner_n")).otherwise(F.col("n")).alias("group_size"),
        "member",
    )


def shards_for(history: DataFrame, batch: DataFrame) -> int:
    return max(1, -(-max(history.count(), batch.count()) // SHARD_DIGESTS))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row a document: of those with the greater half of the ids, all distinct digests are the history; the others are looked up."""
    keys = cut(text_digests(docs), "digests")
    middle = keys.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.col("doc_id") >= F.lit(middle)
    history = cut(history_of(keys.filter(F.coalesce(old, F.lit(False)))), "history")
    batch = cut(history_of(keys.filter(~F.coalesce(old, F.lit(False)))), "batch")
    shards = shards_for(history, batch)
    index = cut(build_index(history, shards), "mph")
    resolved = cut(absorb(batch, index, shards), "resolved")
    free(history, batch, index)
    return join_hot(keys, resolved, "digest", counts=resolved).select(
        "doc_id",
        F.col("locator").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("locator")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
