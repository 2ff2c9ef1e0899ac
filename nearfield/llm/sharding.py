"""Sharding by weighted rendezvous hashing.

Every shard i scores a key by -ln(u(key, i)) / weight(i), u uniform in (0, 1) from MD5; the least score wins. A shard that
is added competes with its own score only, so rows move into it and nowhere else; a shard of twice the weight gets twice
the rows. The choice needs the key and the weights alone: no shuffle, no state.

Defined cases: a null key is the key "null"; null text has no bytes; rows with one key share a shard and get slots in order
of their content; an empty table gives an empty table; extra columns are kept, whatever their names, but for shard and slot,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut, fresh

#: Slots are counted in this many buckets a shard, so that no task has a whole shard. The offsets have shards * BUCKETS rows at most.
BUCKETS = 4096


def scores(key: Column, weights: Sequence[float]) -> Column:
    """An array with (score, shard) of every shard for a key. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and positive weights only")
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard["i"].cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / shard["w"]).alias("score"), shard["i"].alias("shard"))

    return F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]), score)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key."""
    return F.array_min(scores(key, weights))["shard"]


def shard(rows: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """rows with their column `shard`; no shuffle."""
    return rows.withColumn("shard", rendezvous(F.col(key), weights))


def with_slots(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in order of an MD5 bucket and then of `order`.

    Two passes: rows are counted by (shard, bucket), the counts' running sums are offsets, and each bucket numbers its own
    rows. The largest unit of work is a bucket, a 4096th of a shard.
    """
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    bucket, n, offset, row = fresh([*rows.columns, "slot"], "bucket", "n", "offset", "row")
    kept = [c for c in rows.columns if c.lower() != "slot"]
    rows = cut(rows.withColumn(bucket, F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("int")), "slots")
    counts = rows.groupBy(by, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(by, bucket).orderBy(*order)
    numbered = rows.withColumn(row, F.row_number().over(inside)).join(offsets, [by, bucket])
    return numbered.select(*kept, (F.col(offset) + F.col(row) - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of equal weight for documents keyed by doc_id, with slots and the shard that one shard more would give."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), scores(F.col("doc_id"), [1.0] * (shards + 1)).alias("scores"))
    rows = rows.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.array_min(F.slice("scores", 1, shards))["shard"].alias("shard"),
        F.array_min("scores")["shard"].alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
