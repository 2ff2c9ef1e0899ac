"""A filter that spares shuffles: rows that surely have no partner in a join needn't be moved.

The filter is a bitmap over hashed keys, made by one aggregation and used as a scalar subquery. It has 8 bits a key or more, up
to 2^MOST_BITS bits (8 MB) in all. It has no false negatives; where it is full it passes every row and the join behind it does
all the work. Results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, free

LEAST_BITS, MOST_BITS = 16, 26


class Membership:
    """The 64-bit hashed keys of a written table, roughly."""

    def __init__(self, keys: DataFrame, column: str):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
        bit = self._bit(F.col(column))
        words = keys.select(F.shiftright(bit, 6).alias("id"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(`{column}`, 7), {1 << self.bits}L) & 63 AS INT))").alias("w"))
        words = words.groupBy("id").agg(F.bit_or("w").alias("w"))
        every = keys.sparkSession.range(1 << (self.bits - 6)).join(words, "id", "left").select(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("s"))
        # as many entries as the bitmap has words, whatever the table holds
        self.table = cut(every.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["w"]).alias("words")), "bitmap")

    def _bit(self, key: Column) -> Column:
        return F.pmod(F.shiftright(key, 7), F.lit(1 << self.bits))

    def may_hold(self, key: Column) -> Column:
        bit = self._bit(key)
        word = F.element_at(self.table.select("words").scalar(), (F.shiftright(bit, 6) + 1).cast("int"))
        return F.coalesce(F.getbit(word, bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1, F.lit(False))

    def free(self) -> None:
        """Remove the bitmap; what asked it must have been written."""
        free(self.table)
