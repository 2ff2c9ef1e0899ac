"""Joins in which one key may hold a third of all rows.

A key is hot if it holds over LEAST_HOT rows and over one in MOST_HOT of them, so there are MOST_HOT hot keys at most (or rows /
LEAST_HOT, in a small table): a proven bound, and the list of them is broadcast. Rows of a hot key are dealt over SALTS parts, and
its one row of the other side is repeated for each part. A table of up to LEAST_ROWS rows is less than one task's work as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import fresh

LEAST_HOT, MOST_HOT, SALTS, LEAST_ROWS = 256, 10_000, 256, 20_000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, how) with how inner or left; right has distinct keys. left is a written table; counts(key, n) are
    its rows by key, if they are known (no fewer than there are, and hot ones left in)."""
    total = left.count()
    if total <= LEAST_ROWS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    # rows of a null key join nothing
    found = counts.filter((F.col("n") > max(LEAST_HOT, total // MOST_HOT)) & F.col(key).isNotNull()).select(key).toArrow()
    if not found.num_rows:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(found)
    flag, salt = fresh([*left.columns, *right.columns], "hot", "salt")
    marked = F.broadcast(hot.withColumn(flag, F.lit(True)))
    # the salt is a row's place, so equal rows are dealt out, too
    one = left.join(marked, key, "left").withColumn(salt, F.when(F.col(flag), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)).drop(flag)
    every = F.when(F.col(flag), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    many = right.join(marked, key, "left").withColumn(salt, F.explode(every)).drop(flag)
    return one.join(many, [key, salt], how).drop(salt)
