"""A corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents, n_chars being that of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, langid, line_dedup, near_dedup, packing
from nearfield.llm.common import cut, free
from nearfield.llm.membership import Membership

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no letters) go; lang is what was found. Where there is nothing to learn from,
    documents with a letter stay as they are."""
    profiles = langid.learn(docs)
    if not profiles:
        return _documents(docs.filter(F.col("text").rlike(r"\p{L}")))
    return _documents(langid.identify(docs, profiles).filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template came before in another document go, and documents of which nothing is left."""
    return _documents(line_dedup.dedup_lines(docs).filter("n_dropped = 0 OR trim(text) <> ''"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id. Five-word shingles, similarity 0.8 or more.

    Rows with a null or repeated id come after the others of their group; of equal rows of one id and text, one is looked at.
    """
    rows = _numbered(docs)
    drop = near_dedup.near_duplicates(rows, width=5, percent=80, id_col="_id").filter("NOT kept").select(F.col("doc_id").alias("_id"))
    drop = cut(drop.withColumn("_key", F.xxhash64("_id")), "drop")
    # what is surely kept doesn't move
    maybe = Membership(drop, "_key").may_hold(F.xxhash64("_id"))
    return _documents(rows.filter(~maybe).union(rows.filter(maybe).join(drop.select("_id"), "_id", "left_anti").select(*rows.columns)))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a column _id that no two rows share: doc_id where that is a row's own, otherwise a number above all ids."""
    docs = docs.select(*COLUMNS)
    odd = cut(docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id", F.xxhash64("doc_id").alias("_key")), "odd")
    own = F.col("doc_id").cast("long").alias("_id")
    if odd.isEmpty():
        return docs.select("*", own)
    maybe = Membership(odd, "_key").may_hold(F.xxhash64("doc_id")) & F.col("doc_id").isNotNull()
    ids = odd.filter("doc_id IS NOT NULL").select("doc_id")
    alone = docs.filter(~maybe & F.col("doc_id").isNotNull()).union(docs.filter(maybe).join(ids, "doc_id", "left_anti"))
    shared = docs.filter("doc_id IS NULL").union(docs.filter(maybe).join(ids, "doc_id", "left_semi"))
    shared = shared.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    top = docs.agg(F.max("doc_id").cast("long")).first()[0]
    number = F.monotonically_increasing_id() + F.lit(-1 if top is None else top) + 1
    # written, so that the numbers stay what they are
    return cut(alone.select("*", own).union(shared.select(*COLUMNS, number.alias("_id"))), "numbered")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    return _documents(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Loss is borne by what follows a document's first line."""
    return packing.pack(docs.withColumn("share", packing.response_share(F.col("text"))), loss_col="share")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the tokenizer or the learned profiles; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, rows = rows, stage(spark, rows, sf_dir)
        if i + 1 < len(STAGES):
            rows = cut(rows, name)
            free(before)
    return rows
