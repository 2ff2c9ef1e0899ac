"""Vector files: raw float32, query files with a count, ground truth, filter ids; and Parquet in place of what needs a library.

Fixed-width binary files are read by Spark as records, so a file of any size is split over tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import kernels as K


def vectors(df: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """vec_id long, embedding array<float> of any table with such columns."""
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding_col).cast("array<float>").alias("embedding"))


def from_matrix(spark: SparkSession, rows, ids=None) -> DataFrame:
    """A matrix in memory as vec_id, embedding; ids count from 0 where none are given."""
    rows = np.ascontiguousarray(rows, dtype=np.float32)
    if rows.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    ids = np.arange(len(rows)) if ids is None else np.asarray(ids)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": K.lists(rows, pa.float32())})
    return spark.createDataFrame(table)


def read_float_file(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """A headerless row-major float32 file; vec_id is the row's place."""
    records = spark.sparkContext.binaryRecords(path, 4 * dimensions)
    numbered = records.zipWithIndex().map(lambda x: (x[1], bytes(x[0])))
    raw = spark.createDataFrame(numbered, "vec_id long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4").reshape(-1, dimensions)
            yield pa.RecordBatch.from_arrays([b.column(0), K.lists(rows, pa.float32())], names=["vec_id", "embedding"])

    return raw.mapInArrow(run, "vec_id long, embedding array<float>")


def _whole(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    """A query file: a count, then float32 rows. Queries are few; the file is read whole."""
    data = _whole(spark, path)
    (n,) = struct.unpack_from("<I", data)
    rows = np.frombuffer(data, "<f4", offset=4).reshape(n, -1)
    return from_matrix(spark, rows).withColumnRenamed("vec_id", "query_id")


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """A filter file: a count, then uint32 ids."""
    data = _whole(spark, path)
    (n,) = struct.unpack_from("<I", data)
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.frombuffer(data, "<u4", count=n, offset=4).astype(np.int64))}))


def query_file_bytes(rows: np.ndarray) -> bytes:
    rows = np.ascontiguousarray(rows, dtype="<f4")
    return struct.pack("<I", len(rows)) + rows.tobytes()


def write_truth(truth: DataFrame, path: str) -> None:
    """Ground truth (query_id, rank, vec_id, distance) as Parquet."""
    truth.write.mode("overwrite").parquet(path)


def read_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """{query: [ids, nearest first]} as query_id, rank, vec_id."""
    found = json.loads(_whole(spark, path))
    rows = [(int(q), rank, int(v)) for q, ids in found.items() for rank, v in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, vec_id long")


def write_results(rows: DataFrame, path: str) -> None:
    """Append result rows to a folder of CSV files."""
    rows.write.mode("append").option("header", True).csv(path)


def sample_ids(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n vec_ids drawn uniformly, the same ones whatever the partitions: those of the least hashes."""
    key = F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit(str(seed))).cast("binary"))
    return rows.select("vec_id").orderBy(key, "vec_id").limit(n)


def share_ids(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """vec_ids of which each is drawn with a probability, by its hash."""
    return rows.select("vec_id").filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < round(share * (1 << 40)))


def random_vectors(spark: SparkSession, rows: int, dimensions: int, seed: int = 0, groups: int = 0, spread: float = 0.25) -> DataFrame:
    """vec_id, embedding: normal vectors, or with groups normal clouds around that many centres. A row depends on its id and the
    seed alone; blocks of 1,024 rows are made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.random.default_rng(seed).standard_normal((groups, dimensions)) if groups else None
        for b in batches:
            for block in b.column(0).to_pylist():
                random = np.random.default_rng([seed, block + 1])
                data = random.standard_normal((1024, dimensions))
                if centres is not None:
                    data = centres[random.integers(0, groups, 1024)] + spread * data
                ids = np.arange(block * 1024, min(rows, (block + 1) * 1024))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), K.lists(data[: len(ids)].astype(np.float32), pa.float32())], names=["vec_id", "embedding"])

    return spark.range(-(-rows // 1024)).mapInArrow(run, "vec_id long, embedding array<float>")
