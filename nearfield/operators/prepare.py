"""Projections of vectors: normalise, rotate, quantise; one Arrow pass each, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions import kernels as K
from nearfield.plans.config import IndexConfig


@dataclass(frozen=True)
class Quantizer:
    """8-bit scalar quantisation with one base and scale for all components."""

    base: float
    scale: float

    @staticmethod
    def fit(vectors: DataFrame, column: str = "embedding") -> Quantizer:
        """From the least and greatest component of all rows: one aggregation with partial results."""
        r = vectors.agg(F.min(F.array_min(column)).alias("lo"), F.max(F.array_max(column)).alias("hi")).first()
        if r["lo"] is None:
            return Quantizer(0.0, 1.0)
        lo, hi = float(r["lo"]), float(r["hi"])
        return Quantizer(lo, 255.0 / (hi - lo) if hi > lo else 1.0)


def check_vectors(vectors: DataFrame, dimensions: int, column: str = "embedding") -> None:
    bad = vectors.filter(~F.coalesce(D.valid(F.col(column), dimensions), F.lit(False))).limit(1).count()
    if bad:
        raise ValueError(f"vectors must have {dimensions} components, none of them null or NaN")


def rotation(config: IndexConfig) -> np.ndarray | None:
    if config.rotation == "none":
        return None
    make = K.dct_matrix if config.rotation == "dct" else K.rotation_matrix
    return make(config.num_dimensions, config.seed)


def prepare_rows(rows: np.ndarray, config: IndexConfig, matrix: np.ndarray | None) -> np.ndarray:
    rows = rows.astype(np.float32)
    if config.normalizes:
        rows = K.unit(rows)
    return rows if matrix is None else rows @ matrix


def prepare(vectors: DataFrame, config: IndexConfig, key: str = "vec_id") -> DataFrame:
    """key and embedding, normalised where the configuration says so, and rotated."""
    matrix = rotation(config)
    sent = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = prepare_rows(K.matrix(b.column(1), config.num_dimensions), config, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), K.lists(rows, pa.float32())], names=[key, "embedding"])

    return vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"{key} long, embedding array<float>")
