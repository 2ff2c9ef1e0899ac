"""Helpers shared by the training-data operators: keys, byte buffers, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.plans.scratch import cut, free, scratch_path

__all__ = ["ascii_lower", "cut", "free", "fresh", "held_out", "mix64", "scratch_path", "sub_batches", "text_buffer", "without_places"]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as keep them apart from taken ones, in any case of letters."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while (name := "_" + name).lower() in used:
            pass
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(column):
    """Lower-case A-Z only. Texts of ASCII alone take lower(), which has a fast path; others go letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def held_out(doc_id):
    """True where crc32 of the id as text leaves 2 on division by 4; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def without_places(lines: Column, places: Column) -> Column:
    """The entries of an array but for those at the given places. Both are bound once, so the work is in proportion."""
    bound = F.array(F.struct(lines.alias("lines"), places.alias("places")))
    rest = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["places"]), lambda i: F.get(s["lines"], i))
    return F.flatten(F.transform(bound, rest))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def sub_batches(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Slices of the batch whose texts hold at most most_bytes together (one row at least)."""
    sizes = np.asarray(pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
