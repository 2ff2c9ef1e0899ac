"""Language identification by rank-order profiles (out-of-place distance).

A profile is the RANKS most frequent letter n-grams (1 to 3 letters, words padded with a separator) in rank order. A document
is compared with every language's profile: each of its own RANKS most frequent n-grams adds the difference of the two ranks,
or RANKS where the profile lacks it; the least sum wins. The score is the share of the greatest sum that the winner avoids.

Letters are lower-cased and folded to 63 codes: a to z by themselves, others by code point. N-grams of a text are counted in
one vectorised pass over the whole text. Profiles are learned from about `most_docs` documents a language (all, if it has
fewer), chosen by a hash of (id, text length): a bound, not a share of the corpus, and one count is all that the choice needs.

Defined cases: null text and text without a letter are `und` with score 0; ties go to the language that sorts first; documents
without a language are not learned from; where nothing can be learned every document is `und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import held_out

RANKS = 300
GRAMS = 64 * 64 * 64
MOST_DOCS = 1000


def _letter_codes() -> np.ndarray:
    codes = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            codes[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return codes


_codes: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """By code point: 0 for what is no letter, else 1 to 63. Made once a process."""
    if not _codes:
        _codes.append(_letter_codes())
    return _codes[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a text. A 1-gram is a letter, a 2- or 3-gram may begin or end with the separator (0)."""
    a = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] > 0) | (a[:-1] > 0)
    a = np.concatenate([[0], a[keep], [0]]).astype(np.int32)
    two = a[:-1] * 64 + a[1:]
    inner = a[1:-1] > 0
    three = (two[:-1] * 64 + a[2:])[inner]
    two = two[two > 0]
    grams = np.concatenate([a[a > 0], two, three])
    grams.sort()
    if not len(grams):
        return grams, grams
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def top_grams(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent n-grams, most frequent first, ties by n-gram."""
    if len(grams) > RANKS:
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        most = counts >= least
        grams, counts = grams[most], counts[most]
    return grams[np.lexsort((grams, -counts))][:RANKS]


def learn(docs: DataFrame, most_docs: int = MOST_DOCS) -> dict[str, list[int]]:
    """Profiles by language, from documents that are not held out and have a language."""
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20))
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    chosen = reduce(lambda a, b: a | b, [(F.col("lang") == k) & (part < math.ceil((1 << 20) * most_docs / n)) for k, n in sizes.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams, counts = gram_counts(text)
                if lang not in sums:
                    sums[lang] = np.zeros(GRAMS, np.int64)
                sums[lang][grams] += counts
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])], names=["lang", "gram", "n"])

    sums = known.filter(chosen).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_rank") <= RANKS)
    profiles: dict[str, list[int]] = {}
    for r in best.select("lang", "gram", "_rank").orderBy("lang", "_rank").collect():  # RANKS rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def distances(top: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Out-of-place distance of a document's ranked n-grams to each language; ranks: by (language, n-gram), RANKS if absent."""
    there = ranks[:, top].astype(np.int64)
    return np.where(there < RANKS, np.abs(there - np.arange(len(top))), RANKS).sum(axis=1)


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """All columns of docs with lang_pred and score. One Arrow pass, no shuffle."""
    langs = sorted(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.full((len(langs), GRAMS), RANKS, np.int16)
        for i, lang in enumerate(langs):
            ranks[i, profiles[lang]] = np.arange(len(profiles[lang]))
        for b in batches:
            found, scores = [], []
            for text in b.column(b.schema.get_field_index("text")):
                top = top_grams(*gram_counts(text.as_py() or ""))
                if not len(top) or not langs:
                    found.append("und")
                    scores.append(0.0)
                    continue
                d = distances(top, ranks)
                found.append(langs[int(np.argmin(d))])
                scores.append(1.0 - float(d.min()) / (RANKS * len(top)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def label(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, with profiles learned from the table's own languages."""
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
