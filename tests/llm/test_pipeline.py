from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import langid
from tests.llm.test_html_lang_quality_warc import brute_grams
from tests.llm.test_near_line_contamination import brute_hits, brute_near, oracle
from tests.llm.test_sharding_dedup_packing import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_languages(rows):
    """Ids of the documents that have a letter; profiles are not needed to reject."""
    return {i for i, t, *_ in rows if brute_grams(t or "")}


def test_stages_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame(
        [(100_000, None, "en", "s", 0), (100_001, "12 !", "en", "s", 4), (100_002, "Er in the of is. " * 3000, None, None, None), (100_003, "", "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rows = docs.unionByName(odd)
    before = [tuple(r) for r in rows.select(*COLUMNS).collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, data)
        assert out.columns == COLUMNS
        out = spark.createDataFrame(out.collect(), rows.select(*COLUMNS).schema)
        after = [tuple(r) for r in out.collect()]
        ids = {r[0] for r in after}
        pairs = [(r[0], r[1]) for r in before]
        if name == "language_id":
            assert ids == brute_languages(before)
        elif name == "line_dedup":
            want = {k[0]: k for k in oracle("op9_line_templates", pairs)}
            import hashlib

            assert ids == {i for i, k in want.items() if k[4]}
            assert all(hashlib.sha256((r[1] or "").encode()).hexdigest() == want[r[0]][3] for r in after)
        elif name == "minhash_near_dedup":
            assert ids == {k[0] for k in brute_near(pairs, 5, 80) if k[3]}
        else:
            assert ids == {k[0] for k in brute_hits(pairs, bench) if not k[4]}
        texts = dict(pairs)
        if name != "line_dedup":
            assert all(r[1] == texts[r[0]] for r in after)
        assert all(r[4] == len(r[1] or "") for r in after)
        rows, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, data).collect()
    assert check_pieces([(r[0], r[1]) for r in before], pieces) == 0


def test_run_gives_the_packed_pieces(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    got = corpus_pipeline.run(spark, data)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    by = Counter()
    for r in got.select("sequence_id", F.col("length").alias("n")).collect():
        by[r["sequence_id"]] += r["n"]
    assert by and max(by.values()) <= 2048


def test_profiles_rank_the_right_language():
    texts = {"en": "the cat and the dog in the house of that man", "fr": "le chat et le chien dans la maison de cet homme"}
    ranks = np.full((2, langid.GRAMS), langid.RANKS, np.int16)
    for i, t in enumerate(texts.values()):
        top = langid.top_grams(*langid.gram_counts(t))
        ranks[i, top] = np.arange(len(top))
    assert int(langid.distances(langid.top_grams(*langid.gram_counts("the man and that dog")), ranks).argmin()) == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    word = lambda k: "abcdefghij"[k // 10] + "abcdefghij"[k % 10]
    near, clean = " ".join(word(k) for k in range(60)), " ".join(word(99 - k) for k in range(30))
    other = " ".join(word(k) * 2 for k in range(40))
    rows = [(1, near), (2, near + " end"), (2, clean), (None, near), (None, near + " more"), (3, other), (3, other), (None, other), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    ids = got.pop((3, other), 0) + got.pop((None, other), 0)
    assert ids == 1
    assert got == Counter([(1, near), (2, clean), (4, None), (None, "")])


def test_language_reaches_the_output_and_nothing_goes_where_nothing_was_learned(spark):
    rows = [(i, "the cat and the dog in the house of that man", "en") for i in range(4)] + [(9, "le chat et le chien dans la maison de cet homme", "fr"), (10, "le chien dans la maison de cet homme et le chat", "fr")]
    make = lambda rows: spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = [(20, "the house of the man and that cat", "zz"), (21, "?! 12", "en"), (22, None, "en")]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, make(rows * 2 + odd), "").collect()}
    assert got[20] in ("en", "zz") and got[10] == "fr" and got[0] == "en" and not {21, 22} & set(got)
    none = [(i, t, None) for i, t, _ in rows + odd]
    left = corpus_pipeline.identify_language(spark, make(none), "").collect()
    assert {r["doc_id"] for r in left} == {i for i, *_ in rows} | {20} and all(r["lang"] is None for r in left)
