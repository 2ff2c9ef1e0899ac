import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import html_extract, langid, quality_pu, warc
from nearfield.llm.common import held_out

HEAD = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var x="</p><article>";</script></head><body>'


def text_of(page):
    blocks, _ = html_extract.read_blocks(page)
    zone = max([z for z, _ in blocks], default=0)
    return "\n".join(t for z, t in blocks if z == zone)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head</h1><p>One  &lt;b&gt;\n two<p><b>Three</b> &eacute;&nbsp;x<br>more</article>", "Head\nOne <b> two\nThree é x more"),
        ("<nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div><article><p>Text</p></article><footer>F</footer>", "Text"),
        ("<article><p>A</p><aside>side</aside><form><input>go</form><div class='share-bar'>s</div><p>B</p><section id='comments'><article><p>reader</p></article></section></article>", "A\nB"),
        ("<header>Site</header><main><p>Main</p></main><div class='cookie-notice'>Cookies</div>", "Main"),
        ("<main><p>outer</p><article><header><h1>In</h1></header><p>inner</p><footer>by</footer></article></main>", "In\ninner"),
        ("<nav>never closed<p>menu<article><p>Text</p></article>", "Text"),
        ("<article><!-- <p>no</p> --><p>a<script>b</script>c</p><p style='display: none'>x</p><p hidden>y</p></article>", "ac"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
        ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<div><p>no zone at all</p></div>", "no zone at all"),
        ("", ""),
    ],
)
def test_zones_and_blocks(body, want):
    assert text_of(HEAD + body if body else "") == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_places_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = html_extract.shared_places(a, b)
        assert got == sorted(set(got)) and len(got) == lcs(a, b)
        it = iter(b)
        assert all(any(x == a[i] for x in it) for i in got)


def test_template_lines_of_neighbours_are_deleted(spark):
    page = lambda n: f"<div>Site name</div><div>All news</div><p>Story {n} begins</p><p>Story {n} ends</p><div>Imprint</div>"
    rows = [(i, f"http://H.example/news/{i}.html?x={i}", page(i), "e") for i in range(40)]
    rows += [(100, "http://other.example/", page(100), "e"), (101, "http://h.example/news/7.html#top", page(7), "e")]
    rows += [(102, None, None, "e"), (None, "http://h.example/a/", f"<article><p>{'long ' * 50_000}</p></article>", "e"), (103, "http://b.example/news/8.html", "<article><p>Site name</p></article>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows)
    for i in [*range(40)]:
        assert got[i]["text"] == f"Story {i} begins\nStory {i} ends" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[101]["text"] == "Story 7 begins\nStory 7 ends"
    assert got[100]["text"].startswith("Site name") and got[102]["text"] == "" and got[103]["text"] == "Site name"
    assert got[None]["n_chars"] == 5 * 50_000 - 1
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_grams(text):
    code = lambda c: (ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % 37) if c.isalpha() else 0
    n, word = Counter(), []
    for c in [*text, " "]:
        if code(c):
            word.append(code(c))
        elif word:
            padded = [0, *word, 0]
            n.update(word)
            n.update(a * 64 + b for a, b in zip(padded, padded[1:]))
            n.update((a * 64 + b) * 64 + c for a, b, c in zip(padded, padded[1:], padded[2:]))
            word = []
    return n


def test_grams_and_ranks_match_brute_force():
    for text in ["", "1 2", "The cat. the CAT", "Ünï x é", "a", "ab12cd\n" * 40, "日本語の文章です", "word " * 3000]:
        grams, counts = langid.gram_counts(text)
        want = brute_grams(text)
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want
        assert langid.top_grams(grams, counts).tolist() == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[: langid.RANKS]]


def test_out_of_place_distance():
    ranks = np.full((2, langid.GRAMS), langid.RANKS, np.int16)
    ranks[0, [5, 6]] = [0, 1]
    ranks[1, [6]] = [0]
    assert langid.distances(np.array([6, 5, 9]), ranks).tolist() == [1 + 1 + langid.RANKS, 0 + 2 * langid.RANKS]


def test_languages_of_held_out_documents(spark, data):
    df = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (50_000, "", "en"), (50_001, "12 34!", "en"), (50_002, "Th " * 50_000, None)], "doc_id long, text string, lang string")
    both = df.select("doc_id", "text", "lang").unionByName(odd)
    got = langid.label(both).join(both.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == both.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (None, 50_000, 50_001)} == {"und"}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in unseen]) > 0.98
    blind = langid.label(both.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert blind.filter("lang_pred = 'xx'").count() == 0
    assert langid.label(both.limit(0)).count() == 0
    assert langid.label(both.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_quality_of_held_out_documents(spark, data):
    base = data.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").filter("doc_id < 4000")
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")
    odd = spark.createDataFrame([(None, None), (900_001, ""), (900_002, "x" * 300_000), (900_002, "x" * 300_000)], "doc_id long, text string")
    got = quality_pu.score(docs.union(odd), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    unseen = [(r["quality"], r["score"]) for r in got if r["held_out"] and r["quality"] is not None]
    good, bad = ([s for q, s in unseen if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.7) == (q == 1) for q, s in unseen]) > 0.94
    nothing = quality_pu.score(docs.limit(5), labels.limit(0)).collect()
    assert [r["score"] for r in nothing] == [0.5] * 5
    assert quality_pu.score(docs.limit(0), labels).count() == 0


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p = rng.normal(1, 1, (3000, quality_pu.WIDTH))
    u = np.concatenate([rng.normal(1, 1, (2100, quality_pu.WIDTH)), rng.normal(-1, 1, (900, quality_pu.WIDTH))])
    rng.shuffle(u)
    assert abs(quality_pu.estimate_prior(p, u) - 0.7) < 0.05


PAGES = [
    (5, "http://a.example/1", "x" * 150),
    (3, "http://a.example/2", "x" * 150),
    (9, "http://a.example/3", "x" * 150),
    (9, "http://a.example/3", "x" * 150),
    (1, "http://a.example/4", "short"),
    (2, "http://a.example/5", "short"),
    (4, None, None),
    (6, "bad\r\nurl", "WARC/1.0\r\nWARC-Type: response\r\n\r\n" + "é\r\n\r\n" * 60),
    (None, "http://a.example/n", "y" * 120),
    (8, "http://a.example/8", "y" * 120),
    (7, "http://a.example/7", "z" * 400_000),
]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*r, "t") for r in PAGES], "page_id long, url string, html string, type string").repartition(3)
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(df).collect())
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 else page_id
        revisit = first != page_id
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == Counter(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_captures_are_nested_and_hold_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, f"{tmp_path}/w")
    rows = warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r["request"]["type"], r["metadata"]["type"]) == ("request", "metadata") and r["response"]["http_status"] == 200
        if r["metadata"]["page_id"] == 6:
            assert bytes(r["response"]["payload"]) == PAGES[7][2].encode() and r["response"]["target_uri"] == "badurl"


def test_lone_records_and_broken_archives(spark):
    records = spark.createDataFrame(
        [("<m>", "metadata", "<r>"), ("<q>", "request", "<r>"), ("<s>", "response", None), ("<t>", "metadata", "<gone>")], "record_id string, type string, concurrent_to string"
    )
    got = {r["capture_id"]: (r["request"], r["response"], r["metadata"]) for r in warc.assemble(records).collect()}
    assert set(got) == {"<r>", "<s>", "<gone>"}
    assert got["<r>"][1] is None and got["<r>"][0] is not None and got["<s>"][0] is None and got["<gone>"][2] is not None
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(record))
    with pytest.raises(ValueError, match="short"):
        list(warc.parse(record[:-8]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"junk\r\n\r\n"))


def test_archives_with_a_gzip_member_a_record(spark, tmp_path):
    import gzip

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, f"{tmp_path}/w")
    whole = b"".join(b"".join(warc.inflate(f.read_bytes())) for f in sorted((tmp_path / "w").glob("*.gz")))
    records = re.split(rb"(?=WARC/1.0\r\nWARC-Type: \w+\r\nWARC-Record-ID: <urn)", whole)[1:]
    assert len(records) == 3 * len(PAGES)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records) + bytes(512))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.warc").write_bytes(whole)
    want = Counter(tuple(r) for r in warc.resolve(warc.assemble(warc.read_records(spark, f"{tmp_path}/w"))).collect())
    assert sum(want.values()) == len(PAGES)
    for form in "mp":
        assert Counter(tuple(r) for r in warc.resolve(warc.assemble(warc.read_records(spark, f"{tmp_path}/{form}"))).collect()) == want
    with pytest.raises(ValueError, match="member"):
        list(warc.parse(gzip.compress(records[0])[:-12]))
    assert [len(x) for x in warc.inflate(gzip.compress(bytes(5 << 20)))] == [1 << 20] * 5


def test_training_samples_are_exact_and_never_empty(spark):
    rows = spark.createDataFrame([(i if i % 3 else None, [float(i % 50 + k) for k in range(quality_pu.WIDTH)]) for i in range(3000)], "doc_id long, f array<float>")
    for most in (1, 10, 3000, 9000):
        got = quality_pu._bounded(rows, most)
        assert got.shape == (min(most, 3000), quality_pu.WIDTH) and (got == quality_pu._bounded(rows.repartition(5), most)).all()
    assert quality_pu._bounded(rows.limit(0), 10).shape == (0, quality_pu.WIDTH)


def test_hostile_and_odd_markup():
    import time

    for page in ('<a "' * 60_000, "<div '" * 30_000 + ">", "<script " * 60_000, "<!--" * 60_000, "<" * 200_000, "<p>" * 60_000):
        began = time.perf_counter()
        html_extract.read_blocks(page)
        assert time.perf_counter() - began < 6
    assert text_of('<div>menu</div><div role="main"><div>one</div><p>two</p></div><p>after</p>') == "one\ntwo"
    assert text_of("<article><p><a href=/x/>word</a> more</p><div/>rest</article><p>out</p>") == "word more\nrest"
    assert text_of('<article><p title="a > b">in</p><p data-x="never closed>still</p></article>') == "in\nstill"


def test_alignment_is_a_longest_common_subsequence_at_any_length():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        got = html_extract.shared_places(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == table[0][0] and all(a[i] in rest for i in got)
    a = [rng.randrange(3000) for _ in range(20_000)]
    assert html_extract.shared_places(a, a[:7000] + [-1] + a[9000:]) == [*range(7000), *range(9000, 20_000)]


def test_main_loses_the_lines_of_the_site(spark):
    page = lambda k: f"<body><div>menu</div><main><p>All rights are with the house.</p><p>own text {k}</p></main></body>"
    df = spark.createDataFrame([(k, f"http://h.example/a/{k}", page(k)) for k in range(4)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {k: f"own text {k}" for k in range(4)}
