import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import components as cc
from nearfield.llm import decontaminate, line_dedup, near_dedup, registry

DOC = "doc_id long, text string, lang string, place long, node long, label string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "l", 3) for i, t in rows], DOC)


def brute_near(rows, width, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * (k := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min([x for x in groups[find(i)] if x is not None], default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return Counter(out)


def near_rows(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 4001, " ".join(own)))
    return rows


ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (None, "One two"), (9004, "one TWO"), (None, "zzz"), (9005, "one"), (9005, "one"), (9006, "w " * 30_000)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    rows = near_rows(120) + ODD
    got = near_dedup.near_duplicates(docs(spark, rows), width, percent).collect()
    assert Counter(tuple(r) for r in got) == brute_near(rows, width, percent)


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 24)
    monkeypatch.setattr(near_dedup, "HUBS", 3)
    monkeypatch.setattr(near_dedup, "MOST_BUCKET", 16)
    rng = random.Random(2)
    base = ["w%d" % i for i in range(90)]
    rows = []
    for i in range(160):  # a chain that drifts, and a star
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(90)] = "x%d" % rng.randrange(10_000)
        if i % 8 == 0:
            base[rng.randrange(90)] = "y%d" % i
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()
    assert Counter(tuple(r) for r in got) == brute_near(rows, 3, 85)


def test_unlike_texts_that_share_a_passage_make_no_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_BUCKET", 64)
    rng = random.Random(9)
    passage = " ".join("p%d" % i for i in range(60))
    rows = [(i, passage + " " + " ".join("x%d" % rng.randrange(10**9) for _ in range(55))) for i in range(2000)]
    rows += [(10_000 + i, rows[i][1] + " end") for i in range(0, 2000, 40)]
    bucketed = near_dedup._signatures(spark.createDataFrame([(i, str(i), t) for i, t in rows], "doc_id long, doc_key string, text string"), 3)
    nodes = near_dedup.cut(bucketed.select(F.monotonically_increasing_id().alias("node"), "signature", "bands"), "nodes")
    sizes = near_dedup._buckets(nodes.select(F.posexplode("bands").alias("band", "key"), "node"))
    assert sizes.agg(F.max("n")).first()[0] > 64
    assert near_dedup._candidates(nodes, 0.65).count() < 500
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_copies_and_hubs_are_dealt_out(spark, monkeypatch):
    from nearfield.llm import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 8)
    monkeypatch.setattr(skew, "SALTS", 4)
    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    monkeypatch.setattr(cc, "LEAST_ROWS", 0)
    rows = near_rows(60, 5) + ODD + [(20_000 + i if i % 2 else None, "one text that is here many times over") for i in range(200)] + [(30_000, "z" * 3_000_000)]
    got = near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()
    assert Counter(tuple(r) for r in got) == brute_near(rows, 3, 85)


def test_near_dedup_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for overlap in (0.5, 0.85, 1.0):
        shared = near_dedup.mix64(rng.integers(0, 1 << 60, 2000).astype(np.uint64))
        k = int(2000 * overlap)
        a = near_dedup.minima(shared)
        b = near_dedup.minima(np.concatenate([shared[:k], near_dedup.mix64(rng.integers(0, 1 << 60, 2000 - k).astype(np.uint64))]))
        true = k / (4000 - k)
        one, two = (np.frombuffer(near_dedup.pack_bits(x), np.uint64) for x in (a, b))
        assert abs(near_dedup.estimate(one, two[None])[0] - true) < 0.18
        assert len(near_dedup.pack_bits(a)) == 64


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + k) for k in range(1, 60)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    edges = [e for e in edges if e[0] != e[1]]
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_need_no_rounds(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(500), rng.randrange(500)) for _ in range(300)] + [(k + 1, k) for k in range(900, 999)] + [(2000 - k, 3000 + k) for k in range(50)] + [(2000 - k, 3001 + k) for k in range(50)]
    edges = spark.createDataFrame([e for e in pairs if e[0] != e[1]], "a long, b long")
    written, cut = [], cc.cut
    monkeypatch.setattr(cc, "cut", lambda df, what: written.append(what) or cut(df, what))
    got = {r["node"]: r["label"] for r in cc.components(edges).collect()}
    assert not written
    monkeypatch.setattr(cc, "MOST_LOCAL", 0)
    assert got == {r["node"]: r["label"] for r in cc.components(edges).collect()}
    assert "stars" in written


def test_buckets_of_all_depths_are_compared_in_one_pass(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" own{i}" * (i % 3)) for i in range(30)] + [(100 + i, f"the same start of all {i} {i * i} {i % 7} end") for i in range(30)]
    expected = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    calls, pairs = [], near_dedup._pairs
    monkeypatch.setattr(near_dedup, "_pairs", lambda *a: calls.append(a) or pairs(*a))
    monkeypatch.setattr(near_dedup, "MOST_BUCKET", 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()} == expected
    assert len(calls) == 1


def brute_hits(rows, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, t in rows:
        w, hit, named = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(10, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    named.add(item)
        named.discard(None)
        out.append((doc_id, len(w), len(hit), len(named), bool(hit)))
    return Counter(out)


def contaminated(seed=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é1", "a"]) if rng.random() < 0.5 else "w%d" % rng.randrange(40)
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 12, 10, 9, 3, 1, 0, 40])] + [(50, None), (51, "the the the"), (None, text(11)), (3, text(14))]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 60))]
        if i % 3 == 0:
            parts += [rng.choice(items)[1] or "", text(5)]
        rows.append((i, ", ".join(parts).upper() if i % 5 == 0 else "\n".join(parts)))
    return rows + [(None, None), (100, ""), (101, items[0][1]), (101, items[0][1])], items


def test_hits_match_brute_force(spark):
    rows, items = contaminated()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.measure(docs(spark, rows), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == brute_hits(rows, items)
    none = decontaminate.measure(docs(spark, rows), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.measure(docs(spark, rows).limit(0), bench).count() == 0


def test_hits_of_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rows, items = contaminated(7)
    rows += [(200, "the of " * 3000), (201, "x y " * 200_000)]
    items += [(60, "the the the the of"), (61, "the of the of the of the of the of the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.measure(docs(spark, rows), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == brute_hits(rows, items)


def test_decontamination_keeps_columns_of_any_name(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x a b c d", 7, 8, 9), (2, "a b", 7, 8, 9)], "doc_id long, text string, _text_hash int, _ID int, hit int")
    for remove, want in (("documents", {(2, "a b", 7, 8, 9)}), ("spans", {(1, "x ", 7, 8, 9), (2, "a b", 7, 8, 9)})):
        got = decontaminate.decontaminate(df, bench, remove=remove)
        assert got.columns == df.columns and {(r[0], r[1].strip() + " " * (r[0] == 1), *r[2:]) for r in got.collect()} == want


def test_contaminated_documents_and_spans_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "Before it. ONE two, three four five six seven eight nine ten! After it."), (2, "one two three"), (None, item), (3, None)]
    df = docs(spark, rows)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert cut == {1: "Before it. ! After it.", 2: "one two three", None: "", 3: None}
    assert decontaminate.measure(decontaminate.decontaminate(df, bench, remove="spans"), bench).filter("contaminated").count() == 0


def test_spans_of_a_long_text_go_in_linear_time(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = f"{item}; kept, {'own words here. ' * 30_000}{item} and {item}"
    got = decontaminate.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench, remove="spans").collect()
    assert got[0]["text"] == f"; kept, {'own words here. ' * 30_000} and "


def oracle(name, documents):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", documents)
    return Counter(c.sql(registry.ORACLE[name]).fetchall())


def test_line_templates_match_sql(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [" ".join(word() for _ in range(n)) for n in (3, 6, 60)]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(0, rng.choice(shared))
        if i % 3 == 0:
            lines.append(f"Page {i} of {i * 7} in the list")
        if i % 4 == 0:
            lines.append(f"posted long ago in the forum of old things by {word()}")
        rows.append((i, "\n".join(lines)))
    rows += [(100, ""), (101, "a b"), (102, "\n\n"), (103, "  x   y  z\t1 \n"), (104, rows[1][1])]
    df = docs(spark, rows)
    registered = {"n_lines", "n_dropped"}
    got = line_dedup.dedup_lines(df)
    assert registered <= set(got.columns) and set(df.columns) <= set(got.columns)
    monkeypatch.setattr(registry, "_read", lambda *_: df)
    found = Counter(tuple(r) for r in registry.op9_line_templates(spark, "").collect())
    assert found == oracle("op9_line_templates", rows)
    first = {r["doc_id"]: r["text"] for r in got.collect()}
    assert sum(shared[2] in (t or "") for t in first.values()) == 1
    assert first[0] == rows[0][1]


def test_line_templates_of_a_hot_leaf(spark, monkeypatch):
    from nearfield.llm import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 8)
    monkeypatch.setattr(skew, "SALTS", 4)
    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    rows = [(i, f"it was posted by {word(i)} here on this site today\nit was posted {word(i)} {word(i * 7)} {word(i * 3)} {word(i * 9)} end of it all\n{word(i)} is alone") for i in range(111)]
    df = docs(spark, rows)
    monkeypatch.setattr(registry, "_read", lambda *_: df)
    found = Counter(tuple(r) for r in registry.op9_line_templates(spark, "").collect())
    assert found == oracle("op9_line_templates", rows) and sum(r[2] for r in found) >= 110


def test_line_templates_of_nulls_repeats_and_nothing(spark):
    line = "all of this line is known"
    rows = [(1, line), (1, line), (None, line), (2, None), (3, f"{line}\nown words of this one")]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == Counter([(1, "", 1, 1), (1, "", 1, 1), (None, line, 1, 0), (2, None, 0, 0), (3, "own words of this one", 2, 1)])
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_line_templates_of_clashing_names_and_a_very_long_text(spark):
    long = "\n".join(["all of this line is known", *(f"own line number x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} of a long text" for k in range(15_000))])
    rows = [(1, "all of this line is known"), (2, long)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "1 AS _id", "2 AS _hash", "3 AS _DOC", "4 AS n_dropped", "5 AS places")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert (got[1]["n_dropped"], got[2]["n_dropped"], got[2]["n_lines"]) == (0, 1, 15_001)
    assert got[2]["text"] == long.split("\n", 1)[1] and (got[2]["_id"], got[2]["_DOC"], got[2]["places"]) == (1, 3, 5)


def late_lines(spark, rows):
    """(id, dropped) of documents that lose lines."""
    got = line_dedup.dedup_lines(docs(spark, rows)).filter("n_dropped > 0").collect()
    return {r["doc_id"]: r["n_dropped"] for r in got}


@pytest.mark.parametrize("n", [10, 1000, 10_000])
def test_whole_templates_hold_at_any_size(spark, n):
    rng = random.Random(n)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    line = lambda: f"This story was posted by {word(rng.randrange(200))} in the {word(rng.randrange(200))} section of the daily news site today"
    rows = [(i, f"{word(i % 1000)} {word(i // 1000)} own\n{line()}") for i in range(n)]
    assert late_lines(spark, rows) == dict.fromkeys(range(1, n), 1)


def test_whole_takes_short_lines_and_scripts_without_spaces(spark):
    short = ["Les.", "And ornd.", "本网站所有内容均受版权保护", "Page 12", "", "  ", "12", "1 2"]
    rows = [(1, "\n".join(short)), (2, "\n".join(reversed(short))), (3, "And  ornd.\nPage 7\nAlone."), (4, "Twice.\nTwice.")]
    assert late_lines(spark, rows) == {2: 4, 3: 2}
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert left == {1: rows[0][1], 2: "1 2\n12\n  \n", 3: "Alone.", 4: "Twice.\nTwice."}


def test_whole_templates_join_recurring_and_single_variants(spark):
    line = "it was posted by {} here on this site today"
    rows = [(i, line.format(name)) for i, name in enumerate(["Anna", "Anna", "Berta"])]
    assert late_lines(spark, rows) == {1: 1, 2: 1}
    values = [(i, line.format("abcdefghij"[i % 50 // 10] + "abcdefghij"[i % 10])) for i in range(1000)]
    assert late_lines(spark, values) == dict.fromkeys(range(1, 1000), 1)
    # a template in a small part of its leaf, and lines that share no more than their leaf
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    own = [(i, "it was posted " + " ".join(word(i * 6 + k) for k in range(6))) for i in range(1000)]
    rows = own + [(1000 + i, line.format("n" + word(i))) for i in range(40)]
    assert late_lines(spark, rows) == dict.fromkeys(range(1001, 1040), 1)
