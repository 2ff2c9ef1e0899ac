import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, packing, sharding

DOC = "doc_id long, text string, lang string, slot long, shard string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 0.5) for i, t in rows], DOC)


ODD = [(1, "A b"), (2, None), (None, "a B"), (3, ""), (1, "A b"), (4, "É é"), (5, "é é"), (6, "x" * 200_000), (None, None), (7, "a b")]


def brute_shard(key, n):
    u = lambda i: (int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min(range(n), key=lambda i: -math.log(u(i)))


def test_shards_follow_brute_force_and_slots_have_no_gap(spark):
    got = sharding.shard_documents(docs(spark, ODD), 16).collect()
    assert len(got) == len(ODD)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (brute_shard(key, 16), brute_shard(key, 17))
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)


def test_weights_share_rows_and_growth_moves_few(spark):
    rows = spark.range(20_000)
    got = {r["shard"]: r["count"] for r in sharding.shard(rows, "id", [1, 1, 2]).groupBy("shard").count().collect()}
    assert abs(got[2] / 20_000 - 0.5) < 0.02 and abs(got[0] / 20_000 - 0.25) < 0.02
    both = sharding.shard(rows, "id", [1] * 8).withColumnRenamed("shard", "a").join(sharding.shard(rows, "id", [1] * 9), "id")
    moved = both.filter("a <> shard")
    assert moved.filter("shard <> 8").count() == 0
    assert abs(moved.count() / 20_000 - 1 / 9) < 0.02
    with pytest.raises(ValueError):
        sharding.shard(rows, "id", [1, 0])


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_documents(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_slots_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, i % 3, -1, i, "r", i) for i in range(50)], "id long, shard int, slot long, _bucket long, _ROW string, _n long")
    got = sharding.with_slots(df, "shard", ["id"])
    assert got.columns == ["id", "shard", "_bucket", "_ROW", "_n", "slot"]
    rows = got.collect()
    assert {(r["id"], r["shard"], r["_bucket"], r["_ROW"], r["_n"]) for r in rows} == {(i, i % 3, i, "r", i) for i in range(50)}
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(len(range(k, 50, 3)))) for k in range(3))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 5000])
def test_perfect_hash_is_minimal(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    displacements, slots = exact_dedup.build_mph(digests)
    assert sorted(slots.tolist()) == list(range(n))
    assert exact_dedup.lookup_mph(displacements, n, digests).tolist() == slots.tolist()
    other = [hashlib.sha256(b"x%d" % i).digest() for i in range(50)]
    assert ((0 <= (s := exact_dedup.lookup_mph(displacements, n, other))) & (s < n)).all()


def brute_dedup(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(lower)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    rows = ODD + [(100 + i, rng.choice("abcDE") * rng.randint(1, 4)) for i in range(400)]
    got = exact_dedup.dedup_documents(docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_dedup(rows)
    assert exact_dedup.dedup_documents(docs(spark, rows).limit(0)).count() == 0


def test_a_hot_digest_and_long_texts(spark, monkeypatch):
    from nearfield.llm import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    monkeypatch.setattr(skew, "SALTS", 8)
    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 50)
    rows = [(i if i % 7 else None, "Same" if i % 3 else f"text {i % 180}") for i in range(600)] + [(1000, "y" * 5_000_000), (2000, "Y" * 5_000_000)]
    got = exact_dedup.dedup_documents(docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_dedup(rows)


def test_history_is_asked_before_the_batch(spark):
    old = exact_dedup.text_digests(docs(spark, [(1, "seen"), (2, "also")])).withColumnRenamed("doc_id", "locator").withColumn("n", F.lit(5).cast("long"))
    keys = exact_dedup.text_digests(docs(spark, [(10, "SEEN"), (11, "new"), (12, "new")]))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["member"]) for r in keys.join(exact_dedup.deduplicate(keys, old), "digest").collect()}
    assert got == {10: (1, 5, True), 11: (12, 2, False), 12: (12, 2, False)}


TEXTS = ["", " ", "a", " a", "a ", "Hello world", "two  spaces", "tab\tand\nline", "end\n", "\nstart", "a b  c", "it's we'll", "née Ünïcode ça", "<|endoftext|> x", "<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "two  <|endoftext|>", "line\n<|endoftext|>\n", "12 345 6", "日本語 テキスト", "a \n b", "x" * 3000, "!!! ???", "\x1c a\x85 b"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_tokenizers(spark, data):
    import pyarrow as pa

    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    got = packing.ByteBpe(packing.default_vocabulary()).encode_batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == reference_ids(texts)


def check_pieces(rows, pieces, tokens=2048):
    ids = dict(zip([i for i, _ in rows], reference_ids([t or "" for _, t in rows]), strict=True))
    at = defaultdict(list)
    for p in pieces:
        at[p["doc_id"]].append(p)
    for i, want in ids.items():
        whole = [*want, 1]
        own = sorted(at[i], key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert sum(p["length"] for p in own) == len(whole)
        for p in own:
            part = np.array(whole[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(whole) and p["length"] > 0
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    waste = total = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
        n = sum(k for _, k in own)
        assert n <= tokens
        total += n
        waste += 0 if n & (n - 1) == 0 else tokens - n
    return waste / max(1, total)


def test_packing_keeps_every_id_once_and_pads_nothing(spark, data):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate([*TEXTS, None])]
    pieces = packing.pack(docs(spark, rows).repartition(3)).collect()
    assert check_pieces(rows, pieces) == 0
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_vector_limits_hold_for_whole_examples(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 60), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double").coalesce(1)
    got = packing.pack(df, tokens=256, segments=6, loss_tokens=100, loss_col="share", cutting=False).collect()
    loss = {i: round(s * n["doc_tokens"]) for i, _, s in rows for n in [next(p for p in got if p["doc_id"] == i)]}
    sums = defaultdict(lambda: [0, 0, 0])
    for p in got:
        assert p["start"] == 0 and p["length"] == p["doc_tokens"]
        s = sums[p["sequence_id"]]
        s[0] += p["length"]
        s[1] += 1
        s[2] += loss[p["doc_id"]]
    assert len(got) == 300 and all(a <= 256 and b <= 6 and c <= 100 for a, b, c in sums.values())
    least = max(sum(x[0] for x in sums.values()) / 256, 300 / 6, sum(loss.values()) / 100)
    assert len(sums) <= 1.25 * least + 1
    with pytest.raises(Exception, match="may not be cut"):
        packing.pack(df, tokens=16, cutting=False).collect()
    cut = packing.pack(df, tokens=256, segments=6, loss_tokens=100, loss_col="share").collect()
    assert sum(p["length"] for p in cut) == sum({p["doc_id"]: p["doc_tokens"] for p in cut}.values())


def test_shards_follow_the_batch_too(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 10)
    asked, absorb = [], exact_dedup.absorb
    monkeypatch.setattr(exact_dedup, "absorb", lambda batch, index, shards: asked.append(shards) or absorb(batch, index, shards))
    rows = [(i, f"text {i}") for i in range(200)] + [(900, "text 7")]
    got = exact_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # 101 distinct digests in the half that is the history, 100 in the batch
    assert asked == [11]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {i: (900, 2, i == 900) if i in (7, 900) else (i, 1, True) for i, _ in rows}
