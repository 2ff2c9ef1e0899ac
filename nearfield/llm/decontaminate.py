"""Benchmark decontamination by a broadcast hash set of normalised test n-grams. Built-in functions only.

Texts are lower-cased (A-Z) and cut into words. Each item gives windows of ten consecutive words, or one shorter window if it
has fewer words. A window is filed under its longest word, which is rarely a common one; training words probe that table, and
each probe that finds a filed word compares the whole window in place. So one hash probe is made for each training word, and
nothing but verified hits leaves the scan; they are grouped by document afterwards.

The window table is broadcast up to BROADCAST_BYTES, which are measured first. A larger benchmark is joined by shuffle: seeds and
places move, not texts; candidates are grouped by document, meet its text once, are sifted there by the window's hash, and what
is left is compared with the window word by word.

Defined cases: null text has no words, so no hits; a document is known by doc_id and text, so repeated rows get equal results
and null ids are told apart by text; null item ids can hit but are not listed; items without words give no window; extra
columns, whatever their names, are kept by decontaminate() and ignored by measure().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, cut, free, fresh, without_places
from nearfield.llm.membership import Membership

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(seed, seed_at, width, window, item_id) of all windows of items(item_id, text); seed_at is the seed's place in it."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(length)))
    rows = rows.select("item_id", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("window"))
    ranked = F.array_max(F.transform("window", lambda word, at: F.struct(F.char_length(word).alias("n"), F.xxhash64(word).alias("h"), (-at).alias("at"), word.alias("word"))))
    rows = rows.select("item_id", "width", "window", ranked.alias("s"))
    return rows.select(F.col("s")["word"].alias("seed"), (-F.col("s")["at"]).alias("seed_at"), "width", "window", "item_id").distinct()


def hits(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, text_hash, copies, n_words, spans (start, width of each window that
    occurs, from 0), item_ids."""
    table = cut(windows(items, length), "windows")
    # an entry's fields, and 16 bytes a word besides its letters
    size = table.agg(F.sum(64 + 16 * F.col("width") + F.octet_length(F.array_join("window", "")))).first()[0] or 0
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "text_hash", "w", F.size("w").cast("long").alias("n_words"))
    # place 0 is a mark that keeps a document without hits; word i of the text is at place i + 1
    places = F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word")
    if size <= BROADCAST_BYTES:
        rows = rows.select("*", places)
        found = rows.join(F.broadcast(table), rows.word == table.seed, "left").withColumn("start", F.col("at") - 1 - F.col("seed_at"))
        occurs = F.col("seed").isNotNull() & (F.col("at") > 0) & (F.col("start") >= 0) & (F.slice("w", F.greatest("start", F.lit(0)) + 1, F.coalesce("width", F.lit(0))) == F.col("window"))
        found = found.select("doc_id", "text_hash", "n_words", (F.col("at") == 0).alias("mark"), F.when(occurs, F.struct("start", "width")).alias("span"), F.when(occurs, F.col("item_id")).alias("item_id")).filter("mark OR span IS NOT NULL")
    else:
        found = _found_by_shuffle(rows, table)
    return found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum(F.col("mark").cast("long")).alias("copies"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("item_ids")
    )


def _found_by_shuffle(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(doc_id, text_hash, w, n_words) against any number of windows: doc_id, text_hash, n_words, mark, span, item_id."""
    asked = cut(table.select("seed", "seed_at", "width", F.xxhash64("window").alias("id")).distinct(), "seeds")
    place = rows.select("doc_id", "text_hash", "n_words", F.posexplode("w").alias("at", "seed"))
    near = place.join(asked, "seed").withColumn("start", F.col("at") - F.col("seed_at")).filter("start >= 0 AND start + width <= n_words")
    near = cut(near.select("doc_id", "text_hash", "start", "width", "id").distinct(), "near")
    held = near.groupBy(F.xxhash64("doc_id", "text_hash").alias("doc")).agg(F.collect_list(F.struct("start", "width", "id")).alias("near"))
    # texts of one id and hash are equal and give the same answer
    texts = rows.groupBy(F.xxhash64("doc_id", "text_hash").alias("doc"), "doc_id", "text_hash", "n_words").agg(F.first("w").alias("w"))
    sifted = texts.join(held, "doc").select("doc_id", "text_hash", "n_words", F.explode(F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["width"].alias("width"), x["id"].alias("id"), F.slice("w", x["start"] + 1, x["width"]).alias("window")))).alias("x"))
    sifted = sifted.filter(F.xxhash64("x.window") == F.col("x.id")).select("doc_id", "text_hash", "n_words", "x.*")
    hit = sifted.drop("width").join(table.withColumn("id", F.xxhash64("window")), ["id", "window"])
    hit = cut(hit.select("doc_id", "text_hash", "n_words", F.lit(False).alias("mark"), F.struct("start", "width").alias("span"), "item_id"), "hits")
    free(asked, near)
    nothing = hit.schema["span"].dataType
    return hit.union(rows.select("doc_id", "text_hash", "n_words", F.lit(True), F.lit(None).cast(nothing), F.lit(None).cast(hit.schema["item_id"].dataType)))


def hit_places(spans: Column) -> Column:
    """The distinct word places inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1))))


def measure(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, length)
    n_hit = F.size(hit_places(F.col("spans"))).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the words of every hit and what stands between them cut
    out of their texts. All columns are kept."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    id_, hash_, hit_, text_hash, doc = fresh(docs.columns, "id", "hash", "hit", "text_hash", "doc")
    bad = hits(docs, items, length).filter(F.size("spans") > 0)
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), hit_places(F.col("spans")).alias(hit_), F.xxhash64("doc_id", "text_hash").alias(doc))
    bad = cut(bad.drop(hit_) if remove == "documents" else bad, "bad")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    # what surely has no hit doesn't move
    maybe = Membership(bad, doc).may_hold(F.xxhash64("doc_id", text_hash))
    clear, other, bad = keyed.filter(~maybe).select(*docs.columns), keyed.filter(maybe), bad.drop(doc)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_))
    if remove == "documents":
        return clear.union(other.join(bad, same, "left_anti").select(*docs.columns))
    both = other.join(bad, same, "left")
    # gap 0, word 0, gap 1, ...: a hit word goes, and the gap before it too if the word before that is hit; each step is linear
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    parts = F.regexp_extract_all("text", F.lit(rf"({word})"), F.lit(1))
    pieces = F.flatten(F.zip_with(F.split("text", word), parts, lambda gap, w: F.array(gap, w)))
    inside = F.array_intersect(hit_, F.transform(hit_, lambda i: i + 1))
    out = F.concat(F.transform(hit_, lambda i: 2 * i + 1), F.transform(inside, lambda i: 2 * i))
    text = F.when(F.col(hit_).isNull(), F.col("text")).otherwise(F.array_join(without_places(pieces, out), ""))
    return clear.union(both.withColumn("text", text).select(*docs.columns))
