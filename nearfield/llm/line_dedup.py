"""Line deduplication by a fixed-depth log-template tree. Built-in functions only.

A line's path in the tree is its number of tokens and its first DEPTH tokens, tokens with a digit standing for one variable
field. The distinct masked lines of a leaf decide which of its places are fixed: a token is fixed text at a level of LEVELS where
more than that share of them have it at its place (at the last level: two). A line takes the template of the first level where
SIMILAR of its tokens are fixed and two documents share the template, and otherwise itself, where it recurs. As shares are
relative to the leaf, fields stay fields in a corpus of any size, and a template in a small part of its leaf is found at a later
level. Lines with fewer tokens than DEPTH, of scripts without spaces too, take part as they are when masked; blank ones and
those of field marks alone stay.

Lines whose template occurs in two documents or more are dropped, but for the first: that of the least (doc_id, place).
So what many documents share is kept once, and a document that stands alone loses nothing.

What occurs in two documents is told by the least and greatest document key of each line, leaf and token, taken partially
before the shuffle; no leaf is ever collected. Keys are 64-bit hashes. Rows are kept from shuffles by bitmaps where they surely
have no partner: the text of a line moves only if its leaf recurs, that of a document only if it loses a line.

Defined cases: null text stays null; white space beside a line is not part of its tokens but stays in kept lines; a document is
known by doc_id and text, so repeated rows are one document and get equal results; rows with null ids come first in order;
extra columns are kept, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, free, fresh, without_places
from nearfield.llm.membership import Membership
from nearfield.llm.skew import join_hot

DEPTH = 3
SIMILAR = 0.8
FIELD = "<*>"
LEVELS = (1 / 2, 1 / 8, 1 / 32, 1 / 128, 1 / 512, 0.0)
NARROW = ["doc_id", "text_hash", "doc", "place"]


def masked(line: Column) -> Column:
    """A line with single spaces between its tokens, and the field mark in place of tokens with an ASCII digit."""
    odd = F.lit(False)
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"[\t\x0B\f\r]", " ")).otherwise(line))
    plain = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, doc, place, line, leaf, masked of the lines that take part, written."""
    lines = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.select("doc_id", "text_hash", "place", masked(F.col("line")).alias("masked"))
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("doc"), "place", "masked", n.alias("n"))
    lines = lines.filter((F.col("n") >= DEPTH) | (F.trim(F.replace("masked", F.lit(FIELD), F.lit(""))) != ""))
    return cut(lines.select(*NARROW, F.xxhash64("masked").alias("line"), F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), "masked"), "lines")


def _templates(lines: DataFrame) -> DataFrame:
    """(line, template) of each distinct masked line that has a recurring template, written."""
    leaves = cut(lines.groupBy("leaf").agg(F.min("doc").alias("_a"), F.max("doc").alias("_z")).filter("_a <> _z").select("leaf"), "leaves")
    shared_leaf = Membership(leaves, "leaf")
    kinds = lines.filter(shared_leaf.may_hold(F.col("leaf"))).groupBy("line", "leaf").agg(F.min("masked").alias("masked"), F.min("doc").alias("a"), F.max("doc").alias("z"))
    kinds = cut(kinds, "kinds")
    free(leaves)
    shared_leaf.free()
    # a leaf of one distinct line has nothing to compare
    sizes = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.min("a").alias("_a"), F.max("z").alias("_z")).filter("size > 1 AND _a <> _z")
    sizes = cut(sizes.select("leaf", "size", F.col("size").alias("n")), "sizes")
    held = cut(join_hot(kinds, sizes.select("leaf", "size"), "leaf", counts=sizes), "held")
    free(sizes)
    token = held.select("line", "leaf", "size", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    token = token.select("line", "size", F.xxhash64("leaf", "at", "token").alias("token"), F.xxhash64("at").alias("blank"))
    fixed = token.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("_size")).filter("c > 1")
    level = F.lit(len(LEVELS))
    for i, share in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col("c") > F.col("_size") * share, F.lit(i)).otherwise(level)
    shown = token.select("line", "token", "blank").join(fixed.select("token", level.alias("level")), "token", "left")
    shown = shown.withColumn("level", F.coalesce("level", F.lit(len(LEVELS))))
    tried = []
    for i in range(len(LEVELS)):
        steady = F.col("level") <= i
        # a token's hash has its place, so what is shown, combined, is a key of the template
        tried += [F.avg(steady.cast("double")).alias(f"share{i}"), F.bit_xor(F.when(steady, F.col("token")).otherwise(F.col("blank"))).alias(f"key{i}")]
    made = shown.groupBy("line").agg(*tried)
    options = F.array(*[F.when(F.col(f"share{i}") >= SIMILAR, F.struct(F.lit(i).alias("level"), F.col(f"key{i}").alias("key"))) for i in range(len(LEVELS))])
    made = made.select("line", F.explode(F.filter(options, lambda x: x.isNotNull())).alias("option"))
    general = made.join(held.select("line", "leaf", "a", "z"), "line").select("line", "option.level", F.xxhash64("leaf", "option.key").alias("template"), "a", "z")
    general = cut(general, "general")
    free(held)
    shared = general.groupBy("template").agg(F.min("a").alias("_a"), F.max("z").alias("_z")).filter("_a <> _z").select("template")
    # written, so that both sides are dealt anew and a frequent template can be split
    shared = cut(shared, "shared")
    options = general.join(shared, "template", "left_semi").select("line", "level", "template")
    exact = kinds.filter("a <> z").select("line", F.lit(len(LEVELS)).alias("level"), F.col("line").alias("template"))
    chosen = cut(options.union(exact).groupBy("line").agg(F.min_by("template", "level").alias("template")), "chosen")
    free(kinds, general, shared)
    return chosen


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, doc, places): the places (from 0) of the lines to drop, for documents that have any; written."""
    lines = _lines(docs)
    chosen = _templates(lines)
    takes_part = Membership(chosen, "line")
    found = cut(lines.filter(takes_part.may_hold(F.col("line"))).join(chosen, "line").select(*NARROW, "template"), "found")
    free(lines, chosen)
    takes_part.free()
    place = F.struct("doc_id", "text_hash", "place")
    first = cut(found.groupBy("template").agg(F.min(place).alias("first")), "first")
    late = found.join(first, "template").filter(~place.eqNullSafe(F.col("first")))
    late = cut(late.groupBy("doc_id", "text_hash", "doc").agg(F.collect_set("place").alias("places")), "dropped")
    free(found, first)
    return late


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their late recurring lines cut out of text, and n_lines, n_dropped. Order of lines and columns is kept."""
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    id_, hash_, doc_of, places_, text_hash, doc = fresh([*docs.columns], "id", "hash", "doc_of", "places", "text_hash", "doc")
    places = dropped_lines(docs).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("doc").alias(doc_of), F.col("places").alias(places_))
    keyed = docs.withColumn(text_hash, F.xxhash64("text")).withColumn(doc, F.xxhash64("doc_id", text_hash))
    loses = Membership(places, doc_of).may_hold(F.col(doc))
    same = (F.col(doc) == F.col(doc_of)) & F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_))
    some = keyed.filter(loses).join(places.hint("shuffle_hash"), same, "left")
    lines = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col(places_).isNull(), F.col("text")).otherwise(F.array_join(without_places(lines, F.col(places_)), "\n"))
    none = keyed.filter(~loses).select(*own, "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return none.union(some.select(*own, text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size(places_), F.lit(0)).cast("long").alias("n_dropped")))
