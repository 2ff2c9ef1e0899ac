"""Main-text extraction from HTML by zones and nearest-URL page differencing.

A page is read once into blocks, each in a zone: article, main (inside main, or what has that role), boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, comments), or neutral. An article gives its blocks as they are: it is what differencing
must not touch, as sites show articles twice. Of other pages the blocks of main, else the neutral ones, are candidates, and the
site's template is deleted from them. It is found by differencing: pages of a host are sorted by URL path, each is paired with the
neighbour whose path has the longer common prefix, their lines are aligned by longest common subsequence, and shared lines
are deleted from the page's candidates. Pages with equal lines are one entry, so a mirror never deletes its own text.

Only line hashes are sorted and aligned. The order over a host is a range partitioning whose partitions get their
neighbours' edge rows, so a host of any size is spread over tasks and results don't depend on the number of partitions.

Defined cases: null or empty html gives empty text; a page without a host is in host ""; unclosed elements end with the
page, a skipped one also where article or main begins; a page alone in its host loses no line; from a tag on whose quotes never
close, tags end at the first ">". Reading takes time in proportion to the page, aligning a product of two pages' lines over 64.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, sub_batches

BATCH_BYTES = 8 << 20
MAIN, NEUTRAL = 1, 0

# Elements and names that tell zones.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP_TAGS = set("nav footer aside form button select dialog menu fieldset object canvas audio video head".split())
SKIP_NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footnav masthead topbar toolbar pager pagination comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay copyright widget widgets banner skip".split())
SKIP_OUTSIDE = {"header"}
SKIP_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/][^>]*>|([^<]+|<)""",
    re.S | re.I,
)
_TAG_PART = re.compile(r"[>\"']")
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"'])/\Z")
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z0-9]+")


def _skipped(tag: str, attributes: str, inside: bool) -> bool:
    if tag in SKIP_TAGS or (tag in SKIP_OUTSIDE and not inside):
        return True
    if not attributes or attributes == "/":
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names = set(_NAME.findall(value))
            if names & SKIP_NAMES or (not inside and names & SKIP_OUTSIDE):
                return True
        elif (name == "role" and value in SKIP_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def tag_end(page: str, at: int) -> int:
    """The place of the ">" that ends a tag whose name ends at `at`, quoted ones passed over; -1 if the page ends before."""
    while (m := _TAG_PART.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def _tokens(page: str) -> Iterator[tuple[str | None, str, str, str]]:
    """(text, or None for a tag; mark of a closing tag, name, attributes) of what is neither comment nor raw text."""
    at, last, quotes = 0, page.rfind(">"), True
    while at <= last:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            yield m[4], "", "", ""
        elif m[3] is not None:
            end = tag_end(page, at) if quotes else page.find(">", at)
            if end < 0 and quotes:
                quotes = False
                end = page.find(">", at)
            if end < 0:
                return
            yield None, m[2], m[3].lower(), page[at:end]
            at = end + 1
    if at < len(page):
        yield page[at:], "", "", ""


def read_blocks(page: str) -> tuple[list[tuple[int, str]], list[str]]:
    """((zone, text) of the blocks outside boilerplate, all lines of the page). zone: 2 in an article, 1 in main, 0 elsewhere."""
    blocks: list[tuple[int, str]] = []
    lines: list[str] = []
    text: list[str] = []
    article = main = depth = main_depth = 0
    skip = main_tag = ""

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                lines.append(whole)
                if not skip:
                    blocks.append((2 if article else 1 if main else 0, whole))

    for words, closing, tag, attributes in _tokens(page):
        if words is not None:
            text.append(words)
            continue
        if tag in BLOCK_TAGS or tag == skip:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            if skip == tag:
                depth -= 1
                if not depth:
                    skip = ""
            elif not skip:
                article -= tag == "article" and article > 0
                main -= tag == "main" and main > 0
                if tag == main_tag:
                    main_depth -= 1
                    if not main_depth:
                        main, main_tag = max(0, main - 1), ""
            continue
        if tag in VOID_TAGS or _SELF_CLOSED.search(attributes):
            continue
        if skip and tag in ("article", "main") and not (article or main) and not _skipped(tag, attributes, False):
            skip = ""  # the skipped element was never closed
        if skip:
            depth += tag == skip
        elif _skipped(tag, attributes, bool(article)):
            flush()
            skip, depth = tag, 1
        else:
            article += tag == "article"
            main += tag == "main"
            if main_tag:
                main_depth += tag == main_tag
            elif tag != "main" and _MAIN_ROLE.search(attributes):
                flush()
                main, main_tag, main_depth = main + 1, tag, 1
    flush()
    return blocks, lines


def shared_places(one: list[int], two: list[int]) -> list[int]:
    """Places in `one` of a longest common subsequence with `two`."""
    head = 0
    while head < min(len(one), len(two)) and one[head] == two[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(two)) - head and one[-1 - tail] == two[-1 - tail]:
        tail += 1
    common = set(one[head : len(one) - tail]) & set(two[head : len(two) - tail])
    a = [i for i in range(head, len(one) - tail) if one[i] in common]
    b = [two[j] for j in range(head, len(two) - tail) if two[j] in common]
    middle = [a[i] for i in _common_places([one[i] for i in a], b)]
    return [*range(head), *middle, *range(len(one) - tail, len(one))]


def _common_places(rows: list[int], columns: list[int]) -> list[int]:
    """Places in `rows` of a longest common subsequence with `columns`.

    The state of a row is a number with a bit a column (0 where the length grows there), so a row takes a few operations on such
    numbers. Every k-th state is kept, k the root of the rows; the way back makes the others anew, block by block.
    """
    if not rows or not columns:
        return []
    whole = (1 << len(columns)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(columns):
        where[x] = where.get(x, 0) | (1 << j)

    def after(state: int, x: int) -> int:
        hit = state & where.get(x, 0)
        return ((state + hit) | (state - hit)) & whole

    step = math.isqrt(len(rows)) + 1
    kept, state = [whole], whole
    for i, x in enumerate(rows):
        state = after(state, x)
        if (i + 1) % step == 0:
            kept.append(state)
    found, i, j = [], len(rows), len(columns)
    for block in range(len(rows) // step, -1, -1):
        first = block * step
        states = [kept[block]]
        for x in rows[first:i]:
            states.append(after(states[-1], x))
        while i > first and j:
            if states[i - first] >> (j - 1) & 1:
                j -= 1
            elif not states[i - 1 - first] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append(i)
    return found[::-1]


def common_prefix(one: str, two: str) -> int:
    """Number of leading path segments that two paths share, then of letters."""
    a, b = one.split("/"), two.split("/")
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    rest = 0
    if n < min(len(a), len(b)):
        while rest < min(len(a[n]), len(b[n])) and a[n][rest] == b[n][rest]:
            rest += 1
    return n * 1000 + min(rest, 999)


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = "page_id long, url string, host string, path string, text string, neutral array<string>, neutral_lines array<long>, lines array<long>, lines_key long"


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row a page: its text if it has an article (else null, with the candidate blocks), and the hashes of all its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sub_batches(whole, "html", BATCH_BYTES):
                texts, neutral, neutral_lines, lines = [], [], [], []
                for page in b.column("html").to_pylist():
                    blocks, all_lines = read_blocks(page or "")
                    zone = max([z for z, _ in blocks], default=0)
                    if zone == 2:
                        texts.append("\n".join(t for z, t in blocks if z == zone))
                        neutral.append(None)
                        neutral_lines.append(None)
                    else:
                        texts.append(None)
                        neutral.append([t for z, t in blocks if z == zone])
                        neutral_lines.append([_line_hash(t) for z, t in blocks if z == zone])
                    lines.append([_line_hash(x) for x in all_lines])
                keys = [_line_hash(",".join(map(str, x))) for x in lines]
                longs = pa.list_(pa.int64())
                made = [pa.array(texts, pa.string()), pa.array(neutral, pa.list_(pa.string())), pa.array(neutral_lines, longs), pa.array(lines, longs), pa.array(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "path")), *made], names=["page_id", "url", "host", "path", "text", "neutral", "neutral_lines", "lines", "lines_key"])

    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.rtrim(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), "html").mapInArrow(run, PARSED)


def template_lines(parsed: DataFrame) -> DataFrame:
    """(host, lines_key, shared): the line hashes that an entry shares with its nearest neighbour of the host by URL path."""
    entries = parsed.groupBy("host", "lines_key").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    order = ["host", "path", "lines_key"]
    placed = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "paths")
    row = F.struct(*order, "lines")
    edges = placed.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ends = edges.select("part", F.struct("part", "first", "last").alias("e"))
    # as many rows as partitions: the next part that has rows is found by a window over them
    from pyspark.sql import Window

    by = Window.orderBy("part")
    ends = ends.select("part", F.lag("e").over(by)["last"].alias("before"), F.lead("e").over(by)["first"].alias("after"))
    ghosts = ends.select("part", F.explode(F.array("before", "after")).alias("g")).filter("g IS NOT NULL").select("g.*", "part")
    rows = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    rows = rows.select("part", *order, "lines", "ghost").repartition("part").sortWithinPartitions("part", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = here = None

        def done(before, here, after) -> list:
            if here is None or here[5]:
                return []
            near = [x for x in (before, after) if x is not None and x[0] == here[0] and x[1] == here[1]]
            if not near:
                return [(here[1], here[3], [])]
            other = max(near, key=lambda x: common_prefix(here[2], x[2]))
            return [(here[1], here[3], sorted({here[4][i] for i in shared_places(here[4], other[4])}))]

        for b in batches:
            out = []
            for after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += done(before, here, after)
                before, here = here, after
            yield _template(out)
        yield _template(done(before, here, None))

    return rows.mapInArrow(run, "host string, lines_key long, shared array<long>")


def _template(rows: list) -> pa.RecordBatch:
    hosts, keys, shared = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(shared, pa.list_(pa.int64()))], names=["host", "lines_key", "shared"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = cut(parse_pages(pages), "pages")
    template = template_lines(parsed.select("host", "path", "lines", "lines_key"))
    clear = parsed.filter("text IS NOT NULL").select("page_id", "url", "text")
    other = parsed.filter("text IS NULL").join(template, ["host", "lines_key"], "left")
    kept = F.filter("neutral", lambda x, i: ~F.array_contains(F.coalesce("shared", F.array().cast("array<long>")), F.get("neutral_lines", i)))
    other = other.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return clear.union(other).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
