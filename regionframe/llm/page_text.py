"""Main text of web pages, with nearest-URL page differencing.

A page's text blocks are read from its markup, front to back.  Every page is compared with its nearest page of other content: pages of one host
are sorted by URL path, pages with equal lines count as one, and of the two pages beside it the one that shares the longer piece of path is
taken.  The lines of both are aligned by their longest common subsequence and the shared lines are proposed for deletion.

The markup then checks what differencing proposes, since an article may repeat a passage and boilerplate may differ from page to page.  Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element, role and class name, go in any case.  If
text stands in a marked article (``article``, ``main``, or the matching role or property), it is kept with its shared lines, and
the rest goes.  On all other pages the proposal holds, unless less than LEAST of the text would remain: the two are near copies then and the page
keeps its text.

Pages are dealt out in ranges of host and path, and the rows at the edges of a range are passed to the ranges beside it, so no host is
gathered in one task and its size changes no result; only line hashes travel for the comparison.

Defined cases: null or empty html gives an empty text; a null URL belongs to the empty host and path; a page without a neighbour keeps its
lines; repeated rows are returned each; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEAST = 0.2

# What HTML elements, roles and customary class names mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head nav footer aside form script style noscript template iframe object svg canvas video audio button select textarea dialog menu map applet datalist".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
DROPPED_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAMES = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("inside", "main", "text")

    def __init__(self, text: str, main: bool, inside: bool):
        self.text, self.main, self.inside = text, main, inside


def _unwanted(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    for one in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = _NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
        if words and words[0] not in ("has", "with", "no", "without") and not DROPPED_NAMES.isdisjoint(words):
            if in_article and words == ["header"]:
                continue
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The visible text blocks in order: ``main`` if nothing drops them, ``inside`` if they stand in the marked article."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, in article
    dropped = inside = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, not dropped, inside))

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        raw = page[at : found.start()] if found else page[at:]
        if raw:
            parts.append(entities.unescape(raw) if "&" in raw else raw)
        if not found:
            break
        at = found.end()
        closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCK and any(s[0] in BLOCK for s in stack[k + 1 :]):
                        break  # an inline end tag does not close blocks
                    outer = stack[k - 1][1:] if k else (False, False)
                    if outer != (dropped, inside):
                        flush()
                    del stack[k:]
                    dropped, inside = outer
                    break
            continue
        if name in BLOCK:
            flush()
            if name == "p" or name in ("li", "dd", "dt", "tr", "td", "th", "option"):  # these end an open one of their kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        dropped, inside = stack[k - 1][1:] if k else (False, False)
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK and stack[k][0] not in ("p", "td", "th") or stack[k][0] == "table":
                        break
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if rest and rest.strip(" /") else {}
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        drop = dropped or _unwanted(name, attrs, inside)
        mark = inside or (not drop and (name in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "") == "articleBody"))
        if drop != dropped or mark != inside:
            flush()
        stack.append((name, drop, mark))
        dropped, inside = drop, mark
    flush()
    return out


def candidates(found: list[Block]) -> tuple[bool, list[int]]:
    """Whether text stands in a marked article, and the places of the blocks that the markup leaves."""
    inside = [k for k, b in enumerate(found) if b.main and b.inside]
    return bool(inside), inside or [k for k, b in enumerate(found) if b.main]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    rest = set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in rest]  # other lines are in no common subsequence
    y = np.array([x for x in b[head : len(b) - tail] if x in {a[i] for i in places}], np.int64)
    table = np.zeros((len(places) + 1, len(y) + 1), np.int32)
    for i in range(len(places) - 1, -1, -1):
        take = np.where(y == a[places[i]], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    i = j = 0
    middle = []
    while i < len(places) and j < len(y):
        if a[places[i]] == y[j] and table[i, j] == table[i + 1, j + 1] + 1:
            middle.append(places[i])
            i, j = i + 1, j + 1
        elif table[i + 1, j] == table[i, j]:
            i += 1
        else:
            j += 1
    return [*range(head), *middle, *range(len(a) - tail, len(a))]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _content(lines: list[int]) -> int:
    return xxhash.xxh64_intdigest(np.array(lines, np.int64).tobytes()) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[_hash(b.text) for b in blocks(h.as_py() or "")] for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_content(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "path", "content", "lines"])


Row = tuple[str, str, int, bool, list[int]]  # host, path, content, wanted, lines


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Row]]]:
    """The ranges of a task, each with its rows in order."""
    part, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != part and rows:
                yield part, rows
                rows = []
            part = k
            rows.append(tuple(row))
    if rows:
        yield part, rows


def _two(rows: Iterator[Row]) -> list[Row]:
    """The first row and the first of another content or host after it."""
    out: list[Row] = []
    for row in rows:
        if not out or row[::2][:2] != out[0][::2][:2]:
            out.append(row)
            if len(out) == 2:
                break
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _ranges(batches):
        for last, found in ((False, _two(iter(rows))), (True, _two(reversed(rows)))):
            cols = [[part] * len(found), [last] * len(found), list(range(len(found))), *zip(*found)]
            types = (pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "last", "place", "host", "path", "content", "wanted", "lines"])


def _carried(edges: list) -> dict[int, tuple[list[Row], list[Row]]]:
    """For each range the rows before it, in order, and those after it that its own rows can need: two of different content."""
    heads, tails = {}, {}
    for e in sorted(edges, key=lambda e: (e["part"], e["last"], e["place"])):
        (tails if e["last"] else heads).setdefault(e["part"], []).append((e["host"], e["path"], e["content"], e["wanted"], list(e["lines"])))
    parts = sorted(heads)
    before, after, out = [], [], {}
    for k in parts:
        out[k] = (before[::-1], [])
        before = _two(iter(tails[k] + before))
    for k in reversed(parts):
        out[k] = (out[k][0], after)
        after = _two(iter(heads[k] + after))
    return out


def _others(rows: list[Row]) -> list[Row | None]:
    """The last row before each that has its host and another content."""
    out: list[Row | None] = []
    for k, row in enumerate(rows):
        last = rows[k - 1] if k else None
        if last is None or last[0] != row[0]:
            out.append(None)
        else:
            out.append(last if last[2] != row[2] else out[-1])
    return out


def _shared(carried):
    def near(x: str, y: Row | None) -> int:
        return -1 if y is None else next((k for k, (p, q) in enumerate(zip(x, y[1])) if p != q), min(len(x), len(y[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _ranges(batches):
            head, tail = carried.value[part]
            rows = [*head, *own, *tail]
            found = []
            for row, prior, later in list(zip(rows, _others(rows), _others(rows[::-1])[::-1]))[len(head) : len(head) + len(own)]:
                if row[3]:
                    other = prior if near(row[1], prior) >= near(row[1], later) else later
                    found.append((*row[:3], common(row[4], other[4]) if other else []))
            cols = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())))], names=["host", "path", "content", "gone"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that the markup leaves of each page, with their places among all lines."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts, places, contents, articles = [], [], [], []
            for h in part.column(4):
                found = blocks(h.as_py() or "")
                article, at = candidates(found)
                articles.append(article)
                contents.append(_content([_hash(b.text) for b in found]))
                places.append(at)
                texts.append([found[k].text for k in at])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(contents, pa.int64()), pa.array(articles, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))],
                names=["page_id", "url", "host", "path", "content", "article", "texts", "places"],
            )


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, and n_shared, the number of its lines that differencing proposes to delete."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    shape = r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^?#]*)"
    host, path = F.lower(F.regexp_extract(url, shape, 1)).alias("host"), F.regexp_extract(url, shape, 2).alias("path")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host, path, F.col(html_col).alias("html"))
    held = base.mapInArrow(_texts, "page_id long, url string, host string, path string, content long, article boolean, texts array<string>, places array<int>")
    whole = F.array_join("texts", "\n\n")
    kept = F.array_join(F.filter("texts", lambda _, i: F.col("article") | ~F.array_contains("gone", F.get("places", i))), "\n\n")
    text = F.when(F.col("gone").isNull() | (F.length(kept) < LEAST * F.length(whole)), whole).otherwise(kept)
    out = held.join(_shared_lines(base), ["host", "path", "content"], "left").select("page_id", "url", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_shared"))
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def _shared_lines(base: DataFrame) -> DataFrame:
    """host, path, content of every page that has lines, and the places of those that it shares with its nearest page."""
    place = ["host", "path", "content"]
    lines = base.select("host", "path", "html").mapInArrow(_lines, "host string, path string, content long, lines array<long>").where(F.size("lines") > 0)
    single = lines.groupBy(*place).agg(F.first("lines").alias("lines"))
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled anew in every run: they are written once.
    ranged = materialise(single.repartitionByRange(n, *place).select(F.spark_partition_id().alias("part"), *place, F.lit(True).alias("wanted"), "lines"), "page-ranges")
    ordered = ranged.repartition(n, "part").sortWithinPartitions("part", *place)
    edges = ordered.mapInArrow(_edges, "part int, last boolean, place int, host string, path string, content long, wanted boolean, lines array<long>").collect()
    carried = base.sparkSession.sparkContext.broadcast(_carried(edges))
    return ordered.mapInArrow(_shared(carried), "host string, path string, content long, gone array<int>")
