"""Main text of web pages: what markup tells apart, and what a page shares with the page of the nearest URL.

1. A page becomes its lines: the text of each block element, in order. Menus, headers, footers, sidebars, notices,
   adverts, forms, comments, scripts and styles are known by their elements, roles and names, and give no lines.
   Lines inside ``article`` or ``main`` are main lines.
2. Pages are put in order by host and path. Blocks of neighbouring pages, each with the page before and the page after
   it, are dealt to tasks; bounds are positions in that order, so a host may have any share of all pages.
3. A page is paired with the neighbour on its host whose path has more in common with its own. Their lines are aligned
   by their longest common subsequence, and shared lines are deleted: all of them where nothing marks the main text;
   where it is marked, those that are links and nothing else, because articles share passages as well.
A page that would keep no line is a copy of its neighbour: it is held against the other one, or keeps what it has.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, forget, in_order, small_batches

#: pages of a block, and blocks at most (their bounds, of some 100 bytes each, go to all tasks)
BLOCK, MOST_BLOCKS = 64, 65_536

#: fixed values: elements whose text is never read, and those that are never part of the main text
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
ASIDE = frozenset("head nav aside footer form dialog menu select datalist button label fieldset svg math canvas object audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: elements that stand on lines of their own
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: fixed values: elements that end an open one of the same group
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: fixed values: roles, and words in names and classes, of what isn't main text
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup comment comments commentlist disqus respond replies related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager paywall copyright disclaimer".split()
)
#: fixed values: such words that layouts also use for what holds the main text
LAYOUT = frozenset("nav navbar navigation menu sidebar header footer masthead topbar toolbar widget widgets search social share sharing notice notices alert login".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

OPEN, MAIN, WEAK, GONE = 0, 1, 2, 3


@dataclass
class Line:
    text: str
    main: bool
    linked: bool


def _zone(tag: str, attributes: str, zone: int) -> int:
    """Where an element's text belongs, given where the element stands."""
    if zone == GONE or tag in ("html", "body"):
        return zone
    if tag == "header":
        own = zone if zone == MAIN else WEAK
    elif tag in ASIDE:
        own = WEAK if tag == "form" else GONE
    elif tag in ("article", "main"):
        own = MAIN
    else:
        own = zone
    if attributes and not attributes.isspace():
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}  # the first of a name counts
        role = given.get("role", "").lower()
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
            return GONE
        if role in ROLES:
            return GONE
        if role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
            own = MAIN
        elif tag not in ("article", "main") or zone != WEAK:
            parts = {p.lower() for p in _NAME_PARTS.findall(f"{given.get('class', '')} {given.get('id', '')}")}
            if parts & NAMED and not (tag in ("article", "main") and zone == OPEN):
                return GONE
            if parts & (LAYOUT - {"header"} if zone == MAIN else LAYOUT) and tag not in ("article", "main"):
                own = WEAK
    return own


def page_lines(page: str) -> list[Line]:
    """The lines of a page that markup leaves: decoded, with single spaces; none is empty."""
    out: list[Line] = []
    stack: list[tuple[str, int]] = []  # open elements, each with where its text belongs
    zone = links = 0
    held: list[str] = []
    main = plain = False

    def hold(piece):
        nonlocal main, plain
        if piece and zone in (OPEN, MAIN):
            held.append(piece)
            if not piece.isspace():
                main, plain = zone == MAIN, plain or not links

    def flush():
        nonlocal plain
        text = "".join(held)
        held.clear()
        words = (html.unescape(text) if "&" in text else text).split()
        if words:
            out.append(Line(" ".join(words), main, not plain))
        plain = False

    def close(kinds, within):
        """Ends the innermost open element of these kinds and all in it, unless one of ``within`` stands between."""
        nonlocal zone, links
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] in kinds:
                links -= sum(t == "a" for t, _ in stack[d:])
                del stack[d:]
                zone = stack[-1][1] if stack else OPEN
                return
            if stack[d][0] in within:
                return

    at = 0
    while m := _TAG.search(page, at):
        hold(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if m[1]:
            close((tag,), () if tag in BLOCKS else BLOCKS)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            if tag in BLOCKS:
                close(("p",), BLOCKS)
            if tag in ENDS:
                close(ENDS[tag], ("ul", "ol", "dl", "table", "menu", "dir", "select"))
            if tag == "a":
                close(("a",), BLOCKS)
            if tag not in VOID:
                zone = _zone(tag, m[3], zone)
                stack.append((tag, zone))
                links += tag == "a"
    hold(page[at:])
    flush()
    return out


def common_lines(left: list[str], right: list[str]) -> set[int]:
    """Places in ``left`` of a longest common subsequence with ``right`` (bit-parallel, a row of bits a line)."""
    both = set(left) & set(right)
    places = [i for i, x in enumerate(left) if x in both]
    right = [x for x in right if x in both]
    match: dict[str, int] = {}
    for bit, i in enumerate(places):
        match[left[i]] = match.get(left[i], 0) | 1 << bit
    full = (1 << len(places)) - 1
    rows = [full]
    for x in right:
        v = rows[-1]
        u = v & match[x]
        rows.append(((v + u) | (v - u)) & full)
    out, i, j = set(), len(right), len(places)
    while i and j:  # a bit of 0 is where the common length grows
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.add(places[j - 1])
            i, j = i - 1, j - 1
    return out


def main_lines(own: list[Line], others: list[list[Line]]) -> list[str]:
    """The main text of a page, given the lines of the pages that it is paired with, nearest first."""
    marked = any(x.main for x in own)
    mine = [x for x in own if x.main or not marked]
    for other in others:
        shared = common_lines([x.text for x in mine], [x.text for x in other])
        left = [x.text for i, x in enumerate(mine) if i not in shared or (marked and not x.linked)]
        if left:
            return left
    return [x.text for x in mine]


_URL = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")


def place(url: str | None) -> tuple[str, str] | None:
    """Host (without case and ``www.``) and path (without a last slash or extension); None where there is no host."""
    m = _URL.match(url or "")
    if not m or not m[1]:
        return None
    return m[1].lower().removeprefix("www."), re.sub(r"\.[a-zA-Z]{1,5}$", "", m[2].rstrip("/"))


def _alike(a: str, b: str) -> int:
    """Characters with which both paths begin."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_ROW = "block long, own boolean, host string, path string, page_id long, url string, texts array<string>, marks binary"


def _bounds(pages: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The first page of each block, and the last page before it, as (host, path, page_id); narrow columns only."""

    def run(batches):
        for batch in batches:
            rows = [(*p, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (p := place(u))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "path", "page_id"])

    keys = cut(pages.select("page_id", "url").mapInArrow(run, "host string, path string, page_id long").distinct(), "places")
    n = keys.count()
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    order = in_order(keys, F.col("host"), F.col("path"), F.col("page_id").asc_nulls_first())
    edges = order.where((F.pmod("position", F.lit(size)) == 0) | (F.pmod("position", F.lit(size)) == size - 1)).collect()
    forget(keys)
    key = lambda r: (r["host"], r["path"], r["page_id"] is not None, r["page_id"] or 0)
    firsts = sorted(key(r) for r in edges if r["position"] % size == 0)
    return firsts, sorted(key(r) for r in edges if r["position"] % size == size - 1)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html): the page's main text, its blocks
    joined by an empty line.

    Null and empty html gives an empty text. A page without a host in its URL (or without a URL) is paired with none;
    rows that repeat page_id and URL are next to each other and paired like other pages. Other columns play no part; an
    empty table gives no rows. Whole pages count, however long; a task holds three of them.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = spark.sparkContext.broadcast(_bounds(pages))

    def parse(batches):
        firsts, lasts = known.value
        loose = 0
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lines = page_lines(page or "")
                texts, marks = [x.text for x in lines], bytes(x.main + 2 * x.linked for x in lines)
                if (at := place(url)) is None:
                    loose += 1
                    rows.append((-1 - loose % 1024, True, None, None, page_id, url, texts, marks))
                    continue
                key = (*at, page_id is not None, page_id or 0)
                block = bisect.bisect_right(firsts, key) - 1
                rows.append((block, True, *at, page_id, url, texts, marks))
                if block and firsts[block] == key:
                    rows.append((block - 1, False, *at, page_id, url, texts, marks))
                if block + 1 < len(firsts) and lasts[block] == key:
                    rows.append((block + 1, False, *at, page_id, url, texts, marks))
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "own", "host", "path", "page_id", "url", "texts", "marks"])

    def paired(batches):
        for rows in _triples(batches):
            out = []
            for before, (_, _, host, path, page_id, url, lines), after in rows:
                near = [x for x in (before, after) if x is not None and host is not None and x[2] == host]
                near.sort(key=lambda x: -_alike(x[3], path))
                text = "\n\n".join(main_lines(lines, [x[6] for x in near]))
                out.append((page_id, url, text, len(text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_chars"])

    dealt = pages.mapInArrow(parse, _ROW).repartition("block")
    in_turn = dealt.sortWithinPartitions("block", "host", "path", F.col("page_id").asc_nulls_first())
    return in_turn.mapInArrow(paired, "page_id long, url string, text string, n_chars long")


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page before, page, page after) for the pages that a block owns, a list for each batch; neighbours are of the block."""
    before = now = None
    for batch in batches:
        out = []
        for *head, texts, marks in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            row = (*head, [Line(t, bool(k & 1), bool(k & 2)) for t, k in zip(texts, marks, strict=True)])
            if now is not None and now[1]:
                out.append((before, now, row if row[0] == now[0] else None))
            before, now = now if now is not None and now[0] == row[0] else None, row
        yield out
    if now is not None and now[1]:
        yield [(before, now, None)]
