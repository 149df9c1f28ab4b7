"""Main body of web pages by line-block distribution, with corpus statistics of repeated lines.

A page is stripped of its markup into lines, one per block (heading, paragraph, list
item, table cell, definition term, text directly in a div). Text lengths are summed over
sliding windows of lines. The body begins where the sums surge and ends where they dive;
a page may hold several such stretches, parted by boxes. Lines of links, lines inside
frame elements and lines that pages share as part of their frame have no length, so a
navigation bar, a notice or a footer makes no block.

Which repeated lines are frame and which are headings of the body, the pages tell:

1. Each page is parsed once into lines; each distinct line (digits and inner names
   masked) is counted over all pages.
2. The distribution of each page is taken over its lines that don't recur, and the
   recurring lines are counted inside and outside the stretch from surge to dive.
   Headings and table labels lie inside, navigation, notices and footers outside.
3. The distribution is taken again with the frame lines empty. A stretch with a surge is
   kept from surge to dive; of what lies outside only lines that recur inside bodies, cells
   and items of lists and tables, and the heading of the page are kept.

Only line hashes are shuffled for the counts. The hashes that at least HOT_SHARE of the
pages show are few at any size (mean lines of a page / HOT_SHARE at most) and go out by
broadcast; the others, none of which is a hot key, are joined. Defined results: null,
blank and error pages give no rows; plain text is read line by line; a block that occurs
twice on a page gives one row; repeated rows of a page count once; unclosed tags end
where the next block begins; on a single page nothing recurs, so its own lengths decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulaforge.session import cut

#: Lines in a window; the characters at which its sum surges and below which it has dived.
WINDOW, SURGE, DIVE = 3, 80, 40
LINK_SHARE = 0.5
#: A line recurs if a second page shows it.
RECURS = 2
#: Share of the pages from which a line goes by broadcast instead of a join.
HOT_SHARE = 1e-4
#: A heading above a body is shown on at most this share of the pages that show the frame line above it.
RARER = 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|title|template|svg|head(?=\s*>)(?!))\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|([^<]+|<)",
    re.S | re.I,
)
_HAS_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--|<!doctype", re.I)
# Elements that don't end a block, elements and roles that frame a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr input".split())
FRAME = frozenset("nav aside footer header button select form dialog menu".split())
_FRAME_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|dialog|alertdialog|search|menu|menubar|toolbar)\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li td th dt dd".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
LIKE = frozenset("p li dt dd tr td th option".split())
_NAME = re.compile(r"(?<=\s)[A-ZÀ-ÝŒ][\w’'-]*")
_DIGITS = re.compile(r"\d+")

#: What a line is, as bits; the depth of its boxes stands above them.
LINK, FRAMED, HEADING, LIST, TOP, TAGGED, BOX, DEPTH = 1, 2, 4, 8, 16, 32, 64, 8


def line_key(text: str) -> str:
    """A line with digits and the names inside it masked."""
    return _DIGITS.sub("#", _NAME.sub("@", text)).lower()


def _text(raw: str) -> str:
    """Decoded, white space as single blanks."""
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def page_lines(page: str) -> tuple[list[str], list[int], list[list[str]]]:
    """(texts, bits, texts of the links) of the blocks of a page in order; plain text gives its non-blank lines."""
    texts: list[str] = []
    bits: list[int] = []
    anchors: list[list[str]] = []
    if not _HAS_TAG.search(page):
        for raw in re.split(r"[\r\n]+", page):
            text = _text(raw)
            if text:
                texts.append(text)
                bits.append(0)
                anchors.append([])
        return texts, bits, anchors
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool]] = []
    link, frames, divs = False, 0, 0

    def finish() -> None:
        text = _text("".join(parts))
        parts.clear()
        if text:
            tag = stack[-1][0] if stack else ""
            bit = TAGGED | (FRAMED if frames else 0) | (HEADING if tag in HEADINGS else 0) | (LIST if tag in LISTED else 0) | (TOP if tag == "h1" else 0)
            own = []
            if linked:
                own = [a for a in map(_text, linked) if a]
                letters = sum(map(str.isalnum, text))
                bit |= LINK if sum(sum(map(str.isalnum, a)) for a in own) >= LINK_SHARE * max(1, letters) else 0
            texts.append(text)
            # Boxes inside a div: text directly in a div counts as standing beside it.
            bits.append(bit | (divs - (tag == "div")) << DEPTH)
            anchors.append(own)
        linked.clear()

    for _, closing, name, attrs, text in _TOKEN.findall(page):
        if text:
            if parts or not text.isspace():
                parts.append(text)
                if link:
                    linked.append(text)
            continue
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = not closing
        elif name not in INLINE:
            if parts:
                finish()
            link = False
            if name in VOID:
                continue
            if closing:
                if any(s[0] == name for s in stack):
                    while True:
                        top, frame = stack.pop()
                        frames -= frame
                        divs -= top == "div"
                        if top == name:
                            break
            else:
                # A paragraph or item that isn't closed ends where its like begins.
                if stack and stack[-1][0] == name and name in LIKE:
                    frames -= stack.pop()[1]
                frame = name in FRAME or ("role" in attrs and _FRAME_ROLE.search(attrs) is not None)
                frames += frame
                divs += name == "div"
                stack.append((name, frame))
    if parts:
        finish()
    # Headings with nothing but a list of links below head a box.
    for i in range(len(bits) - 1):
        if bits[i] & HEADING and not bits[i] & TOP and bits[i + 1] & LIST and bits[i + 1] & LINK:
            bits[i] |= BOX
    return texts, bits, anchors


def _sums(lengths: list[int]) -> list[int]:
    """The sums of the windows; one for fewer lines than a window has."""
    return [sum(lengths[i : i + WINDOW]) for i in range(max(1, len(lengths) - WINDOW + 1))]


def span(lengths: list[int]) -> tuple[int, int] | None:
    """First line of the surge and last line before the dive of the windowed sums; None without a surge."""
    sums = _sums(lengths)
    surge = next((i for i, s in enumerate(sums) if s >= SURGE), None)
    if surge is None:
        return None
    last = next(i for i in range(len(sums) - 1, -1, -1) if sums[i] >= DIVE)
    some = [i for i, n in enumerate(lengths) if n]
    return next(i for i in some if i >= surge), max(i for i in some if i <= last + WINDOW - 1)


def _stretch(lengths: list[int]) -> tuple[int, int] | None:
    """From the first surge to the last line of the last window that surges."""
    full = [i for i, s in enumerate(_sums(lengths)) if s >= SURGE]
    if not full:
        return None
    some = [i for i, n in enumerate(lengths) if n]
    return next(i for i in some if i >= full[0]), max(i for i in some if i <= full[-1] + WINDOW - 1)


def _statistics(keys: list[int], bits: list[int], lengths: list[int], recurring: set[int]) -> Iterator[tuple[int, int, int]]:
    """(key, inside, outside) of the lines of a marked-up page; links count as outside."""
    if not bits or not bits[0] & TAGGED:
        return
    top = next((i for i, b in enumerate(bits) if b & TOP and not b & FRAMED), None)
    own = _stretch([0 if i in recurring or b & (FRAMED | LINK) else n for i, (b, n) in enumerate(zip(bits, lengths))])
    if own is None:
        # A page without a line of its own (a copy of another) tells nothing but its links and frame elements.
        yield from ((keys[i], 0, 1) for i, b in enumerate(bits) if b & (LINK | FRAMED))
        return
    # Without a heading of the product the headings right above the surge begin the inside.
    begin = own[0] if top is None else top
    while top is None and begin and bits[begin - 1] & HEADING and not bits[begin - 1] & (FRAMED | LINK):
        begin -= 1
    level = bits[begin] >> DEPTH
    for i, b in enumerate(bits):
        inside = begin <= i <= own[1] and not b & FRAMED
        if b & LINK:
            # Links inside the body may repeat its headings: their lines say nothing of those.
            yield keys[i], 0, 0 if inside and b & LIST else 1
        else:
            boxed = b & BOX or b >> DEPTH > level
            yield keys[i], int(inside and not boxed), int(not inside or bool(boxed))


def body(texts: list[str], bits: list[int], frame: dict[int, int], inner: set[int]) -> list[str]:
    """The distinct blocks of the main body. frame: the lines that recur as frame, with the pages that show them;
    inner: the lines that recur inside bodies."""
    n = len(texts)
    empty = [bool(b & (FRAMED | LINK | BOX)) or i in frame for i, b in enumerate(bits)]
    top = next((i for i, b in enumerate(bits) if b & TOP and not b & FRAMED), None)
    if top is not None:
        # The heading of the product begins the body.
        for i in range(top):
            empty[i] = True
        empty[top] = False
    kept: list[int] = []
    surged = None
    i = 0
    while i < n:
        if empty[i]:
            i += 1
            continue
        end = i
        while end < n and not empty[end]:
            end += 1
        found = span([len(texts[k]) for k in range(i, end)])
        if found:
            surged = i if surged is None else surged
        for k in range(i, end):
            if found and found[0] <= k - i <= found[1] or k in inner or bits[k] & (LIST | HEADING):
                kept.append(k)
        i = end
    if surged is None:
        return []
    if not bits[0] & TAGGED:
        kept = [k for k in kept if k >= surged]
        # Plain text has no heading element. The line above the body is its heading if it is rare among the pages, unlike the frame above it.
        if surged and empty[surged - 1] and surged - 1 in frame and frame[surged - 1] <= RARER * frame.get(surged - 2, 0):
            kept.insert(0, surged - 1)
    return list(dict.fromkeys(texts[k] for k in kept))


def _hashes(keys: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(keys, dtype=object), categorize=False).view(np.int64) if keys else np.zeros(0, np.int64)


def _lists(values: pa.Array, lens: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), values)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page: its lines, their keys, lengths and bits, and the keys of the links in lines of several."""
    for batch in batches:
        texts, bits, lens, links, link_lens = [], [], [], [], []
        for page in batch.column(1).to_pylist():
            own, what, anchors = page_lines(page)
            texts += own
            bits += what
            lens.append(len(own))
            several = [line_key(a) for line, b in zip(anchors, what) if len(line) > 1 and b & LINK for a in line]
            links += several
            link_lens.append(len(several))
        keys = pa.array(_hashes([line_key(t) for t in texts]), pa.int64())
        cols = [
            batch.column(0), _lists(pa.array(texts, pa.string()), lens), _lists(keys, lens), _lists(pa.array([len(t) for t in texts], pa.int32()), lens),
            _lists(pa.array(bits, pa.int32()), lens), _lists(pa.array(_hashes(links), pa.int64()), link_lens),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "texts", "h", "n", "bits", "links"])


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, list[int]] = {}
        for h, n, bits, links, recurring in zip(*(batch.column(k).to_pylist() for k in range(5))):
            for key, inside, outside in _statistics(h, bits, n, set(recurring or ())):
                k = counts.setdefault(key, [0, 0])
                k[0] += inside
                k[1] += outside
            for key in links:
                counts.setdefault(key, [0, 0])[1] += 1
        cols = [pa.array(list(counts), pa.int64()), pa.array([k[0] for k in counts.values()], pa.int64()), pa.array([k[1] for k in counts.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["h", "inside", "outside"])


def _body_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, blocks = [], []
        for i, (texts, bits, known) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
            frame = {x["ord"]: x["v"] for x in known or () if x["v"] > 0}
            found = body(texts, bits, frame, {x["ord"] for x in known or () if x["v"] <= 0})
            ids += [i] * len(found)
            blocks += found
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(blocks, pa.string())], names=["id", "block"])


def _known_lines(parsed: DataFrame, values: DataFrame, hot_from: float, found: Column) -> DataFrame:
    """(id, known): of each page the lines whose key is in values(h, pages, …), as collected by `found`."""
    lines = parsed.select("id", F.posexplode("h").alias("ord", "h"))
    hot = F.broadcast(values.where(F.col("pages") >= hot_from))
    rest = values.where(F.col("pages") < hot_from)
    cold = lines.join(hot.select("h"), "h", "left_anti").join(rest, "h")
    return lines.join(hot, "h").unionByName(cold).groupBy("id").agg(found.alias("known"))


def main_body(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, block): the distinct blocks of the main body of each page."""
    p = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{content}`").alias("page")).where("id is not null and page is not null")
    kind = p.schema["id"].dataType.simpleString()
    once = p.groupBy("id").agg(F.min("page").alias("page"))
    parsed = cut(once.mapInArrow(_parse_batches, f"id {kind}, texts array<string>, h array<bigint>, n array<int>, bits array<int>, links array<bigint>"))
    hot_from = HOT_SHARE * parsed.count()
    recurring = cut(parsed.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= RECURS))
    shown = _known_lines(parsed, recurring, hot_from, F.collect_list("ord"))
    counts = parsed.select("id", "h", "n", "bits", "links").join(shown, "id", "left").select("h", "n", "bits", "links", "known").mapInArrow(_stat_batches, "h bigint, inside bigint, outside bigint")
    total = counts.groupBy("h").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where(F.col("inside") + F.col("outside") >= RECURS)
    # A positive value: frame, on so many pages; else inside.
    value = F.when(F.col("outside") > F.col("inside"), F.col("outside")).otherwise(F.lit(0))
    placed = cut(total.select("h", (F.col("inside") + F.col("outside")).alias("pages"), value.alias("v")))
    known = _known_lines(parsed, placed, hot_from, F.collect_list(F.struct("ord", "v")))
    decided = parsed.select("id", "texts", "bits").join(known, "id", "left").mapInArrow(_body_batches, f"id {kind}, block string")
    return decided.select(F.col("id").alias(key), "block")
