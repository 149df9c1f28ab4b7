"""Splitting oversized items at natural boundaries, with overlap.

The boundaries of a text form a hierarchy: blank lines, line breaks, ends of
sentences, white space, any character. Within each size window the coarsest kind
of boundary that occurs there is used, and among its boundaries the one at the
deepest valley of lexical cohesion: the similarity of the word counts in a block
before and a block after the boundary, against the peaks on both sides. The next
piece starts up to `overlap` characters before the cut, at the start of a word.

Every text also gets its boundary level: the first kind at which all trimmed parts
fit the limit by themselves.

Defined results: null texts and texts of at most `limit` characters give no rows;
a text of white space alone gives its level and no pieces; repeated rows count once
per key; equal valleys are cut at the later one; a text without any white space is
cut every `limit` characters. Very long texts are worked off window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = r"(?:\r\n|\n|\r)"
LEVELS = [
    ("paragraph", re.compile(rf"{_BREAK}[^\S\r\n]*{_BREAK}\s*")),
    ("line", re.compile(rf"{_BREAK}\s*")),
    ("sentence", re.compile(rf"(?<=[.!?])\s+|{_BREAK}\s*")),
    ("word", re.compile(r"\s+")),
]
_WORD = re.compile(r"[^\W_]{3,}")


@dataclass(frozen=True)
class SplitRule:
    limit: int = 2000
    overlap: int = 200
    #: A piece is filled at least this far before a cut is looked for.
    least_fill: float = 0.5
    #: Words in each block of the cohesion measure.
    block_words: int = 60


def _fits(text: str, pattern: re.Pattern[str], limit: int) -> bool:
    """Whether every trimmed part between the boundaries has at most limit characters."""
    at = 0
    for m in pattern.finditer(text):
        if m.start() - at > limit and len(text[at : m.start()].strip()) > limit:
            return False
        at = m.end()
    return len(text) - at <= limit or len(text[at:].strip()) <= limit


def boundary_level(text: str, limit: int) -> str:
    return next((name for name, pattern in LEVELS if _fits(text, pattern, limit)), "char")


class _Cohesion:
    """Similarity of the word blocks before and after a place in the text."""

    def __init__(self, text: str, block: int):
        found = [(m.start(), m.group()) for m in _WORD.finditer(text.lower())]
        ids: dict[str, int] = {}
        self.at = np.array([a for a, _ in found], np.int64)
        self.word = np.array([ids.setdefault(w, len(ids)) for _, w in found], np.int64)
        self.block = block

    def similarity(self, place: int) -> float:
        k = int(np.searchsorted(self.at, place))
        before, after = self.word[max(0, k - self.block) : k], self.word[k : k + self.block]
        if not len(before) or not len(after):
            return 0.0
        a, na = np.unique(before, return_counts=True)
        b, nb = np.unique(after, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return float((na[i] * nb[j]).sum() / np.sqrt((na**2).sum() * (nb**2).sum()))

    def deepest(self, gaps: list[tuple[int, int]]) -> tuple[int, int]:
        """The gap at the deepest valley; the later of equal ones."""
        if len(gaps) == 1:
            return gaps[0]
        sims = np.array([self.similarity(b) for _, b in gaps])
        left = np.maximum.accumulate(sims)
        right = np.maximum.accumulate(sims[::-1])[::-1]
        depth = np.round(left + right - 2 * sims, 9)
        return gaps[len(gaps) - 1 - int(np.argmax(depth[::-1]))]


def split_text(text: str, rule: SplitRule) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind of the cut at its end) of the pieces, each of at most rule.limit characters."""
    n = len(text.rstrip())
    begin = len(text) - len(text.lstrip())
    cohesion = None
    fresh = begin
    while fresh < n:
        if n - begin <= rule.limit:
            yield begin, n, "end"
            return
        stop, least = begin + rule.limit, max(fresh + 1, begin + int(rule.limit * rule.least_fill))
        cut: tuple[int, int] | None = None
        kind = "char"
        for floor in (least, fresh + 1):
            for name, pattern in LEVELS:
                # Look a little further so that a boundary that begins within the window is seen whole.
                gaps = [(m.start(), m.end()) for m in pattern.finditer(text, floor, min(n, stop + 64)) if m.start() <= stop]
                if gaps:
                    if cohesion is None:
                        cohesion = _Cohesion(text, rule.block_words)
                    # Word boundaries tell no topics apart: the last one fills the piece best.
                    cut, kind = (gaps[-1] if name == "word" else cohesion.deepest(gaps)), name
                    break
            if cut:
                break
        end, fresh = cut or (stop, stop)
        yield begin, end, kind
        while fresh < n and text[fresh].isspace():
            fresh += 1
        begin = _overlap_start(text, begin, end, fresh, rule)


def _overlap_start(text: str, begin: int, end: int, fresh: int, rule: SplitRule) -> int:
    """Start of the next piece: the first word within the overlap, else the overlap's first character."""
    low = max(begin + 1, end - rule.overlap)
    if low >= end or rule.overlap <= 0:
        return fresh
    if text[low - 1].isspace():
        return low + len(text[low:end]) - len(text[low:end].lstrip()) if text[low:end].strip() else fresh
    m = re.compile(r"\s+").search(text, low, end)
    if m:
        return m.end() if m.end() < end else fresh
    return low


SCHEMA = "tbl string, item_key string, boundary string, piece_no int, begin_char int, end_char int, cut_at string, piece string"
_ARROW = pa.schema(
    [("tbl", pa.string()), ("item_key", pa.string()), ("boundary", pa.string()), ("piece_no", pa.int32()), ("begin_char", pa.int32()), ("end_char", pa.int32()), ("cut_at", pa.string()), ("piece", pa.string())]
)


def _split_batches(batches: Iterator[pa.RecordBatch], rule: SplitRule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for tbl, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            level = boundary_level(text, rule.limit)
            pieces = list(split_text(text, rule)) or [(None, None, None)]
            rows += [(tbl, key, level, k, a, b, kind, None if a is None else text[a:b]) for k, (a, b, kind) in enumerate(pieces)]
        cols = list(zip(*rows)) or [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def split_oversized(items: DataFrame, rule: SplitRule) -> DataFrame:
    """items(tbl, key, text) → one row per piece of every text of more than rule.limit characters.

    The filter runs before the rows of one key are brought together, so only oversized
    texts are shuffled, once.
    """
    long = items.where(F.length("text") > rule.limit).select("tbl", "key", "text").dropDuplicates(["tbl", "key"])
    return long.mapInArrow(lambda it: _split_batches(it, rule), SCHEMA)


def boundary_levels(items: DataFrame, rule: SplitRule) -> DataFrame:
    """(tbl, item_key, boundary) of every oversized text, from its first piece."""
    return split_oversized(items, rule).where("piece_no = 0").select("tbl", "item_key", "boundary")
