"""Long exact spans shared between records, by difference-cover anchors.

Windows are hashed only at positions that lie in a difference cover modulo a period.
For any two positions some shift below the period takes both into the cover, so two
records that share a run of `min_chars` share at least one anchored window of
`min_chars - period + 1` characters. Anchors that another text holds too mark where a
run may lie; there alone the match is extended: every window of `min_chars` around a
shared anchor is hashed, and the windows that occur in another text are the runs.

Both steps go through packed hash buckets (see buckets.py). No pairs are formed, so a
passage copied into a third of all records costs no more than its characters.

Defined results: null texts and texts shorter than `min_chars` have no runs; records
with equal texts share their whole text; a run that only recurs within its own record
isn't shared; rows with repeated ids count once per id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulaforge.llm import buckets as B
from bulaforge.session import cut

#: Perfect difference set: the differences modulo 133 hit every residue once.
PERIOD = 133
COVER = (0, 1, 3, 15, 46, 71, 75, 84, 94, 101, 112, 128)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTES_PER_BUCKET = 4 << 20


def difference_cover(period: int) -> tuple[int, ...]:
    """A difference cover of the period; the perfect set where one is stated, else a greedy one."""
    if period == PERIOD:
        return COVER
    cover, have = [0], {0}
    while len(have) < period:
        gain = lambda x: len({(x - y) % period for y in cover} | {(y - x) % period for y in cover} | have)
        best = max(range(period), key=gain)
        have |= {(best - y) % period for y in cover} | {(y - best) % period for y in cover}
        cover.append(best)
    return tuple(sorted(cover))


_TABLES: dict[str, np.ndarray] = {}


def tables_for(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random word per code point; powers of the base and of its inverse."""
    if "char" not in _TABLES:
        _TABLES["char"] = B.mix64(np.arange(0x110000, dtype=np.uint64) * np.uint64(BASE) + np.uint64(1)) | np.uint64(1)
    if len(_TABLES.get("pow", ())) < size:
        with np.errstate(over="ignore"):
            for name, base in (("pow", BASE), ("inv", BASE_INVERSE)):
                _TABLES[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
    return _TABLES["char"], _TABLES["pow"], _TABLES["inv"]


def _segments(lengths: list[int], reach: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, begin, end) of about SLICE characters; long texts are cut, each piece reaching `reach` further."""
    group: list[tuple[int, int, int]] = []
    size = 0
    for row, n in enumerate(lengths):
        begin = 0
        while begin < n:
            end = min(n, begin + B.SLICE)
            group.append((row, begin, end))
            size += min(n, end + reach) - begin
            begin = end
            if size >= B.SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


class _Windows:
    """Prefix sums of a polynomial hash over one group of segments."""

    def __init__(self, texts: list[str], group: list[tuple[int, int, int]], reach: int):
        parts = [texts[r][a : min(len(texts[r]), b + reach)] for r, a, b in group]
        self.lens = np.array([len(p) for p in parts])
        self.base = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.begin = np.array([a for _, a, _ in group])
        self.own = np.array([b - a for _, a, b in group])
        self.row = np.array([r for r, _, _ in group])
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        char, power, self.inverse = tables_for(len(points))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(char[points] * power[: len(points)])])

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return B.mix64((self.sums[at + width] - self.sums[at]) * self.inverse[at])


def _anchor_rows(batches: Iterator[pa.RecordBatch], period: int, cover: tuple[int, ...], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    in_cover = np.array(cover)
    for batch in batches:
        owner = batch.column(0).to_numpy()
        _, once = np.unique(owner, return_index=True)
        once.sort()
        owner, texts = owner[once], batch.column(1).take(pa.array(once)).to_pylist()
        for group in _segments([len(t) for t in texts], width):
            w = _Windows(texts, group, width)
            at, seg, pos = [], [], []
            for k in range(len(group)):
                lo, hi = w.begin[k], min(w.begin[k] + w.own[k], w.begin[k] + w.lens[k] - width + 1)
                if hi <= lo:
                    continue
                p = (np.arange(lo // period, hi // period + 1)[:, None] * period + in_cover).ravel()
                p = p[(p >= lo) & (p < hi)]
                pos.append(p)
                at.append(p - lo + w.base[k])
                seg.append(np.full(len(p), k))
            if at:
                at, seg, pos = np.concatenate(at), np.concatenate(seg), np.concatenate(pos)
                yield B.encode_slice(owner[w.row[seg]], w.hashes(at, width), pos, buckets, wide=False)


def _window_rows(batches: Iterator[pa.RecordBatch], min_chars: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, owner = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        places = [np.unique(np.concatenate([B.unpack_places(p) for p in ps])) for ps in batch.column(2).to_pylist()]
        for group in _segments([len(t) for t in texts], min_chars):
            w = _Windows(texts, group, min_chars)
            at, seg, pos = [], [], []
            for k in range(len(group)):
                lo, hi = w.begin[k], min(w.begin[k] + w.own[k], w.begin[k] + w.lens[k] - min_chars + 1)
                anchors = places[w.row[k]]
                if hi <= lo or not len(anchors):
                    continue
                # Starts of the windows that hold an anchor: a difference array over the segment.
                mark = np.zeros(hi - lo + 1, np.int32)
                a = np.clip(anchors - (min_chars - width), lo, hi) - lo
                b = np.clip(anchors + 1, lo, hi) - lo
                np.add.at(mark, a, 1)
                np.add.at(mark, b, -1)
                p = np.nonzero(np.cumsum(mark[:-1]) > 0)[0]
                pos.append(p + lo)
                at.append(p + w.base[k])
                seg.append(np.full(len(p), k))
            if at:
                at, seg, pos = np.concatenate(at), np.concatenate(seg), np.concatenate(pos)
                yield B.encode_slice(owner[w.row[seg]], w.hashes(at, min_chars), pos, buckets, wide=True)


def _covered(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[int] = []
        for ps in batch.column(1).to_pylist():
            starts = np.unique(np.concatenate([B.unpack_places(p) for p in ps]))
            out.append(int(min_chars + np.minimum(np.diff(starts), min_chars).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["owner", "covered"])


def shared_chars(df: DataFrame, key: str, text: str, min_chars: int = 200) -> DataFrame:
    """(key, shared_chars): each record with at least one run of min_chars characters that also
    occurs in another record, and how many of its characters lie in such runs."""
    period = PERIOD if min_chars > PERIOD + 40 else max(2, min_chars // 2)
    cover, width = difference_cover(period), min_chars - period + 1
    n = B.bucket_count(df, BYTES_PER_BUCKET)
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.length("text") >= min_chars)
    docs = docs.select("id", F.xxhash64("text").alias("owner"), "text")

    # Equal texts are told by 64 and another 128 bits.
    texts = docs.select("id", "owner", F.unhex(F.md5("text")).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))
    groups = texts.groupBy("owner", "digest").agg(F.countDistinct("id").alias("copies"), F.min("id").alias("rep"))

    anchors = B.shared_places(docs.select("owner", "text"), lambda it: _anchor_rows(it, period, cover, width, n), n, wide=False)
    # One text stands for all its copies, so a text that fills a third of the input is extended once.
    marked = cut(B.join_places(anchors).join(groups, "owner").select(F.col("rep").alias("id"), "owner", "places"))
    bitmap, bits = B.key_filter(marked, "owner", marked.count())
    possible = B.keep_possible(docs.select("id", "owner", "text"), "owner", bitmap, bits)
    todo = possible.dropDuplicates(["id", "owner"]).join(marked, ["id", "owner"]).select("owner", "text", "places")
    windows = B.shared_places(todo, lambda it: _window_rows(it, min_chars, width, n), n, wide=True)
    covered = B.join_places(windows).mapInArrow(lambda it: _covered(it, min_chars), "owner bigint, covered bigint")

    amount = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("covered"))
    out = texts.join(groups.join(covered, "owner", "left").select("owner", "digest", "copies", "covered"), ["owner", "digest"])
    return out.groupBy(F.col("id").alias(key)).agg(F.max(amount).alias("shared_chars")).where(F.col("shared_chars") > 0)
