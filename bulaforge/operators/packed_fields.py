"""Splitting fields that hold several values into one row per value, position kept.

The scan works on the bytes of the Arrow string buffer: quote parity, bracket
depth and delimiter masks are computed for a whole batch at once with numpy,
child offsets are derived from the cut positions, a list array is built over the
trimmed pieces and flattened together with its parent ordinals. No row is visited
by a Python loop.

Rules (`list` mode): separators are ``; | & + • ·``, line breaks, tabs, ``,``,
``/``, a dash between blanks and the word for "and" between blanks. Nothing
separates inside quotes (``"…"`` with doubled quotes, ``“…”``, ``«…»``) or round
brackets. A comma or slash between digits, a comma of a locant such as ``N,N-``,
and a slash of a unit such as ``mg/ml`` do not separate.

Rules (`labelled` mode): the same separators count only where a label and a colon
follow, so the text of an item stays whole; text before the first label is one value.

Defined results: a null, empty or blank field gives no rows; values that are empty
after trimming are not counted in `pos`; an odd last quote and unbalanced brackets
are ordinary characters; repeated input rows give repeated output rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
EDGE = WHITE + ";|,•·/&+-–—"
#: The words for "and" in the languages of the data.
AND_WORDS = ("e", "y", "et", "and")


def _shift(a: np.ndarray, by: int, fill: int) -> np.ndarray:
    """a moved so that position i holds a[i + by]."""
    out = np.full_like(a, fill)
    if by > 0:
        out[:-by] = a[by:]
    elif by < 0:
        out[-by:] = a[:by]
    else:
        out[:] = a
    return out


def _find(data: np.ndarray, token: bytes) -> np.ndarray:
    """Mask of the positions where the bytes of token begin."""
    if len(data) < len(token):
        return np.zeros(len(data), bool)
    mask = data == token[0]
    for k, b in enumerate(token[1:], 1):
        mask &= _shift(data, k, 0) == b
    return mask


def _balanced_depth(opens: np.ndarray, closes: np.ndarray, starts: np.ndarray, lens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Depth at each byte; rows whose marks don't balance count as having none."""
    step = opens.astype(np.int32) - closes.astype(np.int32)
    cum = np.cumsum(step, dtype=np.int64)
    base = np.where(starts > 0, cum[np.maximum(starts - 1, 0)], 0)
    depth = cum - base[row]
    full = lens > 0
    bad = np.zeros(len(lens), bool)
    if full.any():
        ends = starts[full] + lens[full] - 1
        low = np.minimum.reduceat(depth, starts[full])
        bad[full] = (depth[ends] != 0) | (low < 0)
    depth[bad[row]] = 0
    return depth


class _Scan:
    """Masks over the bytes of a string array without nulls."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.large_string())
        self.offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        raw = values.buffers()[2]
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        self.starts = (self.offsets[:-1] - lo).astype(np.int64)
        self.lens = np.diff(self.offsets)
        self.row = np.repeat(np.arange(len(self.lens)), self.lens)
        d, size = self.data, len(self.data)
        first = np.zeros(size, bool)
        first[self.starts[self.lens > 0]] = True
        last = np.zeros(size, bool)
        last[(self.starts + self.lens - 1)[self.lens > 0]] = True
        self.prev = np.where(first, 10, _shift(d, -1, 10))
        self.next = np.where(last, 10, _shift(d, 1, 10))
        nbsp = _find(d, b"\xc2\xa0")
        self.blank = (d == 32) | ((d >= 9) & (d <= 13)) | nbsp | _shift(nbsp.view(np.uint8), -1, 0).view(bool)
        bullets = [_find(d, t) for t in ("•".encode(), "·".encode())]
        dashes = [_find(d, t) for t in ("–".encode(), "—".encode())]
        marks = np.zeros(size, bool)
        for m, width in [*((b, 3 - k) for k, b in enumerate(bullets)), *((x, 3) for x in dashes)]:
            for k in range(width):
                marks |= _shift(m.view(np.uint8), -k, 0).view(bool)
        quotes = {}
        for name, token in (("lo", "“"), ("lc", "”"), ("go", "«"), ("gc", "»")):
            quotes[name] = _find(d, token.encode())
            for k in range(len(token.encode())):
                marks |= _shift(quotes[name].view(np.uint8), -k, 0).view(bool)
        self.letter = (((d | 32) >= 97) & ((d | 32) <= 122)) | ((d >= 128) & ~self.blank & ~marks)
        self.digit = (d >= 48) & (d <= 57)

        straight = d == 0x22
        counts = np.bincount(self.row[straight], minlength=len(self.lens)) if size else np.zeros(len(self.lens), int)
        odd = np.nonzero(counts % 2)[0]
        if len(odd):
            at = np.nonzero(straight)[0]
            straight = straight.copy()
            straight[at[np.searchsorted(self.row[at], odd, side="right") - 1]] = False
        cum = np.cumsum(straight, dtype=np.int64)
        base = np.where(self.starts > 0, cum[np.maximum(self.starts - 1, 0)], 0) if size else np.zeros(len(self.lens), int)
        parity = ((cum - base[self.row]) & 1).astype(bool)
        free = ~parity
        curly = _balanced_depth((quotes["lo"] | quotes["go"]) & free, (quotes["lc"] | quotes["gc"]) & free, self.starts, self.lens, self.row) if size else np.zeros(0, int)
        free = free & (curly == 0)
        brackets = _balanced_depth((d == 40) & free, (d == 41) & free, self.starts, self.lens, self.row) if size else np.zeros(0, int)
        self.in_brackets = brackets > 0
        self.outside = free & (brackets == 0)
        self.quote = straight | quotes["lo"] | quotes["go"]
        self.bullets, self.dashes = bullets, dashes

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of every separator, in order."""
        d, out = self.data, self.outside
        if not len(d):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        after2 = _shift(self.next, 1, 10)
        blank_before = np.isin(self.prev, (32, 9, 10, 13, 0xA0))
        blank_after = np.isin(self.next, (32, 9, 10, 13)) | ((self.next == 0xC2) & (after2 == 0xA0))
        one = np.isin(d, np.frombuffer(b";|&+\n\r\t\x0b\x0c", np.uint8))
        digits = np.isin(self.prev, np.arange(48, 58)) & np.isin(self.next, np.arange(48, 58))
        alpha = lambda x: ((x | 32) >= 97) & ((x | 32) <= 122)
        before2 = _shift(self.prev, -1, 10)
        locant = alpha(self.prev) & ~alpha(before2) & alpha(self.next) & np.isin(after2, (45, 44, 39))
        one |= (d == 44) & ~digits & ~locant
        one |= (d == 47) & ~digits & ~self._unit_slash()
        one |= (d == 45) & blank_before & blank_after
        begin, width = [np.nonzero(one & out)[0]], [1]
        for mask, size in ((self.bullets[0], 3), (self.bullets[1], 2)):
            begin.append(np.nonzero(mask & out)[0])
            width.append(size)
        for mask in self.dashes:
            tail = _shift(d, 3, 10)
            begin.append(np.nonzero(mask & out & blank_before & np.isin(tail, (32, 9, 10, 13, 0xC2)))[0])
            width.append(3)
        low = np.where((d >= 65) & (d <= 90), d | 32, d)
        for word in AND_WORDS:
            token = word.encode()
            tail = _shift(d, len(token), 10)
            begin.append(np.nonzero(_find(low, token) & out & blank_before & np.isin(tail, (32, 9, 10, 13)))[0])
            width.append(len(token))
        ends = np.concatenate([b + w for b, w in zip(begin, width)])
        begins = np.concatenate(begin)
        order = np.argsort(begins, kind="stable")
        return begins[order], ends[order]

    def _unit_slash(self) -> np.ndarray:
        """Slashes right after a short run of letters that follows a number, and right before a word."""
        d = self.data
        at = np.nonzero(d == 47)[0]
        out = np.zeros(len(d), bool)
        if not len(at):
            return out
        index = np.arange(len(d))
        no_letter = np.maximum.accumulate(np.where(self.letter, -1, index))
        no_blank = np.maximum.accumulate(np.where(self.blank, -1, index))
        prior = np.maximum(at - 1, 0)
        stop = no_letter[prior]
        run = prior - stop
        number = no_blank[np.maximum(stop, 0)]
        ok = (at > self.starts[self.row[at]]) & (run >= 1) & (run <= 5) & (stop >= self.starts[self.row[at]])
        ok &= self.digit[np.maximum(number, 0)] & (number >= self.starts[self.row[at]])
        ok &= self.letter[np.minimum(at + 1, len(d) - 1)] | self.digit[np.minimum(at + 1, len(d) - 1)]
        out[at[ok & (at + 1 < self.starts[self.row[at]] + self.lens[self.row[at]])]] = True
        return out

    def label_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """The separators that stand right before a label and its colon."""
        begins, ends = self.cuts()
        d = self.data
        colon = np.nonzero((d == 58) & ~self.in_brackets)[0]
        if not len(colon):
            return begins[:0], ends[:0]
        k = np.searchsorted(begins, colon, side="left") - 1
        same = k >= 0
        kk = np.maximum(k, 0)
        if len(begins):
            same &= self.row[np.minimum(begins[kk], len(d) - 1)] == self.row[colon]
        else:
            same[:] = False
        colon, kk = colon[same], kk[same]
        usual = self.letter | self.blank | np.isin(d, np.frombuffer(b".()-", np.uint8))
        bad = np.concatenate([[0], np.cumsum(~usual)])
        letters = np.concatenate([[0], np.cumsum(self.letter)])
        quote_width = np.zeros(len(d), np.int64)
        quote_width[self.quote] = 1
        # The label may stand behind an opening quote: look at the first byte that isn't blank.
        index = np.arange(len(d))
        next_full = np.minimum.accumulate(np.where(self.blank, len(d), index)[::-1])[::-1]
        begin = next_full[np.minimum(ends[kk], len(d) - 1)]
        begin = np.minimum(begin, colon)
        is_quote = self.quote[begin]
        wide = np.where(d[begin] == 0x22, 1, np.where(d[begin] == 0xE2, 3, 2))
        begin = np.minimum(np.where(is_quote, begin + wide, begin), colon)
        good = (bad[colon] - bad[begin] == 0) & (letters[colon] - letters[begin] >= 2) & self.letter[np.minimum(begin, len(d) - 1)]
        keep = np.unique(kk[good])
        return begins[keep], ends[keep]


def split_values(values: pa.Array, mode: str = "list") -> pa.ListArray:
    """Array of strings to array of lists of trimmed, unquoted, non-empty values; null gives an empty list."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    scan = _Scan(values)
    begins, ends = scan.cuts() if mode == "list" else scan.label_cuts()
    n = len(values)
    of = scan.row[begins] if len(begins) else np.zeros(0, np.int64)
    # A piece begins at a row's start and at each separator's end, and ends at the next separator or the row's end.
    piece_row = np.concatenate([np.arange(n), of])
    piece_begin = np.concatenate([scan.starts, ends])
    order = np.lexsort((piece_begin, piece_row))
    piece_row, piece_begin = piece_row[order], piece_begin[order]
    stop_row = np.concatenate([of, np.arange(n)])
    stop_at = np.concatenate([begins, scan.starts + scan.lens])
    order = np.lexsort((stop_at, stop_row))
    piece_end = np.maximum(stop_at[order], piece_begin)
    pieces = _slices(scan.data, piece_begin, piece_end)
    pieces = _unquote(pc.utf8_trim(pieces, characters=WHITE if mode == "list" else EDGE))
    full = np.asarray(pc.greater(pc.utf8_length(pieces), 0))
    counts = np.bincount(piece_row[full], minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pieces.filter(pa.array(full)).cast(pa.string()))


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """String array of the byte ranges, copied by one gather."""
    lens = end - begin
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    index = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], lens)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[index].tobytes()))


def _unquote(pieces: pa.Array) -> pa.Array:
    """Take off enclosing quotes; a doubled straight quote inside becomes one."""
    for opening, closing in (('"', '"'), ("“", "”"), ("«", "»")):
        length = pc.utf8_length(pieces)
        quoted = pc.and_(pc.and_(pc.starts_with(pieces, opening), pc.ends_with(pieces, closing)), pc.greater(length, 1))
        if not pc.any(quoted).as_py():
            continue
        inner = pc.utf8_slice_codeunits(pieces, 1, stop=-1)
        if opening == '"':
            # Two quoted values side by side are no enclosed value: an inner quote must be doubled.
            single = pc.match_substring(pc.replace_substring(inner, '""', ""), '"')
            quoted = pc.and_(quoted, pc.invert(single))
            inner = pc.replace_substring(inner, '""', '"')
        pieces = pc.if_else(quoted, pc.utf8_trim(inner, characters=WHITE), pieces)
    return pieces


def _explode_batches(batches: Iterator[pa.RecordBatch], keys: list[str], fields: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, mode in fields.items():
            column = batch.column(f"f_{name}")
            if pa.types.is_list(column.type):
                outer = pc.list_parent_indices(column)
                inner = split_values(column.flatten(), mode)
                parent = outer.take(pc.list_parent_indices(inner))
            else:
                inner = split_values(column, mode)
                parent = pc.list_parent_indices(inner)
            ordinal = np.asarray(parent)
            first = np.searchsorted(ordinal, ordinal, side="left") if len(ordinal) else ordinal
            pos = (np.arange(len(ordinal)) - first + 1).astype(np.int32)
            cols = [batch.column(f"k_{k}").take(parent) for k in keys]
            cols += [pa.array([name] * len(ordinal), pa.string()), pa.array(pos), inner.flatten()]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, schema)], schema=schema)


def explode_packed(df: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """One row (keys…, fld, pos, val) per value of the named string or array<string> fields.

    `fields` maps a column to `list` or `labelled`. Other columns of df are pruned, so
    they may have any name, `fld`, `pos` and `val` included; a key of such a name is refused.
    No shuffle: a map over Arrow batches.
    """
    if {"fld", "pos", "val"} & set(keys):
        raise ValueError("a key can't be named fld, pos or val: those are columns of the result")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [T.StructField("fld", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())]
    )
    arrow = to_arrow_schema(spark_schema)
    picked = df.select(*[F.col(f"`{k}`").alias(f"k_{k}") for k in keys], *[F.col(f"`{f}`").alias(f"f_{f}") for f in fields])
    return picked.mapInArrow(lambda it: _explode_batches(it, keys, fields, arrow), spark_schema)
