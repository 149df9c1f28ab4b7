"""Packed shuffles: finding equal hashes among billions of them at a few bytes each.

A map over Arrow batches packs the hashes of a slice of items into one binary row
per hash bucket; the shuffle moves those rows; a map per bucket compares them. Per
hash this costs its stored bytes plus about one byte of position, instead of a row.

A hash that several owners of one slice share is settled in that slice: its places go
out as hits at once and only two of them go on to the bucket, so a hash held by a
third of all items reaches its bucket once per slice. The bucket keeps one entry per
distinct hash; their number is bounded by the number of buckets, which follows the input.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2_000_000
HASH_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Plans over rows that aren't files report this size or more.
UNKNOWN_BYTES = 1 << 60


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files under df, from the plan's leaves without a job; where they aren't files, a third of the bytes of its texts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        size = (df.select(F.sum(sum(texts, F.lit(0)))).first()[0] or 0) // 3
    return max(1, size)


def bucket_count(df: DataFrame, bytes_per_bucket: int) -> int:
    return max(12, math.ceil(source_bytes(df) / bytes_per_bucket))


#: Shuffle partitions at most; a partition takes several buckets one after the other beyond it.
MAX_PARTITIONS = 50_000


def place_buckets(packed: DataFrame, buckets: int) -> DataFrame:
    """The rows of one bucket together and in order of their buckets."""
    n = min(buckets, MAX_PARTITIONS)
    return packed.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket")


def groups_of(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the buckets that occur; the places in ascending order."""
    by = np.argsort(where, kind="stable")
    found, begin = np.unique(where[by], return_index=True)
    for k, mine in zip(found.tolist(), np.split(by, begin[1:]) if len(begin) else ()):
        yield k, mine


def _squeeze(a: np.ndarray) -> bytes:
    """Small integers as zstd: planes of equal significance lie together."""
    raw = a.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy().tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _expand(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return raw.reshape(4, n).T.copy().view("<u4").ravel()


def pack_places(pos: np.ndarray) -> bytes:
    """Ascending positions as packed differences."""
    p = pos.astype(np.int64)
    return struct.pack("<I", len(p)) + _squeeze(np.diff(p, prepend=0))


def unpack_places(b: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", b)
    return np.cumsum(_expand(b[4:], n), dtype=np.int64)


def _pack(owner: np.ndarray, h: np.ndarray, pos: np.ndarray, wide: bool) -> bytes:
    """A new group begins where the owner changes or the position falls back (a repeated row)."""
    first = np.nonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pos[1:] < pos[:-1])]))[0]
    counts = np.diff(np.append(first, len(owner)))
    step = np.diff(pos.astype(np.int64), prepend=0)
    step[first] = pos[first]
    small = _squeeze(np.concatenate([counts, step]))
    head = struct.pack("<III", len(first), len(owner), len(small))
    return head + owner[first].astype("<i8").tobytes() + small + (h.astype("<u8") if wide else h.astype("<u4")).tobytes()


def _unpack(b: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owners, n, size = struct.unpack_from("<III", b)
    at = 12
    own = np.frombuffer(b, "<i8", owners, at)
    at += 8 * owners
    small = _expand(b[at : at + size], owners + n).astype(np.int64)
    counts, step = small[:owners], small[owners:]
    h = np.frombuffer(b, "<u8" if wide else "<u4", n, at + size).astype(np.uint64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    base = total[first] - step[first]
    return np.repeat(own, counts), h, total - np.repeat(base, counts)


def _shared(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order by hash; begins of its runs; whether a run has two owners or more."""
    order = np.argsort(h, kind="stable")
    hs, os_ = h[order], owner[order]
    begin = np.nonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))[0]
    return order, begin, np.minimum.reduceat(os_, begin) != np.maximum.reduceat(os_, begin)


def _hit_rows(owner: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(owner):
        return
    order = np.lexsort((pos, owner))
    owner, pos = owner[order], pos[order]
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    for a, b in zip(first, np.append(first[1:], len(owner))):
        yield int(owner[a]), pack_places(np.unique(pos[a:b]))


SHUFFLE_SCHEMA = pa.schema([("bucket", pa.int32()), ("owner", pa.int64()), ("payload", pa.binary())])


def encode_slice(owner: np.ndarray, h: np.ndarray, pos: np.ndarray, buckets: int, wide: bool) -> pa.RecordBatch:
    """The shuffle rows of one slice: hits settled here (bucket < 0) and one payload per bucket."""
    rows: list[tuple[int, int, bytes]] = []
    if len(h):
        order, begin, multi = _shared(h, owner)
        lens = np.diff(np.append(begin, len(h)))
        member = np.repeat(multi, lens)
        # Two entries of different owners stand for a shared hash, so that later ones of either owner see it as shared.
        sent = np.zeros(len(h), bool)
        sent[begin] = True
        other = owner[order] != np.repeat(owner[order[begin]], lens)
        second = np.minimum.reduceat(np.where(other, np.arange(len(h)), len(h)), begin)
        sent[second[second < len(h)]] = True
        hit = order[member]
        rows += [(-1 - int(o % buckets), o, p) for o, p in _hit_rows(owner[hit], pos[hit])]
        keep = np.sort(order[~member | sent])
        owner, h, pos = owner[keep], h[keep], pos[keep]
        where = (h >> np.uint64(40)) % np.uint64(buckets)
        for k, pick in groups_of(where):
            rows.append((k, 0, _pack(owner[pick], h[pick] & np.uint64(0xFFFFFFFFFFFFFFFF if wide else 0xFFFFFFFF), pos[pick], wide)))
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, SHUFFLE_SCHEMA)], schema=SHUFFLE_SCHEMA)


class _Bucket:
    """One entry per distinct hash; yields the places of hashes that two owners share."""

    def __init__(self) -> None:
        self.h = np.zeros(0, np.uint64)
        self.owner = np.zeros(0, np.int64)
        self.pos = np.zeros(0, np.int64)
        self.told = np.zeros(0, bool)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
        self.parts.append(part)
        self.waiting += len(part[0])
        if self.waiting > SLICE:
            yield from self.settle()

    def settle(self) -> Iterator[tuple[int, bytes]]:
        if not self.parts:
            return
        old = len(self.h)
        owner = np.concatenate([self.owner, *[p[0] for p in self.parts]])
        h = np.concatenate([self.h, *[p[1] for p in self.parts]])
        pos = np.concatenate([self.pos, *[p[2] for p in self.parts]])
        told = np.concatenate([self.told, np.zeros(len(h) - old, bool)])
        self.parts, self.waiting = [], 0
        order, begin, multi = _shared(h, owner)
        lens = np.diff(np.append(begin, len(h)))
        shared = np.repeat(multi | np.logical_or.reduceat(told[order], begin), lens)
        hit = order[shared & ~told[order]]
        yield from _hit_rows(owner[hit], pos[hit])
        rep = order[begin]
        self.h, self.owner, self.pos = h[rep], owner[rep], pos[rep]
        self.told = multi | told[rep]


def _decode(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("owner", pa.int64()), ("places", pa.binary())])

    def rows() -> Iterator[tuple[int, bytes]]:
        state, current = _Bucket(), None
        for batch in batches:
            for bucket, owner, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket < 0:
                    yield owner, payload.as_py()
                    continue
                if bucket != current:
                    yield from state.settle()
                    state, current = _Bucket(), bucket
                yield from state.add(_unpack(payload.as_py(), wide))
        yield from state.settle()

    out: list[tuple[int, bytes]] = []
    for row in rows():
        out.append(row)
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], schema=schema)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], schema=schema)


def shared_places(df: DataFrame, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int, wide: bool) -> DataFrame:
    """(owner, places): packed positions of an owner's hashes that another owner holds too.

    `encode` turns Arrow batches of df into rows of SHUFFLE_SCHEMA. An owner may have several rows.
    """
    packed = df.mapInArrow(encode, "bucket int, owner bigint, payload binary")
    return place_buckets(packed, buckets).mapInArrow(lambda it: _decode(it, wide), "owner bigint, places binary")


def join_places(df: DataFrame) -> DataFrame:
    """One row per owner with all its packed pieces."""
    return df.groupBy("owner").agg(F.collect_list("places").alias("places"))


# ---- a filter of bounded size -------------------------------------------------------

MAX_FILTER_BITS = 1 << 26


def _filter_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64) ^ HASH_SEED)
    return [(h >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 32)]


def key_filter(df: DataFrame, column: str, count: int) -> tuple[bytes, int]:
    """Bitmap of the keys in df (two bits a key), at most MAX_FILTER_BITS long.

    It only spares later shuffles rows that can't match; where it is too small for the
    keys it lets more rows through, and the join that follows still decides.
    """
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, math.ceil(math.log2(max(1, count) * 12))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits, bool)
        for batch in batches:
            for at in _filter_bits(batch.column(0).to_numpy(zero_copy_only=False), bits):
                bitmap[at] = True
        yield pa.RecordBatch.from_pydict({"b": [pa.compress(np.packbits(bitmap).tobytes(), codec="zstd", asbytes=True)]}, schema=pa.schema([("b", pa.binary())]))

    total = np.zeros(bits // 8, np.uint8)
    parts = df.select(F.col(column).cast("bigint")).where(F.col(column).isNotNull()).coalesce(8)
    for row in parts.mapInArrow(build, "b binary").toLocalIterator():
        total |= np.frombuffer(pa.decompress(row.b, decompressed_size=bits // 8, codec="zstd", asbytes=True), np.uint8)
    return total.tobytes(), bits


def may_hold(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _filter_bits(keys, bits):
        out &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


def keep_possible(df: DataFrame, column: str, bitmap: bytes, bits: int) -> DataFrame:
    """Rows of df whose key may be in the filter; the filter goes out as a broadcast variable of bounded size."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    index = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bm = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ok = may_hold(bm, bits, batch.column(index).to_numpy(zero_copy_only=False))
            if ok.any():
                yield batch.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)
