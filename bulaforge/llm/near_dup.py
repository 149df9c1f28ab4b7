"""Near-duplicate records by the similarity of their word-run sets, without pairwise comparison.

1. A sketch counts the word runs of all records; its counts give one global order, rare
   runs first. Its size follows the square root of the input, up to 16 MB.
2. Every record's runs are put in that order and cut to a prefix. The n-grams of the
   prefix (g neighbours in the order) are the join keys. Two sets of Jaccard similarity
   t or more differ in few runs, and each differing run parts at most g - 1 groups of
   neighbours; the prefix is as long as it takes for one group of common neighbours to
   stay whole, so both records hold the same key and no link is lost. A key of three
   runs hardly ever meets by chance, so the candidates follow the true pairs instead of
   growing with the square of the input. Small sets, for which three neighbours can't be
   guaranteed, also send keys of two or one.
3. Keys meet in packed hash buckets. Length and positional filters drop candidates there.
   A pair must also have met in as many keys as its sizes demand. A key whose rarest run
   has too many holders for one bucket has them split into blocks, and every pair of
   blocks meets in a bucket of its own.
4. Each distinct candidate is verified once: a suffix filter (difference of the counts
   in hash ranges) and then the exact overlap.

Records with equal run sets form one class from the start and are compared as one.

Defined results: null and blank texts and texts of fewer than `min_words` words take no
part; repeated rows count once per key; a very long text is read whole; empty input
gives empty output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulaforge.llm import buckets as B
from bulaforge.llm.shared_spans import tables_for
from bulaforge.session import cut

#: Cells of the rarity sketch as powers of two: the first up to 1 GB of input, then as its square root, the last at 4 TB (16 MB to each executor).
SKETCH_BITS, MOST_SKETCH_BITS = 18, 24
SKETCH_PARTS = 16
BYTES_PER_BUCKET = 8 << 20
#: Keys that a task gathers before it packs them by bucket: the more, the fewer rows.
KEYS_PER_PACK = 1_000_000
#: Holders of a key that may meet in one bucket; or so many times the mean load of a sketch cell, below which counts tell nothing.
HOT, HOT_LOADS = 8192, 4
BATCH_CHARS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Runs of `run` words, Jaccard similarity of `threshold` or more, texts of `min_words` or more."""

    run: int = 5
    threshold: float = 0.8
    min_words: int = 5
    #: Exact copies of one text are expanded into all their pairs up to this number; more copies
    #: come out as their least key paired with every other one. Different texts always are expanded.
    expand_copies_up_to: int = 50


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """(table number, keys, texts) of about BATCH_CHARS characters at a time."""
    tables = batch.column(0).to_numpy()
    keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or i + 1 - begin >= MAX_ROWS or i == len(texts) - 1:
            yield tables[begin : i + 1], keys[begin : i + 1], texts[begin : i + 1]
            begin, size = i + 1, 0


_WORD_CHAR: list[np.ndarray] = []


def _runs(tables: np.ndarray, texts: list[str], how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the word runs of each text with enough words, in order of text and place.

    Words are maximal runs of letters and digits, in lower case. Their hashes come from
    prefix sums over the code points of all texts, so no word becomes a Python object.
    """
    if not _WORD_CHAR:
        _WORD_CHAR.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    joined = "\n".join([t.lower() for t in texts]) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(_WORD_CHAR[0][points].view(np.int8), prepend=np.int8(0))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    char, power, inverse = tables_for(len(points))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(char[points] * power[: len(points)])])
        h = B.mix64((sums[end] - sums[begin]) * inverse[begin])
    stops = np.cumsum([len(t.lower()) + 1 for t in texts])
    row = np.searchsorted(stops, begin, side="right")
    n = np.bincount(row, minlength=len(texts))
    m = max(0, len(h) - how.run + 1)
    with np.errstate(over="ignore"):
        run = B.mix64(tables.astype(np.uint64)[row[:m]] + np.uint64(0x51ED270B))
        for k in range(how.run):
            run = B.mix64(run * np.uint64(0x9E3779B97F4A7C15) + h[k : m + k])
    whole = (row[:m] == row[how.run - 1 :]) & (n[row[:m]] >= how.min_words) if m else np.zeros(0, bool)
    return row[:m][whole], run[whole]


def _run_sets_of(row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, by row and hash."""
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    return row[first], run[first]


def sketch_bits(size: int) -> int:
    """Cells of the rarity sketch for an input of `size` bytes, as a power of two."""
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, SKETCH_BITS + round(math.log2(max(1.0, size / (1 << 30))) / 2)))


def _count_runs(batches: Iterator[pa.RecordBatch], how: Similarity, bits: int) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << bits, np.int64)
    for batch in batches:
        for tables, _, texts in _slices(batch):
            # Copies in one slice count once: a key's holders are counted, not its copies.
            once = list(dict.fromkeys(zip(tables.tolist(), texts)))
            _, run = _runs(np.array([t for t, _ in once]), [x for _, x in once], how)
            sketch += np.bincount((run & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    parts = np.split(sketch.astype("<u4"), SKETCH_PARTS)
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(SKETCH_PARTS), pa.int32()), "counts": pa.array([B._squeeze(p) for p in parts], pa.binary())})


def _add_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, np.zeros(size, np.uint64)) + B._expand(counts, size)
    levels = [np.floor(LEVELS_PER_BIT * np.log2(v.astype(np.float64) + 1)).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "levels": pa.array(levels, pa.binary()), "n": pa.array([int(v.sum()) for v in total.values()], pa.int64())})


LEVELS_PER_BIT = 4


@dataclass(frozen=True)
class Rarity:
    """Logarithmic count level per sketch cell, over all records, and the holders beyond which a key is split."""

    levels: np.ndarray
    hot: int

    def of(self, run: np.ndarray) -> np.ndarray:
        return self.levels[(run & np.uint64(len(self.levels) - 1)).astype(np.int64)].astype(np.uint64)

    def blocks(self, level: np.ndarray) -> np.ndarray:
        """In how many blocks the holders of a key are split whose rarest run has that level."""
        return np.maximum(1, np.ceil(2.0 ** (level.astype(np.float64) / LEVELS_PER_BIT) / self.hot)).astype(np.int64)


def rarity_levels(records: DataFrame, how: Similarity, bits: int) -> Rarity:
    """Counts of all records' runs in 2**bits cells; 2**bits bytes reach the driver, 16 MB at most."""
    size = (1 << bits) // SKETCH_PARTS
    counted = records.mapInArrow(lambda it: _count_runs(it, how, bits), "part int, counts binary")
    summed = counted.repartition(SKETCH_PARTS, "part").mapInArrow(lambda it: _add_counts(it, size), "part int, levels binary, n bigint")
    levels, total = np.zeros(1 << bits, np.uint8), 0
    for row in summed.collect():
        levels[row.part * size : (row.part + 1) * size] = np.frombuffer(row.levels, np.uint8)
        total += row.n
    return Rarity(levels, max(HOT, HOT_LOADS * (total >> bits)))


def key_plan(threshold: float) -> list[tuple[int, float, float]]:
    """(g, ratio, up to size): send keys of g neighbours from the first ratio*n + g runs of sets below that size.

    With x runs of a set and y of its partner outside the overlap, g neighbours stay whole
    among the first g*x + (g-1)*y + g runs. Over all sizes of a similar partner g*x + (g-1)*y
    is at most ratio*n; sets with ratio*n + g > n, and their partners, need shorter keys too.
    """
    t, plan, below = threshold, [], math.inf
    for g in (3, 2, 1):
        ratio = max(g * (1 - t), (2 * g - 1) * (1 - t) / (1 + t), (g - 1) * (1 - t) / t)
        if ratio < 1:
            plan.append((g, ratio, below))
            below = min(below, math.ceil(g / (1 - ratio)) / t)
    return plan


HASH_BITS, LEVEL_BITS = 40, 8
MAX_ROWS = 1 << 16


SIDE = 30


def _split_hot(at: np.ndarray, key: np.ndarray, blocks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, key, side): every holder of a hot key lies in one block and goes to the pairs of its block with each, so that any two holders
    meet once: in the pair of their blocks, on different sides of it (1, 2), or in their common block alone (0)."""
    side = np.zeros(len(at), np.uint32)
    hot = np.nonzero(blocks > 1)[0]
    if not len(hot):
        return at, key, side
    times = blocks[hot]
    entry = np.repeat(hot, times)
    other = (np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    with np.errstate(over="ignore"):
        own = B.mix64(owner[entry].view(np.uint64) + np.uint64(0x2545F491)) % blocks[entry].astype(np.uint64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        split = B.mix64(key[entry] + B.mix64((low << np.uint64(32)) + high + np.uint64(1)))
    cold = np.nonzero(blocks <= 1)[0]
    sides = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint32)
    return np.concatenate([at[cold], at[entry]]), np.concatenate([key[cold], split]), np.concatenate([side[cold], sides])


def _key_rows(batches: Iterator[pa.RecordBatch], rarity: Rarity, how: Similarity, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = B.SHUFFLE_SCHEMA
    low = np.uint64((1 << HASH_BITS) - 1)
    waiting: list[tuple[np.ndarray, ...]] = []

    def rows_of(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, schema)], schema=schema)

    def packed_keys() -> pa.RecordBatch:
        own, n, key, pos = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        return rows_of([(b, 0, _pack_keys(own[mine], n[mine], key[mine], pos[mine])) for b, mine in B.groups_of((key >> np.uint64(40)) % np.uint64(buckets))])

    for batch in batches:
        for tables, keys, texts in _slices(batch):
            row, run = _runs(tables, texts, how)
            if not len(row):
                continue
            level = rarity.of(run)
            # One sort of single words: record, then level, then hash. Equal runs come together.
            packed = (row.astype(np.uint64) << np.uint64(HASH_BITS + LEVEL_BITS)) | (level << np.uint64(HASH_BITS)) | (run >> np.uint64(64 - HASH_BITS))
            packed.sort()
            packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
            of, run = (packed >> np.uint64(HASH_BITS + LEVEL_BITS)).astype(np.int64), packed & low
            level = (packed >> np.uint64(HASH_BITS)) & np.uint64((1 << LEVEL_BITS) - 1)
            first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
            rows, n = of[first], np.diff(np.append(first, len(of)))
            with np.errstate(over="ignore"):
                owner = B.mix64(np.add.reduceat(B.mix64(run + np.uint64(1)), first) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                owner = B.mix64(owner + tables[rows].astype(np.uint64)).view(np.int64)
            out = [(-1 - int(o % buckets), int(o), _text_hash(texts[r]) + f"{int(tables[r])}:{keys[r]}".encode()) for o, r in zip(owner, rows)]
            # Equal run sets send their keys once.
            chosen = np.zeros(len(rows), bool)
            chosen[np.unique(owner, return_index=True)[1]] = True
            rank = np.repeat(np.arange(len(rows)), n)
            pos, size = np.arange(len(of)) - first[rank], n[rank]
            sent: list[tuple[np.ndarray, np.ndarray]] = []
            for g, ratio, below in key_plan(how.threshold):
                length = np.minimum(n, np.floor(ratio * n + 1e-9).astype(np.int64) + g)
                at = np.nonzero((chosen & (n < below))[rank] & (pos + g <= length[rank]))[0]
                with np.errstate(over="ignore"):
                    key = np.full(len(at), g, np.uint64)
                    for k in range(g):
                        key = B.mix64(key * np.uint64(0xD6E8FEB86659FD93) + run[at + k])
                sent.append((at, key))
            at, key = np.concatenate([a for a, _ in sent]), np.concatenate([k for _, k in sent])
            # The rarest run of a key comes first and bounds its holders.
            at, key, side = _split_hot(at, key, rarity.blocks(level[at]), owner[rank[at]])
            order = np.argsort(at, kind="stable")
            at, key, side = at[order], key[order], side[order]
            waiting.append((owner[rank[at]], size[at], key, pos[at] + (side.astype(np.int64) << SIDE)))
            yield rows_of(out)
            if sum(len(w[0]) for w in waiting) >= KEYS_PER_PACK:
                yield packed_keys()
    if waiting:
        yield packed_keys()


def _text_hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _pack_keys(owner: np.ndarray, size: np.ndarray, key: np.ndarray, pos: np.ndarray) -> bytes:
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    counts = np.diff(np.append(first, len(owner)))
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    small = B._squeeze(np.concatenate([counts, size[first], step]))
    head = np.array([len(first), len(owner), len(small)], "<u4").tobytes()
    return head + owner[first].astype("<i8").tobytes() + small + (key & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _unpack_keys(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    owners, n, length = (int(x) for x in np.frombuffer(b, "<u4", 3))
    own = np.frombuffer(b, "<i8", owners, 12)
    at = 12 + 8 * owners
    small = B._expand(b[at : at + length], 2 * owners + n)
    counts = small[:owners].astype(np.int64)
    key = np.frombuffer(b, "<u4", n, at + length)
    step = small[2 * owners :].astype(np.int64)
    total, begin = np.cumsum(step), np.cumsum(counts) - counts
    pos = total - np.repeat(total[begin] - step[begin], counts)
    return np.repeat(own, counts), np.repeat(small[owners : 2 * owners], counts), key, pos.astype(np.uint32)


def _candidates(parts: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, met, needed): pairs of owners that hold the same key and pass the length and
    positional filters, how many keys they met in here, and how many they must meet in over all buckets."""
    owner, size, key, pos = (np.concatenate(x) for x in zip(*[_unpack_keys(p) for p in parts]))
    # Keys held once can't meet: drop them before the full sort.
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    near = np.zeros(len(key), bool)
    same = sorted_key[1:] == sorted_key[:-1]
    near[1:] |= same
    near[:-1] |= same
    order = order[near]
    owner, size, key, pos = owner[order], size[order].astype(np.float64), key[order], pos[order]
    order = np.lexsort((owner, key))
    owner, size, key, pos = owner[order], size[order], key[order], pos[order]
    side, pos = pos >> np.uint32(SIDE), (pos & np.uint32((1 << SIDE) - 1)).astype(np.float64)
    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0
    alive = np.arange(len(key))
    for step in range(1, len(key)):
        # Only a key met at the step before can be met at this one.
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive + step] == key[alive]]
        if not len(alive):
            break
        i, j = alive, alive + step
        ok = (owner[i] != owner[j]) & ((side[i] != side[j]) | (side[i] == 0))
        ok &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        common = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
        most = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
        ok &= most >= common
        i, j = i[ok], j[ok]
        waiting.append((owner[i], owner[j], _keys_needed(size[i], size[j], common[ok], threshold)))
        held += len(i)
        if held > B.SLICE:
            yield _counted_pairs(waiting)
            waiting, held = [], 0
    if waiting:
        yield _counted_pairs(waiting)


def _keys_needed(n: np.ndarray, m: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the longest kind that sets of n and m runs share at least, if `common` runs are common:
    of the prefix that ends first, all but those the differing runs part."""
    g, ratio, _ = key_plan(threshold)[0]
    x, y = n - common, m - common
    length = lambda k: np.minimum(k, np.floor(ratio * k + 1e-9) + g)
    whole = np.minimum(length(n) - g * x - (g - 1) * y, length(m) - g * y - (g - 1) * x) - (g - 1)
    return np.clip(whole, 1, 30_000).astype(np.int16)


def _counted_pairs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    u, v, need = (np.concatenate(x) for x in zip(*parts))
    a, b = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.nonzero(first)[0]
    return a[begin], b[begin], np.diff(np.append(begin, len(a))).astype(np.int32), need[begin]


STAGE = "a bigint, b bigint, met int, needed smallint, tbl int, key string, txt bigint"
_STAGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int32()), ("needed", pa.int16()), ("tbl", pa.int32()), ("key", pa.string()), ("txt", pa.int64())])


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Bucket rows in order of bucket → candidate pairs (a, b) and, passed through, records (a = class, tbl, key, txt = hash of the text)."""

    def pairs(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if parts:
            for found in _candidates(parts, threshold):
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in found], pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=_STAGE_SCHEMA)

    current, parts = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        passing = batch.filter(pa.array(bucket < 0))
        if passing.num_rows:
            payloads = passing.column(2).to_pylist()
            said = [p[8:].split(b":", 1) for p in payloads]
            txt = pa.array([int.from_bytes(p[:8], "little", signed=True) for p in payloads], pa.int64())
            empty = [pa.nulls(len(said), t) for t in (pa.int64(), pa.int32(), pa.int16())]
            cols = [passing.column(1), *empty, pa.array([int(s[0]) for s in said], pa.int32()), pa.array([s[1].decode() for s in said], pa.string()), txt]
            yield pa.RecordBatch.from_arrays(cols, schema=_STAGE_SCHEMA)
        for k, payload in zip(bucket, batch.column(2)):
            if k < 0:
                continue
            if k != current:
                yield from pairs(parts)
                current, parts = k, []
            parts.append(payload.as_py())
    yield from pairs(parts)


def _run_sets(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tables, keys, texts in _slices(batch):
            row, run = _run_sets_of(*_runs(tables, texts, how))
            if not len(row):
                continue
            rows, first, n = np.unique(row, return_index=True, return_counts=True)
            # The upper 40 bits of each hash: two of a pair's few differing runs agree in them once in 10**9 pairs.
            short = (run >> np.uint64(64 - HASH_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].copy()
            sets = [short[a : a + k].tobytes() for a, k in zip(first, n)]
            yield pa.RecordBatch.from_pydict({"tbl": pa.array(tables[rows], pa.int32()), "key": pa.array([keys[r] for r in rows], pa.string()), "runs": pa.array(sets, pa.binary())})


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    need = math.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9)
    # Suffix filter: sets that differ in the counts of hash ranges differ at least that much.
    top = np.uint64(HASH_BITS - 6)
    spread = np.abs(np.bincount((a >> top).astype(np.int64), minlength=64) - np.bincount((b >> top).astype(np.int64), minlength=64)).sum()
    if spread > len(a) + len(b) - 2 * need:
        return False
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def _widen(b: pa.Buffer) -> np.ndarray:
    short = np.frombuffer(b, np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, : HASH_BITS // 8] = short
    return wide.view("<u8").ravel()


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[_widen(x.as_buffer()) for x in batch.column(k)] for k in (2, 3)]
        ok = np.array([_similar(a, b, threshold) for a, b in zip(*sets)], bool)
        yield batch.select([0, 1]).filter(pa.array(ok))


@dataclass(frozen=True)
class NearDuplicates:
    """records (cls, tbl, key, txt): every record with its class of equal run sets and the hash of its text;
    links (a, b): the similar classes, a < b."""

    records: DataFrame
    links: DataFrame


def near_duplicates(records: DataFrame, how: Similarity) -> NearDuplicates:
    """records must have the columns tbl INT, key STRING, text STRING; only rows of one tbl are compared."""
    spark = records.sparkSession
    texts = records.where(F.col("text").isNotNull() & F.col("key").isNotNull()).select("tbl", "key", "text")
    n = B.bucket_count(records, BYTES_PER_BUCKET)
    rarity = spark.sparkContext.broadcast(rarity_levels(texts, how, sketch_bits(B.source_bytes(records))))
    packed = texts.mapInArrow(lambda it: _key_rows(it, rarity.value, how, n), "bucket int, owner bigint, payload binary")
    stage = cut(B.place_buckets(packed, n).mapInArrow(lambda it: _meet(it, how.threshold), STAGE))
    classes = stage.where("b is null").groupBy(F.col("a").alias("cls"), "tbl", "key").agg(F.min("txt").alias("txt"))
    # Pairs that meet in fewer keys than similar sets must are chance meetings.
    met = stage.where("b is not null").groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("needed").alias("needed"))
    pairs = cut(met.where("met >= needed").select("a", "b"))
    # The run sets of the classes that have a candidate, from one record each.
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    chosen = cut(classes.groupBy("cls", "tbl").agg(F.min("key").alias("key")).join(needed, "cls", "left_semi").withColumn("kh", F.xxhash64("tbl", "key")))
    bitmap, bits = B.key_filter(chosen, "kh", chosen.count())
    possible = B.keep_possible(texts.select("tbl", "key", "text", F.xxhash64("tbl", "key").alias("kh")), "kh", bitmap, bits).select("tbl", "key", "text")
    sets = possible.mapInArrow(lambda it: _run_sets(it, how), "tbl int, key string, runs binary")
    sets = sets.join(chosen.select("tbl", "key", "cls"), ["tbl", "key"]).groupBy("cls").agg(F.first("runs").alias("runs"))
    both = pairs.join(sets.toDF("a", "runs_a"), "a").join(sets.toDF("b", "runs_b"), "b").select("a", "b", "runs_a", "runs_b")
    links = both.mapInArrow(lambda it: _verify(it, how.threshold), "a bigint, b bigint")
    return NearDuplicates(classes, links)


def _copies(found: NearDuplicates, how: Similarity) -> DataFrame:
    """(cls, tbl, key, rep, many): every record with the least key of its text, and if the text has more than
    `expand_copies_up_to` copies."""
    texts = found.records.groupBy("cls", "tbl", "txt").agg(F.min("key").alias("rep"), (F.count("*") > how.expand_copies_up_to).alias("many"))
    return found.records.join(texts, ["cls", "tbl", "txt"]).select("cls", "tbl", "key", "rep", "many")


def key_pairs(found: NearDuplicates, how: Similarity) -> DataFrame:
    """(tbl, key_a, key_b) with key_a < key_b: the pairs of similar records.

    A class holds texts of equal run sets, which may differ in case, marks or white space. Of more
    than `expand_copies_up_to` records of exactly equal text the least key stands for all in the
    pairs with other texts, and is paired with each of them; `unexpanded_copies` names them.
    """
    records = cut(_copies(found, how))
    shown = records.where(~F.col("many") | (F.col("key") == F.col("rep"))).select("cls", "tbl", "key")
    listed = shown.groupBy("cls", "tbl").agg(F.sort_array(F.collect_list("key")).alias("ks")).where(F.size("ks") > 1)
    first = listed.select("tbl", "ks", F.posexplode("ks").alias("i", "key_a"))
    within = first.select("tbl", "key_a", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("key_b"))
    star = records.where(F.col("many") & (F.col("key") != F.col("rep"))).select("tbl", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    links = cut(found.links)
    a = shown.select(F.col("cls").alias("a"), "tbl", F.col("key").alias("ka"))
    b = shown.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    across = links.join(a, "a").join(b, "b").select("tbl", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return across.unionByName(within).unionByName(star)


def unexpanded_copies(found: NearDuplicates, how: Similarity) -> DataFrame:
    """(tbl, key, rep): the records for which `key_pairs` shows the least key of their equal texts. Each stands in
    every pair of rep, and in a pair with every record of the same rep."""
    return _copies(found, how).where(F.col("many") & (F.col("key") != F.col("rep"))).select("tbl", "key", "rep")


def components(found: NearDuplicates) -> DataFrame:
    """(tbl, key, cls, component, links): each record with its class, its connected group and the
    number of classes its own is linked to. Groups are found by alternating large-star and
    small-star rounds over the class links; every round shuffles the links once per star."""
    links = cut(found.links.distinct())
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        after = cut(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    joined = found.records.join(edges.toDF("cls", "root"), "cls", "left").join(degree, "cls", "left")
    return joined.select("tbl", "key", "cls", F.coalesce("root", "cls").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
