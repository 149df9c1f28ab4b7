"""Filling containers of fixed capacity with items of varying length, by non-negative least squares.

Only the histogram of lengths is planned: shallow combinations of lengths whose sum
falls into a narrow window below the capacity are enumerated, their repeat counts are
solved as non-negative least squares against the histogram, rounded within what is
there, and the residual lengths are packed greedily, largest first, many containers at
a time. The plan has some COMBINATIONS combinations, or 8 per distinct length, and one
greedy step per distinct length, however many items there are; only the histogram reaches
the driver. Items are then numbered within their length, in as many cells as their number
asks for, so that one length may hold any share of them, and looked up in the plan.

An item is split only if it alone exceeds the capacity. Defined results: null and blank
texts are not placed; repeated rows are placed once per key; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bulaforge.session import cut

COMBINATIONS = 12_000
#: Combinations must fill the capacity up to this share of it.
WINDOW_SHARE = 0.003
SWEEPS = 40
#: Items of one length that one task numbers, if the length holds all items.
ROWS_PER_CELL = 50_000


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[tuple[int, int], ...]  # (length, times in one container)
    containers: int
    solved: bool = False


def _combinations(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Shallow combinations with sums in the window: the closest fits of one, two and three lengths."""
    have = set(lengths.tolist())
    least = capacity - int(capacity * WINDOW_SHARE)
    ordered = np.sort(lengths)
    out: dict[tuple[int, ...], None] = {}

    def below(limit: int, count: int) -> list[int]:
        k = int(np.searchsorted(ordered, limit, side="right"))
        return [int(x) for x in ordered[max(0, k - count) : k]]

    each = max(1, COMBINATIONS // max(1, 8 * len(ordered)))
    for a in map(int, ordered[::-1]):
        if least <= a <= capacity:
            out[(a,)] = None
        for b in below(capacity - a, each):
            if a >= b and a + b >= least:
                out[(a, b)] = None
        # Three: a long one, a middle one spread over the range, the closest third.
        rest = capacity - a
        for b in {below(rest * s // 8, 1)[0] for s in range(1, 8) if below(rest * s // 8, 1)}:
            for c in below(rest - b, each):
                if a + b + c >= least:
                    out[tuple(sorted((a, b, c), reverse=True))] = None
    for times in range(2, 9):
        if capacity // times in have:
            out[(capacity // times,) * times] = None
    return list(out)


def _nnls(columns: list[list[tuple[int, int]]], target: np.ndarray) -> np.ndarray:
    """Coordinate descent for min |Ax - target|² with x ≥ 0; columns hold (row, entry)."""
    x = np.zeros(len(columns))
    rest = target.astype(float).tolist()
    norms = [sum(v * v for _, v in c) for c in columns]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(v * rest[r] for r, v in c) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for r, v in c:
                    rest[r] -= v * step
        if moved < 1e-3 * max(1.0, float(target.sum())):
            break
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns with their numbers of containers that place every length of the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return []
    if max(left) > capacity or min(left) < 1:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = np.array(sorted(left))
    at = {int(x): i for i, x in enumerate(lengths)}
    combos = [tuple((x, c.count(x)) for x in dict.fromkeys(c)) for c in _combinations(lengths, capacity)]
    out: list[Pattern] = []
    if combos:
        x = _nnls([[(at[k], v) for k, v in c] for c in combos], np.array([left[int(k)] for k in lengths]))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.3:
                break
            n = min([round(float(x[j])), *[left.get(k, 0) // v for k, v in combos[j]]])
            if n > 0:
                out.append(Pattern(combos[j], n, solved=True))
                for k, v in combos[j]:
                    left[k] -= v * n
    # Residuals: best fit decreasing, as many equal containers at a time as the counts allow.
    left = {k: v for k, v in left.items() if v}
    ordered = sorted(left)
    while ordered:
        used: dict[int, int] = {}
        room = capacity
        k = len(ordered) - 1
        while k >= 0 and room >= ordered[0]:
            k = min(k, int(np.searchsorted(ordered, room, side="right")) - 1)
            if k < 0:
                break
            x = ordered[k]
            take = min(room // x, left[x] - used.get(x, 0))
            if take:
                used[x] = used.get(x, 0) + take
                room -= take * x
            k -= 1
        n = min(left[x] // v for x, v in used.items())
        out.append(Pattern(tuple(used.items()), n))
        for x, v in used.items():
            left[x] -= v * n
            if not left[x]:
                del left[x]
                ordered.remove(x)
    return out


def _ranges(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """(key, times, base) sorted by key = length << 40 | first ordinal: which items of a length go where."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        for length, times in p.lengths:
            begin = taken.get(length, 0)
            rows.append(((length << 40) | begin, times, base, begin))
            taken[length] = begin + times * p.containers
        base += p.containers
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(id, piece_no, n_tokens, …) of 1..capacity units → the same with container_id and planned (the container is one of those solved for)."""
    # One row per piece of a key; the numbers below must be taken over what is written here.
    items = cut(pieces.where("n_tokens > 0").dropDuplicates(["id", "piece_no"]))
    cells = 1 << max(6, (items.count() // ROWS_PER_CELL).bit_length())
    items = items.withColumn("_cell", F.pmod(F.xxhash64("id", "piece_no"), F.lit(cells)))
    counts = items.groupBy("n_tokens", "_cell").agg(F.count("*").alias("_count"))
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("_count").alias("n")).collect()}  # at most `capacity` rows
    patterns = plan(histogram, capacity)
    solved = sum(p.containers for p in patterns if p.solved)
    known = items.sparkSession.sparkContext.broadcast(_ranges(patterns))
    before = F.sum("_count").over(Window.partitionBy("n_tokens").orderBy("_cell")) - F.col("_count")
    nth = F.row_number().over(Window.partitionBy("n_tokens", "_cell").orderBy("id", "piece_no")) - 1
    first = counts.select("n_tokens", "_cell", before.alias("_first"))
    names = [c for c in items.columns if c != "_cell"]
    numbered = items.withColumn("_nth", nth).join(first, ["n_tokens", "_cell"]).select(*names, (F.col("_first") + F.col("_nth")).cast("bigint").alias("_ordinal"))
    i_n = names.index("n_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, base, begin = known.value
        for batch in batches:
            n, ordinal = batch.column(i_n).to_numpy().astype(np.int64), batch.column(len(names)).to_numpy().astype(np.int64)
            k = np.searchsorted(key, (n << 40) | ordinal, side="right") - 1
            container = base[k] + (ordinal - begin[k]) // times[k]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(container < solved), *[batch.column(i) for i in range(len(names))]], names=["container_id", "planned", *names])

    schema = "container_id bigint, planned boolean, " + ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in names)
    return numbered.mapInArrow(place, schema)
