"""Mixing sources to target shares by a min-cost flow over membership patterns.

Equal texts may stand in several sources. Documents are aggregated by the set of
sources their text occurs in (the pattern); each pattern offers its tokens once per
repetition, at a cost that grows with the repetition, and the flow routes them to the
source quotas. The network has one node per pattern and source, whatever the data. The
documents of a pattern are laid out in seeded order along a line as long as their
tokens; the flows of the pattern's sources are consecutive stretches of that line, wound
around it as often as tokens are repeated, and a document is used for the stretch in
which it begins. So every share is met to within one document per stretch.

Defined results: documents with null or blank text, or of a source without target, are
not used; a source without documents keeps the whole mixture at zero tokens; without targets there is no sample; repeated
rows count once; ties in the seeded order go by id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bulaforge.llm.tokens import Tokenizer, token_counts
from bulaforge.session import cut

MAX_SOURCES = 62
ROWS_PER_CELL = 100_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


class _Flow:
    """Successive shortest paths with potentials; costs are non-negative integers."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for u, v, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.edges))
            self.edges.append([v, c, w])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        height = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            via = [-1] * n
            dist[s] = 0
            heap: list[tuple[float, int]] = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v, c, w = self.edges[e]
                    nd = d + w + height[u] - height[v]
                    if c > 0 and nd < dist[v]:
                        dist[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
            if via[t] < 0:
                return total
            for v in range(n):
                if dist[v] < float("inf"):
                    height[v] += int(dist[v])
            push, v = None, t
            while v != s:
                e = via[v]
                push = self.edges[e][1] if push is None else min(push, self.edges[e][1])
                v = self.edges[e ^ 1][0]
            v = t
            while v != s:
                e = via[v]
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
                v = self.edges[e ^ 1][0]
            total += push


def route(patterns: dict[int, int], targets: list[Target], total: int) -> dict[tuple[int, int], int] | None:
    """Tokens of each pattern (bit mask) for each source number so that all quotas of `total` are met, at least repetition; None if they can't be."""
    masks = sorted(patterns)
    n = len(masks)
    flow = _Flow(n + len(targets) + 2)
    s, t = n + len(targets), n + len(targets) + 1
    edges: dict[tuple[int, int], int] = {}
    for i, m in enumerate(masks):
        mine = [k for k in range(len(targets)) if m >> k & 1]
        for repeat in range(max(targets[k].max_repeats for k in mine)):
            flow.add(s, i, patterns[m], repeat * repeat)
        for k in mine:
            edges[(m, k)] = flow.add(i, n + k, patterns[m] * targets[k].max_repeats, 0)
    quotas = [int(total * x.share) for x in targets]
    for k, q in enumerate(quotas):
        flow.add(n + k, t, q, 0)
    if flow.run(s, t) < sum(quotas):
        return None
    return {key: flow.edges[e ^ 1][1] for key, e in edges.items() if flow.edges[e ^ 1][1]}


def largest_total(patterns: dict[int, int], targets: list[Target], limit: int) -> int:
    """The most tokens, up to limit, whose quotas can all be met."""
    low, high = 0, limit
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if route(patterns, targets, mid) is not None else (low, mid - 1)
    return low


def mix(docs: DataFrame, key: str, text: str, source: str, targets: list[Target], tokenizer: Tokenizer, total: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, uses): the sample. `total` tokens are shared out; by default as many
    as the distinct texts hold, or the largest number the shares and repeat limits allow."""
    if len(targets) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources")
    spark = docs.sparkSession
    if not targets:
        return spark.createDataFrame([], f"doc_id {docs.schema[key].dataType.simpleString()}, source string, n_tokens bigint, uses int")
    bits = F.create_map(*[x for k, t in enumerate(targets) for x in (F.lit(t.source), F.lit(1 << k))])
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("src"), F.col(f"`{text}`").alias("body"))
    rows = rows.where(F.col("src").isin([t.source for t in targets]) & F.col("body").rlike(r"[^\s\u00a0]"))
    rows = rows.select("id", F.try_element_at(bits, F.col("src")).cast("bigint").alias("bit"), F.xxhash64("body").alias("th"), "body")
    counted = token_counts(rows, "body", tokenizer)
    # One row per text: its sources, one document of each, its place in the seeded order.
    per_source = counted.groupBy("th", "bit").agg(F.min("id").alias("id"), F.max("n_tokens").alias("n"))
    texts = per_source.groupBy("th").agg(F.bit_or("bit").alias("mask"), F.max("n").alias("n"), F.map_from_entries(F.collect_set(F.struct("bit", "id"))).alias("ids"))
    texts = cut(texts.withColumn("place", F.xxhash64(F.lit(seed), "th")))
    cell_bits = max(6, (texts.count() // ROWS_PER_CELL).bit_length())
    texts = texts.withColumn("cell", F.shiftright("place", 64 - cell_bits).cast("int"))
    sums = texts.groupBy("mask", "cell").agg(F.sum("n").alias("n"))
    patterns = {r["mask"]: r["n"] for r in sums.groupBy("mask").agg(F.sum("n").alias("n")).collect()}  # one row a pattern: at most 2**MAX_SOURCES
    before = F.sum("n").over(Window.partitionBy("mask").orderBy("cell")) - F.col("n")
    start = sums.select("mask", "cell", before.alias("start"))
    goal = largest_total(patterns, targets, total if total is not None else sum(patterns.values()))
    flows = route(patterns, targets, goal) or {}
    stretches, at = [], dict.fromkeys(patterns, 0)
    for (m, k), f in sorted(flows.items()):
        stretches.append((m, 1 << k, targets[k].source, at[m], at[m] + f, patterns[m]))
        at[m] += f
    runs = spark.createDataFrame(stretches or [(0, 0, "", 0, 0, 1)], "mask bigint, bit bigint, source string, low bigint, high bigint, around bigint")
    order = Window.partitionBy("mask", "cell").orderBy("place", "th")
    within = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    lined = texts.withColumn("within", within).join(start, ["mask", "cell"]).withColumn("at", F.col("start") + F.col("within"))
    # Windings of the line at whose place `at` the stretch lies: k with low <= at + k*around < high.
    first = F.greatest(F.lit(0), F.ceil((F.col("low") - F.col("at")) / F.col("around")))
    last = F.ceil((F.col("high") - F.col("at")) / F.col("around")) - 1
    used = lined.join(F.broadcast(runs), "mask").withColumn("uses", (last - first + 1).cast("int")).where("uses > 0")
    return used.select(F.try_element_at("ids", F.col("bit")).alias("doc_id"), "source", F.col("n").alias("n_tokens"), "uses")


def shares(sample: DataFrame, targets: list[Target]) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, reached_share, most_uses) of a sample, one row per target."""
    wanted = sample.sparkSession.createDataFrame([(t.source, t.share, t.max_repeats) for t in targets], "source string, target_share double, max_repeats int")
    got = sample.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    out = wanted.join(got, "source", "left").na.fill(0, ["docs", "tokens", "most_uses"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
