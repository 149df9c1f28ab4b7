"""Ranking every question's own chunks: those of its product in the sections of its topic, with statistics of their own.

Questions of one product, topic and words are one search, and no row per question and chunk is made. A chunk is
reduced to a narrow row (lengths, topics it serves, hashes of the wanted terms in it). Products of up to BLOCK chunks
share groups of about GROUP, in which each is ranked whole; the rows of a larger one meet its searches in blocks,
and a block passes on the best few of each search. No text is carried. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulaforge.functions.dimensions import GENERAL, TOPICS
from bulaforge.functions.text import tokens
from bulaforge.operators import chunking, lexical, sections
from bulaforge.session import cut

# Chunks of a block and of a group of products, bits of a key filter and of one row of its making.
BLOCK, GROUP, FILTER_BITS, BITMAP = 20_000, 5_000, 1 << 23, 1 << 15
#: Bit of each topic in the masks below; the general topic has no sections of its own.
_BITS = {name: 1 << i for i, name in enumerate([*[t[0] for t in TOPICS], GENERAL])}
_CHUNK = ["chunk_id", "chunk_ord", "product", "section_num", "section_title", "is_table", "text"]


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of a hash column, always FILTER_BITS of them. With very many keys it lets more rows through; what follows still decides."""
    at = keys.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).alias("at")).distinct()
    made = at.groupBy(F.floor(F.col("at") / BITMAP).alias("nth")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in made.toLocalIterator():
        out[row.nth * BITMAP // 8 : (row.nth + 1) * BITMAP // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def possible(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the keys of the filter."""
    at = np.mod(keys, FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _with_filter(df: DataFrame, column: str, bits: np.ndarray, keep: Callable[[pa.RecordBatch, int, np.ndarray], pa.RecordBatch]) -> DataFrame:
    shared, index = df.sparkSession.sparkContext.broadcast(bits), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield keep(batch, index, shared.value)

    return df.mapInArrow(run, df.schema)


def keep_rows(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose hash may be in the filter."""
    return _with_filter(df, column, bits, lambda b, i, bits: b.filter(pa.array(possible(bits, b.column(i).to_numpy(zero_copy_only=False)))))


def keep_items(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows with those hashes of an array column that may be in the filter; no array may be null."""

    def keep(batch: pa.RecordBatch, index: int, bits: np.ndarray) -> pa.RecordBatch:
        lists = batch.column(index)
        ok = possible(bits, lists.flatten().to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(ok)])[ends].astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(offsets), lists.flatten().filter(pa.array(ok)))
        return pa.RecordBatch.from_arrays([kept if i == index else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return _with_filter(df, column, bits, keep)


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def row_hash() -> Column:
    """Hash by which a row of the chunks is found again."""
    return F.xxhash64(*_CHUNK)


def search(scoped: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """`ranked` with the fields of the chunks found in place of h and chars."""
    searches, best = ranked(scoped, chunks, k)
    best = cut(best)
    texts = keep_rows(chunks.select(*_CHUNK, row_hash().alias("h")), "h", key_filter(best, "h"))
    hit = best.select("search", "rank", "score", "h", F.col("chunk_id").alias("id_")).join(texts, "h").where(F.col("id_").eqNullSafe(F.col("chunk_id"))).drop("id_", "h")
    return searches, hit.dropDuplicates(["search", "rank"])


def ranked(scoped: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """scoped(qid, asked, topic, p), chunks with repeated rows → (qid, search) and (search, rank, score, chunk_id, h, chars): the k best chunks
    of lower-cased product p in the winning section tier of the topic. BM25 counts over the chunks in scope; chunks without a term of the question
    score 0, so a question always has its first chunks. Ties go by chunk_ord and chunk_id. h is the chunk's `row_hash`, chars the length of its
    rendered text."""
    topic_bit = F.create_map(*[F.lit(x) for item in _BITS.items() for x in item])
    q = scoped.where("p IS NOT NULL").select("qid", "p", F.coalesce(F.try_element_at(topic_bit, F.col("topic")), F.lit(_BITS[GENERAL])).alias("bit"), F.array_sort(_hashed(F.col("asked"))).alias("words"))
    q = cut(q.withColumn("search", F.min("qid").over(Window.partitionBy("p", "bit", "words"))))
    searches = q.where("qid = search").drop("qid")
    narrow = cut(_narrow(searches, chunks))
    want = searches.groupBy("p").agg(F.bit_or("bit").alias("asked"))
    per = narrow.groupBy("p").agg(F.count("*").alias("n"), F.bit_or("hit1").alias("any1"), F.bit_or("hit2").alias("any2"))
    # One row for BLOCK chunks at least.
    large = F.broadcast(cut(per.where(F.col("n") > BLOCK).join(want, "p")))
    total = narrow.count()
    few = _ranked_whole(searches.join(large, "p", "left_anti"), narrow.join(large, "p", "left_anti"), max(1, -(-total // GROUP)), k)
    rows = _in_scope(narrow, large)
    many = lexical.top_k(_scored(searches.join(large, "p", "left_semi"), rows, k), "search", [F.col("at"), F.col("chunk_id")], k)
    columns = ["search", "rank", "score", "chunk_id", "h", "chars"]
    return q.select("qid", "search"), few.select(*columns).unionByName(many.select(*columns))


def _narrow(searches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, h, at, p, hit1, hit2, chars, dl, words) of each chunk once: masks of the topics whose sections it belongs to or whose words it holds,
    its lengths, and its tokens that may be wanted. Of rows that repeat a key the one of the least hash is meant; its text is fetched by that hash."""

    def mask(hit: Callable[[str], Column | None]) -> Column:
        hits = [F.when(h, b).otherwise(0) for name, b in _BITS.items() if (h := hit(name)) is not None]
        return sum(hits[1:], hits[0]).cast("int")

    by_number, by_word = sections.hits("section_num", "section_title", "text")
    words = searches.select(F.explode("words").alias("w"))
    chars = F.length(chunking.rendered(F.col("section_num"), F.col("section_title"), F.col("is_table"), F.col("text")))
    read = chunks.where("text IS NOT NULL AND product IS NOT NULL").select(
        "chunk_id", row_hash().alias("h"), F.coalesce("chunk_ord", F.lit(-(1 << 63))).alias("at"), F.lower("product").alias("p"), mask(by_number).alias("hit1"), mask(by_word).alias("hit2"),
        chars.alias("chars"), _hashed(F.concat_ws(" ", "section_title", "text")).alias("words"),
    )
    read = read.withColumn("dl", F.size("words"))
    kept = keep_items(read, "words", key_filter(words, "w"))
    rest = ["h", "at", "p", "hit1", "hit2", "chars", "dl", "words"]
    return kept.groupBy("chunk_id").agg(F.min(F.struct(*rest)).alias("r")).select("chunk_id", "r.*")


def _in_scope(narrow: DataFrame, large: DataFrame) -> DataFrame:
    """(p, block, blocks, chunk_id, h, at, chars, dl, scope, words): chunks of the large products with the mask of the topics asked about their product
    that they serve. A chunk that is among the first of a topic by its words has a row for that topic."""
    a, one, two = F.col("asked"), F.col("any1"), F.col("any2")
    rules = large.select(
        "p", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), a.bitwiseAND(one).alias("first"), a.bitwiseAND(F.bitwise_not(one)).bitwiseAND(two).alias("second"),
        a.bitwiseAND(F.bitwise_not(one)).bitwiseAND(F.bitwise_not(two)).alias("all"),
    )
    rows = narrow.join(F.broadcast(rules), "p").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    out = ["p", "block", "blocks", "chunk_id", "h", "at", "chars", "dl", "scope", "words"]
    main = rows.withColumn("scope", F.col("all").bitwiseOR(F.col("hit1").bitwiseAND(F.col("first")))).where("scope != 0").select(*out)
    bits = F.filter(F.array(*[F.lit(b) for b in _BITS.values()]), lambda b: b.bitwiseAND(F.col("hit2")).bitwiseAND(F.col("second")) != 0)
    said = rows.where(F.col("hit2").bitwiseAND(F.col("second")) != 0).withColumn("scope", F.explode(bits))
    nth = F.row_number().over(Window.partitionBy("p", "scope").orderBy("at", "chunk_id"))
    few = said.select(*out).withColumn("nth", nth).where(F.col("nth") <= sections.FALLBACK_ROWS).select(*out)
    return cut(main.unionByName(few))


def _terms(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the rows in order, with the row of each and its count there."""
    words, owner = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.repeat(np.arange(len(lists)), lists.map(len).to_numpy(np.int64))
    order = np.lexsort((owner, words))
    words, owner = words[order], owner[order]
    first = np.nonzero((np.diff(words, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0))[0]
    return words[first], owner[first], np.diff(np.append(first, len(words)))


def _gains(owner: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What each term adds to its row's score, for a weight of 1."""
    length = np.maximum(dl, 1)[owner]
    return tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * length / max(avgdl, 1.0)))


def _best(words: np.ndarray, owner: np.ndarray, gains: np.ndarray, n: int, w: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of n rows, which are in the order of ties, and their scores; w are the terms, x their weights."""
    score = np.zeros(n)
    for a, b, weight in zip(np.searchsorted(words, w, "left"), np.searchsorted(words, w, "right"), x):
        score[owner[a:b]] += weight * gains[a:b]  # a term has one entry a row
    s = np.round(score, 9)
    near = np.nonzero(s >= np.partition(s, n - k)[n - k])[0] if n > k else np.arange(n)
    got = near[np.argsort(-s[near], kind="stable")[:k]]
    return got, score[got]


def _found(here: pd.DataFrame, searches: list, places: list[np.ndarray], scores: list[np.ndarray], names: list[str]) -> pd.DataFrame:
    if not places:
        return here.iloc[:0].reindex(columns=names)
    out = here.iloc[np.concatenate(places)]
    sizes = [len(p) for p in places]
    return out.assign(search=np.repeat(np.array(searches), sizes), rank=np.concatenate([np.arange(1, n + 1) for n in sizes]), score=np.concatenate(scores))[names]


def _schema(searches: DataFrame, rows: DataFrame) -> T.StructType:
    """Of what the groups give: rank counts within a group."""
    return T.StructType(
        [T.StructField("search", searches.schema["search"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())] + [rows.schema[c] for c in ("chunk_id", "h", "at", "chars")]
    )


def _ranked_whole(searches: DataFrame, narrow: DataFrame, groups: int, k: int) -> DataFrame:
    """(search, rank, score, chunk_id, h, at, chars): the k best for each search about a product whose chunks stand in one group."""
    group = F.pmod(F.xxhash64("p"), F.lit(groups)).alias("g")
    rows, asks = narrow.withColumn("g", group), searches.select(group, F.col("p").alias("q"), "search", "bit", F.col("words").alias("asked"))
    schema = _schema(searches, narrow)

    def best(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values(["p", "at", "chunk_id"], na_position="first", kind="stable").reset_index(drop=True)
        at = here.groupby("p", sort=False).indices
        found: list = []
        places: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for p, its in asked.groupby("q", sort=False):
            if p not in at:
                continue
            own = at[p]
            part = here.iloc[own]
            words, owner, tf = _terms(part["words"])
            dl, hit1, hit2 = part["dl"].to_numpy(), part["hit1"].to_numpy(), part["hit2"].to_numpy()
            for bit, some in its.groupby("bit", sort=False):
                inside = np.nonzero(hit1 & bit)[0]
                if not len(inside):
                    inside = np.nonzero(hit2 & bit)[0][: sections.FALLBACK_ROWS]
                if not len(inside):
                    inside = np.arange(len(part))
                n = len(inside)
                spot = np.full(len(part), -1)
                spot[inside] = np.arange(n)
                ok = spot[owner] >= 0
                w, o = words[ok], spot[owner[ok]]
                gains = _gains(o, tf[ok], dl[inside], dl[inside].mean())
                for search, terms in zip(some["search"], some["asked"]):
                    t, times = np.unique(np.asarray(terms, np.int64), return_counts=True)
                    df = np.searchsorted(w, t, "right") - np.searchsorted(w, t, "left")
                    got, score = _best(w, o, gains, n, t, times * np.log((n - df + 0.5) / (df + 0.5) + 1), k)
                    found.append(search)
                    places.append(own[inside[got]])
                    scores.append(score)
        return _found(here, found, places, scores, schema.names)

    return rows.groupBy("g").cogroup(asks.groupBy("g")).applyInPandas(best, schema)


def _scored(searches: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(search, score, chunk_id, h, at, chars): the k best of each block for each search."""
    bits = F.filter(F.array(*[F.lit(b) for b in _BITS.values()]), lambda b: b.bitwiseAND(F.col("scope")) != 0)
    each = rows.select("p", F.explode(bits).alias("bit"), "dl", F.array_distinct("words").alias("words"))
    sized = each.groupBy("p", "bit").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = each.select("p", "bit", F.explode("words").alias("w")).groupBy("p", "bit", "w").agg(F.count("*").alias("df"))
    terms = searches.select("search", "p", "bit", F.explode("words").alias("w")).groupBy("search", "p", "bit", "w").agg(F.count("*").alias("qn"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = terms.join(df, ["p", "bit", "w"]).join(sized, ["p", "bit"]).groupBy("search").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("qn") * idf).alias("x")))).alias("t"))
    none = F.array().cast("array<struct<w:bigint,x:double>>")
    asks = searches.select("search", "p", "bit").join(sized, ["p", "bit"]).join(weights, "search", "left").withColumn("t", F.coalesce("t", none))
    blocks = rows.groupBy("p", "block").agg(F.bit_or("scope").alias("scope"))
    asks = asks.join(blocks, "p").where(F.col("bit").bitwiseAND(F.col("scope")) != 0).select(
        F.col("p").alias("q"), F.col("block").alias("part"), "search", F.col("bit").alias("bit"), "avgdl", F.col("t.w").alias("w"), F.col("t.x").alias("x")
    )
    schema = _schema(searches, rows)

    def best(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values(["at", "chunk_id"], na_position="first", kind="stable").reset_index(drop=True)
        words, owner, tf = _terms(here["words"])
        scope, dl = here["scope"].to_numpy(), here["dl"].to_numpy()
        found: list = []
        places: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for bit, some in asked.groupby("bit", sort=False):
            inside = np.nonzero(scope & bit)[0]
            if not len(inside):
                continue
            spot = np.full(len(here), -1)
            spot[inside] = np.arange(len(inside))
            ok = spot[owner] >= 0
            own, o = words[ok], spot[owner[ok]]
            gains = _gains(o, tf[ok], dl[inside], some["avgdl"].iloc[0])
            for search, w, x in zip(some["search"], some["w"], some["x"]):
                got, score = _best(own, o, gains, len(inside), w, x, k)
                found.append(search)
                places.append(inside[got])
                scores.append(score)
        return _found(here, found, places, scores, schema.names)

    return rows.groupBy("p", "block").cogroup(asks.groupBy("q", "part")).applyInPandas(best, schema).drop("rank")
