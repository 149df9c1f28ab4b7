"""Queries of the training-data problems and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulaforge.llm.answer_defects import defect_labels, main_defect
from bulaforge.llm.canonical import map_values
from bulaforge.llm.main_body import main_body
from bulaforge.llm.mixing import Target, mix, shares
from bulaforge.llm.near_dup import NearDuplicates, Similarity, components, key_pairs, near_duplicates, unexpanded_copies
from bulaforge.llm.packing import pack
from bulaforge.llm.shared_spans import shared_chars
from bulaforge.llm.split_long import SplitRule, boundary_levels, split_oversized
from bulaforge.llm.tokens import Tokenizer, token_pieces
from bulaforge.operators.packed_fields import explode_packed
from bulaforge.sources.tables import once_per_key, table

# The tables of problem 2, numbered, and the similarity TESTDATA.md states for them.
NEAR_TABLES = [("chunks", "chunk_id", "text"), ("sections", "section_id", "body")]
NEAR = Similarity(run=3, threshold=0.7, min_words=20)


def _long_texts(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, key, text) of chunks and sections."""
    parts = [
        table(spark, base, name, [key, text]).select(F.lit(i).alias("tbl"), F.col(key).alias("key"), F.col(text).alias("text"))
        for i, (name, key, text) in enumerate(NEAR_TABLES)
    ]
    return parts[0].unionByName(parts[1])


def _table_name() -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _, _ in NEAR_TABLES]), F.col("tbl") + 1).alias("tbl")


def _near(spark: SparkSession, base: str) -> NearDuplicates:
    return near_duplicates(_long_texts(spark, base), NEAR)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return key_pairs(_near(spark, base), NEAR).select(_table_name(), "key_a", "key_b")


def p2_copies(spark: SparkSession, base: str) -> DataFrame:
    """The exact copies that p2_found leaves to the least key of their text."""
    return unexpanded_copies(_near(spark, base), NEAR).select(_table_name(), "key", "rep")


def p2_groups(spark: SparkSession, base: str) -> DataFrame:
    """Each record with its class of equal texts, its group and the number of classes linked to its own."""
    return components(_near(spark, base)).select(_table_name(), "key", "cls", "component", "links")


def _answer_pairs(spark: SparkSession, base: str) -> DataFrame:
    answers = once_per_key(table(spark, base, "answers", ["answer_id", "qid", "response", "found", "confidence", "ingested_at"]), "answer_id")
    questions = once_per_key(table(spark, base, "questions", ["qid", "text", "ingested_at"]), "qid")
    joined = answers.join(questions.select("qid", F.col("text").alias("question")), "qid", "left")
    return joined.select(F.col("answer_id").alias("id"), "question", "response", "found", "confidence")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return main_defect(defect_labels(_answer_pairs(spark, base))).select(F.col("id").alias("answer_id"), "defect")


def p3_labels(spark: SparkSession, base: str) -> DataFrame:
    """Every label that passes its cutoff, several per answer where they do."""
    return defect_labels(_answer_pairs(spark, base)).select(F.col("id").alias("answer_id"), "defect", F.round("posterior", 4).alias("posterior"))


SPLIT = SplitRule(limit=2000, overlap=200)


def _items(spark: SparkSession, base: str) -> DataFrame:
    """chunks and sections under their names."""
    return _long_texts(spark, base).select(_table_name(), "key", "text")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return boundary_levels(_items(spark, base), SPLIT)


def p4_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of every oversized text."""
    return split_oversized(_items(spark, base), SPLIT)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return main_body(table(spark, base, "details", ["detail_id", "conteudo_html"]), "detail_id", "conteudo_html")


def _canonical_rows(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, rec_key, fld, pos, kind, val): the freely typed values of listings and entities."""
    listings = once_per_key(table(spark, base, "listings", ["listing_id", "species", "form", "ingested_at"]), "listing_id")
    species = explode_packed(listings, ["listing_id"], {"species": "list"}).select(
        F.lit("listings").alias("tbl"), F.col("listing_id").alias("rec_key"), "fld", "pos", F.lit("species").alias("kind"), "val"
    )
    form = listings.select(F.lit("listings").alias("tbl"), F.col("listing_id").alias("rec_key"), F.lit("form").alias("fld"), F.lit(1).alias("pos"), F.lit("form").alias("kind"), F.col("form").alias("val"))
    asked = table(spark, base, "entities", ["qid", "species"]).dropDuplicates(["qid"])
    asked = asked.select(F.lit("entities").alias("tbl"), F.col("qid").alias("rec_key"), F.lit("species").alias("fld"), F.lit(1).alias("pos"), F.lit("species").alias("kind"), F.col("species").alias("val"))
    return species.unionByName(form).unionByName(asked)


def _references(spark: SparkSession, base: str) -> DataFrame:
    species = table(spark, base, "dim_species").select(F.lit("species").alias("kind"), F.col("syn_ord").alias("ord"), F.col("synonym").alias("name"), "canonical")
    itself = table(spark, base, "dim_species").select(F.lit("species").alias("kind"), F.lit(10_000).alias("ord"), F.col("canonical").alias("name"), "canonical").distinct()
    forms = table(spark, base, "dim_form").select(F.lit("form").alias("kind"), F.col("form_id").alias("ord"), F.col("canonical").alias("name"), "canonical")
    return species.unionByName(itself).unionByName(forms)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    mapped = map_values(_canonical_rows(spark, base), _references(spark, base))
    return mapped.select("tbl", "rec_key", "fld", "pos", "canonical")


def p7_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """The values that no entry matches, with how often they were typed."""
    mapped = map_values(_canonical_rows(spark, base), _references(spark, base))
    return mapped.where("canonical = 'UNMATCHED'").groupBy("tbl", "fld", "val").agg(F.count("*").alias("n"))


CAPACITY = 2048


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    """Every document with text, or its pieces, with the container of CAPACITY tokens it lies in."""
    pieces = token_pieces(table(spark, base, "documents", ["doc_id", "text"]), "doc_id", "text", Tokenizer.public(), CAPACITY)
    return pack(pieces, CAPACITY).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens, unused share, the fewest containers that could hold the tokens, and the share of containers the least squares gave."""
    held = p8_containers(spark, base).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("planned").cast("int")).alias("planned"))
    return held.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"),
        (1 - F.sum("n") / (F.count("*") * F.lit(CAPACITY))).alias("unused_share"), F.ceil(F.sum("n") / F.lit(CAPACITY)).alias("bound"),
        F.avg("planned").alias("solved_share"),
    )


def _targets(spark: SparkSession, base: str) -> list[Target]:
    """mix_targets is a fixed list of sources, bounded by MAX_SOURCES."""
    rows = table(spark, base, "mix_targets").orderBy("source").collect()
    return [Target(r["source"], r["target_share"], r["max_repeats"]) for r in rows]


def p9_sample(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mixture with their source and number of uses."""
    docs = table(spark, base, "documents", ["doc_id", "text", "source"])
    return mix(docs, "doc_id", "text", "source", _targets(spark, base), Tokenizer.public())


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and reached share of every source."""
    return shares(p9_sample(spark, base), _targets(spark, base))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return shared_chars(table(spark, base, "documents", ["doc_id", "text"]), "doc_id", "text", 200)


def p10_share_by_source(spark: SparkSession, base: str) -> DataFrame:
    """Characters shared elsewhere against all characters, by source."""
    docs = table(spark, base, "documents", ["doc_id", "source", "text"]).select("doc_id", "source", F.length("text").alias("n"))
    joined = docs.join(p10_found(spark, base), "doc_id", "left")
    return joined.groupBy("source").agg(F.sum("n").alias("chars"), F.sum(F.coalesce("shared_chars", F.lit(0))).alias("shared_chars"))


QUERIES = {
    "p2_found": p2_found,
    "p2_copies": p2_copies,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_sample": p9_sample,
    "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_share_by_source": p10_share_by_source,
}
_TEXTS = """t AS (SELECT 'chunks' AS tbl, chunk_id AS k, any_value(text) AS x FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id
UNION ALL SELECT 'sections', section_id, any_value(body) FROM sections WHERE body IS NOT NULL GROUP BY section_id)"""
_FITS = "list_bool_and(list_transform(string_split_regex(x, '{0}'), lambda p: length(regexp_replace(p, '^[\\s\\x0b\\x{{00a0}}]+|[\\s\\x0b\\x{{00a0}}]+$', '', 'g')) <= 2000))"
_BR = r"(\r\n|\n|\r)"
_WHITE = r"[\s\x0b\x{00a0}]"

#: Plain restatements that DuckDB can run at a small scale.
SQL: dict[str, str] = {
    "p2_found": f"""WITH {_TEXTS}, w AS (SELECT tbl, k, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') AS ws FROM t),
g AS (SELECT tbl, k, list_distinct(list_transform(range(1, len(ws)-1), lambda i: ws[i]||' '||ws[i+1]||' '||ws[i+2])) AS gs FROM w WHERE len(ws) >= 20),
u AS (SELECT tbl, k, len(gs) AS n, unnest(gs) AS g FROM g),
p AS (SELECT a.tbl, a.k AS key_a, b.k AS key_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.tbl=b.tbl AND a.g=b.g AND a.k < b.k GROUP BY 1,2,3)
SELECT tbl, key_a, key_b FROM p WHERE c/(na+nb-c) >= 0.7""",
    "p4_found": f"""WITH {_TEXTS} SELECT tbl, k AS item_key, CASE WHEN {_FITS.format(_BR + '[ \\t\\f\\x0b\\x{00a0}]*' + _BR)} THEN 'paragraph' WHEN {_FITS.format(_BR)} THEN 'line'
WHEN list_bool_and(list_transform(string_split_regex(regexp_replace(x, '([.!?]){_WHITE}+', '\\1'||chr(10), 'g'), '{_BR}'), lambda p: length(regexp_replace(p, '^{_WHITE}+|{_WHITE}+$', '', 'g')) <= 2000)) THEN 'sentence'
WHEN {_FITS.format(_WHITE + '+')} THEN 'word' ELSE 'char' END AS boundary FROM t WHERE length(x) > 2000""",
    "p10_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
s AS (SELECT doc_id, i, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text)-198)) AS i FROM d)),
m AS (SELECT h FROM s GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s SEMI JOIN m USING (h))
SELECT doc_id, sum(CASE WHEN b IS NULL THEN 200 ELSE least(200, i-b) END)::BIGINT AS shared_chars FROM c GROUP BY 1""",
}
