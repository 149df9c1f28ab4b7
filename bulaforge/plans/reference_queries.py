"""Queries of the document question-answering operators and their SQL for DuckDB.

Searches take every question or vector whose id is divisible by 100 against all rows; the whole plan answers every question.
Where SQL can't state an operator there is none, and the tests restate it in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bulaforge.functions import answers as A
from bulaforge.functions import dimensions as D
from bulaforge.functions import entities as E
from bulaforge.functions import language
from bulaforge.functions.text import cache_key, squeeze
from bulaforge.operators import cachestore, chunking, compare, dense, doses, fusion, layout, lexical, reports, resolve, sections, sessions
from bulaforge.plans import pipeline
from bulaforge.sources import html, sinks
from bulaforge.sources.questions import questions as question_lines
from bulaforge.sources.tables import once_per_key, table
from bulaforge.streaming import sessions as streaming
from bulaforge.streaming.turns import Standing, follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- inputs ---------------------------------------------------------------------------


def _questions(s: SparkSession, b: str) -> DataFrame:
    return once_per_key(table(s, b, "questions", ["qid", "session_id", "seq", "text", "ingested_at"]), "qid")


def _asked(s: SparkSession, b: str) -> DataFrame:
    return _questions(s, b).where("qid % 100 = 0 AND text IS NOT NULL").select("qid", F.col("text").alias("question"))


def _chunks(s: SparkSession, b: str) -> DataFrame:
    return table(s, b, "chunks", ["chunk_id", "section_title", "text"]).dropDuplicates(["chunk_id"]).select("chunk_id", F.concat_ws(" ", "section_title", "text").alias("body"))


def _answers(s: SparkSession, b: str) -> DataFrame:
    return once_per_key(table(s, b, "answers"), "answer_id")


def _listings(s: SparkSession, b: str) -> DataFrame:
    return once_per_key(table(s, b, "listings"), "listing_id")


def _events(s: SparkSession, b: str) -> DataFrame:
    return table(s, b, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_STOP = "('para','com','por','que','das','dos','nos','nas','uma','aos','mas','como')"
_TOK = "list_filter(regexp_extract_all(strip_accents(lower(coalesce({0},''))), '[a-z0-9]+'), lambda t: length(t)>2 AND t NOT IN " + _STOP + ")"
_Q = "q AS (SELECT DISTINCT qid, text AS question FROM questions WHERE qid % 100 = 0 AND text IS NOT NULL)"
_C = "d AS (SELECT chunk_id AS k, any_value(concat_ws(' ', section_title, text)) AS body FROM chunks GROUP BY 1)"
_BM = f"""tok AS (SELECT k, {_TOK.format('body')} AS ts FROM d), dl AS (SELECT k, len(ts) AS dl FROM tok),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM tok) GROUP BY 1,2), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT qid, unnest({_TOK.format('question')}) AS term FROM q),
sc AS (SELECT qid, tf.k, sum(ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(0.25+0.75*greatest(dl,1)/greatest(avgdl,1)))) AS score
 FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.k=tf.k CROSS JOIN st GROUP BY 1,2),
lex AS (SELECT * FROM (SELECT qid, k, score, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, k) AS rank FROM sc))"""
_DOCS = "d AS (SELECT doc_id AS k, text AS body FROM documents)"
_DEN = """den AS (SELECT * FROM (SELECT qid, k, score, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, k) AS rank FROM
 (SELECT a.vec_id AS qid, b.vec_id AS k, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 {0}) WHERE round(score,9) >= 0.3))"""


# ---- retrieval ------------------------------------------------------------------------


@query(f"WITH {_Q}, {_C}, {_BM} SELECT qid, k AS chunk_id, rank, round(score,4) AS score FROM lex WHERE rank <= 8")
def bm25_topk(s: SparkSession, b: str) -> DataFrame:
    """BM25 top 8 of the chunks for each stated question."""
    found = lexical.search(_asked(s, b), _chunks(s, b), "qid", "question", "chunk_id", "body", 8)
    return found.select("qid", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("SELECT 1 AS qid, k AS chunk_id, rn AS rank, 0.0::DOUBLE AS score FROM (SELECT DISTINCT chunk_id AS k, dense_rank() OVER (ORDER BY chunk_id) AS rn FROM chunks) WHERE rn <= 8")
def bm25_empty_query(s: SparkSession, b: str) -> DataFrame:
    """A question without tokens gets the first chunks with score 0."""
    asked = s.createDataFrame([(1, "o a de ?")], "qid int, question string")
    return lexical.search(asked, _chunks(s, b), "qid", "question", "chunk_id", "body", 8).select("qid", "chunk_id", "rank", "score")


@query(f"WITH tok AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS term FROM tok) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM u GROUP BY 1")
def term_stats(s: SparkSession, b: str) -> DataFrame:
    """Document and collection frequency of every term of the documents."""
    tf, _ = lexical.postings(table(s, b, "documents", ["doc_id", "text"]), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH dl AS (SELECT len({_TOK.format('text')}) AS dl FROM documents) SELECT count(*) AS n, round(avg(dl),6) AS avgdl FROM dl")
def length_stats(s: SparkSession, b: str) -> DataFrame:
    """Number and mean length of documents; those without tokens count."""
    _, dl = lexical.postings(table(s, b, "documents", ["doc_id", "text"]), "doc_id", "text")
    return dl.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


def _vectors(s: SparkSession, b: str) -> DataFrame:
    return table(s, b, "embeddings").withColumnRenamed("embedding", "v")


def _query_vectors(s: SparkSession, b: str) -> DataFrame:
    return table(s, b, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query(f"WITH {_DEN.format('')} SELECT qid, k AS vec_id, rank, round(score,4) AS score FROM den WHERE rank <= 8")
def dense_topk(s: SparkSession, b: str) -> DataFrame:
    """Cosine top 8 at 0.30 or more."""
    return dense.search(_query_vectors(s, b), _vectors(s, b), "qid", "vec_id").select("qid", "vec_id", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {_DEN.format('AND b.label = 3')} SELECT qid, k AS vec_id, rank, round(score,4) AS score FROM den WHERE rank <= 8")
def dense_topk_filtered(s: SparkSession, b: str) -> DataFrame:
    """The same among the vectors of one label; the filter reaches the scan."""
    return dense.search(_query_vectors(s, b), _vectors(s, b), "qid", "vec_id", where=F.col("label") == 3).select("qid", "vec_id", "rank", F.round("score", 4).alias("score"))


def _both_sides(s: SparkSession, b: str) -> tuple[DataFrame, DataFrame]:
    """Lexical over documents and dense over vectors; vec_id stands for doc_id and for qid, a stated synthetic alignment."""
    docs = table(s, b, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "k")
    lex = lexical.search(_asked(s, b), docs, "qid", "question", "k", "text", 24)
    den = dense.search(_query_vectors(s, b), _vectors(s, b).withColumnRenamed("vec_id", "k"), "qid", "k", 24)
    return lex, den


_FUSE = """u AS (SELECT qid, k, score, rank, 'bm25' AS src FROM lex WHERE rank <= 24 UNION ALL SELECT qid, k, score, rank, 'cosine' FROM den WHERE rank <= 24 {0}),
s2 AS (SELECT *, (SELECT count(DISTINCT src) FROM u v WHERE v.qid=u.qid) AS sides FROM u),
m AS (SELECT qid, k, sides, sum(1.0/(60+rank)) AS rrf, max(score) AS own, min(CASE WHEN src='bm25' THEN rank END) AS lr, min(CASE WHEN src='cosine' THEN rank END) AS dr, min(src) AS src FROM s2 GROUP BY 1,2,3),
f AS (SELECT qid, k, CASE WHEN sides=2 THEN rrf ELSE own END AS score, CASE WHEN sides=2 THEN 'rrf' ELSE src END AS score_kind, lr, dr FROM m),
fu AS (SELECT qid, k, score, score_kind, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, lr NULLS LAST, dr NULLS LAST, k) AS rank FROM f)"""


@query(f"WITH {_Q}, {_DOCS}, {_BM}, {_DEN.format('')}, {_FUSE.format('')} SELECT qid, k AS doc_id, rank, round(score,4) AS score, score_kind FROM fu WHERE rank <= 8")
def hybrid_rrf(s: SparkSession, b: str) -> DataFrame:
    """Rank fusion of 24 lexical and 24 dense results to 8."""
    return fusion.fuse(*_both_sides(s, b), "qid", "k").select("qid", F.col("k").alias("doc_id"), "rank", F.round("score", 4).alias("score"), "score_kind")


@query(f"WITH {_Q}, {_DOCS}, {_BM}, {_DEN.format('')}, {_FUSE.format('AND qid % 200 = 0')} SELECT qid, k AS doc_id, rank, round(score,4) AS score, score_kind FROM fu WHERE rank <= 8")
def hybrid_fallbacks(s: SparkSession, b: str) -> DataFrame:
    """Fusion where every other question has no dense side: its scores stay BM25."""
    lex, den = _both_sides(s, b)
    return fusion.fuse(lex, den.where("qid % 200 = 0"), "qid", "k").select("qid", F.col("k").alias("doc_id"), "rank", F.round("score", 4).alias("score"), "score_kind")


@query(f"WITH {_Q}, {_DOCS}, {_BM}, {_DEN.format('')}, {_FUSE.format('')}, x AS (SELECT qid, k, 0 AS part, rank FROM fu WHERE rank <= 8 UNION ALL SELECT qid, k, 1, rank FROM lex WHERE rank <= 16), o AS (SELECT qid, k, min(part*1000+rank) AS spot FROM x GROUP BY 1,2) SELECT qid, k AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY spot) AS ord FROM o")
def expand_context(s: SparkSession, b: str) -> DataFrame:
    """The fused results followed by a wider lexical search, each document once."""
    lex, den = _both_sides(s, b)
    return fusion.expand(fusion.fuse(lex, den, "qid", "k"), lex.where("rank <= 16"), "qid", "k").select("qid", F.col("k").alias("doc_id"), "ord")


@query("""WITH t AS (SELECT chunk_id, any_value(product) AS product, any_value(chunk_ord) AS chunk_ord, any_value(text) AS text FROM chunks WHERE text IS NOT NULL AND product IS NOT NULL GROUP BY 1),
r AS (SELECT *, sum(length(text)) OVER (PARTITION BY product ORDER BY chunk_ord, chunk_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT product, chunk_id, CASE WHEN run <= 3000 THEN length(text) ELSE 3000-(run-length(text)) END AS kept FROM r WHERE run <= 3000 OR (run-length(text) <= 3000 AND 3000-(run-length(text)) > 200)""")
def context_budget(s: SparkSession, b: str) -> DataFrame:
    """The chunks of each product that fit 3,000 characters in order, the first overflowing one cut."""
    t = table(s, b, "chunks", ["chunk_id", "product", "chunk_ord", "text"]).where("text IS NOT NULL AND product IS NOT NULL").dropDuplicates(["chunk_id"])
    t = t.withColumn("at", F.struct("chunk_ord", "chunk_id"))
    return fusion.within_budget(t, "product", "at", "text", 3000).select("product", "chunk_id", F.length("text").alias("kept"))


_TOPIC_CASE = "CASE doc_id % 4 WHEN 0 THEN 'dose' WHEN 1 THEN 'especies' WHEN 2 THEN 'composicao' ELSE 'geral' END"


@query(f"""WITH r AS (SELECT section_id, any_value(doc_id) AS doc_id, any_value(sec_ord) AS sec_ord, any_value(coalesce(number,'')) AS number, lower(any_value(concat(coalesce(title,''),' ',coalesce(body,'')))) AS said FROM sections GROUP BY 1),
m AS (SELECT *, {_TOPIC_CASE} AS topic FROM r),
h AS (SELECT *, CASE topic WHEN 'dose' THEN starts_with(number,'4.9') OR starts_with(number,'4.2') WHEN 'especies' THEN starts_with(number,'4.1') WHEN 'composicao' THEN starts_with(number,'2') OR starts_with(number,'6.1') ELSE false END AS h1,
 CASE topic WHEN 'dose' THEN contains(said,'posologia') OR contains(said,'dose') OR contains(said,'administração') WHEN 'especies' THEN contains(said,'espécies') OR contains(said,'alvo') WHEN 'composicao' THEN contains(said,'composição') ELSE false END AS h2 FROM m),
a AS (SELECT *, bool_or(h1) OVER (PARTITION BY doc_id) AS a1, bool_or(h2) OVER (PARTITION BY doc_id) AS a2, row_number() OVER (PARTITION BY doc_id, h2 ORDER BY sec_ord, section_id) AS nth FROM h)
SELECT doc_id, section_id, tier FROM (SELECT doc_id, section_id, CASE WHEN a1 THEN CASE WHEN h1 THEN 1 END WHEN a2 THEN CASE WHEN h2 AND nth <= 6 THEN 2 END ELSE 3 END AS tier FROM a) WHERE tier IS NOT NULL""")
def section_tiers(s: SparkSession, b: str) -> DataFrame:
    """The sections of each document that serve a topic: by number, else by word, else all."""
    rows = table(s, b, "sections", ["section_id", "doc_id", "sec_ord", "number", "title", "body"]).dropDuplicates(["section_id"])
    rows = rows.withColumn("topic", F.expr(_TOPIC_CASE)).withColumn("at", F.struct("sec_ord", "section_id"))
    return sections.tiered(rows, ["doc_id"], "at", "topic", "number", "title", "body").select("doc_id", "section_id", "tier")


# ---- text -----------------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\nDireção Geral de Alimentação e Veterinária.*?Página \d+ de \d+ \n', '', 'g'), '(?m)^[\s\x0b]*Página \d+ de \d+[\s\x0b]*$', '', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), ' {2,}', ' ', 'g'), '^[\s\x0b\x{00a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x0b\x{00a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def text_clean(s: SparkSession, b: str) -> DataFrame:
    """Digest of every cleaned document text."""
    return table(s, b, "documents", ["doc_id", "text"]).where("text IS NOT NULL").select("doc_id", F.md5(chunking.clean(F.col("text"))).alias("digest"))


@query()
def section_split(s: SparkSession, b: str) -> DataFrame:
    """Numbered sections of every document."""
    return chunking.sections(table(s, b, "documents", ["doc_id", "text"]), "doc_id", "text")


@query()
def section_split_strict(s: SparkSession, b: str) -> DataFrame:
    """The same with a mandatory dot after the number."""
    return chunking.sections(table(s, b, "documents", ["doc_id", "text"]), "doc_id", "text", strict=True)


@query()
def table_extract(s: SparkSession, b: str) -> DataFrame:
    """Marked tables of every section body."""
    rows = table(s, b, "sections", ["section_id", "body"]).dropDuplicates(["section_id"])
    return rows.select("section_id", F.explode(chunking.tables_of(F.col("body"))).alias("t")).select("section_id", "t.page", "t.text")


_SPANS = [(1, 1, 1, "Peso", 10.0, 100.0), (1, 1, 2, "Dose", 60.0, 102.0), (1, 1, 3, "5 kg", 10.0, 120.0), (1, 1, 4, "1 ml", 60.0, 121.0), (1, 1, 5, "10 kg", 60.0, 140.0), (1, 1, 6, "2 ml", 10.0, 141.0), (1, 2, 1, "só", 5.0, 10.0), (1, 2, 2, "texto", 5.0, 40.0), (2, 1, 1, "A", 1.0, 1.0), (2, 1, 2, "B", 9.0, 1.0), (2, 1, 3, " ", 9.0, 9.0), (2, 1, 4, "C", 1.0, 20.0), (2, 1, 5, "D", 9.0, 22.0)]
_SPAN_SQL = "(VALUES " + ",".join(f"({d},{p},{o},'{t}',{x}::DOUBLE,{y}::DOUBLE)" for d, p, o, t, x, y in _SPANS) + ") AS t(doc_id,page_no,ord,text,x,y)"


@query(f"""WITH f AS (SELECT *, CASE WHEN abs(y-lag(y) OVER (PARTITION BY doc_id,page_no ORDER BY ord)) > 5 THEN 1 ELSE 0 END AS j FROM {_SPAN_SQL} WHERE trim(text) <> ''),
g AS (SELECT *, sum(j) OVER (PARTITION BY doc_id,page_no ORDER BY ord) AS r FROM f), h AS (SELECT doc_id,page_no,r, count(*) AS n, string_agg(text,' | ' ORDER BY x,ord) AS line FROM g GROUP BY 1,2,3 HAVING count(*) >= 2),
k AS (SELECT doc_id,page_no, list(line ORDER BY r) AS ls, count(DISTINCT n) AS w FROM h GROUP BY 1,2 HAVING count(*) >= 2)
SELECT doc_id, page_no, array_to_string(list_concat([ls[1], repeat('-',length(ls[1]))], ls[2:]), chr(10)) AS table_text FROM k WHERE w <= 3""")
def table_detect(s: SparkSession, b: str) -> DataFrame:
    """Tables found among layout spans (no table of spans exists; a small stated one stands in)."""
    spans = s.createDataFrame(_SPANS, "doc_id int, page_no int, ord int, text string, x double, y double")
    return layout.detect_tables(spans, ["doc_id", "page_no"])


_ITEMS = "i AS (SELECT section_id, any_value(coalesce(body,'')) AS body FROM sections GROUP BY 1)"
_WS = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_PARA = f"""p AS (SELECT section_id, list_filter(list_transform(string_split_regex(body, '\\n{_WS}*\\n'), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS ps FROM i),
pp AS (SELECT section_id, flatten(list_transform(ps, lambda x: CASE WHEN length(x) <= 2000 THEN [x] ELSE (
 list_transform([list_reduce(list_transform(string_split(regexp_replace(x, '([.!?]){_WS}+', '\\1'||chr(31), 'g'), chr(31)), lambda z: {{'o': []::VARCHAR[], 'b': z}}),
 lambda a, z: CASE WHEN length(a.b)+length(z.b)+1 <= 1500 THEN {{'o': a.o, 'b': CASE WHEN a.b='' THEN z.b ELSE {_strip_sql("a.b||' '||z.b")} END}}
  ELSE {{'o': CASE WHEN a.b='' THEN a.o ELSE list_append(a.o, a.b) END, 'b': z.b}} END, {{'o': []::VARCHAR[], 'b': ''}})],
 lambda f: CASE WHEN f.b='' THEN f.o ELSE list_append(f.o, f.b) END)[1]) END)) AS ps FROM p)"""


@query(f"WITH {_ITEMS}, {_PARA}, u AS (SELECT section_id, unnest(ps) AS t, generate_subscripts(ps,1)-1 AS n FROM pp) SELECT section_id, n::INT AS n, md5(t) AS digest, length(t)::INT AS chars FROM u")
def paragraph_split(s: SparkSession, b: str) -> DataFrame:
    """Paragraphs of every section body, long ones as packs of sentences."""
    rows = table(s, b, "sections", ["section_id", "body"]).dropDuplicates(["section_id"])
    return rows.select("section_id", F.posexplode(chunking.paragraphs(F.coalesce("body", F.lit("")))).alias("n", "t")).select("section_id", "n", F.md5("t").alias("digest"), F.length("t").alias("chars"))


_PACK = f"""pk AS (SELECT section_id, list_reduce(list_transform(ps, lambda z: {{'o': []::VARCHAR[], 'b': z}}), lambda a, z: CASE WHEN a.b='' THEN {{'o': a.o, 'b': z.b}} WHEN length(a.b)+length(z.b)+1 <= 1400 THEN {{'o': a.o, 'b': a.b||chr(10)||chr(10)||z.b}}
 ELSE {{'o': list_append(a.o, a.b), 'b': {_strip_sql("right(a.b,320)||chr(10)||chr(10)||z.b")}}} END, {{'o': []::VARCHAR[], 'b': ''}}) AS f FROM pp),
pl AS (SELECT section_id, CASE WHEN f.b='' THEN f.o ELSE list_append(f.o, f.b) END AS cs FROM pk),
mt AS (SELECT section_id, list_reduce(list_transform(cs, lambda c: [c]), lambda a, c: CASE WHEN length(c[1]) < 160 AND len(a) > 0 THEN list_append(a[1:len(a)-1], a[len(a)]||chr(10)||chr(10)||c[1]) ELSE list_append(a, c[1]) END, []::VARCHAR[]) AS cs FROM pl WHERE len(cs) > 0)"""


@query(f"WITH {_ITEMS}, {_PARA}, {_PACK}, u AS (SELECT section_id, unnest(cs) AS t, generate_subscripts(cs,1)-1 AS n FROM mt) SELECT section_id, n::INT AS n, md5(t) AS digest, length(t)::INT AS chars FROM u")
def chunk_pack(s: SparkSession, b: str) -> DataFrame:
    """Packs of paragraphs with overlap of every section body."""
    rows = table(s, b, "sections", ["section_id", "body"]).dropDuplicates(["section_id"])
    return rows.select("section_id", F.posexplode(chunking.packed(chunking.paragraphs(F.coalesce("body", F.lit(""))))).alias("n", "t")).select("section_id", "n", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query(f"WITH {_ITEMS}, {_PARA}, {_PACK}, u AS (SELECT section_id, unnest(cs) AS t FROM mt), n AS (SELECT section_id, any_value(number) AS number FROM sections GROUP BY 1) SELECT number, count(*) AS chunks, sum(length(t))::BIGINT AS chars, max(length(t))::INT AS longest FROM u JOIN n USING (section_id) GROUP BY 1")
def chunk_stats(s: SparkSession, b: str) -> DataFrame:
    """Number and size of the chunks by section number."""
    rows = table(s, b, "sections", ["section_id", "number", "body"]).dropDuplicates(["section_id"])
    packs = rows.select("number", F.explode(chunking.packed(chunking.paragraphs(F.coalesce("body", F.lit(""))))).alias("t"))
    return packs.groupBy("number").agg(F.count("*").alias("chunks"), F.sum(F.length("t")).alias("chars"), F.max(F.length("t")).alias("longest"))


@query()
def chunk_sections(s: SparkSession, b: str) -> DataFrame:
    """Chunks of every section, tables apart, with their header lines."""
    rows = table(s, b, "sections", ["section_id", "number", "title", "body"]).dropDuplicates(["section_id"])
    out = chunking.chunks(rows, ["section_id"], "number", "title", "body")
    return out.withColumn("rendered", chunking.rendered(F.col("section_num"), F.col("section_title"), F.col("is_table"), F.col("text")))


def _lang_sql(x: str) -> str:
    lists = [(n, "[" + ",".join(f"'{w}'" for w in ws) + "]") for n, ws in D.LANGUAGE_WORDS]
    hints = "[" + ",".join(f"'{w}'" for w in dict.fromkeys(D.PORTUGUESE_HINTS)) + "]"
    score = ", ".join(f"len(list_intersect(ws, {l}))/greatest(len(ws),1) AS s_{n}" for n, l in lists)
    best = "greatest(" + ",".join(f"s_{n}" for n, _ in lists) + ")"
    first = "CASE " + " ".join(f"WHEN s_{n}={best} THEN '{n}'" for n, _ in lists) + " END"
    return f"""w AS (SELECT *, list_distinct(list_concat(regexp_extract_all(lower(coalesce({x},'')), '[a-záàâãéêíóôõúüç'']+'), regexp_extract_all(strip_accents(lower(coalesce({x},''))), '[a-z'']+'))) AS ws FROM src),
sc AS (SELECT *, {score}, len(list_intersect(ws, {hints}))/greatest(len(ws),1) AS s_pt FROM w),
lab AS (SELECT *, CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '[^\\s\\x0b\\x{{00a0}}]') THEN 'indefinido' WHEN regexp_matches({x}, '[\\x{{0400}}-\\x{{04ff}}\\x{{0600}}-\\x{{06ff}}\\x{{0900}}-\\x{{097f}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{309f}}\\x{{30a0}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN 'cjk'
 WHEN {best} > 0.12 AND {best} > s_pt THEN {first} WHEN s_pt >= 0.05 OR len(regexp_extract_all({x}, '[^\\s\\x0b]+')) <= 4 THEN 'portugues' ELSE 'outro' END AS label FROM sc)"""


@query(f"WITH src AS (SELECT doc_id, text FROM documents), {_lang_sql('text')} SELECT doc_id, label FROM lab")
def language_id(s: SparkSession, b: str) -> DataFrame:
    """Language label of every document."""
    return table(s, b, "documents", ["doc_id", "text"]).select("doc_id", language.detect(F.col("text")).alias("label"))


@query(f"WITH src AS (SELECT lang, text FROM documents), {_lang_sql('text')} SELECT coalesce(lower(lang),'none') AS lang, label, count(*) AS n FROM lab GROUP BY 1,2")
def language_confusion(s: SparkSession, b: str) -> DataFrame:
    """Stated against found language."""
    d = table(s, b, "documents", ["lang", "text"]).select(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), language.detect(F.col("text")).alias("label"))
    return d.groupBy("lang", "label").agg(F.count("*").alias("n"))


@query(f"WITH src AS (SELECT DISTINCT answer_id, response AS text FROM answers), {_lang_sql('text')} SELECT answer_id, label IN ('portugues','indefinido') AS accepted, CASE label WHEN 'portugues' THEN 'ok' WHEN 'indefinido' THEN 'indefinido (texto curto)' ELSE 'detectado='||label END AS reason FROM lab")
def language_guard(s: SparkSession, b: str) -> DataFrame:
    """Whether each answer passes the policy of one language, and why not."""
    return _answers(s, b).select("answer_id", language.judge(F.col("response")).alias("g")).select("answer_id", "g.accepted", "g.reason")


# ---- entities and intent --------------------------------------------------------------


def _word_sql(words: list[str]) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(w.replace("-", r"\-") for w in words) + r")($|[^\p{L}\p{N}_])"


_QT = "qq AS (SELECT DISTINCT qid, text FROM questions)"
_SPECIES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_word_sql(ws)}') THEN '{c}'" for c, ws in D.SPECIES) + " END"
_TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_word_sql(ks)}') THEN '{t}'" for t, ks, _ in D.TOPICS) + " ELSE 'geral' END"
_FORM_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{f}') THEN '{f.capitalize()}'" for f in D.FORMS) + " END"


@query(f"WITH {_QT} SELECT qid, {_SPECIES_SQL} AS species, {_TOPIC_SQL} AS topic, {_FORM_SQL} AS form FROM qq")
def question_topics(s: SparkSession, b: str) -> DataFrame:
    """Species, topic and form of every question."""
    t = F.col("text")
    return _questions(s, b).select("qid", E.find_species(t).alias("species"), E.topic(t).alias("topic"), E.form(t).alias("form"))


@query(f"WITH {_QT}, t AS (SELECT {_TOPIC_SQL} AS topic FROM qq) SELECT topic, count(*) AS n, round(count(*)*1.0/sum(count(*)) OVER (),6) AS share FROM t GROUP BY 1")
def topic_counts(s: SparkSession, b: str) -> DataFrame:
    """Questions by topic with their share."""
    g = _questions(s, b).groupBy(E.topic(F.col("text")).alias("topic")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query()
def species_normalize(s: SparkSession, b: str) -> DataFrame:
    """Questions with species synonyms replaced."""
    return _questions(s, b).select("qid", E.normalize_species(F.col("text")).alias("text"))


@query()
def entity_extract(s: SparkSession, b: str) -> DataFrame:
    """Entities of every question."""
    return _questions(s, b).where("text IS NOT NULL").select("qid", E.entities(E.normalize_species(F.col("text"))).alias("e")).select("qid", "e.*")


_COMPARED = "(" + " OR ".join(f"contains(lower(text),'{k}')" for k in D.COMPARISON) + ")"


@query(f"WITH {_QT} SELECT qid, CASE WHEN {_COMPARED} AND NOT (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])que\\s+medicamento\\s+') AND NOT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])que\\s+medicamentos($|[^\\p{{L}}\\p{{N}}_])')) THEN 'comparacao' ELSE 'medicamento' END AS category FROM qq WHERE text IS NOT NULL")
def intent_category(s: SparkSession, b: str) -> DataFrame:
    """Comparison or single product, for every question."""
    q = pipeline.classified(_questions(s, b).where("text IS NOT NULL").select("qid", "text"))
    return q.select("qid", "category")


@query()
def intent_rules(s: SparkSession, b: str) -> DataFrame:
    """Category, confidence and deciding layer, kind of alternative asked for."""
    q = pipeline.classified(_questions(s, b).where("text IS NOT NULL").select("qid", "text"))
    return q.select("qid", "category", "class_confidence", "via", F.when(E.asks_alternative(F.col("text")), E.alternative_kind(F.col("text"))).alias("alternative"))


@query()
def followup_rewrite(s: SparkSession, b: str) -> DataFrame:
    """Short follow-ups rewritten against the turn before (not chained; see the stream for chained state)."""
    q = _questions(s, b).where("session_id IS NOT NULL AND text IS NOT NULL").select("session_id", "seq", "qid", "text")
    q = q.withColumn("product", E.product(F.col("text"))).withColumn("topic", E.topic(F.col("text"))).withColumnRenamed("text", "query")
    q = sessions.previous_turn(q, "session_id", ["seq", "qid"], ["query", "product", "topic"])
    return q.select("session_id", "seq", "qid", E.follow_up(F.col("query"), F.col("last_query"), F.col("last_product"), F.col("last_topic")).alias("rewritten"))


@query()
def followup_chained(s: SparkSession, b: str) -> DataFrame:
    """Every turn with the question it stands for, each read against what the turn before stood for; the stream's fold over a stored table."""
    q = _questions(s, b).where("session_id IS NOT NULL AND text IS NOT NULL").select("session_id", "seq", "qid", E.turn_features(F.col("text")).alias("f")).select("session_id", "seq", "qid", "f.*")

    def step(state: Standing, turn: dict) -> tuple:
        state, made = follow(state, turn)
        return state, (turn["session_id"], turn["seq"], turn["qid"], made, state.product)

    return sessions.fold_in_order(q, "session_id", ["seq", "qid"], Standing(), step, "session_id string, seq int, qid bigint, rewritten string, about string")


@query(r"SELECT qid, trim(text) AS text FROM (SELECT DISTINCT qid, text FROM questions) WHERE ends_with(trim(text),'?') AND NOT regexp_matches(trim(text), '^(\||#|//|--)')")
def question_filter(s: SparkSession, b: str) -> DataFrame:
    """Lines that are questions under the strict rule."""
    q = _questions(s, b).withColumn("text", F.trim("text"))
    return q.join(question_lines(q.select("text"), "text").distinct(), "text", "left_semi").select("qid", "text")


# ---- doses and answers ----------------------------------------------------------------

_DOSE_RE = r"\d+[.,]?\d*\s*(?:mg|mcg|µg|ml)\s*/\s*kg"


@query(rf"""WITH a AS (SELECT DISTINCT answer_id, response FROM answers), m AS (SELECT answer_id, unnest(regexp_extract_all(coalesce(response,''), '(?i){_DOSE_RE}')) AS m FROM a)
SELECT DISTINCT answer_id, replace(regexp_extract(m,'^(\d+[.,]?\d*)',1),',','.')||' '||replace(lower(regexp_extract(m,'(?i)(mg|mcg|µg|ml)\s*/',1)),'µg','mcg')||'/kg' AS display FROM m""")
def dose_extract(s: SparkSession, b: str) -> DataFrame:
    """Distinct doses mentioned in every answer."""
    return doses.extract(_answers(s, b), ["answer_id"], ["answered_at"], "response").select("answer_id", "display")


@query()
def dose_context(s: SparkSession, b: str) -> DataFrame:
    """Doses with the text around them, in order of mention."""
    return doses.extract(_answers(s, b), ["answer_id"], ["answered_at"], "response")


_ALLOWED_RE = r"(\d+[.,]?\d*)\s*(mg|mcg|µg|ug|ml|g)\s*/\s*(kg|quilograma)"
_NORM = f"replace(regexp_extract(m,'(?i){_ALLOWED_RE}',1),',','.')||' '||replace(replace(lower(regexp_extract(m,'(?i){_ALLOWED_RE}',2)),'µg','mcg'),'ug','mcg')||'/'||lower(regexp_extract(m,'(?i){_ALLOWED_RE}',3))"


@query(rf"""WITH l AS (SELECT DISTINCT lower(product) AS p, {_NORM} AS dose FROM (SELECT product, unnest(regexp_extract_all(coalesce(display,''), '(?i){_ALLOWED_RE}')) AS m FROM doses JOIN documents USING (doc_id) WHERE product IS NOT NULL)),
a AS (SELECT DISTINCT answer_id, qid, response FROM answers), e AS (SELECT DISTINCT qid, lower(trim(product)) AS p FROM entities WHERE product IS NOT NULL),
d AS (SELECT answer_id, p, {_NORM} AS dose FROM (SELECT answer_id, p, unnest(regexp_extract_all(coalesce(response,''), '(?i){_ALLOWED_RE}')) AS m FROM a JOIN e USING (qid)))
SELECT DISTINCT answer_id, dose FROM d WHERE p IN (SELECT p FROM l) AND NOT EXISTS (SELECT 1 FROM l WHERE l.p = d.p AND split_part(l.dose,' ',1) = split_part(d.dose,' ',1))""")
def dose_validate(s: SparkSession, b: str) -> DataFrame:
    """Doses of every answer that the extracted doses of its question's product don't allow; the same number in another unit passes."""
    docs = table(s, b, "documents", ["doc_id", "product"]).where("product IS NOT NULL")
    listed = table(s, b, "doses", ["dose_id", "doc_id", "display"]).dropDuplicates(["dose_id"]).join(docs, "doc_id")
    # The distinct doses of a product, however many rows state them.
    each = listed.select(F.lower("product").alias("p"), F.explode(A.doses_in(F.col("display"))).alias("dose")).distinct()
    allowed = each.groupBy("p").agg(F.collect_list("dose").alias("allowed"))
    asked = table(s, b, "entities", ["qid", "product"]).where("product IS NOT NULL").select("qid", F.lower(F.trim("product")).alias("p")).distinct()
    said = _answers(s, b).select("answer_id", "qid", "response").join(asked, "qid").join(allowed, "p")
    return said.select("answer_id", F.explode(A.invalid_doses(F.col("response"), F.col("allowed"))).alias("dose")).distinct()


_VAGUE_SQL = "(" + "+".join(f"contains(lower(response),'{v}')::INT" for v in D.VAGUE) + ")"
_UNITS_SQL = "(" + " OR ".join(f"contains(lower(response),'{u}')" for u in D.SPECIFIC_UNITS) + ")"


@query(f"WITH a AS (SELECT DISTINCT answer_id, response FROM answers WHERE response IS NOT NULL) SELECT answer_id, ({_VAGUE_SQL} >= 2 OR ({_VAGUE_SQL} >= 1 AND length(response) < 80)) AS vague, (regexp_matches(response,'[0-9]') OR {_UNITS_SQL}) AS specific FROM a")
def vague_response(s: SparkSession, b: str) -> DataFrame:
    """Vague answers and answers with specifics."""
    a = _answers(s, b).where("response IS NOT NULL")
    return a.select("answer_id", A.is_vague(F.col("response")).alias("vague"), A.has_specifics(F.col("response")).alias("specific"))


@query()
def parse_answer(s: SparkSession, b: str) -> DataFrame:
    """Answers written as model output and read back by the lenient parser."""
    raw = F.when(F.col("answer_id") % 3 == 0, F.col("response")).otherwise(
        F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("response").alias("resposta"), F.col("found").alias("encontrada_no_documento"), F.col("confidence").alias("confianca"))), F.lit("\n```"))
    )
    return _answers(s, b).select("answer_id", A.parse_answer(raw).alias("p")).select("answer_id", "p.resposta", "p.encontrada_no_documento", F.round("p.confianca", 4).alias("confianca"), "p.parse_ok")


_SCALED = "least(greatest(CASE WHEN confidence > 1 THEN confidence/100 ELSE confidence END, 0), 1)"


@query(f"""WITH a AS (SELECT DISTINCT answer_id, qid, response, coalesce(found,false) AS found, coalesce({_SCALED},0.5) AS conf, coalesce(parse_ok,false) AS ok FROM answers),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY answer_id) AS nth FROM a), f AS (SELECT * FROM r WHERE nth=1), g AS (SELECT * FROM r WHERE nth=2)
SELECT f.qid, f.answer_id AS first_id, (NOT f.ok OR {_strip_sql("coalesce(f.response,'')")}='' OR NOT f.found OR f.conf < 0.55) AS reprompt, CASE WHEN g.answer_id IS NOT NULL AND (NOT f.ok OR {_strip_sql("coalesce(f.response,'')")}='' OR NOT f.found OR f.conf < 0.55) AND g.conf >= f.conf AND g.found THEN g.answer_id ELSE f.answer_id END AS chosen_id FROM f LEFT JOIN g USING (qid)""")
def reprompt_choice(s: SparkSession, b: str) -> DataFrame:
    """Which of a question's first two answers stands, the second counting only where the first calls for another try."""
    conf = F.coalesce(F.expr(_SCALED), F.lit(0.5))
    a = _answers(s, b).select("answer_id", "qid", "response", F.coalesce("found", F.lit(False)).alias("found"), conf.alias("conf"), F.coalesce("parse_ok", F.lit(False)).alias("ok"))
    ranked = a.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("answer_id"))).where("nth <= 2")
    both = ranked.groupBy("qid").agg(F.max_by(F.struct("answer_id", "response", "found", "conf", "ok"), -F.col("nth")).alias("f"), F.max(F.when(F.col("nth") == 2, F.struct("answer_id", "found", "conf"))).alias("g"))
    again = A.needs_reprompt(F.col("f.ok"), F.col("f.response"), F.col("f.found"), F.col("f.conf"))
    wins = F.coalesce(again & A.second_wins(F.col("f.conf"), F.col("g.conf"), F.col("g.found")), F.lit(False))
    return both.select("qid", F.col("f.answer_id").alias("first_id"), again.alias("reprompt"), F.when(wins, F.col("g.answer_id")).otherwise(F.col("f.answer_id")).alias("chosen_id"))


@query(f"""WITH a AS (SELECT answer_id, any_value({_strip_sql("coalesce(response,'')")}) AS said, any_value(coalesce(sources,[])) AS src FROM answers GROUP BY 1),
e AS (SELECT *, list_filter(list_transform(src, lambda s: {_strip_sql("coalesce(s.excerpt,'')")}), lambda t: t <> '') AS ex FROM a)
SELECT answer_id, md5(CASE WHEN said <> '' THEN said WHEN len(ex) > 0 THEN 'Segundo o documento:'||chr(10)||chr(10)||array_to_string(list_transform(ex, lambda t: CASE WHEN length(t) <= 600 THEN t ELSE left(t,600)||'…' END), chr(10)||chr(10)) ELSE 'Não foi possível gerar resposta.' END
 || CASE WHEN len(src) > 0 THEN chr(10)||chr(10)||'Fontes (excertos):'||array_to_string(list_transform(src, lambda s: chr(10)||'- **'||CASE WHEN coalesce(s.section,'')='' THEN '(secção)' ELSE s.section END||'**'||CASE WHEN {_strip_sql("coalesce(s.excerpt,'')")} <> '' THEN ': '||CASE WHEN length({_strip_sql('s.excerpt')}) <= 250 THEN {_strip_sql('s.excerpt')} ELSE left({_strip_sql('s.excerpt')},250)||'…' END ELSE '' END), '') ELSE '' END) AS digest FROM e""")
def render_answer(s: SparkSession, b: str) -> DataFrame:
    """Digest of every answer as shown to a user."""
    none = F.expr("cast(array() as array<struct<section:string,excerpt:string>>)")
    return _answers(s, b).select("answer_id", F.md5(A.render(F.col("response"), F.coalesce("sources", none))).alias("digest"))


@query()
def prompts(s: SparkSession, b: str) -> DataFrame:
    """Prompts of the stated questions over their best chunks."""
    q = _asked(s, b)
    top = lexical.search(q, _chunks(s, b), "qid", "question", "chunk_id", "body", 3).join(_chunks(s, b), "chunk_id")
    ctx = top.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda r: r.body).alias("texts"))
    q = q.join(ctx, "qid", "left").withColumn("product", F.coalesce(E.product(F.col("question")), F.lit("")))
    return q.select("qid", A.prompt(F.col("question"), F.col("product"), E.find_species(F.col("question")), F.coalesce("texts", F.array().cast("array<string>"))).alias("prompt"))


# ---- catalogue ------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT qid, search_term AS term FROM entities WHERE search_term IS NOT NULL AND qid % 100 = 0), l AS (SELECT DISTINCT listing_id, trim(name) AS name FROM listings WHERE name IS NOT NULL),
w AS (SELECT qid, term, list_distinct(list_filter(string_split_regex(lower(term),'\\s+'), lambda w: length(w)>2)) AS ws FROM e),
x AS (SELECT qid, listing_id, name, ws FROM w, l WHERE len(list_filter(ws, lambda t: contains(lower(name), t))) > 0)
SELECT qid, listing_id, round(CASE WHEN len(ws)=0 THEN 0 ELSE len(list_filter(ws, lambda t: contains(lower(name), t)))::DOUBLE/len(ws) END, 4) AS overlap FROM x""")
def resolve_tokens(s: SparkSession, b: str) -> DataFrame:
    """Word overlap of search terms with the listings whose name holds one of their words; the SQL looks at all pairs."""
    e = table(s, b, "entities", ["qid", "search_term"]).where("search_term IS NOT NULL AND qid % 100 = 0").distinct().withColumnRenamed("search_term", "term")
    names = _listings(s, b).where("name IS NOT NULL").select("listing_id", F.trim("name").alias("name"))
    pairs = resolve.candidates(e, names, "qid", "term", "listing_id", "name").join(e, "qid").join(names, "listing_id")
    return pairs.select("qid", "listing_id", F.round(resolve.token_overlap(F.col("term"), F.col("name")), 4).alias("overlap"))


@query()
def resolve_entities(s: SparkSession, b: str) -> DataFrame:
    """Listings ranked for each stated question, with the gap to the next."""
    asked = pipeline.classified(_asked(s, b).withColumnRenamed("question", "text"))
    return pipeline.resolved(asked, _listings(s, b)).withColumn("score", F.round("score", 6)).withColumn("gap", F.round("gap", 6))


@query()
def substances_parse(s: SparkSession, b: str) -> DataFrame:
    """Substances read from the visible text of every listing."""
    return _listings(s, b).select("listing_id", F.posexplode(compare.substances_of(F.coalesce("visible_text", F.lit("")))).alias("n", "substance"))


def _reference_pairs(s: SparkSession, b: str) -> tuple[DataFrame, DataFrame]:
    rows = _listings(s, b).where("active IS NOT NULL AND trim(active) <> '' AND name IS NOT NULL").select("listing_id", F.trim("name").alias("name"), compare.base_name(F.col("active")).alias("substance"))
    return rows.select(F.col("listing_id").alias("ref_id"), F.col("name").alias("ref_name"), "substance"), rows


_ALT = """l AS (SELECT DISTINCT listing_id, trim(name) AS name, trim(regexp_replace(lower(active), '\\s*\\d+(?:[.,]\\d+)*\\s*(?:mg|ml|g|mcg|µg|ui|%)?(?:/\\pL+)?\\s*$', '')) AS substance FROM listings WHERE active IS NOT NULL AND trim(active) <> '' AND name IS NOT NULL),
p AS (SELECT a.listing_id AS ref_id, a.substance, b.listing_id, b.name FROM l a JOIN l b USING (substance) WHERE NOT contains(lower(b.name), lower(a.name)) AND a.listing_id <> b.listing_id)"""


@query(f"WITH {_ALT} SELECT * FROM (SELECT ref_id, substance, listing_id, row_number() OVER (PARTITION BY ref_id, substance ORDER BY listing_id) AS nth FROM p) WHERE nth <= 10")
def alternatives(s: SparkSession, b: str) -> DataFrame:
    """The first ten other products with the same active substance, for every listing."""
    return compare.alternatives(*_reference_pairs(s, b), per_substance=10).select("ref_id", "substance", "listing_id", "nth")


@query(f"WITH {_ALT} SELECT ref_id, count(DISTINCT substance) AS substances, count(*) AS total FROM p GROUP BY 1")
def alternative_counts(s: SparkSession, b: str) -> DataFrame:
    """How many alternatives every listing has."""
    return compare.counts(*_reference_pairs(s, b))


@query("""SELECT listing_id, md5('1. **'||coalesce(trim(name),'')||'**'||coalesce(chr(10)||'   - Espécies: '||nullif(species,''),'')||coalesce(chr(10)||'   - Forma: '||nullif(form,''),'')||coalesce(chr(10)||'   - Link: '||nullif(link,''),'')) AS digest
FROM (SELECT listing_id, any_value(name) AS name, any_value(species) AS species, any_value(form) AS form, any_value(link) AS link FROM listings GROUP BY 1)""")
def listing_text(s: SparkSession, b: str) -> DataFrame:
    """Digest of every listing as an item of a listing answer."""
    text = compare.item_text(F.lit(1), F.coalesce(F.trim("name"), F.lit("")), F.col("species"), F.col("form"), F.col("link"))
    return _listings(s, b).select("listing_id", F.md5(text).alias("digest"))


@query("""WITH l AS (SELECT DISTINCT listing_id, name FROM listings), d AS (SELECT listing_id, min(detail_id) AS detail_id, bool_or(conteudo_html IS NOT NULL AND trim(conteudo_html) <> '') AS has_html, max(pdf_url) AS pdf_url FROM details GROUP BY 1)
SELECT l.listing_id, coalesce(detail_id,-1) AS detail_id, coalesce(has_html,false) AS has_html, CASE WHEN pdf_url IS NOT NULL THEN 'pdf' WHEN has_html THEN 'html' ELSE 'listing' END AS best_source, md5(pdf_url)||'.pdf' AS pdf_file FROM l LEFT JOIN d USING (listing_id)""")
def listing_sources(s: SparkSession, b: str) -> DataFrame:
    """The fallback chain listing, page, PDF of every listing, with the content-addressed file name."""
    d = table(s, b, "details", ["detail_id", "listing_id", "conteudo_html", "pdf_url"])
    has = F.col("conteudo_html").isNotNull() & (F.trim(F.coalesce("conteudo_html", F.lit(""))) != "")
    d = d.groupBy("listing_id").agg(F.min("detail_id").alias("detail_id"), F.bool_or(has).alias("has_html"), F.max("pdf_url").alias("pdf_url"))
    j = table(s, b, "listings", ["listing_id"]).distinct().join(d, "listing_id", "left")
    best = F.when(F.col("pdf_url").isNotNull(), "pdf").when(F.col("has_html"), "html").otherwise("listing")
    return j.select("listing_id", F.coalesce("detail_id", F.lit(-1)).alias("detail_id"), F.coalesce("has_html", F.lit(False)).alias("has_html"), best.alias("best_source"), F.concat(F.md5("pdf_url"), F.lit(".pdf")).alias("pdf_file"))


@query()
def html_text(s: SparkSession, b: str) -> DataFrame:
    """Kept text and PDF link of every page."""
    pages = once_per_key(table(s, b, "details", ["detail_id", "link", "conteudo_html", "ingested_at"]), "detail_id")
    return html.page_texts(pages, "detail_id", "conteudo_html", "link")


@query()
def html_links(s: SparkSession, b: str) -> DataFrame:
    """Product links of every page, each name once."""
    pages = once_per_key(table(s, b, "details", ["detail_id", "link", "conteudo_html", "ingested_at"]), "detail_id")
    return html.parse_listings(pages, "detail_id", "conteudo_html", "link", "/m/").select("detail_id", "ord", "name", "link")


# ---- cache, sessions, reports ---------------------------------------------------------


@query(r"""SELECT qid, 'intent:'||sha1('["'||replace(replace(k,'\','\\'),'"','\"')||'"]') AS key FROM (SELECT DISTINCT qid, trim(regexp_replace(strip_accents(lower(text)), '[\s\x0b\x{00a0}]+', ' ', 'g')) AS k FROM questions WHERE text IS NOT NULL)""")
def cache_keys(s: SparkSession, b: str) -> DataFrame:
    """Cache key of every question; case, accents and blanks make no difference."""
    return _questions(s, b).where("text IS NOT NULL").select("qid", cache_key("intent", F.col("text")).alias("key"))


@query("SELECT strip_key AS key, count(*) AS n FROM (SELECT trim(regexp_replace(strip_accents(lower(text)), '[\\s\\x0b\\x{00a0}]+', ' ', 'g')) AS strip_key FROM (SELECT DISTINCT qid, text FROM questions WHERE text IS NOT NULL)) GROUP BY 1 HAVING count(*) > 1")
def repeated_questions(s: SparkSession, b: str) -> DataFrame:
    """Questions asked more than once under the cache's normal form."""
    return _questions(s, b).where("text IS NOT NULL").groupBy(squeeze(F.col("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + to_seconds((event_id % 20) * 86400) END AS expires_at FROM events) WHERE expires_at IS NULL OR TIMESTAMP '2024-01-15 00:00:00' <= expires_at")
def cache_ttl(s: SparkSession, b: str) -> DataFrame:
    """Entries still valid at a moment; those without expiry always are."""
    e = _events(s, b).withColumn("expires_at", F.when(F.col("event_id") % 5 != 0, F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 20) * 86_400_000_000)))
    return cachestore.valid(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "user_id")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS hits, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS misses")
def cache_split(s: SparkSession, b: str) -> DataFrame:
    """Documents with and without a stored vector."""
    docs, known = table(s, b, "documents", ["doc_id"]), table(s, b, "embeddings", ["vec_id"]).withColumnRenamed("vec_id", "doc_id")
    hits, misses = cachestore.split(docs, known, "doc_id")
    return hits.agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")), F.lit(True))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def cache_latest(s: SparkSession, b: str) -> DataFrame:
    """The last stored entry of every key."""
    return cachestore.latest(_events(s, b).select("user_id", "event_id", "ts"), ["user_id"], "ts").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH t AS (SELECT session_id, seq, any_value(qid) AS qid, any_value(text) AS text FROM (SELECT DISTINCT qid, session_id, seq, text FROM questions WHERE session_id IS NOT NULL) GROUP BY qid, session_id, seq),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, qid DESC) AS back FROM t) SELECT session_id, qid, back, CASE WHEN length(text) > 200 THEN left(text,200)||'...' ELSE text END AS text FROM r WHERE back <= 8""")
def session_history(s: SparkSession, b: str) -> DataFrame:
    """The last eight turns of every session."""
    t = _questions(s, b).where("session_id IS NOT NULL").select("session_id", "seq", "qid", "text")
    return sessions.last_turns(t, "session_id", ["seq", "qid"], "text").select("session_id", "qid", "back", "text")


_GAP = "g AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS f FROM events), h AS (SELECT *, 1+sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)"


@query(f"WITH {_GAP} SELECT event_id, user_id, session_no::BIGINT AS session_no FROM h")
def session_gap(s: SparkSession, b: str) -> DataFrame:
    """Session number of every event; an hour without one ends a session."""
    return sessions.gap_sessions(_events(s, b), "user_id", "ts", "event_id").select("event_id", "user_id", "session_no")


@query(f"WITH {_GAP}, k AS (SELECT user_id, session_no, count(*) AS n FROM h GROUP BY 1,2) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest_session FROM k GROUP BY 1")
def session_counts(s: SparkSession, b: str) -> DataFrame:
    """Sessions and events of every user."""
    return sessions.longest_gap_history(_events(s, b), "user_id", "ts", "event_id")


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000000 THEN 1 ELSE 0 END AS f FROM events), h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts)+INTERVAL 1 HOUR AS session_end, count(*) AS n FROM h GROUP BY user_id, k")
def session_window_agg(s: SparkSession, b: str) -> DataFrame:
    """Session windows of every user (the batch form of the stream)."""
    out = streaming.session_windows(_events(s, b), "ts", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def tumbling_agg(s: SparkSession, b: str) -> DataFrame:
    """Events by hour and type (the batch form of the stream)."""
    out = streaming.tumbling(_events(s, b), "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type AS step, round(sum(value),4) AS seconds, round(sum(value)/(SELECT sum(value) FROM events),6) AS share, row_number() OVER (ORDER BY sum(value) DESC, event_type) AS place FROM events GROUP BY 1")
def step_timings(s: SparkSession, b: str) -> DataFrame:
    """Summed durations by step with their share."""
    out = reports.step_report(table(s, b, "events", ["event_type", "value"]), "event_type", "value")
    return out.select(F.col("event_type").alias("step"), F.round("seconds", 4).alias("seconds"), F.round("share", 6).alias("share"), "place")


@query("WITH a AS (SELECT DISTINCT answer_id, model, coalesce(parse_ok,false) AS ok, length(coalesce(response,''))::DOUBLE AS sec FROM answers) SELECT model, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, round(coalesce(avg(sec) FILTER (WHERE ok),0),4) AS mean_seconds, round(coalesce(sum(sec) FILTER (WHERE ok),0),4) AS total_seconds FROM a GROUP BY 1")
def run_summary(s: SparkSession, b: str) -> DataFrame:
    """Successes, failures and mean per model; the length of the response stands for the seconds."""
    a = _answers(s, b).select("model", F.coalesce("parse_ok", F.lit(False)).alias("ok"), F.length(F.coalesce("response", F.lit(""))).cast("double").alias("sec"))
    out = reports.run_summary(a, ["model"], "ok", "sec")
    return out.select("model", "n_ok", "n_failed", F.round("mean_seconds", 4).alias("mean_seconds"), F.round("total_seconds", 4).alias("total_seconds"))


@query("SELECT event_id, 'data: {\"type\":\"'||event_type||'\",\"seq\":'||row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)||'}'||chr(10)||chr(10) AS frame FROM events")
def event_frames(s: SparkSession, b: str) -> DataFrame:
    """Server-sent frames of every user's events, numbered."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(s, b).select("event_id", sinks.frame(F.struct(F.col("event_type").alias("type"), seq.alias("seq"))).alias("frame"))


@query()
def rag_answer(s: SparkSession, b: str) -> DataFrame:
    """The whole plan for every question; one without text is a blank one."""
    return pipeline.rag_answer(s, b, _questions(s, b).select("qid", F.coalesce("text", F.lit("")).alias("text")))


