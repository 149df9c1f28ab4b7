"""The whole question-answering plan, set at a time: a question is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bulaforge.functions import answers as A
from bulaforge.functions import entities as E
from bulaforge.functions import language
from bulaforge.functions.dimensions import SPECIES
from bulaforge.functions.text import cache_key
from bulaforge.operators import compare, doses, fusion, resolve
from bulaforge.operators import scoped as scoped_search
from bulaforge.session import cut
from bulaforge.sources.tables import once_per_key, table

TOP_K, BUDGET, LISTINGS = 8, 30_000, 10
#: Name of the answer backend, part of the response cache's key.
MODEL = "extractive"
NOTHING_FOUND = "Não foram encontrados resultados para a tua pergunta."


def classified(questions: DataFrame) -> DataFrame:
    """questions(qid, text) → with normalised text, entities, category, confidence and via; column expressions only."""
    q = questions.withColumn("asked", E.normalize_species(F.col("text"))).withColumn("e", E.entities(F.col("asked")))
    category, confidence, via = E.category(F.col("asked"), F.col("e.product"))
    return q.withColumn("category", category).withColumn("class_confidence", confidence).withColumn("via", via)


def resolved(asked: DataFrame, listings: DataFrame, k: int = LISTINGS) -> DataFrame:
    """(qid, listing_id, name, link, score, rank, gap, ambiguous): the k listings that fit each question's search term best, in order.

    Terms and names are compared once each. A name stays only if its best possible score reaches the least one of names with
    enough listings; of a name's listings with equal score for an entity the first ones stand."""
    keep = k + 1  # the gap of the last one is that to the next
    e = asked.select("qid", F.col("e.search_term").alias("term"), F.col("e.species").alias("q_species"), F.col("e.substance").alias("q_substance"))
    e = cut(e.withColumn("entity", F.min("qid").over(Window.partitionBy("q_species", "q_substance"))))
    names = listings.groupBy("name").agg(F.count("*").alias("n"))
    near = resolve.candidates(e.select("term").distinct(), names, "term", "term", "name", "name").join(names, "name")
    near = near.withColumn("name_sim", resolve.similarity(F.col("term"), F.col("name"))).withColumn("overlap", resolve.token_overlap(F.col("term"), F.col("name")))
    near = near.withColumn("least", resolve.total(F.col("name_sim"), F.col("overlap"), F.lit(False), F.lit(False))).withColumn("most", resolve.total(F.col("name_sim"), F.col("overlap"), F.lit(True), F.lit(True)))
    w = Window.partitionBy("term")
    near = near.withColumn("better", F.sum("n").over(w.orderBy(F.desc("least"), "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    near = near.withColumn("floor", F.when(F.sum("n").over(w) >= keep, F.min(F.when(F.col("better") < keep, F.col("least"))).over(w)))
    # The margin covers the rounding of scores.
    near = cut(near.where("floor IS NULL OR most >= floor - 1e-6").select("term", "name", "name_sim", "overlap"))
    wanted = e.join(near, "term").select("entity", "q_species", "q_substance", "name").distinct()
    met = wanted.join(listings.select("name", "listing_id", "species", "substances"), "name").select(
        "entity", "name", "listing_id", resolve.species_matches(F.col("q_species"), F.col("species")).alias("species_hit"), resolve.substance_matches(F.col("q_substance"), F.col("substances")).alias("substance_hit")
    )
    nth = F.row_number().over(Window.partitionBy("entity", "name", "species_hit", "substance_hit").orderBy("listing_id"))
    first = met.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")
    asks = e.groupBy("term", "entity").agg(F.min("qid").alias("ask"))
    rows = asks.join(near, "term").join(first, ["entity", "name"])
    hits = resolve.rank(rows, "ask", "listing_id", F.col("name_sim"), F.col("overlap"), F.col("species_hit"), F.col("substance_hit")).where(F.col("rank") <= k)
    hits = hits.select("term", "entity", "listing_id", "score", "rank", "gap", "ambiguous").join(listings.select("listing_id", "name", "link"), "listing_id")
    return e.select("qid", "term", "entity").join(hits, ["term", "entity"]).select("qid", "listing_id", "name", "link", "score", "rank", "gap", "ambiguous")


def rag_answer(spark: SparkSession, base: str, questions: DataFrame) -> DataFrame:
    """(qid, category, via, product, topic, species, confidence, n_chunks, cache_key, invalid_doses, language_ok, response) of every question.

    A comparison is answered from the products of the same substances.

    The answer backend is extractive: the best chunk's opening stands for the model's answer, and the
    dose path answers from extracted doses. A model can replace it by a mapInPandas over `prompt`."""
    listings = once_per_key(table(spark, base, "listings", ["listing_id", "name", "link", "species", "form", "substances", "ingested_at"]), "listing_id").withColumn("name", F.trim("name"))
    chunks = table(spark, base, "chunks", ["chunk_id", "chunk_ord", "product", "section_num", "section_title", "is_table", "text"])
    # Read by many branches below: written once, so that the extraction runs once.
    listings = cut(listings)
    asked = cut(classified(spread(questions)))
    # Of the listings the best and two others are named.
    found = cut(resolved(asked, listings, 3))
    best = found.where("rank = 1").select("qid", "listing_id", F.col("name").alias("found_name"), "link", "ambiguous")
    others = found.where("rank IN (2, 3)").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("others"))
    scoped = asked.select("qid", "asked", F.col("e.topic").alias("topic")).join(best, "qid")
    searches, top = scoped_search.ranked(scoped.select("qid", "asked", "topic", F.lower("found_name").alias("p")), chunks, TOP_K)
    context = searches.join(contexts(fusion.counted(top, "search", "rank", "chars", BUDGET), chunks), "search").drop("search")
    rows = asked.join(best, "qid", "left").join(others, "qid", "left").join(context, "qid", "left")
    none = F.array().cast("array<string>")
    # Doses count only where their context or section names the species asked about.
    guarded = F.filter("doses", lambda d: F.col("e.species").isNull() | F.array_contains(d["species"], F.col("e.species")))
    listed = F.coalesce(F.array_distinct(F.transform(guarded, lambda d: d["display"])), none)
    by_dose = (F.col("e.topic") == "dose") & (F.size(listed) > 0)
    compared = comparisons(asked, found, listings)
    rows = rows.join(compared, "qid", "left")
    text = F.when(F.col("comparison").isNotNull(), F.col("comparison")).when(F.col("n_chunks").isNull(), NOTHING_FOUND).when(by_dose, A.dose_answer(F.col("found_name"), F.col("e.species"), listed)).otherwise(F.col("opening"))
    foot = F.when(F.col("comparison").isNull() & F.col("n_chunks").isNotNull(), A.provenance(F.col("found_name"), F.col("link"), F.when(F.col("ambiguous"), F.coalesce("others", none)).otherwise(none))).otherwise("")
    confidence = F.when(F.col("comparison").isNotNull(), 0.8).when(F.col("n_chunks").isNull(), 0.1).when(by_dose, 0.85).otherwise(0.6)
    # The model is part of the key: another model's answers are others.
    key = cache_key("response", F.lit(MODEL), F.col("asked"), F.coalesce("e.search_term", F.lit("")), F.col("e.topic"), F.coalesce("e.species", F.lit("")))
    return rows.select(
        "qid", "category", "via", F.col("e.product").alias("product"), F.col("e.topic").alias("topic"), F.col("e.species").alias("species"),
        confidence.alias("confidence"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), key.alias("cache_key"),
        A.invalid_doses(text, F.flatten(F.transform(listed, A.doses_in))).alias("invalid_doses"), language.guard(text)[0].alias("language_ok"), F.concat(text, foot).alias("response"),
    )


def spread(questions: DataFrame) -> DataFrame:
    """The questions over all tasks: their rows are few bytes and much work."""
    return questions.repartition(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")


def contexts(fit: DataFrame, chunks: DataFrame) -> DataFrame:
    """fit(search, rank, chunk_id, h) → (search, n_chunks, opening, doses): the number of a search's chunks, the first one's opening, and all mentions
    of doses in order with the species that each names. Openings and mentions are taken once a chunk, whatever the number of its searches."""
    read = chunks.where("text IS NOT NULL").select(scoped_search.row_hash().alias("th"), F.col("chunk_id").alias("tid"), "text")
    named = F.filter(F.array(*[F.lit(s) for s, _ in SPECIES]), lambda s: doses.names(s))
    each = doses.mentions(read.where(F.col("text").rlike(doses.MENTION)).dropDuplicates(["th", "tid"]), ["th", "tid"], [], "text").select("th", "tid", "i_", "display", named.alias("species"))
    said = each.groupBy("th", "tid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i_", "display", "species"))), lambda m: F.struct(m["display"].alias("display"), m["species"].alias("species"))).alias("doses"))

    def same(h: str, key: str) -> Column:
        return (F.col(h) == F.col("th")) & F.col(key).eqNullSafe(F.col("tid"))

    rows = fit.join(said, same("h", "chunk_id"), "left")
    inside = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doses"))), lambda m: m["doses"]), lambda d: d.isNotNull())
    first = F.min_by(F.struct("h", "chunk_id"), "rank").alias("first")
    made = cut(rows.groupBy("search").agg(F.count("*").alias("n_chunks"), first, F.flatten(inside).alias("doses")).select("search", "n_chunks", "doses", "first.h", "first.chunk_id"))
    extract = F.regexp_extract("text", r"(?s)^\s*(.{1,400}?[.!?](?=\s|$)|.{1,400})", 1)
    openings = scoped_search.keep_rows(read.select("th", "tid", extract.alias("opening")), "th", scoped_search.key_filter(made, "h"))
    return made.join(openings.dropDuplicates(["th", "tid"]), same("h", "chunk_id")).select("search", "n_chunks", "opening", "doses")


def comparisons(asked: DataFrame, found: DataFrame, listings: DataFrame) -> DataFrame:
    """(qid, comparison): the answers to the questions that compare products.

    The substances of the best listing are joined by equality with the substances of all listings; per question and
    substance the first LISTINGS products stay whose names don't contain the product's."""
    wanted = asked.where("category = 'comparacao'").select("qid", F.col("e.product").alias("ref"), F.col("e.species").alias("species"), E.alternative_kind(F.col("asked")).alias("kind"))
    each = listings.select("listing_id", "name", F.explode(F.filter("substances", lambda x: F.trim(x) != "")).alias("s")).withColumn("s", compare.base_name(F.col("s")))
    own = cut(wanted.join(found.where("rank = 1").select("qid", "listing_id"), "qid").join(each.select("listing_id", "s"), "listing_id").select("qid", "ref", "s").distinct())
    listed = each.where("name IS NOT NULL").select("listing_id", "name", F.col("s").alias("substance")).join(own.select(F.col("s").alias("substance")).distinct(), "substance", "left_semi")
    first = compare.alternatives(own.select(F.col("qid").alias("ref_id"), F.lower("ref").alias("ref_name"), F.col("s").alias("substance")), cut(listed.distinct()), LISTINGS)
    first = first.withColumnsRenamed({"ref_id": "qid", "substance": "s"}).join(listings.select("listing_id", "name", F.col("species").alias("l_species"), "form", "link"), "listing_id")
    items = first.groupBy("qid", "s").agg(F.sort_array(F.collect_list(F.struct("nth", "name", F.col("l_species").alias("species"), "form", "link"))).alias("items"))
    none = F.expr("cast(array() as array<struct<nth:int,name:string,species:string,form:string,link:string>>)")
    per = own.join(items, ["qid", "s"], "left").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("substance"), F.coalesce("items", none).alias("items")))).alias("per"))
    known = found.where("rank = 1").select("qid", F.lit(True).alias("known"))
    rows = wanted.join(known, "qid", "left").join(per, "qid", "left")
    return rows.select("qid", compare.answer_text(F.col("ref"), F.col("kind"), F.col("species"), F.col("known"), F.coalesce("per", F.expr("cast(array() as array<struct<substance:string,items:array<struct<nth:int,name:string,species:string,form:string,link:string>>>>)"))).alias("comparison"))
