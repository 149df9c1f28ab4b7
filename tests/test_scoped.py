import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bulaforge.functions.dimensions import TOPIC_WORDS, TOPICS
from bulaforge.functions.text import ACCENTED, DROPPED, PLAIN
from bulaforge.operators import resolve, scoped
from bulaforge.plans import pipeline

CHUNK = "chunk_id string, chunk_ord bigint, product string, section_num string, section_title string, is_table boolean, text string"
LISTING = "listing_id bigint, name string, link string, species string, form string, substances array<string>, ingested_at timestamp"


def plain_tokens(text):
    folded = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return [t for t in re.findall("[a-z0-9]+", folded) if len(t) >= 3 and t not in DROPPED]


def plain_search(asked, topic, product, chunks, k):
    """Tier, statistics and order of one question by loops."""
    own = sorted((c for c in {c[0]: c for c in chunks}.values() if c[2] and c[2].lower() == product and c[6] is not None), key=lambda c: (c[1], c[0]))
    targets = next(([s.rstrip(".") for s in secs] for name, _, secs in TOPICS if name == topic), [])
    one = [c for c in own if any((c[3] or "").startswith(t) for t in targets)]
    two = [c for c in own if any(w in f"{c[4] or ''} {c[6]}".lower() for w in TOPIC_WORDS.get(topic, []))]
    scope = one or two[:6] or own
    words = {c[0]: plain_tokens(" ".join(x for x in (c[4], c[6]) if x is not None)) for c in scope}
    mean = sum(map(len, words.values())) / max(1, len(scope))

    def score(c):
        total = 0.0
        for term in plain_tokens(asked):
            df, tf = sum(term in w for w in words.values()), words[c[0]].count(term)
            total += math.log((len(scope) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(words[c[0]])) / max(1, mean)))
        return round(total, 9)

    return [c[0] for c in sorted(scope, key=lambda c: -score(c))[:k]]


def some_chunks():
    out = []
    for i in range(90):
        product = ["Zirovet", "ZIROVET", "Lumigard", None][i % 4]
        number, title = [("4.9", "Dose"), ("4.10", "Outra"), ("6.4", None), ("", "Conservação"), (None, "Geral")][i % 5]
        text = None if i == 7 else "" if i == 9 else f"A dose diária {'dose ' * (i % 3)}do Zirovet e o prazo de validade {i % 6} dias {'frasco ' * (i % 4)}"
        out.append((f"c{i:03d}", 200 - 2 * i if i % 3 else i, product, number if product != "Lumigard" else "9.9", title, i % 9 == 0, text))
    return out + out[:20]


@pytest.mark.parametrize("block", [5, 20_000])
def test_scoped_search_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(scoped, "BLOCK", block)
    chunks = some_chunks()
    questions = [
        (i, text, topic, product)
        for i, (text, topic, product) in enumerate(
            (text, topic, product)
            for product in ("zirovet", "lumigard", "unknown", None)
            for topic in ("dose", "armazenamento", "geral", "especies", "receita")
            for text in ("Qual a dose do Zirovet, dose diária?", "Que prazo de validade tem o frasco", "o a de ?", "Que prazo de validade tem o frasco?")
        )
    ]
    which, best = scoped.search(spark.createDataFrame(questions, "qid bigint, asked string, topic string, p string"), spark.createDataFrame(chunks, CHUNK), 4)
    got: dict[int, list] = {}
    for r in which.join(best, "search").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rank, r.chunk_id, r.text))
    text_of = {c[0]: c[6] for c in chunks}
    for qid, asked, topic, product in questions:
        want = plain_search(asked, topic, product, chunks, 4) if product else []
        assert got.get(qid, []) == [(n, c, text_of[c]) for n, c in enumerate(want, 1)], (asked, topic, product)
    # Equal words, topic and product are one search.
    assert best.select("search").distinct().count() == 2 * 5 * 3


def some_listings():
    species = ["Cães e Gatos", "bovinos", None, "GATOS"]
    names = ["Zirovet 50 mg", "Zirovet", "zirovet", "Zirovax 50 mg", "Outrovet", None, "Prozirovet forte"]
    return [(i, names[i % 7], f"l/{i}", species[i % 4], "po", [["Zirovet base"], ["amoxi 5 mg", None], [], None][(i // 4) % 4], None) for i in range(1, 200)]


def test_resolved_against_all_pairs(spark):
    texts = ["Qual a dose do Zirovet 50 mg em gatos?", "Qual a dose do Zirovet em gatos?", "Dose do Zirovet", "alternativa ao Outrovet", "quanto custa", "Qual a dose do Zirovet em gatos?"]
    asked = pipeline.classified(spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string"))
    listings = spark.createDataFrame(some_listings(), LISTING)
    e = asked.select("qid", F.col("e.search_term").alias("term"), F.col("e.species").alias("s"), F.col("e.substance").alias("u"))
    near = resolve.candidates(e, listings, "qid", "term", "listing_id", "name").join(e, "qid").join(listings, "listing_id")
    near = near.withColumn("sim", resolve.similarity(F.col("term"), F.col("name"))).withColumn("ov", resolve.token_overlap(F.col("term"), F.col("name")))
    want = resolve.rank(near, "qid", "listing_id", F.col("sim"), F.col("ov"), resolve.species_matches(F.col("s"), F.col("species")), resolve.substance_matches(F.col("u"), F.col("substances")))
    columns = ["qid", "rank", "listing_id", "name", "link", F.round("score", 9).alias("score"), F.round("gap", 9).alias("gap"), "ambiguous"]
    got = pipeline.resolved(asked, listings).select(*columns)
    assert sorted(got.collect()) == sorted(want.where(F.col("rank") <= pipeline.LISTINGS).select(*columns).collect()) and got.count() > 30


def test_every_question_is_answered(spark, tmp_path):
    base = str(tmp_path)
    texts = ["Qual a dose de Zirovet em gatos?", "Qual a dose de Zirovet em porcos?", "Que validade tem o Lumigard?", "", None, "Qual a dose de Zirovet em gatos?"]
    rows = [(i, None, 1, text, None) for i, text in enumerate(texts, 1)] + [(100, None, 1, "Dose do Zirovet", None)]
    spark.createDataFrame(rows + rows[:2], "qid bigint, session_id string, seq int, text string, ingested_at timestamp").write.parquet(f"{base}/questions.parquet")
    chunks = [
        ("c1", 1, "Zirovet", "4.9", "Posologia", False, "A dose em gatos é de 5 mg/kg. Ver quadro."),
        ("c2", 2, "zirovet", "4.9", "Posologia", False, f"A dose em suínos é de 7,5 mg/kg. {'x ' * 90}Ou ainda 9 mg/kg. Fim da dose."),
        ("c3", 3, "Lumigard", "", "", False, "Tem validade de dois anos. Conservar."),
    ]
    spark.createDataFrame(chunks + chunks[:1], CHUNK).write.parquet(f"{base}/chunks.parquet")
    spark.createDataFrame([(i, n, f"l/{i}", "gatos", "po", ["amoxi"], None) for i, n in enumerate(["Zirovet", "Lumigard", "Zirovet"])], LISTING).write.parquet(f"{base}/listings.parquet")
    got = {r.qid: r for r in entry.queries()["rag_answer"](spark, base).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 100]
    assert [got[i].n_chunks for i in (1, 2, 3, 4, 5, 6, 100)] == [2, 2, 1, 0, 0, 2, 2]
    assert ", para gatos, a dose indicada é 5 mg/kg." in got[1].response and got[1].response == got[6].response
    assert ", para suínos, as doses indicadas são:\n- 7.5 mg/kg\n- 9 mg/kg" in got[2].response
    assert got[3].response.startswith("Tem validade de dois anos.\n") and got[4].response == got[5].response == pipeline.NOTHING_FOUND
    assert all(f"- {d} mg/kg" in got[100].response for d in ("5", "7.5", "9"))


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_row_per_question_and_row_of_its_product(spark, tmp_path):
    """Questions and rows of one product: fewer rows are shuffled than there are pairs of them."""
    asks, rows = 150, 600
    base = str(tmp_path)
    chunks = [(f"c{i:04d}", i, "Zirovet", "", "", False, f"Texto {i} do Zirovet com palavra{i % 50}.") for i in range(rows)]
    spark.createDataFrame(chunks, CHUNK).write.parquet(f"{base}/chunks.parquet")
    spark.createDataFrame([(i, "Zirovet", f"l/{i}", "gatos", "po", ["amoxi"], None) for i in range(rows)], LISTING).write.parquet(f"{base}/listings.parquet")
    questions = spark.createDataFrame([(100 * i, f"Que palavra{i} do Zirovet?") for i in range(asks)], "qid bigint, text string")
    before = shuffled_rows(spark)
    got = pipeline.rag_answer(spark, base, questions).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(got) == asks and all(r.n_chunks == 8 for r in got)
    assert all(f"palavra{r_id}." in r.response for r in got if (r_id := r.qid // 100) < 50)
    assert shuffled_rows(spark) - before < asks * rows / 2
