import json
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from bulaforge.functions import answers as A
from bulaforge.functions import entities as E
from bulaforge.functions import language
from bulaforge.functions.text import cache_key, tokens
from bulaforge.operators import cachestore, chunking, compare, dense, doses, fusion, layout, lexical, reports, resolve, sections, sessions
from bulaforge.sources import html, sinks
from bulaforge.sources.questions import questions
from bulaforge.sources.tables import once_per_key
from bulaforge.streaming import sessions as streaming
from bulaforge.streaming.turns import Standing, follow


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, tokens(F.col("t")), t="A Dose de Água, para OS cães 15 mg") == ["dose", "agua", "caes"]
    assert one(spark, tokens(F.col("t")), t=None) == []
    a, b = (one(spark, cache_key("intent", F.col("t")), t=t) for t in ("Qual a  DOSE?", "qual a dose? "))
    assert a == b and a.startswith("intent:") and len(a) == 47


@pytest.mark.parametrize(
    ("text", "want"),
    [("O medicamento deve ser guardado em local seco para os animais", "portugues"), ("The document and the dose should follow with this", "ingles"), ("el perro según la información de los animales debe", "espanhol"), ("药品", "cjk"), ("", "indefinido"), ("  ", "indefinido"), ("Via oral", "portugues")],
)
def test_language(spark, text, want):
    assert one(spark, language.detect(F.col("t")), t=text) == want


def test_entities(spark):
    asked = "Qual a dose do medicamento Zirovet 50 mg para vacas?"
    e = one(spark, E.entities(E.normalize_species(F.col("t"))), t=asked)
    assert (e.product, e.species, e.topic) == ("Zirovet 50", "bovinos", "dose")
    assert one(spark, E.find_species(F.col("t")), t="os felinos e as porcas e um porco") == "suínos"
    assert one(spark, E.topic(F.col("t")), t="Para que espécies está indicado o Xyz") == "indicacao"
    assert one(spark, E.form(F.col("t")), t="quanto tempo") == "Po"
    assert one(spark, E.alternative_of(F.col("t")), t="Há alternativas ao Zirovet para cães?") == "Zirovet"
    assert one(spark, E.product(F.col("t")), t="como se guarda isto") is None


def test_categories_and_follow_up(spark):
    for text, want in (("Que medicamentos existem para cães", "comparacao"), ("Que medicamento é o Zirovet similar", "medicamento"), ("Qual a dose do Zirovet", "medicamento"), ("alternativa ao Zirovet", "comparacao")):
        assert one(spark, E.category(F.col("t"), E.product(F.col("t")))[0], t=text) == want
    f = E.follow_up(F.col("q"), F.col("lq"), F.col("p"), F.col("tp"))
    assert one(spark, f, q="E para gatos?", lq="Qual a dose do Zirovet em cães?", p="Zirovet", tp="dose") == "Qual a dose do Zirovet para gatos?"
    assert one(spark, f, q="e a composição?", lq="Qual a dose do Zirovet?", p="Zirovet", tp="dose") == "Qual a composição do Zirovet?"
    assert one(spark, f, q="E para gatos?", lq=None, p=None, tp=None) is None
    turns = ["Qual a dose do Zirovet em cães?", "E para gatos?", "e a composição?", "  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, t string").select("i", E.turn_features(F.col("t")).alias("f")).orderBy("i").collect()
    state, made = Standing(), []
    for r in rows:
        state, rewritten = follow(state, r["f"].asDict())
        made.append(rewritten)
    assert made == [None, "Qual a dose do Zirovet para gatos?", "Qual a composição do Zirovet?", None] and (state.product, state.topic, state.seen) == ("Zirovet", "composicao", 3)


def test_stream_and_batch_read_a_named_product_alike(spark):
    text = "Posso dar o medicamento Zirovet a gatos?"
    assert one(spark, E.turn_features(F.col("t")), t=text)["product"] == one(spark, E.product(F.col("t")), t=text) == "Zirovet"


def test_bm25_ties_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "gato gato cão"), (2, "gato cão"), (3, "gato cão"), (4, None), (5, "")], "k int, body string")
    ask = spark.createDataFrame([(1, "gato"), (2, "o a"), (3, "gato gato"), (4, None)], "q int, t string")
    got = lexical.search(ask, docs, "q", "t", "k", "body", 3).collect()
    by = {q: [r["k"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] for q in (1, 2, 3, 4)}
    assert by[1] == by[3] == [1, 2, 3] and by[2] == by[4] == [1, 2, 3]
    score = {(r["q"], r["k"]): r["score"] for r in got}
    assert score[(3, 1)] == pytest.approx(2 * score[(1, 1)]) and score[(2, 1)] == 0
    assert lexical.search(ask, docs.limit(0), "q", "t", "k", "body", 3).count() == 0


def test_dense_threshold_zero_vector(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 0.0], 1), (4, [1.0, 0.0], 1)], "k int, v array<double>, label int")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q_id int, q array<double>")
    assert [r["k"] for r in dense.search(q, v, "q_id", "k").orderBy("rank").collect()] == [1, 4]
    assert [r["k"] for r in dense.search(q, v, "q_id", "k", where=F.col("label") == 1).collect()] == [4]
    assert dense.search(q, v, "q_id", "k", least=None).count() == 4


def test_fusion_and_budget(spark):
    lex = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2), (2, "c", 5.0, 1)], "q int, k string, score double, rank int")
    den = spark.createDataFrame([(1, "b", 0.9, 1), (3, "d", 0.8, 1)], "q int, k string, score double, rank int")
    got = {(r["q"], r["k"]): r for r in fusion.fuse(lex, den, "q", "k").collect()}
    assert got[(1, "b")]["rank"] == 1 and got[(1, "b")]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert (got[(2, "c")]["score_kind"], got[(2, "c")]["score"]) == ("bm25", 5.0) and got[(3, "d")]["score_kind"] == "cosine"
    assert [r["k"] for r in fusion.expand(lex, den, "q", "k").where("q=1").orderBy("ord").collect()] == ["a", "b"]
    for rest, kept in ((200, 1), (201, 2)):
        t = spark.createDataFrame([(1, 1, "x" * (1000 - rest)), (1, 2, "y" * 500), (1, 3, "z")], "q int, o int, t string")
        rows = fusion.within_budget(t, "q", "o", "t", 1000).orderBy("o").collect()
        assert len(rows) == kept and sum(len(r["t"]) for r in rows) <= 1000


def test_section_tiers(spark):
    rows = [(1, 1, "4.1", "", ""), (1, 2, "4.10", "", ""), (1, 3, "5", "", ""), (2, 1, "9", "Espécies", ""), (2, 2, "8", "", ""), (3, 1, None, None, None)]
    df = spark.createDataFrame(rows, "d int, o int, n string, t string, b string").withColumn("topic", F.lit("especies"))
    got = {(r["d"], r["o"]): r["tier"] for r in sections.tiered(df, ["d"], "o", "topic", "n", "t", "b").collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 2, (3, 1): 3}
    assert {(r["d"], r["o"]) for r in sections.tiered(df, ["d"], "o", "topic", "n", "t", "b", exact=True).where("d=1").collect()} == {(1, 1)}


def test_sections_and_tables(spark):
    text = "prefácio\n4.1 Espécies\ncorpo um\n4.2. Indicações\ncorpo [Tabela página 3]\na | b\n[/Tabela] fim\n15 mg dia\nresto"
    df = spark.createDataFrame([(1, text), (2, "sem cabeçalho"), (3, None), (4, "")], "d int, t string")
    got = chunking.sections(df, "d", "t").collect()
    assert [(r["number"], r["title"]) for r in got if r["d"] == 1] == [("4.1", "Espécies"), ("4.2", "Indicações"), ("15", "mg dia")]
    assert [r["body"] for r in got if r["d"] == 2] == ["sem cabeçalho"] and [r["body"] for r in got if r["d"] > 2] == ["", ""]
    assert [r["number"] for r in chunking.sections(df, "d", "t", strict=True).where("d=1").collect()] == ["4.2"]
    assert chunking.sections(df, "d", "t", keep_preface=True).where("d=1").first()["body"] == "prefácio"
    made = chunking.chunks(chunking.sections(df, "d", "t"), ["d"], "number", "title", "body")
    tab = made.where("is_table").collect()
    assert [(r["page"], r["text"], r["paragraph_idx"]) for r in tab] == [(3, "a | b", -1)]
    assert one(spark, F.size(chunking.tables_of(F.col("t"))), t="[Tabela página 1]\naberta") == 1


def pack_plain(parts, target=1400, overlap=320, tiny=160):
    out, cur = [], ""
    for p in parts:
        if not cur:
            cur = p
        elif len(cur) + len(p) + 1 <= target:
            cur += "\n\n" + p
        else:
            out.append(cur)
            cur = (cur[-overlap:] + "\n\n" + p).strip()
    out += [cur] if cur else []
    made = out[:1]
    for c in out[1:]:
        if len(c) < tiny:
            made[-1] += "\n\n" + c
        else:
            made.append(c)
    return made


def test_packing_against_a_plain_loop(spark):
    rng = random.Random(2)
    cases = [[("p%d " % k + "w" * rng.choice([5, 100, 700, 1390, 1999, 2000]))[: rng.randrange(3, 2001)].strip() or "x" for k in range(rng.randrange(9))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ps array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", chunking.packed(F.col("ps")).alias("x")).collect()}
    assert [got[i] for i in range(60)] == [pack_plain(c) for c in cases]


def test_doses(spark):
    df = spark.createDataFrame([(1, 1, "Dar 0,5 mg/kg a gatos\ne 0.5 MG / kg ou 3 µg/kg."), (1, 2, None), (2, 1, "nada")], "d int, o int, b string")
    got = doses.extract(df, ["d"], ["o"], "b").orderBy("ord").collect()
    assert [(r["display"], r["valor"]) for r in got] == [("0.5 mg/kg", "0,5"), ("3 mcg/kg", "3")] and "\n" not in got[0]["contexto"]
    long = spark.createDataFrame([(1, 1, "a" * 100 + " 7 ml/kg " + "b" * 100)], "d int, o int, b string")
    assert doses.extract(long, ["d"], ["o"], "b").first()["contexto"] == "a" * 79 + " 7 ml/kg " + "b" * 79
    assert doses.extract(df, ["d"], ["o"], "b", species=F.lit("cães")).count() == 0
    allowed = F.array(F.lit("5 mg/kg"))
    assert one(spark, A.invalid_doses(F.col("t"), allowed), t="dar 5 ml/kg e 6 mg/kg") == ["6 mg/kg"]
    assert one(spark, A.invalid_doses(F.col("t"), allowed, strict=True), t="dar 5 ml/kg") == ["5 ml/kg"]


def test_answers(spark):
    raws = ['{"resposta": "ok", "confianca": 2, "encontrada_no_documento": "false", "fontes": [{"secao": "4.1", "trecho": "x"}, 3]}', "```json\n{“resposta”: “a”}\n```", 'bla {"resposta": "b", } bla', "só texto", "", None, "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    got = [r["p"] for r in df.select("i", A.parse_answer("r").alias("p")).orderBy("i").collect()]
    assert (got[0].resposta, got[0].confianca, got[0].encontrada_no_documento, len(got[0].fontes)) == ("ok", 1.0, True, 1)
    assert [g.resposta for g in got[1:4]] == ["a", "b", "só texto"] and [g.parse_ok for g in got] == [True, True, True, False, False, False, False]
    assert one(spark, A.is_vague(F.col("t")), t="Não consta. Consulte a bula.") and not one(spark, A.is_vague(F.col("t")), t="x" * 80 + " não consta")
    src = F.array(F.struct(F.lit("4.2").alias("section"), F.lit("e" * 300).alias("excerpt")))
    shown = one(spark, A.render(F.col("t"), src), t="")
    assert shown.startswith("Segundo o documento:") and "- **4.2**: " + "e" * 250 + "…" in shown
    assert one(spark, A.dose_answer(F.col("t"), F.lit("cães"), F.array(F.lit("1 mg/kg"))), t="X") == "Segundo o documento de X, para cães, a dose indicada é 1 mg/kg."


def test_resolution(spark):
    df = spark.createDataFrame([("Zirovet 5 mg", "zirovet"), ("", "a"), (None, "b")], "a string, b string")
    got = [r["x"] for r in df.select(resolve.similarity("a", "b").alias("x")).collect()]
    assert got == [SequenceMatcher(None, (a or "").lower(), b).ratio() for a, b in (("Zirovet 5 mg", "zirovet"), ("", "a"), ("", "b"))]
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (2, 3, 0.5)], "q int, k int, s double")
    ranked = resolve.rank(pairs, "q", "k", F.col("s"), F.col("s"), F.lit(False), F.lit(False)).orderBy("q", "rank").collect()
    assert [(r["k"], r["ambiguous"]) for r in ranked] == [(1, True), (2, False), (3, False)] and ranked[1]["gap"] == 1.0


def test_catalogue(spark):
    assert one(spark, compare.substances_of(F.col("t")), t="Substância(s) Ativa(s): Um 50 mg | Dois, 10 mg/ml | Espécie: cães") == ["Um", "Dois"]
    page = '<div class="search-result"><h5>Zirovet</h5><a href="/m/1">v</a><p>Espécie: cães</p></div><div class="search-result"><a href="/m/2">x</a></div>'
    rows = html.listing_rows(page, "https://a.example/q", "/m/")
    assert [(r["name"], r["link"]) for r in rows] == [("Zirovet", "https://a.example/m/1")] and "Espécie" in rows[0]["species"]
    links = html.listing_rows('<a href="/m/1">A</a><a href="/m/2">A</a><a href="/x">B</a>', "https://a.example/", "/m/")
    assert [r["name"] for r in links] == ["A"]
    assert html.pdf_link('<a href="b.PDF">b</a>', "https://a.example/d/") == "https://a.example/d/b.PDF"
    assert html.pdf_link('<a target="_blank" href="c"><span class="fa fa-file-pdf-o"></span></a>', "https://a.example/d/") == "https://a.example/d/c"
    assert html.kept_text("<body><article><h1>T</h1><p>um <b>dois</b></p></article><p>fora</p></body>") == "## T umdois"
    assert html.kept_text(None) == "" and html.pdf_link("", "") is None
    one_ref = spark.createDataFrame([(1, "Zirovet", "um"), (2, "Outro", "um"), (3, "Zirovet forte", "um")], "ref_id int, ref_name string, substance string")
    found = compare.alternatives(one_ref, one_ref.toDF("listing_id", "name", "substance"))
    assert {(r["ref_id"], r["listing_id"]) for r in found.collect()} == {(1, 2), (2, 1), (2, 3), (3, 1), (3, 2)}


def test_layout_tables(spark):
    spans = spark.createDataFrame([(1, 1, "a", 9.0, 0.0), (1, 2, "b", 1.0, 5.0), (1, 3, "c", 1.0, 11.0), (1, 4, "d", 9.0, 11.0)], "p int, ord int, text string, x double, y double")
    assert layout.detect_tables(spans, ["p"]).first()["table_text"] == "b | a\n-----\nc | d"
    assert layout.detect_tables(spans.limit(0), ["p"]).count() == 0


def test_cache_sessions_reports(spark):
    t0 = datetime(2024, 1, 1)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    e = spark.createDataFrame([(1, t0), (2, t0 - timedelta(seconds=1)), (3, None)], "k int, expires_at timestamp")
    assert {r["k"] for r in cachestore.valid(e, now).collect()} == {1, 3}
    ev = spark.createDataFrame([("u", t0, 1), ("u", t0 + timedelta(seconds=3600), 2), ("u", t0 + timedelta(seconds=7201), 3)], "u string, ts timestamp, id int")
    assert [r["session_no"] for r in sessions.gap_sessions(ev, "u", "ts", "id").orderBy("id").collect()] == [1, 1, 2]
    turns = spark.createDataFrame([("s", k, "x" * (199 + k % 3)) for k in range(9)], "s string, n int, r string")
    last = sessions.last_turns(turns, "s", ["n"], "r").collect()
    assert len(last) == 8 and min(r["n"] for r in last) == 1 and max(len(r["r"]) for r in last) == 203
    rep = reports.run_summary(spark.createDataFrame([("a", False, 3.0)], "m string, ok boolean, s double"), ["m"], "ok", "s").first()
    assert (rep["n_ok"], rep["n_failed"], rep["mean_seconds"]) == (0, 1, 0.0)
    frame = one(spark, sinks.frame(F.struct(F.col("t").alias("type"))), t="start")
    assert json.loads(frame[len("data: ") :]) == {"type": "start"} and frame.endswith("\n\n")
    rows = spark.createDataFrame([(1, "b", t0 + timedelta(days=1)), (1, "a", t0), (2, "c", None)], "k int, v string, ingested_at timestamp")
    assert {(r["k"], r["v"]) for r in once_per_key(rows, "k").collect()} == {(1, "a"), (2, "c")}


def test_sinks(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "a", t0)], "k int, v string, at timestamp")
    new = spark.createDataFrame([(1, "b", t0 + timedelta(1)), (2, "c", t0)], "k int, v string, at timestamp")
    sinks.upsert(old, new, ["k"], "at", str(tmp_path / "kv"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "kv")).collect()} == {(1, "b"), (2, "c")}
    sinks.write_report(new.select("k", "v"), str(tmp_path / "r"), ["k"])
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_question_lines(spark):
    lines = spark.createDataFrame([("Qual a dose?",), ("| a?",), ("# b?",), ("-- c?",), ("sem ponto",), ("",)], "value string")
    assert [r["text"] for r in questions(lines).collect()] == ["Qual a dose?"]
    assert [r["text"] for r in questions(lines, strict=False).collect()] == ["Qual a dose?", "sem ponto"]


def test_streams_agree_with_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = streaming.stream_of(spark, str(tmp_path / "ev"), events.schema)
    q = streaming.tumbling(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    want = streaming.tumbling(events, "ts", "event_type")
    assert spark.table("tumbled").select("window_start", "event_type", "n").exceptAll(want.select("window_start", "event_type", "n")).count() == 0
    assert spark.table("tumbled").count() == want.count()


def test_chained_follow_ups_as_a_stream(spark, tmp_path):
    rows = [("s", 1, "Qual a dose do Zirovet em cães?"), ("s", 2, "E para gatos?"), ("s", 3, "e a composição?"), ("t", 1, "E para gatos?")]
    spark.createDataFrame(rows, "session_id string, seq int, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = streaming.stream_of(spark, str(tmp_path / "t"), "session_id string, seq int, text string")
    q = streaming.chained_follow_ups(stream).writeStream.outputMode("append").format("memory").queryName("chained").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["seq"]): r["rewritten"] for r in spark.table("chained").collect()}
    assert got == {("s", 1): None, ("s", 2): "Qual a dose do Zirovet para gatos?", ("s", 3): "Qual a composição do Zirovet?", ("t", 1): None}


def test_comparison_path(spark):
    from bulaforge.plans import pipeline

    asked = pipeline.classified(spark.createDataFrame([(1, "Que alternativa ao Zirovet"), (2, "Qual a dose do Zirovet")], "qid bigint, text string"))
    listings = spark.createDataFrame(
        [(1, "Zirovet", "l1", "cães", "gel", ["Xaina 5 mg"]), (2, "Outrovet", "l2", "cães", None, ["xaina"]), (3, "Zirovet forte", "l3", None, None, ["Xaina 9 mg"])],
        "listing_id bigint, name string, link string, species string, form string, substances array<string>",
    )
    found = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "qid bigint, listing_id bigint, rank int")
    got = pipeline.comparisons(asked, found, listings).collect()
    want = "**Medicamentos alternativos ao Zirovet:**\n\nPrincípio activo: xaina\n\nMedicamentos encontrados (1):\n\n1. **Outrovet**\n   - Espécies: cães\n   - Link: l2\n\nTotal: 1 medicamentos alternativos."
    assert [tuple(r) for r in got] == [(1, want)]


def test_words_inside_other_words_are_candidates(spark):
    asked = spark.createDataFrame([(1, "penicilina forte"), (2, "vet"), (3, "ab xy"), (4, None)], "qid int, term string")
    listings = spark.createDataFrame([(1, "Benzilpenicilina"), (2, "Zirovet"), (3, "Forteza"), (4, None), (5, "x")], "listing_id int, name string")
    got = resolve.candidates(asked, listings, "qid", "term", "listing_id", "name").collect()
    assert {tuple(r) for r in got} == {(1, 1), (1, 3), (2, 2)}
