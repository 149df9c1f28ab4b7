import random

from bulaforge.llm.answer_defects import CUTOFFS, DEFECTS, FUNCTIONS, Lexicon, best_cutoffs, defect_labels, defect_posteriors, label_model, main_defect, votes

NOUNS = "soro frasco animal rim folheto tumor lote leite fungo ciclo".split()
VERBS = "reduz altera mantém protege agrava limita".split()


def sentence(rng):
    return f"O {rng.choice(NOUNS)} {rng.choice(VERBS)} o {rng.choice(NOUNS)} com um {rng.choice(NOUNS)}."


def made(n=900, seed=6):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        q = f"Qual é a dose de Produto{i} para cães?"
        good = f"A dose recomendada de Produto{i} é de {i % 50 + 1} mg/kg por dia. " + " ".join(sentence(rng) for _ in range(3))
        kind = rng.choice([None] * 6 + list(DEFECTS))
        r, found = good, True
        if kind == "empty":
            r = rng.choice([None, "", " ", "...", "N/A", "<p></p>", "**Resposta:**", '{"resposta": ""}', "null"])
        elif kind == "copy":
            r = rng.choice([q, q.upper(), f'"{q}"', f"Pergunta: {q}", f"{q} {q}"])
        elif kind == "refusal":
            r, found = rng.choice([("Lamento, mas não posso responder a essa pergunta.", False), (f"Esse dado não consta do documento de Produto{i}.", True)])
        elif kind == "language":
            r = "The recommended dose of this is given every day. The animal should be kept with the leaflet and the bottle."
        elif kind == "truncated":
            r = rng.choice([good[:-1].rsplit(" ", 1)[0], good[:-1].rsplit(" ", 3)[0] + "...", good[:-1] + " (ver também", good[:-1] + ","])
        elif i % 7 == 0:
            r = good[:-1]
        elif i % 11 == 0:
            r, found = "O texto fornecido não menciona esse dado.", False
        elif i % 13 == 0:
            r = "Uma vez por dia"
        rows.append((i, q, r, found))
        if kind:
            truth[i] = kind
    return rows, truth


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, question string, response string, found boolean").dropDuplicates(["id"])
    voted, table = defect_posteriors(df)
    by = {(v, d): p for v, d, p in table}
    return {r["id"]: {d: by[r["votes"], d] for d in DEFECTS} for r in voted.collect()}


def test_cutoffs_found_on_labelled_pairs_hold_on_others(spark):
    rows, truth = made(400, seed=17)
    posteriors = scored(spark, rows)
    found = best_cutoffs([(d, p, truth.get(i) == d) for i, own in posteriors.items() for d, p in own.items()])
    assert found == CUTOFFS
    others, truth = made(900, seed=6)
    by = {d: [0, 0, 0] for d in DEFECTS}
    for i, own in scored(spark, others).items():
        for d, p in own.items():
            by[d][0] += p >= found[d] and truth.get(i) == d
            by[d][1] += p >= found[d]
            by[d][2] += truth.get(i) == d
    print({d: {"recall": hit / true, "precision": hit / max(1, got)} for d, (hit, got, true) in by.items()})
    for d, (hit, got, true) in by.items():
        assert hit >= 0.95 * true and got - hit <= 0.05 * true + 1, (d, by[d])


def test_held_out_accuracy(spark):
    rows, truth = made()
    df = spark.createDataFrame([*rows, rows[0], (5000, None, "O soro reduz o rim.", None), (5001, "Qual?", "a" * 100_000, None)], "id bigint, question string, response string, found boolean")
    labels = defect_labels(df.dropDuplicates(["id"]))
    got = {r["id"]: r["defect"] for r in main_defect(labels).collect()}
    for d in DEFECTS:
        want, have = {i for i, k in truth.items() if k == d}, {i for i, k in got.items() if k == d and i < 5000}
        assert len(want & have) >= 0.95 * len(want) and len(have - want) <= 0.05 * len(want) + 1, d
    assert 5000 not in got


def test_empty_table(spark):
    none = spark.createDataFrame([], "id bigint, question string, response string, found boolean")
    assert defect_labels(none).count() == 0


def test_votes_of_traps():
    lex = Lexicon([], 0)
    v = votes("Qual é a dose?", "Lamentavelmente, o Zirovet causa vómitos em 10 % dos animais.", True, 0.9, lex)
    assert 1 not in v["refusal"]
    assert 1 not in votes("Qual é a dose?", 'O rótulo diz: "The animal should be kept with the dose." O soro reduz o rim.', True, None, lex)["language"]
    assert 1 not in votes("Qual é a dose?", "Qual é a dose? A dose é de 5 mg por dia.", True, None, lex)["copy"]
    assert votes(None, None, None, None, lex)["empty"][0] == 1
    assert {d: len(v[d]) for d in DEFECTS} == {d: len(FUNCTIONS[d]) for d in DEFECTS}


def test_confidence_votes_on_either_scale():
    lex = Lexicon([], 0)
    cast = [votes("Qual é a dose?", "Sim.", True, c, lex)["refusal"][-1] for c in (None, 0.1, 10.0, 0.9, 90.0, 0.6)]
    assert cast == [0, 1, 1, -1, -1, 0]


def test_label_model_separates():
    first = [("a", 0.95, 0.02), ("b", 0.9, 0.02), ("c", 0.7, 0.2)]
    p = label_model([((1, 1, 0), 50), ((-1, -1, 0), 900), ((1, -1, 0), 30), ((0, 0, 0), 20)], first)
    assert p[(1, 1, 0)] > 0.9 and p[(-1, -1, 0)] < 0.05


def test_a_table_and_its_multiple_get_the_same_labels(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(400):
        text = f"A dose recomendada é de {i % 50 + 1} mg/kg por dia. " + " ".join(sentence(rng) for _ in range(4))
        if i % 40 == 0:
            text += f" O soro {rng.choice(VERBS)} o fra"
            cut.add(i)
        rows.append((i, "Qual é a dose para cães?", text, True))
    schema = "id bigint, question string, response string, found boolean"
    once = {(r["id"], r["defect"]) for r in defect_labels(spark.createDataFrame(rows, schema)).collect()}
    tenfold = [(k * 1000 + i, *rest) for k in range(10) for i, *rest in rows]
    often = {(r["id"], r["defect"]) for r in defect_labels(spark.createDataFrame(tenfold, schema)).collect()}
    assert once == {(i, "truncated") for i in cut}
    assert often == {(k * 1000 + i, d) for k in range(10) for i, d in once}
