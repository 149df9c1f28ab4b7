import random

from bulaforge.llm.canonical import map_values

REFS = [("form", 1, "comprimidos", "comprimidos"), ("form", 2, "comprimidos mastigáveis", "comprimidos mastigáveis"), ("form", 3, "solução injetável", "solução injetável"), ("form", 4, "suspensão injetável", "suspensão injetável"), ("s", 1, "cães", "cães"), ("s", 2, "cachorros", "cães"), ("s", 3, "gatos", "gatos"), ("s", 4, "patos", "patos"), ("s", 5, "pombos-correio", "pombos")]


def refs(spark):
    return spark.createDataFrame(REFS, "kind string, ord int, name string, canonical string")


def test_spellings(spark):
    cases = [
        ("form", "COMPRIMIDOS", "comprimidos"), ("form", "comp.", "comprimidos"), ("form", "cp", "comprimidos"), ("form", "comp. mast.", "comprimidos mastigáveis"), ("form", "sol. inj.", "solução injetável"), ("form", "susp inj", "suspensão injetável"),
        ("form", "solucao  injetavle", "solução injetável"), ("form", "caixa", "UNMATCHED"), ("form", "???", "UNMATCHED"), ("s", "Cães (adultos)", "cães"), ("s", "cachorors, de guarda", "cães"), ("s", "gatoss", "gatos"),
        ("s", "pombos correio", "pombos"), ("s", "elefantes", "UNMATCHED"), ("s", "gatos", "gatos"), ("s", "x" * 5000, "UNMATCHED"), ("s", "comprimidos", "UNMATCHED"),
    ]
    df = spark.createDataFrame([(i, k, v, "extra") for i, (k, v, _) in enumerate(cases)] + [(90, "s", None, "e"), (91, "s", "  ", "e"), (92, "form", "", "e"), (0, "form", "COMPRIMIDOS", "extra")], "i int, kind string, val string, canonical string")
    got = sorted((r["i"], r["canonical"]) for r in map_values(df, refs(spark)).collect())
    assert got == sorted([(i, c) for i, (_, _, c) in enumerate(cases)] + [(0, "comprimidos")])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(v, n):
    letters = iter(n)
    return all(c in letters for c in v)


def test_skeletons_mean_the_entry_written_most_often(spark):
    entries = [("f", 1, "capsulas", "capsulas"), ("f", 2, "comprimidos", "comprimidos"), ("f", 3, "sabonete", "sabonete")]
    table = spark.createDataFrame(entries, "kind string, ord int, name string, canonical string")
    for often, want in (("comprimidos", "comprimidos"), ("capsulas", "capsulas")):
        vals = [("f", often)] * 3 + [("f", x) for x in ("capsulas", "comprimidos", "cp", "CPS.", "sxq")]
        got = {r["val"]: r["canonical"] for r in map_values(spark.createDataFrame(vals, "kind string, val string"), table).collect()}
        assert (got["cp"], got["CPS."], got["sxq"]) == (want, want, "UNMATCHED")


def test_pigeonhole_finds_every_value_within_its_edits(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 4, 6, 8, 9, 12, 15]))) for _ in range(12)]
    values = set()
    for n in names:
        for _ in range(25):
            w = list(n)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "z", "a", "q"])
            values.add("".join(w))
    values = sorted(v for v in values if v.strip())
    table = spark.createDataFrame([("k", i, n, n) for i, n in enumerate(names)], "kind string, ord int, name string, canonical string")
    got = {r["val"]: r["canonical"] for r in map_values(spark.createDataFrame([("k", v) for v in values], "kind string, val string"), table).collect()}
    allowed = lambda n: 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 8 else 3
    for v in values:
        if not any(n.startswith(v) for n in names):
            best = min(((distance(v, n), n) for n in names if distance(v, n) <= allowed(len(n))), default=None)
            skeletons = [n for n in names if not set(v) & set("aeiou") and len(v) > 1 and n[0] == v[0] and within(v, n)]
            assert (got[v] == "UNMATCHED") == (best is None and not skeletons)
            assert distance(v, got[v]) == best[0] if best else got[v] == "UNMATCHED" or got[v] in skeletons


def test_empty(spark):
    none = spark.createDataFrame([], "kind string, val string")
    assert map_values(none, refs(spark)).count() == 0
    one = spark.createDataFrame([("s", "cães")], "kind string, val string")
    assert [r["canonical"] for r in map_values(one, refs(spark).limit(0)).collect()] == ["UNMATCHED"]
