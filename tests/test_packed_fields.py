import random

import pyarrow as pa
import pytest

from bulaforge.operators.packed_fields import explode_packed, split_values


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("   ", []), (";;", []), ("cães", ["cães"]),
        ("cães; gatos | aves\tperus\nratos", ["cães", "gatos", "aves", "perus", "ratos"]),
        ("cães e gatos E aves", ["cães", "gatos", "aves"]), ("pombos-correio - cão", ["pombos-correio", "cão"]),
        ('"Ovinos, de leite" e galinhas', ["Ovinos, de leite", "galinhas"]), ('"x ""forte"" y"', ['x "forte" y']),
        ("a (b; c), d", ["a (b; c)", "d"]), ("“a; b” + c", ["a; b", "c"]), ('a" b; c', ['a" b', "c"]), ("a (b; c", ["a (b", "c"]),
        ("Xa 12,5 mg/ml / Yo 2,27 mg", ["Xa 12,5 mg/ml", "Yo 2,27 mg"]), ("N,N-dimetil, 2,4-di", ["N,N-dimetil", "2,4-di"]), ("cão/gato", ["cão", "gato"]),
        ("a, b", ["a", "b"]), ("• A,b", ["A", "b"]),
    ],
)
def test_list(text, want):
    assert split_values(pa.array([text], pa.string())).to_pylist() == [want]


def test_labelled_keeps_the_text_of_an_item_whole():
    text = 'Nome 5 mg • Vias: oral, tópica; "Titular: Lab A; B"\nN.º AIM: 1/2 |'
    assert split_values(pa.array([text]), "labelled").to_pylist()[0] == ["Nome 5 mg", "Vias: oral, tópica", "Titular: Lab A; B", "N.º AIM: 1/2"]
    assert split_values(pa.array(["só texto, sem rótulo", None, ""]), "labelled").to_pylist() == [["só texto, sem rótulo"], [], []]


def test_a_label_of_any_length_begins_an_item():
    label = "Data da primeira autorização de introdução no mercado de medicamentos veterinários"
    assert split_values(pa.array([f"Nome; {label}: 2001; Titular: A"]), "labelled").to_pylist()[0] == ["Nome", f"{label}: 2001", "Titular: A"]


def brute(text):
    """Character by character, for texts of letters, blanks, quotes, brackets and ; only."""
    quotes = text.count('"') // 2 * 2
    out, cur, inside, depth, seen = [], "", False, 0, 0
    balanced = True
    level = 0
    q = 0
    for c in text:
        if c == '"' and q < quotes:
            q += 1
        elif c in "()" and q % 2 == 0:
            level += 1 if c == "(" else -1
            balanced &= level >= 0
    balanced &= level == 0
    for c in text:
        if c == '"' and seen < quotes:
            seen += 1
            inside = not inside
        elif c in "()" and not inside and balanced:
            depth += 1 if c == "(" else -1
        if c == ";" and not inside and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    out.append(cur)
    made = []
    for v in map(str.strip, out):
        if len(v) > 1 and v[0] == v[-1] == '"' and '"' not in v[1:-1].replace('""', ""):
            v = v[1:-1].replace('""', '"').strip()
        if v:
            made.append(v)
    return made


def test_against_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice('ab ";()') for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert split_values(pa.array(texts)).to_pylist() == [brute(t) for t in texts]


def test_explode_positions_arrays_and_clashing_names(spark):
    rows = [(1, "a; b", ["x + y", None, "", "z"], "other"), (1, "a; b", ["x + y", None, "", "z"], "other"), (2, None, None, None), (3, "é" * 50_000 + ";k", [], "")]
    df = spark.createDataFrame(rows, "id int, val string, fld array<string>, pos string")
    got = explode_packed(df, ["id"], {"val": "list", "fld": "list"}).collect()
    first = sorted(tuple(r) for r in got if r[0] == 1)
    assert first == sorted([(1, "val", 1, "a"), (1, "val", 2, "b"), (1, "fld", 1, "x"), (1, "fld", 2, "y"), (1, "fld", 3, "z")] * 2)
    assert [len(r[3]) for r in got if r[0] == 3] == [50_000, 1]
    assert not [r for r in got if r[0] == 2]
    assert explode_packed(df.limit(0), ["id"], {"val": "list"}).count() == 0


def test_key_named_like_a_result_column_is_refused(spark):
    with pytest.raises(ValueError):
        explode_packed(spark.createDataFrame([(1, "a")], "pos int, t string"), ["pos"], {"t": "list"})
