import pytest

from bulaforge.operators.units import alias_dictionary, known_names, per_kilogram, unmatched_spellings, weighted_distance


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, v string, u string, c string").selectExpr("*", "'x' AS key", "'y' AS lit")
    return {r["id"]: (r["dim"], r["lo"], r["hi"]) for r in per_kilogram(df, "id", "v", "u", "c").collect()}


def test_places_of_unit_and_denominator(spark):
    got = run(
        spark,
        [
            ("16", "MG", "usar 16MG/lb. Durante 11 dias"), ("775", None, "usar 775 mil UI por tonelada de peso vivo"), ("0,1", "dl/50kg", "aves: 0,1"),
            ("9 a 19", "μg", "de 9 a 19 μg/g de peso, não mais de 256 mg por animal"), ("1442.50-1.492,5", "ug/kg", ""), ("59 500 ug por kg", None, None),
            ("½", "", "Em gatos: ½ mg/kg"), ("5", "mg por cabeça", ""), ("5", "gotas", "5 gotas/kg"), ("5", None, None), (None, "mg", "mg/kg"), ("", "", ""),
            ("2", "miligrmas/kg", ""), ("entre 31,85 e 33,85", "mg", "usar entre 31,85 e 33,85 mg por 100 kg de peso vivo"), ("3", "cc", None), ("7", "%", "7 %"),
        ],
    )
    assert got == {
        0: ("mass", 35274, 35274), 1: ("iu", 775000, 775000), 2: ("volume", 200, 200), 3: ("mass", 9000, 19000), 4: ("mass", 1443, 1493), 5: ("mass", 59500, 59500),
        6: ("mass", 500, 500), 12: ("mass", 2000, 2000), 13: ("mass", 319, 339), 14: ("volume", 3000, 3000),
    }


def test_repeated_long_and_empty(spark):
    long = "x " * 50_000 + "8 mg/kg"
    df = spark.createDataFrame([(1, "8", None, long), (1, "8", None, long)], "id bigint, v string, u string, c string")
    assert [tuple(r) for r in per_kilogram(df, "id", "v", "u", "c").collect()] == [(1, "mass", 8000, 8000)]
    assert per_kilogram(df.limit(0), "id", "v", "u", "c").count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("mg", "mg", 0), ("gramas", "grammas", 0.5), ("libra", "lirba", 0.5), ("gramas", "gremas", 0.5), ("gotas", "gramas", 2.5)])
def test_distance(a, b, d):
    assert weighted_distance(a, b) == d


def test_dictionary_leaves_what_is_far_or_ambiguous(spark):
    units, _ = known_names(spark)
    raw = spark.createDataFrame([("microgrmas",), ("miligramass",), ("gotas",), ("mh",), ("",), ("mmg",), ("lm",), ("uu",), ("em",)], "raw string")
    got = {r["raw"]: (r["dim"], r["size"]) for r in alias_dictionary(raw, units).collect()}
    assert got == {"microgrmas": ("mass", 1.0), "miligramass": ("mass", 1000.0), "mmg": ("mass", 1000.0), "lm": ("volume", 1000.0)}


def test_unmatched_spellings_are_reported(spark):
    df = spark.createDataFrame([(1, "5", "gotas", None), (2, "5", "gotas", None), (3, "5", "mg/animal", ""), (4, "5 mg/kg", None, None)], "id bigint, v string, u string, c string")
    assert {tuple(r) for r in unmatched_spellings(df, "id", "v", "u", "c").collect()} == {("unit", "gotas", 2), ("denominator", "animal", 1)}


def test_digits_of_the_amount_in_the_denominator(spark):
    assert run(spark, [("10", "mg", "dose de 10 mg/10 kg"), ("1", "ug", "usar 1 ug/100 g"), ("1", "mg", "11 mg/g, 1 mg/g")]) == {0: ("mass", 1000, 1000), 1: ("mass", 10, 10), 2: ("mass", 1_000_000, 1_000_000)}
