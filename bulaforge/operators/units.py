"""Amounts written in many units, brought to common units per kilogram of body weight.

Spellings are resolved once per distinct spelling, not once per row: the distinct
unit and denominator spellings are matched against the known names through an
inverted index of letter pairs and letters, candidates are verified by a weighted edit
distance, and the resulting alias dictionary is joined to all rows.

Defined results: a row whose value holds no number, states no known unit or is
given per animal, day or form yields no row; null and empty texts count as
missing; repeated rows give one row per key; a range written backwards is kept
as written. Spellings that mean no known unit are reported by `unmatched_spellings`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulaforge.session import cut

# Names of units, their dimension and their size in the base unit
# (µg, µl, thousandths of an IU), and names of body-weight units in grams.
UNIT_NAMES = [
    ("kg", "mass", 1e9), ("quilogramas", "mass", 1e9), ("g", "mass", 1e6), ("gr", "mass", 1e6), ("grama", "mass", 1e6), ("gramas", "mass", 1e6),
    ("mg", "mass", 1e3), ("mgr", "mass", 1e3), ("mgs", "mass", 1e3), ("miligrama", "mass", 1e3), ("miligramas", "mass", 1e3),
    ("ug", "mass", 1.0), ("mcg", "mass", 1.0), ("mcgr", "mass", 1.0), ("micrograma", "mass", 1.0), ("microgramas", "mass", 1.0),
    ("ng", "mass", 1e-3), ("nanograma", "mass", 1e-3), ("nanogramas", "mass", 1e-3),
    ("l", "volume", 1e6), ("lt", "volume", 1e6), ("litro", "volume", 1e6), ("litros", "volume", 1e6), ("dl", "volume", 1e5), ("decilitros", "volume", 1e5),
    ("cl", "volume", 1e4), ("centilitros", "volume", 1e4), ("ml", "volume", 1e3), ("mls", "volume", 1e3), ("cc", "volume", 1e3), ("cm3", "volume", 1e3),
    ("mililitro", "volume", 1e3), ("mililitros", "volume", 1e3), ("ul", "volume", 1.0), ("mcl", "volume", 1.0), ("microlitro", "volume", 1.0), ("microlitros", "volume", 1.0),
    ("ui", "iu", 1e3), ("iu", "iu", 1e3), ("unidades internacionais", "iu", 1e3), ("unidade internacional", "iu", 1e3), ("international units", "iu", 1e3),
    ("mil ui", "iu", 1e6), ("mil iu", "iu", 1e6), ("mil unidades internacionais", "iu", 1e6), ("milhoes ui", "iu", 1e9), ("milhao ui", "iu", 1e9), ("milhoes unidades internacionais", "iu", 1e9),
]
WEIGHT_NAMES = [
    ("kg", 1e3), ("kgs", 1e3), ("kg pv", 1e3), ("quilo", 1e3), ("quilos", 1e3), ("quilograma", 1e3), ("quilogramas", 1e3), ("g", 1.0), ("gr", 1.0), ("grama", 1.0), ("gramas", 1.0),
    ("lb", 453.59237), ("lbs", 453.59237), ("libra", 453.59237), ("libras", 453.59237), ("t", 1e6), ("ton", 1e6), ("tonelada", 1e6), ("toneladas", 1e6),
]

_N = r"(?:[¼½¾⅓⅔⅛]|\d{1,3}(?:[ \u00a0\u202f\u2009]\d{3})+(?:[.,]\d+)?(?![\d])|\d+(?:[.,]\d+)*)"
_RANGE = rf"(?:entre\s+)?{_N}(?:\s*(?:a|e|até|-|–|—)\s*{_N})?"
_UNIT = r"(?:mil\s+|milh(?:ão|ões)\s+(?:de\s+)?)?[\p{L}µμ%?.³²3]+(?:\s+internacion\p{L}+)?"
_DEN = rf"\s*(?:/|por\s+(?:cada\s+)?|per\s+|cada\s+)\s*({_N})?\s*([\p{{L}}]+(?:\s?p\.?v\b)?)"
#: Distance a spelling may have from a name, as a share of the name's length; half an edit (a doubled letter, a swap) whatever the length.
MAX_SHARE, HALF = 0.2, 0.5
#: Names of fewer letters than this take no vowel for another: too little is left of them.
SHORT = 5


def spelling(c: Column) -> Column:
    """Lower case without accents, marks and outer blanks; both micro signs become u."""
    plain = F.translate(F.lower(c), "áàâãäéèêëíìîïóòôõöúùûüçñµμ", "aaaaaeeeeiiiiooooouuuucnuu")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.?\-]", ""), r"[\s\u00a0]+", " "))


def number(c: Column) -> Column:
    """Value of a written number: comma decimal; dot decimal unless a comma follows; blanks group thousands."""
    fractions = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125}
    bare = F.regexp_replace(c, r"[ \u00a0\u202f\u2009]", "")
    plain = F.when(F.contains(bare, F.lit(",")), F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(bare)
    out = plain.try_cast("double")
    for sign, value in fractions.items():
        out = F.when(bare == sign, F.lit(value)).otherwise(out)
    return out


def weighted_distance(a: str, b: str) -> float:
    """Edit distance of a from the name b where a doubled letter, a swap of neighbours and, in names that aren't short, a vowel for a vowel cost half."""
    vowels = set("aeiou") if len(b) >= SHORT else set()
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            change = 0.0 if x == y else HALF if x in vowels and y in vowels else 1.0
            drop = HALF if i > 1 and a[i - 2] == x else 1.0
            add = HALF if j > 1 and b[j - 2] == y else 1.0
            best = min(rows[i - 1][j - 1] + change, rows[i - 1][j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + HALF)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["cost"] = [weighted_distance(a, b) for a, b in zip(pdf["raw"], pdf["name"])]
        yield pdf[["raw", "name", "dim", "size", "cost"]]


def _grams(c: Column) -> Column:
    """Letter pairs, ends included, and single letters."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.array_distinct(F.concat(pairs, F.split(c, "")))


def alias_dictionary(spellings: DataFrame, names: DataFrame) -> DataFrame:
    """(raw) × (name, dim, size) → (raw, dim, size): each distinct spelling with the name it means.

    Exact spellings map at once. Others go through the index of letter pairs and letters,
    keep names that share at least half as many of them as the name has letters, and map to
    the name of least weighted distance within MAX_SHARE of its length (half an edit at
    least), unless two names of different meaning are equally near.
    """
    raw = spellings.where(F.length("raw") > 0).distinct()
    exact = raw.join(names, raw.raw == names.name).select("raw", "dim", "size")
    open_ = raw.join(names, raw.raw == names.name, "left_anti")
    index = names.select("name", "dim", "size", F.explode(_grams(F.col("name"))).alias("g"))
    allowed = F.greatest(F.lit(HALF), F.length("name") * MAX_SHARE)
    near = (
        open_.select("raw", F.explode(_grams(F.col("raw"))).alias("g"))
        .join(index, "g")
        .groupBy("raw", "name", "dim", "size")
        .agg(F.count("*").alias("shared"))
        # Every letter more or less costs half an edit or more.
        .where((F.col("shared") * 2 >= F.length("name")) & (F.abs(F.length("raw") - F.length("name")) * HALF <= allowed))
    )
    cost = near.mapInPandas(_verify, "raw string, name string, dim string, size double, cost double")
    best = (
        cost.where(F.col("cost") <= allowed)
        .groupBy("raw", "dim", "size")
        .agg(F.min("cost").alias("cost"))
        .groupBy("raw")
        .agg(F.min(F.struct("cost", "dim", "size")).alias("b"), F.sort_array(F.collect_list("cost")).alias("costs"))
        .where((F.size("costs") == 1) | (F.get("costs", F.lit(0)) < F.get("costs", F.lit(1))))
    )
    return exact.unionByName(best.select("raw", "b.dim", "b.size"))


def known_names(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The unit names and the names of body-weight denominators."""
    units = spark.createDataFrame(UNIT_NAMES, "name string, dim string, size double")
    weights = spark.createDataFrame([(n, "weight", s) for n, s in WEIGHT_NAMES], "name string, dim string, size double")
    return units, weights


_HERE = "\x01"


def _mentions(df: DataFrame) -> DataFrame:
    """One row per place that may state the unit: the rest of valor, unidade, each copy of the number in contexto.

    The number is marked in the context by a plain replacement, so that all patterns are constant."""
    lit = F.regexp_extract("valor", rf"(?iu)^[\s\u00a0]*({_RANGE})", 1)
    base = df.withColumn("lit", lit).where(F.length("lit") > 0)
    after = rf"(?iu)^\s*({_UNIT})?(?:{_DEN})?"
    rest = F.regexp_replace("valor", rf"(?iu)^[\s\u00a0]*{_RANGE}", "")
    # The denominator may hold the same digits: they stand marked until the place is cut out.
    den = _DEN.replace("(" + _N + ")?", rf"(?:[\d.,]*{_HERE}[\d.,{_HERE}]*|{_N})?").replace(r"([\p{L}]+(?:\s?p\.?v\b)?)", r"[\p{L}]+(?:\s?p\.?v\b)?")
    # The number as written, neither preceded nor followed by more digits of its own.
    here = rf"(?iu)(?<![\d.,{_HERE}]){_HERE}(?![\d{_HERE}]|[.,][\d{_HERE}])((?:\s*{_UNIT})?(?:{den})?)"
    marked = F.replace(F.lower(F.translate("contexto", _HERE, " ")), F.lower("lit"), F.lit(_HERE))
    places = F.concat(
        F.array(F.struct(F.lit(0).alias("src"), rest.alias("said")), F.struct(F.lit(1).alias("src"), F.coalesce("unidade", F.lit("")).alias("said"))),
        F.transform(F.coalesce(F.regexp_extract_all(marked, F.lit(here), F.lit(1)), F.array().cast("array<string>")), lambda s: F.struct(F.lit(2).alias("src"), F.replace(s, F.lit(_HERE), F.col("lit")).alias("said"))),
    )
    rows = base.select("key", "lit", F.posexplode(places).alias("ord", "p")).select("key", "lit", "ord", "p.src", "p.said")
    return rows.select(
        "key", "lit", "ord", "src",
        spelling(F.regexp_extract("said", after, 1)).alias("unit_raw"),
        F.nullif(F.regexp_extract("said", after, 2), F.lit("")).alias("den_qty"),
        spelling(F.regexp_extract("said", after, 3)).alias("den_raw"),
    ).where((F.length("unit_raw") > 0) | (F.length("den_raw") > 0))


def _resolved(doses: DataFrame, key: str, value: str, unit: str, context: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The places that may state a unit, and the dictionaries of their unit and denominator spellings."""
    units, weights = known_names(doses.sparkSession)
    df = doses.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("valor"), F.col(f"`{unit}`").alias("unidade"), F.col(f"`{context}`").alias("contexto"))
    # Written once: the dictionaries and the join read the short spellings, not the texts.
    said = cut(_mentions(df))
    unit_alias = alias_dictionary(said.select(F.col("unit_raw").alias("raw")), units).toDF("unit_raw", "dim", "unit_size")
    den_alias = alias_dictionary(said.select(F.col("den_raw").alias("raw")), weights).toDF("den_raw", "den_kind", "den_size")
    return said, unit_alias, den_alias


def unmatched_spellings(doses: DataFrame, key: str, value: str, unit: str, context: str) -> DataFrame:
    """(place, spelling, n): the spellings that stand where a unit or a denominator is expected and mean no known one, with the doses that have them.
    place is `unit` or `denominator`. Words that merely follow the number in a text are among them."""
    said, unit_alias, den_alias = _resolved(doses, key, value, unit, context)
    parts = [
        said.where(F.length(c) > 0).join(alias, c, "left_anti").select("key", F.lit(place).alias("place"), F.col(c).alias("spelling"))
        for place, c, alias in (("unit", "unit_raw", unit_alias), ("denominator", "den_raw", den_alias))
    ]
    return parts[0].unionByName(parts[1]).distinct().groupBy("place", "spelling").agg(F.count("*").alias("n"))


def per_kilogram(doses: DataFrame, key: str, value: str, unit: str, context: str) -> DataFrame:
    """(key, dim, lo, hi): every amount with a known unit, in base units per kg, rounded half up.

    The unit and the denominator are taken from the value itself, else from the unit
    field, else from the place in the context where the same number stands.
    """
    said, unit_alias, den_alias = _resolved(doses, key, value, unit, context)
    mapped = said.join(unit_alias, "unit_raw", "left").join(den_alias, "den_raw", "left")
    den = F.when(F.length("den_raw") > 0, F.struct(F.col("den_size").alias("size"), F.coalesce(number(F.col("den_qty")), F.lit(1.0)).alias("qty")))
    # In the context a weight after the unit counts most, then a bare unit, then another denominator.
    rank = F.when(F.col("src") < 2, 0).when(F.col("den_size").isNotNull(), 1).when(F.length("den_raw") == 0, 2).otherwise(3)
    found = F.struct("src", rank.alias("rank"), "ord", "dim", "unit_size", den.alias("den"))
    by_key = mapped.groupBy("key", "lit").agg(F.sort_array(F.collect_set(found)).alias("places"))
    stated = F.get(F.filter("places", lambda p: p.dim.isNotNull()), F.lit(0))
    by_key = by_key.withColumn("u", stated).where(F.col("u").isNotNull())
    usable = F.filter("places", lambda p: (p.src < 2) | ((p.dim == F.col("u.dim")) & (p.unit_size == F.col("u.unit_size"))))
    best_in_context = F.get(F.filter(usable, lambda p: p.src == 2), F.lit(0))
    own = F.get(F.filter(usable, lambda p: (p.src < 2) & p.den.isNotNull()), F.lit(0))
    by_key = by_key.withColumn("d", F.coalesce(own.getField("den"), best_in_context.getField("den")))
    grams = F.when(F.col("d").isNull(), F.lit(1000.0)).otherwise(F.col("d.size") * F.col("d.qty"))
    numbers = F.regexp_extract_all("lit", F.lit(rf"({_N})"), F.lit(1))
    by_key = by_key.withColumn("grams", grams).where(F.col("grams") > 0).withColumn("ns", numbers)
    at = lambda i: F.floor(F.round(number(F.get("ns", i)) * F.col("u.unit_size") * 1000.0 / F.col("grams"), 6) + F.lit(0.5))
    out = by_key.select(F.col("key").alias(key), F.col("u.dim").alias("dim"), at(F.lit(0)).cast("bigint").alias("lo"), at(F.size("ns") - 1).cast("bigint").alias("hi"))
    return out.where(F.col("lo").isNotNull())
