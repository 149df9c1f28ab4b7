"""Free-entered values mapped to a canonical list by a partition-based pigeonhole join, in SQL only.

A reference string that may differ from a value by k edits is cut into k + 1 segments;
k edits can't touch them all, so one segment stands whole in the value, shifted by no
more than the edits before it. Values and references are joined by equality on those
positional substrings and verified by the built-in `levenshtein`; what no step matches
is found by an anti-join and reported.

Distinct normalised values are resolved, in this order: equal after folding case,
accents, marks and qualifiers; abbreviated (its words begin words of the reference, in
order, the first one its first word); within k edits; a skeleton (consonants only, in
the order of the reference's letters), which means the reference most often written.
The resulting dictionary is joined back to the rows.

Defined results: null and blank values give no rows; of several nearest references the
one with the same first letter, then the same length, then the lower ordinal wins;
repeated rows give repeated output; an empty reference list leaves all unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulaforge.session import cut as cut_lineage

UNMATCHED = "UNMATCHED"
_ACCENTS, _PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñý", "aaaaaaeeeeiiiiooooouuuucny"


def folded(value: Column) -> Column:
    """Lower case, no accents, no qualifier in brackets or after a comma, no marks, single blanks."""
    s = F.lower(value)
    s = F.regexp_replace(s, r"\([^)]*\)?|\[[^\]]*\]?|,.*$", " ")
    s = F.translate(s, _ACCENTS, _PLAIN)
    s = F.regexp_replace(s, r"['’`´\-‐‑–]", "")
    s = F.regexp_replace(s, r"[^a-z0-9]+", " ")
    return F.trim(s)


def edits_allowed(length: Column) -> Column:
    """None up to 2 letters, 1 to 4, 2 to 8, 3 to 16, then one more for every 8 letters."""
    return F.when(length <= 2, 0).when(length <= 4, 1).when(length <= 8, 2).otherwise(F.floor((length - 1) / 8).cast("int") + 2)


def _step(todo: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found of todo, rest of todo); todo is written with what was found, so that no later step repeats this one."""
    known = cut_lineage(todo.join(found, ["kind", "v"], "left"))
    return known.where("canonical is not null").select("kind", "v", "n", "canonical"), known.where("canonical is null").select("kind", "v", "n")


def dictionary(values: DataFrame, references: DataFrame) -> DataFrame:
    """values(kind, v) × references(kind, ord, name, canonical) → (kind, v, canonical) for the values that match."""
    refs = cut_lineage(references.select("kind", "ord", folded(F.col("name")).alias("r"), "canonical").where(F.length("r") > 0).distinct())
    todo = values.where(F.length("v") > 0).groupBy("kind", "v").agg(F.count("*").alias("n"))

    exact = refs.groupBy("kind", F.col("r").alias("v")).agg(F.min_by("canonical", "ord").alias("canonical"))
    direct, rest = _step(todo, exact)
    begun = _abbreviated(rest, refs)
    abbreviated, rest = _step(rest, begun)
    fuzzy, rest = _step(rest, _near(rest, refs))
    done = direct.unionByName(abbreviated).unionByName(fuzzy)
    return done.select("kind", "v", "canonical").unionByName(_skeletons(rest, refs, done).select("kind", "v", "canonical"))


def _abbreviated(rest: DataFrame, refs: DataFrame) -> DataFrame:
    """"susp inj" as susp%inj%: of the references that fit the one of the fewest words, then letters."""
    short = rest.where(F.length(F.replace("v", F.lit(" "), F.lit(""))) >= 2).withColumn("head", F.substring_index("v", " ", 1))
    first = F.substring_index("r", " ", 1)
    by_head = refs.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.substring(first, F.lit(1), i))).alias("head"))
    begun = short.join(by_head, ["kind", "head"]).where(F.expr("r LIKE concat(replace(v, ' ', '%'), '%') AND length(v) < length(r)"))
    # Every word of the value begins a word of the reference; after a single letter it may stand inside the word that letter begins ("s. cut.").
    begun = begun.withColumn("vw", F.split("v", " ")).where(
        F.expr("forall(filter(vw, (x, i) -> length(x) > 1 AND NOT (i > 0 AND length(vw[greatest(i - 1, 0)]) = 1)), x -> exists(split(r, ' '), y -> startswith(y, x)))")
    )
    return begun.groupBy("kind", "v").agg(F.min_by("canonical", F.struct(F.size(F.split("r", " ")), F.length("r"), "ord")).alias("canonical"))


def _skeletons(rest: DataFrame, refs: DataFrame, done: DataFrame) -> DataFrame:
    """Values of consonants only, such as a first letter and some of those after it: the canonical entry that the resolved values mean most often."""
    often = done.groupBy("kind", "canonical").agg(F.sum("n").alias("times"))
    bare = refs.withColumn("r", F.replace("r", F.lit(" "), F.lit(""))).where(F.length("r") >= 2)
    pairs = bare.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(2), F.length("r")), lambda i: F.concat(F.substring("r", 1, 1), F.substring(F.col("r"), i, F.lit(1)))))).alias("head"))
    short = rest.where(F.col("v").rlike("^[b-df-hj-np-tv-z]{2,}$")).withColumn("head", F.substring("v", 1, 2))
    fits = short.join(pairs, ["kind", "head"]).where(F.expr("r LIKE concat(regexp_replace(v, '(.)', '$1%'))")).join(often, ["kind", "canonical"], "left")
    return fits.groupBy("kind", "v").agg(F.min_by("canonical", F.struct(-F.coalesce("times", F.lit(0)), F.length("r"), "ord")).alias("canonical"))


def _near(rest: DataFrame, refs: DataFrame) -> DataFrame:
    # Pigeonhole join, without blanks: a missing or doubled blank is no edit.
    open_ = rest.withColumn("whole", F.col("v")).withColumn("v", F.replace("v", F.lit(" "), F.lit("")))
    cut = refs.withColumn("r", F.replace("r", F.lit(" "), F.lit(""))).withColumn("len", F.length("r")).withColumn("k", edits_allowed(F.col("len")))
    segments = cut.select("kind", "ord", "r", "canonical", "len", "k", F.explode(F.expr("sequence(0, k)")).alias("i")).withColumn(
        "seg", F.expr("substring(r, cast(floor(i * len / (k + 1)) as int) + 1, cast(floor((i + 1) * len / (k + 1)) - floor(i * len / (k + 1)) as int))")
    )
    # For a reference of length len the value may hold segment i shifted by at most i edits on its left and k - i on its right.
    lengths = cut.select("kind", "len", "k").distinct().withColumn("n", F.explode(F.expr("sequence(greatest(len - k, 1), len + k)")))
    probes = (
        open_.withColumn("n", F.length("v"))
        .join(lengths, ["kind", "n"])
        .distinct()
        .select("kind", "v", "n", "len", "k", F.explode(F.expr("sequence(0, k)")).alias("i"))
        .withColumn("low", F.expr("greatest(-i, n - len - (k - i))"))
        .withColumn("high", F.expr("least(i, n - len + (k - i))"))
        .where("low <= high")
        .select("kind", "v", "len", "k", "i", F.explode(F.expr("sequence(low, high)")).alias("shift"))
        .withColumn("at", F.expr("cast(floor(i * len / (k + 1)) as int) + 1 + shift"))
        .where("at >= 1")
        .withColumn("seg", F.expr("substring(v, at, cast(floor((i + 1) * len / (k + 1)) - floor(i * len / (k + 1)) as int))"))
    )
    candidates = probes.select("kind", "v", "len", "i", "seg").join(segments, ["kind", "len", "i", "seg"]).select("kind", "v", "ord", "r", "canonical", "k").distinct()
    near = candidates.withColumn("d", F.expr("levenshtein(v, r, k)")).where("d >= 0")
    order = F.struct("d", F.substring("v", 1, 1) != F.substring("r", 1, 1), F.length("v") != F.length("r"), "ord")
    best = near.groupBy("kind", "v").agg(F.min_by("canonical", order).alias("canonical"))
    return open_.join(best, ["kind", "v"]).select("kind", F.col("whole").alias("v"), "canonical")


def map_values(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows(kind, val, …) with a column canonical added: the entry meant, or UNMATCHED. Blank values are dropped.

    Columns of rows other than kind and val are kept; a column named `canonical` or `v` is replaced."""
    full = cut_lineage(rows.drop("canonical").where(F.col("val").isNotNull() & F.col("val").rlike(r"[^\s\u00a0]")).withColumn("v", folded(F.col("val"))))
    known = cut_lineage(dictionary(full.select("kind", "v"), references))
    matched = full.join(known, ["kind", "v"])
    missed = full.join(known, ["kind", "v"], "left_anti").withColumn("canonical", F.lit(UNMATCHED))
    return matched.unionByName(missed).drop("v")
