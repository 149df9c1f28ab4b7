"""Alternatives by shared substance, listings, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulaforge.operators.resolve import holding
from bulaforge.session import cut

#: Fixed value: concentrations inside a substance text.
CONCENTRATION = r"(?iu)\d+[.,]?\d*\s*(?:mg|ml|g|mcg|µg)(?:/(?:ml|kg|g))?"
LABELLED = r"(?iu)Substância(?:s)?\s*(?:\(s\))?\s*Ativa(?:s)?\s*(?:\(s\))?[:]\s*(.+?)(?:\s*\|\s*Espécie|\s*$)"
# Headings of the comparison text by kind.
HEADINGS = {"alternativo": "Medicamentos alternativos ao ", "substituto": "Medicamentos substitutos do ", "equivalente": "Medicamentos equivalentes ao "}
OTHER_HEADING = "Medicamentos com mesmo princípio activo que "


def substances_of(text: Column) -> Column:
    """Substances after their label, concentrations and marks taken off."""
    parts = F.split(F.regexp_extract(text, LABELLED, 1), r"\|")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, CONCENTRATION, ""), r"^[ ,;.]+|[ ,;.]+$", "")), lambda p: p != "")


def base_name(substance: Column) -> Column:
    """Lower-cased name of a substance without its concentration."""
    bare = F.regexp_replace(F.lower(substance), r"(?u)\s*\d+(?:[.,]\d+)*\s*(?:mg|ml|g|mcg|µg|ui|%)?(?:/\p{L}+)?\s*$", "")
    return F.trim(bare)


def _excluded(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(ref_name, substance, listing_id): the products of the substance whose name contains the reference's, itself among them."""
    names = listed.select("listing_id", "substance", F.lower("name").alias("n")).distinct()
    return holding(wanted.withColumn("w", F.lower("ref_name")), names, "w", "n", on=["substance"]).select("ref_name", "substance", "listing_id").distinct()


def alternatives(references: DataFrame, listed: DataFrame, per_substance: int = 10) -> DataFrame:
    """references(ref_id, ref_name, substance), listed(listing_id, name, substance) → (ref_id, substance, listing_id, nth): the first products of
    the substance whose names don't contain the reference's name.

    No pairs of a substance are made: each distinct name asks by number for as many first products as it wants and leaves out."""
    wanted = references.select("ref_name", "substance").distinct()
    out = cut(_excluded(wanted, listed))
    left_out = out.groupBy("ref_name", "substance").agg(F.count("*").alias("x"))
    numbered = listed.select("listing_id", "substance").distinct().withColumn("at", F.row_number().over(Window.partitionBy("substance").orderBy("listing_id")))
    asks = wanted.join(left_out, ["ref_name", "substance"], "left").withColumn("at", F.explode(F.sequence(F.lit(1), (F.coalesce("x", F.lit(0)) + per_substance).cast("int"))))
    near = asks.join(numbered, ["substance", "at"]).join(out, ["ref_name", "substance", "listing_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("ref_name", "substance").orderBy("at"))
    first = near.withColumn("nth", nth).where(F.col("nth") <= per_substance)
    return references.join(first, ["ref_name", "substance"]).select("ref_id", "substance", "listing_id", "nth")


def counts(references: DataFrame, listed: DataFrame) -> DataFrame:
    """(ref_id, substances, total): how many substances have alternatives and how many there are: the products of each substance less those left out."""
    wanted = references.select("ref_name", "substance").distinct()
    left_out = _excluded(wanted, listed).groupBy("ref_name", "substance").agg(F.count("*").alias("x"))
    sizes = listed.groupBy("substance").agg(F.countDistinct("listing_id").alias("n"))
    each = wanted.join(sizes, "substance").join(left_out, ["ref_name", "substance"], "left").withColumn("others", F.col("n") - F.coalesce("x", F.lit(0))).where("others > 0")
    rows = references.distinct().join(each, ["ref_name", "substance"])
    return rows.groupBy("ref_id").agg(F.countDistinct("substance").alias("substances"), F.sum("others").alias("total"))


def heading(kind: Column, reference: Column) -> Column:
    known = [F.when(kind == k, F.lit(h)) for k, h in HEADINGS.items()]
    return F.concat(F.coalesce(*known, F.lit(OTHER_HEADING)), reference)


def item_text(nth: Column, name: Column, species: Column, form: Column, link: Column, indent: str = "") -> Column:
    def line(label: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\n{indent}   - {label}: "), F.nullif(value, F.lit(""))), F.lit(""))

    return F.concat(F.lit(indent), nth.cast("string"), F.lit(". **"), name, F.lit("**"), line("Espécies", species), line("Forma", form), line("Link", link))


# Messages of a comparison that finds nothing; {} is the reference.
NO_REFERENCE = "Não foi possível identificar o medicamento de referência."
NO_LISTING = "Não foi possível encontrar informações sobre '{}'."
NO_SUBSTANCE = "Não foi possível identificar substâncias activas de '{}'."
NO_ALTERNATIVE = "Não foram encontrados medicamentos alternativos para nenhuma das substâncias de '{}'."


def answer_text(reference: Column, kind: Column, species: Column, listed: Column, found: Column) -> Column:
    """The answer to a comparison. listed: the reference is in the catalogue; found: ARRAY<STRUCT<substance, items>>, the
    other products of each of its substances, items being ARRAY<STRUCT<name, species, form, link>>."""

    def about(message: str) -> Column:
        return F.concat(*[x for part in message.split("{}") for x in (F.lit(part), reference)][:-1])

    def numbered(items: Column, indent: str) -> Column:
        return F.array_join(F.transform(items, lambda x, i: item_text(i + 1, x["name"], x["species"], x["form"], x["link"], indent)), "\n")

    def species_line(label: str) -> Column:
        return F.coalesce(F.concat(F.lit(label), F.nullif(species, F.lit(""))), F.lit(""))

    title = F.concat(F.lit("**"), heading(kind, reference), F.lit(":**\n"))
    lone = F.get(found, F.lit(0))
    n = F.size(lone["items"]).cast("string")
    single = F.concat(
        title, F.lit("\nPrincípio activo: "), lone["substance"], species_line("\nEspécie: "), F.lit("\n\nMedicamentos encontrados ("), n, F.lit("):\n\n"), numbered(lone["items"], ""),
        F.lit("\n\nTotal: "), n, F.lit(" medicamentos alternativos."),
    )
    some = F.filter(found, lambda x: F.size(x["items"]) > 0)
    total = F.aggregate(found, F.lit(0), lambda t, x: t + F.size(x["items"]))

    def part(x: Column, i: Column) -> Column:
        body = F.concat(F.size(x["items"]).cast("string"), F.lit(" medicamento(s):\n"), numbered(x["items"], "  "))
        return F.concat(F.lit("\n\n## "), (i + 1).cast("string"), F.lit(". "), x["substance"], F.lit("\n"), F.when(F.size(x["items"]) > 0, body).otherwise("Nenhum medicamento adicional encontrado."))

    several = F.concat(
        title, F.lit("\n"), reference, F.lit(" contém múltiplas substâncias activas:"), F.array_join(F.transform(found, lambda x: F.concat(F.lit("\n  - "), x["substance"])), ""),
        species_line("\n\nEspécie-alvo: "), F.array_join(F.transform(found, part), ""),
        F.lit("\n\nTotal: "), total.cast("string"), F.lit(" medicamentos alternativos em "), F.size(some).cast("string"), F.lit(" substância(s)."),
    )
    only = F.concat(F.lit("Apenas '"), reference, F.lit("' foi encontrado com '"), lone["substance"], F.lit("'."))
    return (
        F.when(F.coalesce(reference, F.lit("")) == "", NO_REFERENCE)
        .when(~F.coalesce(listed, F.lit(False)), about(NO_LISTING))
        .when(F.coalesce(F.size(found), F.lit(0)) < 1, about(NO_SUBSTANCE))
        .when((F.size(found) == 1) & (F.size(some) == 0), only)
        .when(F.size(found) == 1, single)
        .when(F.size(some) == 0, about(NO_ALTERNATIVE))
        .otherwise(several)
    )
