"""Model answers: lenient parsing, re-prompt choice, rendering, dose checks, vagueness, prompts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulaforge.functions.dimensions import SPECIFIC_UNITS, VAGUE
from bulaforge.functions.text import strip_all

# Thresholds, the message for nothing found, patterns of doses, fences and objects.
LEAST_CONFIDENCE, RAW_CHARS, RAW_CONFIDENCE = 0.55, 2000, 0.2
NOT_FOUND = "Informação não encontrada no documento."
DOSE = r"(?iu)(\d+[.,]?\d*)\s*(mg|mcg|µg|ug|ml|g)\s*/\s*(kg|quilograma)"
_SOURCE = T.StructType([T.StructField("secao", T.StringType()), T.StructField("trecho", T.StringType())])
PARSED = T.StructType(
    [
        T.StructField("resposta", T.StringType()), T.StructField("encontrada_no_documento", T.BooleanType()), T.StructField("confianca", T.DoubleType()),
        T.StructField("fontes", T.ArrayType(_SOURCE)), T.StructField("parse_ok", T.BooleanType()),
    ]
)
_FENCE = re.compile(r"```(?:json)?\s*|\s*```", re.I)
_OBJECT = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.S)
_QUOTES = str.maketrans("“”‘’", "\"\"''")


def _object(text: str) -> dict | None:
    """The JSON object in a text: the whole, else the first braces, else those without trailing commas."""
    tries = [text]
    found = _OBJECT.search(text)
    if found:
        tries += [found.group(), re.sub(r",\s*([}\]])", r"\1", found.group())]
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def _parse(raw: str | None) -> tuple:
    text = (raw or "").strip()
    if not text:
        return NOT_FOUND, False, 0.0, [], False
    text = _FENCE.sub("", text).translate(_QUOTES)
    data = _object(text)
    if data is None:
        return text[:RAW_CHARS], False, RAW_CONFIDENCE, [], False
    try:
        confidence = min(1.0, max(0.0, float(data.get("confianca", 0.5))))
    except (TypeError, ValueError):
        confidence = 0.5
    listed = data.get("fontes")
    sources = [{"secao": str(f.get("secao", "")), "trecho": str(f.get("trecho", ""))} for f in listed if isinstance(f, dict)] if isinstance(listed, list) else []
    return str(data.get("resposta", "")).strip(), bool(data.get("encontrada_no_documento", True)), confidence, sources, True


@F.pandas_udf(PARSED)
def parse_answer(raw: pd.Series) -> pd.DataFrame:
    """Raw model output to answer fields; what isn't JSON becomes the answer's text with low confidence."""
    return pd.DataFrame([_parse(r) for r in raw], columns=["resposta", "encontrada_no_documento", "confianca", "fontes", "parse_ok"])


def needs_reprompt(parse_ok: Column, response: Column, found: Column, confidence: Column) -> Column:
    return ~parse_ok | (strip_all(F.coalesce(response, F.lit(""))) == "") | ~found | (confidence < LEAST_CONFIDENCE)


def second_wins(first_confidence: Column, second_confidence: Column, second_found: Column) -> Column:
    return (second_confidence >= first_confidence) & second_found


def _short(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def render(response: Column, sources: Column) -> Column:
    """Answer as markdown; a blank one is put together from its sources. sources: array<struct<section, excerpt>>."""
    said = strip_all(F.coalesce(response, F.lit("")))
    excerpts = F.filter(F.transform(sources, lambda s: strip_all(F.coalesce(s.excerpt, F.lit("")))), lambda t: t != "")
    made = F.concat(F.lit("Segundo o documento:\n\n"), F.array_join(F.transform(excerpts, lambda t: _short(t, 600)), "\n\n"))
    main = F.when(said != "", said).when(F.size(excerpts) > 0, made).otherwise("Não foi possível gerar resposta.")

    def line(s: Column) -> Column:
        label = F.when(F.coalesce(s.section, F.lit("")) == "", F.lit("(secção)")).otherwise(s.section)
        text = strip_all(F.coalesce(s.excerpt, F.lit("")))
        return F.concat(F.lit("\n- **"), label, F.lit("**"), F.when(text != "", F.concat(F.lit(": "), _short(text, 250))).otherwise(""))

    listed = F.when(F.size(sources) > 0, F.concat(F.lit("\n\nFontes (excertos):"), F.array_join(F.transform(sources, line), ""))).otherwise("")
    return F.concat(main, listed)


def doses_in(text: Column) -> Column:
    """Normalised doses per weight in a text, in order, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOSE), F.lit(0))

    def one(m: Column) -> Column:
        unit = F.replace(F.replace(F.lower(F.regexp_extract(m, DOSE, 2)), F.lit("µg"), F.lit("mcg")), F.lit("ug"), F.lit("mcg"))
        return F.concat(F.replace(F.regexp_extract(m, DOSE, 1), F.lit(","), F.lit(".")), F.lit(" "), unit, F.lit("/"), F.lower(F.regexp_extract(m, DOSE, 3)))

    return F.transform(found, one)


def invalid_doses(text: Column, allowed: Column, strict: bool = False) -> Column:
    """Doses of the text that the allowed list (normalised) lacks; the same number in another unit passes unless strict."""
    def known(d: Column) -> Column:
        same = F.array_contains(allowed, d)
        return same if strict else same | F.exists(allowed, lambda a: F.startswith(a, F.concat(F.substring_index(d, " ", 1), F.lit(" "))))

    return F.when(F.size(allowed) == 0, F.array().cast("array<string>")).otherwise(F.filter(doses_in(text), lambda d: ~known(d)))


def vague_marks(text: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(v) for v in VAGUE]), lambda v: F.contains(F.lower(text), v)))


def is_vague(text: Column, min_length: int = 80) -> Column:
    marks = vague_marks(text)
    return (marks >= 2) | ((marks >= 1) & (F.length(text) < min_length))


def has_specifics(text: Column) -> Column:
    return text.rlike(r"(?U)\d") | F.exists(F.array(*[F.lit(u) for u in SPECIFIC_UNITS]), lambda u: F.contains(F.lower(text), u))


def dose_answer(product: Column, species: Column, doses: Column) -> Column:
    """The answer put together from extracted doses alone."""
    head = F.concat(F.lit("Segundo o documento de "), product, F.coalesce(F.concat(F.lit(", para "), species), F.lit("")))
    many = F.concat(head, F.lit(", as doses indicadas são:\n"), F.array_join(F.transform(doses, lambda d: F.concat(F.lit("- "), d)), "\n"))
    return F.when(F.size(doses) == 1, F.concat(head, F.lit(", a dose indicada é "), F.get(doses, F.lit(0)), F.lit("."))).otherwise(many)


def provenance(product: Column, link: Column, others: Column) -> Column:
    """Footer naming the product consulted and, where given, other candidates."""
    foot = F.concat(F.lit("\n\n---\nMedicamento consultado: **"), product, F.lit("**"), F.coalesce(F.concat(F.lit("\n"), F.nullif(link, F.lit(""))), F.lit("")))
    return F.concat(foot, F.when(F.size(others) > 0, F.concat(F.lit("\n\n_(também encontrados: "), F.array_join(others, ", "), F.lit(")_"))).otherwise(""))


def prompt(question: Column, product: Column, species: Column, texts: Column, doses: Column | None = None) -> Column:
    """Prompt of the general path, or of the dose path where doses are given; the pluggable model defines its own instructions."""
    about = F.concat(F.lit("Medicamento: "), product, F.coalesce(F.concat(F.lit("\nEspécie-alvo: "), species), F.lit("")))
    listed = F.lit("") if doses is None else F.concat(F.lit("\n\nDoses: "), F.array_join(doses, "; "))
    return F.concat(about, listed, F.lit("\n\nContexto:\n"), F.array_join(texts, "\n\n---\n\n"), F.lit("\n\nPergunta: "), question)
