"""Rule-based entities of questions: species, topic, form, product, search term, category."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulaforge.functions import dimensions as D


def _word(*alternatives: str) -> str:
    """Pattern of whole words, letters with accents counted as letters."""
    return r"(?iU)\b(?:" + "|".join(re.escape(a) for a in alternatives) + r")\b"


def normalize_species(text: Column) -> Column:
    """Every synonym by its canonical name, word-bounded, in any case."""
    for canonical, synonyms in D.SPECIES:
        text = F.regexp_replace(text, _word(*synonyms), canonical)
    return text


def find_species(text: Column) -> Column:
    """Canonical name of the first synonym in list order (not in text order)."""
    return F.coalesce(*[F.when(F.lower(text).rlike(_word(*synonyms)), F.lit(canonical)) for canonical, synonyms in D.SPECIES])


def topic(text: Column) -> Column:
    """First topic in declared order with a word-bounded keyword, else the general one."""
    found = [F.when(text.rlike(_word(*keywords)), F.lit(name)) for name, keywords, _ in D.TOPICS]
    return F.coalesce(*found, F.lit(D.GENERAL))


def form(text: Column) -> Column:
    """First form that occurs anywhere in the text, also inside a word; capitalised."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(f)), F.lit(f.capitalize())) for f in D.FORMS])


# Patterns of question tails, product names and strengths whose matches must agree with the published behaviour.
_TAIL = r"(?iU)\s+(?:em|para|de|do|da|com|a|o)\s+\w+.*$"
_ENDS = r"^[ ?.,;:]+|[ ?.,;:]+$"


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def alternative_of(text: Column) -> Column:
    """The product a question asks alternatives to; null if it asks none."""
    links = r"\s+(?:ao|para|do)\s+"
    heads = [rf"alternativ[oa]s?{links}", rf"substitut[oa]s?{links}", rf"equivalente{links}", rf"similar{links}", r"mesmo\s+princípio\s+ativo\s+que\s+(?:o\s+medicamento\s+)?"]
    out = []
    for head in heads:
        got = F.trim(_captured(text, rf"(?iU){head}(.+?)(?:\s+para|\s+em|$)"))
        got = F.regexp_replace(got, r"(?iU)\s+(?:para|em|indicado)\b.*$", "")
        out.append(F.nullif(F.regexp_replace(got, _ENDS, ""), F.lit("")))
    return F.coalesce(*out)


_STRENGTH = r"(?:[\-/]\d+(?:[.,]\d+)?(?:\s*(?:mg|ml|g|mcg|%)(?:/(?:ml|kg|g))?)?)*"
_NAMED = rf"^([A-ZÀ-Ú][A-Za-zÀ-Úà-ú\-]+{_STRENGTH}(?:\s+[A-ZÀ-Ú0-9][A-Za-zÀ-Úà-ú0-9\-]*{_STRENGTH}){{0,5}})"
_CAPITALISED = (
    r"(?U)\b[A-ZÀ-Ú][A-ZÀ-Úa-zà-ú\-]{2,}(?:\s+[A-ZÀ-Ú][A-ZÀ-Úa-zà-ú\-]+)*(?:\s+(?:PÓ|Pó|SOLUÇÃO|Solução|COMPRIMIDO|Comprimido|INJETÁVEL|Injetável))?"
    r"(?:\s+\d+(?:[.,]\d+)?%?(?:\s*(?:mg|ml|g|mcg)(?:/(?:ml|kg|g))?)?)*"
)


def product(text: Column) -> Column:
    """The product named after "o medicamento", else the first capitalised run that is no common word."""
    after = _captured(text, r"(?iUs)\b(?:o|do|no|ao|de|para|com)\s+medicamento\s+(.*)$")
    named = F.regexp_replace(_captured(after, _NAMED), _ENDS, "")
    named = F.nullif(F.regexp_replace(F.regexp_replace(named, _TAIL, ""), _ENDS, ""), F.lit(""))
    runs = F.transform(F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(0)), F.trim)
    runs = F.filter(runs, lambda r: ~F.lower(r).isin(D.NOT_A_PRODUCT) & (F.length(r) >= 3))
    return F.coalesce(named, F.get(runs, F.lit(0)))


def search_term(text: Column, named: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(named, F.trim(text)), _TAIL, ""))


def entities(text: Column) -> Column:
    """STRUCT of search term, product, substance, species, form and topic of a question."""
    reference = alternative_of(text)
    named = product(text)
    chosen = F.coalesce(reference, named)
    return F.struct(
        F.coalesce(reference, search_term(text, named)).alias("search_term"), chosen.alias("product"), chosen.alias("substance"),
        find_species(text).alias("species"), form(text).alias("form"), topic(text).alias("topic"),
    )


def has_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def category(text: Column, named: Column) -> tuple[Column, Column, Column]:
    """(category, confidence, via): rules in order; without a rule the fallback of an absent model."""
    low = F.lower(text)
    plural, singular = low.rlike(r"(?U)\bque\s+medicamentos\b"), low.rlike(r"(?U)\bque\s+medicamento\s+")
    compared = has_any(low, D.COMPARISON) & ~(singular & ~plural)
    by_name = low.rlike(r"(?U)\b(?:o|do|no|ao|de|para|com)\s+medicamento\s+\w+")
    phrase = has_any(low, D.ONE_PRODUCT) & named.isNotNull()
    confidence = F.when(compared | by_name, 0.95).when(phrase, 0.9).when(named.isNotNull(), 0.7).otherwise(0.3)
    via = F.when(compared | by_name | named.isNotNull(), "rules").otherwise("fallback")
    return F.when(compared, "comparacao").otherwise("medicamento"), confidence, via


def asks_alternative(text: Column) -> Column:
    return has_any(F.lower(text), ["alternativ", "substitut", "equivalente", "mesmo princípio ativo"])


def alternative_kind(text: Column) -> Column:
    """Kind of alternative a comparison asks for."""
    low = F.lower(text)
    kinds = [("alternativ", "alternativo"), ("substitut", "substituto"), ("equivalente", "equivalente")]
    return F.coalesce(*[F.when(F.contains(low, F.lit(mark)), F.lit(kind)) for mark, kind in kinds], F.lit("mesmo princípio ativo"))


_PLACE = r"(?iU)\b(?:em|para)\s+(?:suínos|bovinos|equinos|cães|gatos|aves|perus?|coelhos|ovinos|caprinos)\b"
SHORT_TURN = 5


def _opening(now: Column) -> Column:
    """Beginning of a question on a topic; null for the general one."""
    known = [F.when(now == t, F.lit(o)) for t, o in D.FOLLOW_UP_OPENING.items()]
    return F.when(now != D.GENERAL, F.coalesce(*known, F.lit("Informação sobre ")))


def around_place(query: Column) -> tuple[Column, Column]:
    """What stands before and after the place of a species in a question; without one its end, where a species may be added."""
    named = query.rlike(_PLACE)
    head = F.when(named, F.regexp_extract(query, rf"(?s)^(.*?){_PLACE}", 1)).otherwise(F.concat(F.regexp_replace(query, r"\?+$", ""), F.lit(" ")))
    return head, F.when(named, F.regexp_extract(query, rf"(?s)^.*?{_PLACE}(.*)$", 1)).otherwise("?")


def turn_features(text: Column) -> Column:
    """STRUCT of what a turn says by itself: all that a conversation needs to be carried on."""
    said = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    head, tail = around_place(text)
    return F.struct(
        F.when(F.trim(text) != "", text).alias("said"), head.alias("head"), tail.alias("tail"), product(text).alias("product"), find_species(text).alias("species"),
        topic(text).alias("topic"), _opening(topic(text)).alias("opening"), (F.size(said) <= SHORT_TURN).alias("brief"),
        F.arrays_overlap(said, F.array(*[F.lit(w) for w in D.SHORT_FOLLOW_UP])).alias("cue"),
    )


def follow_up(query: Column, last_query: Column, last_product: Column, last_topic: Column) -> Column:
    """The full question a short follow-up stands for; null if it is none."""
    said = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    species, now = find_species(query), topic(query)
    changed = (now != D.GENERAL) & ~now.eqNullSafe(last_topic)
    short = (F.size(said) <= SHORT_TURN) & (F.coalesce(last_query, F.lit("")) != "") & (F.coalesce(last_product, F.lit("")) != "")
    marked = species.isNotNull() | changed | F.arrays_overlap(said, F.array(*[F.lit(w) for w in D.SHORT_FOLLOW_UP]))
    about = F.concat(_opening(now), last_product, F.coalesce(F.concat(F.lit(" para "), species), F.lit("")), F.lit("?"))
    head, tail = around_place(last_query)
    rewritten = F.when(now != D.GENERAL, about).when(species.isNotNull(), F.concat(head, F.lit("para "), species, tail)).otherwise(last_query)
    return F.when(short & marked, rewritten)
