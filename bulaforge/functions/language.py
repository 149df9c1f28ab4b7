"""Language identification by shares of frequent words, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulaforge.functions.dimensions import LANGUAGE_WORDS, PORTUGUESE_HINTS
from bulaforge.functions.text import fold

# Shares that decide, and the scripts that are told apart from Latin.
FOREIGN_SHARE, PORTUGUESE_SHARE, SHORT_WORDS = 0.12, 0.05, 4
_OTHER_SCRIPT = r"[Ѐ-ӿ؀-ۿऀ-ॿ一-鿿぀-ゟ゠-ヿ가-힯]"


def words(text: Column) -> Column:
    """Distinct words: the accented runs together with the folded runs."""
    accented = F.regexp_extract_all(F.lower(text), F.lit("[a-záàâãéêíóôõúüç']+"), F.lit(0))
    plain = F.regexp_extract_all(fold(text), F.lit("[a-z']+"), F.lit(0))
    return F.array_distinct(F.concat(accented, plain))


def _let(value: Column, body) -> Column:
    """body over a value that is evaluated once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _share(found: Column, listed: list[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in dict.fromkeys(listed)]))) / F.greatest(F.size(found), F.lit(1))


def detect(text: Column) -> Column:
    """Label of the language; `indefinido` for null and blank text, `cjk` for any other script."""
    names = F.array(*[F.lit(name) for name, _ in LANGUAGE_WORDS])
    n_words = F.size(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0)))

    def by_shares(shares: Column) -> Column:
        foreign, portuguese = F.slice(shares, 1, len(LANGUAGE_WORDS)), F.get(shares, F.lit(len(LANGUAGE_WORDS)))
        best = F.array_max(foreign)
        first = F.get(names, F.array_position(foreign, best).cast("int") - 1)
        return F.when((best > FOREIGN_SHARE) & (best > portuguese), first).when((portuguese >= PORTUGUESE_SHARE) | (n_words <= SHORT_WORDS), "portugues").otherwise("outro")

    def by_words(found: Column) -> Column:
        return _let(F.array(*[_share(found, listed) for _, listed in LANGUAGE_WORDS], _share(found, PORTUGUESE_HINTS)), by_shares)

    blank = text.isNull() | ~text.rlike(r"[^\s\u00a0]")
    return F.when(blank, "indefinido").when(text.rlike(_OTHER_SCRIPT), "cjk").otherwise(_let(words(text), by_words))


def guard(text: Column) -> tuple[Column, Column]:
    """(accepted, reason) of the policy that answers are in Portuguese."""
    judged = judge(text)
    return judged.getField("accepted"), judged.getField("reason")


def judge(text: Column) -> Column:
    """STRUCT of label, accepted and reason."""

    def of(label: Column) -> Column:
        reason = F.when(label == "portugues", "ok").when(label == "indefinido", "indefinido (texto curto)").otherwise(F.concat(F.lit("detectado="), label))
        return F.struct(label.alias("label"), label.isin("portugues", "indefinido").alias("accepted"), reason.alias("reason"))

    return _let(detect(text), of)
