"""Text folding, tokens and cache keys as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâãäåāăąéèêëēĕėęěíìîïīĭįóòôõöōŏőúùûüūŭůűçćĉċčñńņňýÿšśŝşžźżğģ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiioooooooouuuuuuuucccccnnnnyysssszzzgg"
# Stop words and the least length of a token.
STOP_WORDS = [
    "a", "o", "as", "os", "de", "da", "do", "das", "dos", "em", "para", "com", "por", "que", "é", "são", "no", "na", "nos", "nas", "um",
    "uma", "se", "ao", "à", "às", "aos", "ou", "e", "mas", "como",
]
MIN_TOKEN = 3
#: Those that a folded token of that length can equal.
DROPPED = [w for w in STOP_WORDS if w.isascii() and len(w) >= MIN_TOKEN]


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded letter-digit runs of three or more characters that are no stop words, in order, repeats kept."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(DROPPED))


def squeeze(text: Column) -> Column:
    """Trimmed, folded, runs of white space as one blank."""
    return F.trim(F.regexp_replace(fold(text), r"[\s\u00a0]+", " "))


def cache_key(namespace: str, *parts: Column) -> Column:
    """namespace:sha1 of the JSON array of the squeezed parts, written with ", " between them."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(squeeze(p), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.concat(F.lit(f"{namespace}:"), F.sha1(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))))


def strip_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A[\s\u00a0]+|[\s\u00a0]+\z", "")
