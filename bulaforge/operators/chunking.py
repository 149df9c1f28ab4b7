"""Cleaning, sectioning and chunking of leaflet text; folds run natively, header positions through Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulaforge.functions.text import strip_all

# Sizes of paragraphs, packs and overlap, and patterns of section headers.
LONG_PARAGRAPH, SENTENCE_PACK = 2000, 1500
TARGET, OVERLAP, TINY = 1400, 320, 160
#: The marks around a table in page text.
TABLE = r"(?iuU)\[tabela página (\d+)\]\n([\s\S]*?)((?-i:\[/Tabela\])|\z)"
_HEADERS = {
    False: re.compile(r"(?m)^\s*(?P<num>\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+(?P<title>[^\n]{2,200})$"),
    True: re.compile(r"(?m)^(?P<num>\d+(?:\.\d+)*)\.\s+(?P<title>[^\n]{2,120})$"),
}


def clean(text: Column) -> Column:
    """Page boilerplate and page footers dropped, blank lines and blanks squeezed, ends trimmed."""
    t = F.regexp_replace(text, r"(?s)\nDireção Geral de Alimentação e Veterinária.*?Página \d+ de \d+ \n", "")
    t = F.regexp_replace(t, r"(?mU)^\s*Página \d+ de \d+\s*$", "")
    return strip_all(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), " {2,}", " "))


def sections(pages: DataFrame, key: str, text: str, strict: bool = False, keep_preface: bool = False) -> DataFrame:
    """(key, sec_ord, number, title, body, has_table): the numbered sections of each text.

    Without a header the text is one section with empty number and title. Text before the
    first header is dropped, or kept as section "" with `keep_preface`."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                t = t or ""
                heads = [(m.start(), m.end(), m["num"], m["title"].strip()) for m in _HEADERS[strict].finditer(t)]
                stops = [h[0] for h in heads[1:]] + [len(t)]
                found = [(num, title, t[end:stop].strip()) for (_, end, num, title), stop in zip(heads, stops)]
                if not heads:
                    found = [("", "", t.strip())]
                elif keep_preface and t[: heads[0][0]].strip():
                    found = [("", "", t[: heads[0][0]].strip()), *found]
                rows += [(k, i, *f, "[Tabela" in f[2]) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "sec_ord", "number", "title", "body", "has_table"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, text).mapInPandas(split, f"{key} {kind}, sec_ord int, number string, title string, body string, has_table boolean")


def tables_of(body: Column) -> Column:
    """ARRAY<STRUCT<page, text>> of the marked tables; an unclosed one takes the rest."""
    found = F.regexp_extract_all(body, F.lit(TABLE), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, TABLE, 1).cast("int").alias("page"), strip_all(F.regexp_extract(t, TABLE, 2)).alias("text")))


def without_tables(body: Column) -> Column:
    return strip_all(F.regexp_replace(body, TABLE, ""))


def paragraphs(text: Column) -> Column:
    """Paragraphs at blank lines; one of more than LONG_PARAGRAPH characters as packs of sentences."""
    parts = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip_all), lambda p: p != "")
    zero = F.expr("cast(struct(array(), '') as struct<o:array<string>,b:string>)")

    def pack(acc: Column, s: Column) -> Column:
        fits = F.length(acc.b) + F.length(s) + 1 <= SENTENCE_PACK
        grown = F.when(acc.b == "", s).otherwise(strip_all(F.concat(acc.b, F.lit(" "), s)))
        done = F.when(fits | (acc.b == ""), acc.o).otherwise(F.concat(acc.o, F.array(acc.b)))
        return F.struct(done.alias("o"), F.when(fits, grown).otherwise(s).alias("b"))

    def split_long(p: Column) -> Column:
        packed = F.aggregate(F.split(p, r"(?U)(?<=[.!?])\s+"), zero, pack, lambda a: F.when(a.b == "", a.o).otherwise(F.concat(a.o, F.array(a.b))))
        return F.when(F.length(p) <= LONG_PARAGRAPH, F.array(p)).otherwise(packed)

    return F.flatten(F.transform(parts, split_long))


def packed(parts: Column, target: int = TARGET, overlap: int = OVERLAP, tiny: int = TINY) -> Column:
    """Paragraphs packed up to target characters, each pack beginning with the tail of the one before; tiny packs join the one before."""
    zero = F.expr("cast(struct(array(), '') as struct<o:array<string>,b:string>)")

    def grow(acc: Column, p: Column) -> Column:
        fits = F.length(acc.b) + F.length(p) + 1 <= target
        tail = F.when(F.length(acc.b) > overlap, F.substring(acc.b, -overlap, overlap)).otherwise(acc.b) if overlap > 0 else F.lit("")
        fresh = strip_all(F.concat(tail, F.lit("\n\n"), p)) if overlap > 0 else p
        buffer = F.when(acc.b == "", p).when(fits, F.concat(acc.b, F.lit("\n\n"), p)).otherwise(fresh)
        return F.struct(F.when((acc.b == "") | fits, acc.o).otherwise(F.concat(acc.o, F.array(acc.b))).alias("o"), buffer.alias("b"))

    folded = F.aggregate(parts, zero, grow, lambda a: F.when(a.b == "", a.o).otherwise(F.concat(a.o, F.array(a.b))))

    def absorb(acc: Column, c: Column) -> Column:
        join = (F.length(c) < tiny) & (F.size(acc) > 0)
        last = F.concat(F.get(acc, F.size(acc) - 1), F.lit("\n\n"), c)
        return F.when(join, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(folded, F.array().cast("array<string>"), absorb)


def chunks(secs: DataFrame, keys: list[str], number: str, title: str, body: str) -> DataFrame:
    """(keys…, number, title, paragraph_idx, is_table, page, text): tables first with index -1, then the packs from 0."""
    own = [*keys, F.col(number).alias("section_num"), F.col(title).alias("section_title")]
    text = F.coalesce(F.col(body), F.lit(""))
    tabs = secs.select(*own, F.explode(tables_of(text)).alias("t")).select(
        *keys, "section_num", "section_title", F.lit(-1).alias("paragraph_idx"), F.lit(True).alias("is_table"), F.col("t.page").alias("page"), F.col("t.text").alias("text")
    )
    packs = secs.select(*own, F.posexplode(packed(paragraphs(without_tables(text)))).alias("paragraph_idx", "text")).select(
        *keys, "section_num", "section_title", "paragraph_idx", F.lit(False).alias("is_table"), F.lit(None).cast("int").alias("page"), "text"
    )
    return tabs.unionByName(packs)


def rendered(number: Column, title: Column, is_table: Column, text: Column) -> Column:
    """Chunk text with its section and table header lines."""
    head = F.when((number != "") | (title != ""), F.concat(F.lit("[Secção "), F.trim(F.concat_ws(" ", number, title)), F.lit("]\n"))).otherwise("")
    return F.concat(head, F.when(is_table, F.lit("[Tabela]\n")).otherwise(""), text)
