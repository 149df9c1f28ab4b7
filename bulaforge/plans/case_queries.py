"""Operators on stated rows whose results are known beforehand.

The tables of the project hold few rows that reach every branch of an operator. Each query
here applies an operator to a list of stated rows; its SQL states the results as VALUES.
The same operators run over the whole tables in reference_queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulaforge.functions import answers as A
from bulaforge.functions import entities as E
from bulaforge.functions import language
from bulaforge.operators import chunking, compare, doses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


def _cases(name: str, schema: str, made: Callable[[DataFrame], DataFrame], columns: str, rows: list[tuple[tuple, tuple]]) -> None:
    """Register `made` over the inputs of rows(input, results…); `columns` names the results after the case number."""
    names = ["case_no", *columns.split()]

    def run(s: SparkSession, b: str) -> DataFrame:
        given = s.createDataFrame([(i, *x) for i, (x, *_) in enumerate(rows)], f"case_no int, {schema}")
        return made(given).select(*names)

    QUERIES[name] = run
    values = ", ".join("(" + ", ".join(_literal(v) for v in (i, *y)) + ")" for i, (_, *results) in enumerate(rows) for y in results)
    SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(names)})"


def _column(made: Callable[[], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    """The columns are built when the query runs: they need a session."""
    return lambda df: df.withColumns(made())


_cases(
    "species_normalize_cases", "t string", _column(lambda: dict(said=E.normalize_species(F.col("t")), first=E.find_species(F.col("t")))), "said first",
    [
        (("Dose para porcos",), ("Dose para suínos", "suínos")), (("VACAS e cavalos",), ("bovinos e equinos", "bovinos")), (("gatinhos",), ("gatos", "gatos")),
        (("sem nada",), ("sem nada", None)), (("avestruz",), ("avestruz", None)), (("gato e porco",), ("gatos e suínos", "suínos")),
    ],
)



def _entities() -> dict[str, Column]:
    e = E.entities(F.col("t"))
    return {name: e.getField(name) for name in ("product", "species", "topic", "search_term")}


_cases(
    "entity_extract_cases", "t string", _column(_entities), "product species topic search_term",
    [
        (("Qual a dose do Zirovet em cães?",), ("Zirovet", "cães", "dose", "Zirovet")), (("Posso dar o medicamento Zirovet a gatos?",), ("Zirovet", "gatos", "geral", "Zirovet")),
        (("como armazenar?",), (None, None, "armazenamento", "como armazenar?")), (("Que alternativa ao Zirovet para bovinos",), ("Zirovet", "bovinos", "geral", "Zirovet")),
    ],
)

_cases(
    "intent_rules_cases", "t string", _column(lambda: dict(zip(("category", "sure", "via"), E.category(F.col("t"), E.product(F.col("t")))))), "category sure via",
    [
        (("Que medicamentos existem para cães",), ("comparacao", 0.95, "rules")), (("alternativa ao Zirovet",), ("comparacao", 0.95, "rules")),
        (("Qual a dose do Zirovet",), ("medicamento", 0.9, "rules")), (("dose do medicamento xis",), ("medicamento", 0.95, "rules")),
        (("Zirovet",), ("medicamento", 0.7, "rules")), (("olá",), ("medicamento", 0.3, "fallback")), (("Que medicamento é o Zirovet similar",), ("medicamento", 0.7, "rules")),
    ],
)

_cases(
    "alternative_kind_cases", "t string", _column(lambda: dict(asks=E.asks_alternative(F.col("t")), kind=E.alternative_kind(F.col("t")))), "asks kind",
    [
        (("Uma alternativa ao Xis",), (True, "alternativo")), (("substituto do Xis",), (True, "substituto")), (("equivalente ao Xis",), (True, "equivalente")),
        (("mesmo princípio ativo que Xis",), (True, "mesmo princípio ativo")), (("dose do Xis",), (False, "mesmo princípio ativo")),
    ],
)

_cases(
    "followup_rewrite_cases", "q string, lq string, p string, tp string", _column(lambda: dict(rewritten=E.follow_up(F.col("q"), F.col("lq"), F.col("p"), F.col("tp")))), "rewritten",
    [
        (("E para gatos?", "Qual a dose do Zirovet em cães?", "Zirovet", "dose"), ("Qual a dose do Zirovet para gatos?",)), (("E para gatos?", "Qual a dose do Zirovet?", "Zirovet", "dose"), ("Qual a dose do Zirovet para gatos?",)),
        (("e a composição?", "Qual a dose do Zirovet?", "Zirovet", "dose"), ("Qual a composição do Zirovet?",)), (("E para gatos?", None, None, None), (None,)),
        (("uma pergunta com mais de cinco palavras", "Qual a dose do Zirovet?", "Zirovet", "dose"), (None,)),
    ],
)

_cases(
    "parse_answer_cases", "raw string", lambda df: df.withColumn("p", A.parse_answer(F.col("raw"))).select("case_no", F.col("p.resposta").alias("said"), F.col("p.encontrada_no_documento").alias("found"), F.col("p.confianca").alias("sure"), "p.parse_ok"), "said found sure parse_ok",
    [
        (('{"resposta": "A", "encontrada_no_documento": true, "confianca": 0.9}',), ("A", True, 0.9, True)), (('```json\n{"resposta": "B", "confianca": 2}\n```',), ("B", True, 1.0, True)),
        (("{“resposta”: “C”,}",), ("C", True, 0.5, True)), (("texto livre",), ("texto livre", False, 0.2, False)), (("",), (A.NOT_FOUND, False, 0.0, False)), ((None,), (A.NOT_FOUND, False, 0.0, False)),
        (('Aqui está: {"resposta": "D", "encontrada_no_documento": false} fim',), ("D", False, 0.5, True)),
    ],
)

_cases(
    "dose_validate_cases", "t string, allowed array<string>", _column(lambda: dict(lenient=A.invalid_doses(F.col("t"), F.col("allowed")), strict=A.invalid_doses(F.col("t"), F.col("allowed"), strict=True))), "lenient strict",
    [
        (("dar 5 mg/kg", ["5 mg/kg"]), ([], [])), (("dar 7 mg/kg ou 5 mg / kg", ["5 mg/kg"]), (["7 mg/kg"], ["7 mg/kg"])),
        (("dar 5 ml/kg", ["5 mg/kg"]), ([], ["5 ml/kg"])), (("dar 9 mg/kg", []), ([], [])), (("sem dose", ["5 mg/kg"]), ([], [])),
    ],
)

_cases(
    "language_cases", "t string", _column(lambda: dict(label=language.detect(F.col("t")))), "label",
    [
        (("A dose do medicamento é de 5 mg para cães.",), ("portugues",)), (("The dose for this species should be indicated with the storage information.",), ("ingles",)), (("",), ("indefinido",)),
        (("药物的剂量",), ("cjk",)), (("sim",), ("portugues",)),
    ],
)

_cases(
    "substances_parse_cases", "t string", _column(lambda: dict(substances=compare.substances_of(F.col("t")))), "substances",
    [
        (("Substância Ativa: Amoxicilina 50 mg | Espécie: cães",), (["Amoxicilina"],)), (("Substância(s) Ativa(s): Xaina 5 mg/ml | Yona 2,5 mg",), (["Xaina", "Yona"],)), (("Titular: Lab",), ([],)),
    ],
)

_cases(
    "answer_text_cases", "product string, species string, doses array<string>", _column(lambda: dict(text=A.dose_answer(F.col("product"), F.col("species"), F.col("doses")))), "text",
    [
        (("Zirovet", "cães", ["5 mg/kg"]), ("Segundo o documento de Zirovet, para cães, a dose indicada é 5 mg/kg.",)),
        (("Zirovet", None, ["5 mg/kg", "7 mg/kg"]), ("Segundo o documento de Zirovet, as doses indicadas são:\n- 5 mg/kg\n- 7 mg/kg",)),
    ],
)

_cases(
    "section_split_cases", "t string", lambda df: chunking.sections(df, "case_no", "t"), "sec_ord number title body",
    [
        (("4.1 Espécies-alvo\nCães e gatos.\n4.2 Indicações\nDor.",), (0, "4.1", "Espécies-alvo", "Cães e gatos."), (1, "4.2", "Indicações", "Dor.")),
        (("sem cabeçalhos",), (0, "", "", "sem cabeçalhos")), (("",), (0, "", "", "")),
    ],
)

_cases(
    "table_extract_cases", "t string", lambda df: df.select("case_no", F.posexplode(chunking.tables_of(F.col("t"))).alias("n", "x"), chunking.without_tables(F.col("t")).alias("rest")).select("case_no", "n", "x.page", "x.text", "rest"), "n page text rest",
    [(("antes\n[Tabela página 3]\na | b\n[/Tabela]\ndepois",), (0, 3, "a | b", "antes\n\ndepois")), (("[Tabela página 7]\nc | d",), (0, 7, "c | d", ""))],
)

_cases(
    "dose_context_cases", "t string, sp string", lambda df: doses.extract(df, ["case_no"], ["t"], "t", species=F.col("sp")), "ord display contexto",
    [(("Dar 5 mg/kg aos cães.", "cães"), (1, "5 mg/kg", "Dar 5 mg/kg aos cães.")), (("Dar 5 mg/kg aos cães.", "gatos"),), (("Usar 1,5 ml / kg\ne 2 mg/kg", None), (1, "1.5 ml/kg", "Usar 1,5 ml / kg e 2 mg/kg"), (2, "2 mg/kg", "Usar 1,5 ml / kg e 2 mg/kg"))],
)

_ITEM = "array<struct<name:string,species:string,form:string,link:string>>"
_one, _two = ("Xis", "cães", None, "l1"), ("Ypsilon", None, "gel", None)
_cases(
    "comparison_text_cases", f"ref string, kind string, species string, known boolean, per array<struct<substance:string,items:{_ITEM}>>",
    _column(lambda: dict(text=compare.answer_text(F.col("ref"), F.col("kind"), F.col("species"), F.col("known"), F.col("per")))), "text",
    [
        ((None, "alternativo", None, True, []), ("Não foi possível identificar o medicamento de referência.",)), (("Z", "alternativo", None, False, []), ("Não foi possível encontrar informações sobre 'Z'.",)),
        (("Z", "alternativo", None, True, []), ("Não foi possível identificar substâncias activas de 'Z'.",)), (("Z", "alternativo", None, True, [("a", [])]), ("Apenas 'Z' foi encontrado com 'a'.",)),
        (("Z", "alternativo", None, True, [("a", []), ("b", [])]), ("Não foram encontrados medicamentos alternativos para nenhuma das substâncias de 'Z'.",)),
        (("Z", "substituto", "cães", True, [("a", [_one])]), ("**Medicamentos substitutos do Z:**\n\nPrincípio activo: a\nEspécie: cães\n\nMedicamentos encontrados (1):\n\n1. **Xis**\n   - Espécies: cães\n   - Link: l1\n\nTotal: 1 medicamentos alternativos.",)),
        (
            ("Z", "outro", None, True, [("a", [_two]), ("b", [])]),
            ("**Medicamentos com mesmo princípio activo que Z:**\n\nZ contém múltiplas substâncias activas:\n  - a\n  - b\n\n## 1. a\n1 medicamento(s):\n  1. **Ypsilon**\n     - Forma: gel\n\n## 2. b\nNenhum medicamento adicional encontrado.\n\nTotal: 1 medicamentos alternativos em 1 substância(s).",),
        ),
    ],
)
