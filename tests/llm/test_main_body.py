import random

from bulaforge.llm.main_body import LIST, body, line_key, main_body, page_lines, span

FRAME = ["Política de privacidade e termos de utilização deste sítio", "Subscreva o boletim semanal e receba os alertas no seu correio."]


def page(rng, i, layout):
    word = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    main = [f"Produto{i}", "Posologia", word(25), word(30), "Conservação", word(20) + f" {i}"]
    nav = "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(["Início", "Contactos", "Ajuda"]))
    foot = "".join(f"<p>{t}</p>" for t in FRAME)
    box = '<div class="q"><h3>Mais lidos</h3><ul><li><a href="/m/1">Outro</a></li><li><a href="/m/2">Mais</a></li></ul></div>'
    inner = f"<h1>{main[0]}</h1><h2>{main[1]}</h2><p>{main[2]}</p>{box}<p>{main[3]}</p><h2>{main[4]}</h2><p>{main[5]}</p>"
    if layout == "text":
        return "\n".join(["Início", "Contactos", *main, *FRAME]), main
    if layout == "flat":
        return f"<html><body><p><a href='/'>Início</a> | <a href='/c'>Contactos</a></p>{inner}{foot}</body></html>", main
    return f"<html><head><title>x</title><script>if(a<b){{}}</script></head><body><nav><ul>{nav}</ul></nav><main>{inner}</main><footer>{foot}</footer></body></html>", main


WORDS = ["".join(random.Random(k).choice("abcdefghijlmnoprstuv") for _ in range(6)) for k in range(400)]


def test_bodies_of_three_layouts(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        html, main = page(rng, i, ["main", "flat", "text"][i % 3])
        rows.append((i, html, "x"))
        want[i] = set(main)
    rows += [(100, None, "x"), (101, "  ", "x"), (102, "<html><body><nav><a href=#>Início</a></nav><p>Página não encontrada</p></body></html>", "x"), rows[0]]
    df = spark.createDataFrame(rows, "id int, page string, block string")
    got = {}
    for r in main_body(df, "id", "page").collect():
        assert r["block"] not in got.setdefault(r["id"], set())
        got[r["id"]].add(r["block"])
    assert got == want
    assert main_body(df.limit(0), "id", "page").count() == 0


def test_lines_of_a_page():
    texts, bits, _ = page_lines("<div>um&nbsp; <b>d</b>ois<br>três<p>quatro</div><!-- > x --><ul><li>cinco<li>seis</ul><td>sete")
    assert texts == ["um dois três", "quatro", "cinco", "seis", "sete"] and [bool(b & LIST) for b in bits] == [False, False, True, True, True]
    assert page_lines("a < 5 mg\n\n b ")[0] == ["a < 5 mg", "b"]
    assert page_lines("") == ([], [], [])
    assert len(page_lines("<p>" + "x" * 500_000)[0]) == 1


def test_span_and_keys():
    assert span([]) is None and span([10, 10]) is None
    assert span([5, 0, 100, 90, 0, 80, 0, 0, 0, 3]) == (0, 5)
    assert line_key("Linha 800 de Zirovet 5") == line_key("Linha 12 de Outrovet 7")
    assert body([], [], {}, set()) == []


def test_the_dive_decides_where_the_body_ends(spark):
    """One page alone: nothing recurs, no element is a frame, only the lengths tell."""
    long = "a dose recomendada para este animal é dada ao longo de todo o dia " * 3
    page = "<div>" + "".join(f"<p>n{i}</p>" for i in range(9)) + f"<p>{long}</p><p>{long}fim</p>" + "".join(f"<p>{w}</p>" for w in WORDS[:12]) + "</div>"
    got = [r["block"] for r in main_body(spark.createDataFrame([(1, page)], "id int, page string"), "id", "page").collect()]
    assert {long.strip(), f"{long}fim"} <= set(got) and not set(got) & set(WORDS[3:12]) and not set(got) & {f"n{i}" for i in range(7)}


def test_short_text_after_the_dive_is_left_out(spark):
    want, rows = {}, []
    for i in range(2):
        main = [f"Produto{i}", "Posologia", "a dose " * 20 + str(i), "b", "Conservar ao abrigo da luz e do calor, " * 3 + str(i)]
        table = "".join(f"<tr><td>{WORDS[9 * i + k]}</td></tr>" for k in range(5))
        box = '<ul><li><a href="/m">Outros produtos</a></li></ul>'
        html = f"<h1>{main[0]}</h1><h2>{main[1]}</h2><p>{main[2].strip()}</p>{box}<p>{main[3]}</p><p>{main[4]}</p>{box}<table>{table}</table>"
        rows.append((i, f"<html><body>{html}{box}<p>Sede: Rua {'xy'[i]}</p><p>Linha {'ab'[i]}</p></body></html>"))
        want[i] = {*main, *WORDS[9 * i : 9 * i + 5]}
    got = {}
    for r in main_body(spark.createDataFrame(rows, "id int, page string"), "id", "page").collect():
        got.setdefault(r["id"], set()).add(r["block"])
    assert got == want


def test_recurring_headings_of_pages_without_h1(spark):
    rows, want = [], {}
    for i in range(6):
        main = [f"Produto{i}", "Posologia", ("dose " + WORDS[i] + " ") * 12 + "fim", "Conservar no frio", ("guardar " + WORDS[i] + " ") * 12 + "fim"]
        inner = f"<h2>{main[0]}</h2><h3>{main[1]}</h3><p>{main[2]}</p><h3>{main[3]}</h3><p>{main[4]}</p>"
        rows.append((i, f"<html><body><nav><a href='/'>Início</a></nav><div class='a'><div class='b'>{inner}</div></div><footer><p>{FRAME[0]}</p></footer></body></html>"))
        want[i] = set(main)
    got = {}
    for r in main_body(spark.createDataFrame(rows, "id int, page string"), "id", "page").collect():
        got.setdefault(r["id"], set()).add(r["block"])
    assert got == want
