import random
import re

from bulaforge.llm.split_long import SplitRule, boundary_level, split_oversized, split_text


def plain_level(text, limit):
    steps = [("paragraph", r"\n[^\S\n]*\n\s*"), ("line", r"\n"), ("sentence", r"(?<=[.!?])\s+|\n"), ("word", r"\s+")]
    return next((n for n, p in steps if all(len(x.strip()) <= limit for x in re.split(p, text))), "char")


def test_pieces_cover_fit_and_overlap():
    rng = random.Random(4)
    rule = SplitRule(limit=120, overlap=20)
    for _ in range(300):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.choice([2, 5, 9, 150 if rng.random() < 0.02 else 4]))) for _ in range(rng.randrange(1, 160))]
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for w in words)
        pieces = list(split_text(text, rule))
        assert boundary_level(text, rule.limit) == plain_level(text, rule.limit)
        covered = set()
        for (a, b, _), nxt in zip(pieces, [*pieces[1:], None]):
            assert 0 < b - a <= rule.limit
            covered |= set(range(a, b))
            if nxt:
                assert a < nxt[0] and b - nxt[0] <= rule.overlap and nxt[1] > b
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_levels_rows_and_edges(spark):
    long = "x" * 5000
    rows = [("t", "a", "p. " * 900), ("t", "b", long), ("t", "c", "curto"), ("t", "d", None), ("t", "e", ""), ("t", "f", " " * 3000), ("t", "b", long), ("t", "g", ("linha " * 200 + "\n") * 3), ("t", "h", ("é" * 1999 + "\n\n") * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "tbl string, key string, text string, piece int")
    got = split_oversized(df, SplitRule()).collect()
    assert {(r["item_key"], r["boundary"]) for r in got} == {("a", "sentence"), ("b", "char"), ("f", "paragraph"), ("g", "line"), ("h", "paragraph")}
    assert [len(r["piece"]) for r in got if r["item_key"] == "b"] == [2000, 2000, 1400]
    assert [r["piece"] for r in got if r["item_key"] == "f"] == [None]
    assert split_oversized(df.limit(0), SplitRule()).count() == 0


def test_a_change_of_topic_is_where_it_cuts():
    first, second = "gato felino rato leite. " * 30, "motor pneu travão óleo. " * 30
    a, b, _ = next(iter(split_text(first + second, SplitRule(limit=1000, overlap=0))))
    assert abs(b - len(first)) < 30
