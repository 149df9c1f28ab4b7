import random

import pytest

from bulaforge.llm.shared_spans import COVER, PERIOD, difference_cover, shared_chars


def brute(rows, n):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    out = {}
    for i, t in rows:
        covered = [False] * len(t or "")
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                covered[k : k + n] = [True] * n
        if any(covered):
            out[i] = sum(covered)
    return out


@pytest.mark.parametrize("n", [200, 60])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    new = lambda m: "".join(rng.choice("abcdé ç\n😀") for _ in range(m))
    texts = [new(rng.randrange(0, 900)) for _ in range(40)]
    for _ in range(40):
        a, b = rng.randrange(40), rng.randrange(40)
        length = rng.choice([n - 1, n, n + 1, 2 * n, 3 * n])
        part = (texts[a] + new(length))[-length - rng.randrange(30) :][:length]
        at = rng.randrange(len(texts[b]) + 1)
        texts[a] += part
        texts[b] = texts[b][:at] + part + texts[b][at:]
    repeat = new(300)
    rows = list(enumerate([*texts, texts[3], texts[3], None, "", repeat + repeat, "x" * (n - 1)]))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id bigint, text string, owner string")
    got = {r["id"]: r["shared_chars"] for r in shared_chars(df, "id", "text", n).collect()}
    assert got == brute(rows, n)


def test_repeated_rows_empty_and_very_long(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    rows = [(1, long), (1, long), (2, "y" * 50 + long[1_999_900:2_000_200] + "z")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert {(r["id"], r["shared_chars"]) for r in shared_chars(df, "id", "t").collect()} == {(1, 300), (2, 300)}
    assert shared_chars(df.limit(0), "id", "t").count() == 0


def test_a_periodic_text_that_spans_slices(spark):
    rows = [(1, "c" * 2_300_000), (2, "y" * 50 + "c" * 300 + "z")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert {(r["id"], r["shared_chars"]) for r in shared_chars(df, "id", "t").collect()} == {(1, 2_300_000), (2, 300)}


def test_covers():
    assert len({(a - b) % PERIOD for a in COVER for b in COVER}) == PERIOD
    for v in (2, 7, 30, 91):
        d = difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
