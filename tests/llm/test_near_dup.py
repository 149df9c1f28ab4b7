import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulaforge.llm import near_dup
from bulaforge.llm.near_dup import Similarity, components, key_pairs, key_plan, near_duplicates, unexpanded_copies


def sets(rows, how):
    out = {}
    for t, k, x in rows:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if len(w) >= max(how.min_words, how.run):
            out[(t, k)] = {tuple(w[i : i + how.run]) for i in range(len(w) - how.run + 1)}
    return out


def brute(rows, how):
    s = sets(rows, how)
    keys = sorted(s)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(s[a] & s[b]) >= how.threshold * len(s[a] | s[b]) - 1e-12}


def edited(rng, words, vocabulary):
    w = list(words)
    for _ in range(rng.randrange(1, 9)):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice(vocabulary)
        elif kind == 1:
            w.insert(at, rng.choice(vocabulary))
        else:
            to = rng.randrange(len(w))
            w[at : at + 3], w[to : to + 3] = w[to : to + 3], w[at : at + 3]
    return w


@pytest.mark.parametrize("how", [Similarity(run=3, threshold=0.7, min_words=20), Similarity(run=5, threshold=0.8), Similarity(run=2, threshold=0.5, min_words=4), Similarity(run=1, threshold=0.9, min_words=1)])
def test_against_all_pairs(spark, how):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 18, 22, 30, 45, 80, 200]))]
        rows.append((g % 2, f"a{g}", " ".join(base)))
        for k in range(rng.randrange(4)):
            rows.append((g % 2, f"b{g}_{k}", " ".join(edited(rng, base, vocabulary))))
        if g % 5 == 0:
            rows.append((g % 2, f"c{g}", " ".join(base).upper()))
    rows += [(0, "null", None), (0, "blank", " \n"), (1, "tiny", "x"), rows[0], (0, "ação", "É " * 30), (0, "acao", "e " * 30)]
    df = spark.createDataFrame(rows, "tbl int, key string, text string").withColumn("runs", F.lit(1)).withColumn("owner", F.lit("x"))
    got = key_pairs(near_duplicates(df, how), how)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(set(rows), how)


def test_large_classes_of_copies_come_as_stars(spark):
    how = Similarity(run=3, threshold=0.7, min_words=5, expand_copies_up_to=3)
    rows = [(0, f"k{i}", "um dois três quatro cinco seis sete oito nove dez onze doze") for i in range(6)]
    rows.append((0, "z", "um dois três quatro cinco seis sete oito nove dez onze treze"))
    found = near_duplicates(spark.createDataFrame(rows, "tbl int, key string, text string"), how)
    pairs = {(r["key_a"], r["key_b"]) for r in key_pairs(found, how).collect()}
    assert pairs == {("k0", f"k{i}") for i in range(1, 6)} | {("k0", "z")}


def test_different_texts_of_a_large_class_are_expanded(spark):
    how = Similarity(run=3, threshold=0.7, min_words=5, expand_copies_up_to=3)
    words = "um dois três quatro cinco seis sete oito nove dez onze doze".split()
    rows = [(0, f"v{i}", " ".join(words[:i]) + ", " + " ".join(words[i:])) for i in range(1, 8)]
    rows += [(0, f"k{i}", " ".join(words)) for i in range(5)]
    rows += [(0, "z", " ".join([*words[:-1], "treze"])), rows[0]]
    found = near_duplicates(spark.createDataFrame(rows, "tbl int, key string, text string"), how)
    pairs = [(r["tbl"], r["key_a"], r["key_b"]) for r in key_pairs(found, how).collect()]
    copies = {r["key"]: r["rep"] for r in unexpanded_copies(found, how).collect()}
    assert copies == {f"k{i}": "k0" for i in range(1, 5)} and len(pairs) == len(set(pairs))
    want = brute(set(rows), how)
    assert set(pairs) == {p for p in want if not {p[1], p[2]} & set(copies) or p[1] == copies.get(p[2])}
    # With the copies every pair can be restored.
    of = {k: [k, *(c for c, r in copies.items() if r == k)] for _, k, _ in rows}
    restored = {(0, *sorted((x, y))) for _, a, b in pairs for x in of[a] for y in of[b] if x != y}
    restored |= {(0, *sorted((x, y))) for x in of["k0"] for y in of["k0"] if x != y}
    assert restored == want


def test_components(spark):
    how = Similarity(run=2, threshold=0.5, min_words=2)
    base = [f"w{i}" for i in range(12)]
    rows = [(0, f"c{k}", " ".join(base[k : k + 8])) for k in range(5)] + [(0, "alone", "x y z u v"), (0, "copy", "x y z u v")]
    got = {r["key"]: r for r in components(near_duplicates(spark.createDataFrame(rows, "tbl int, key string, text string"), how)).collect()}
    assert len({got[f"c{k}"]["component"] for k in range(5)}) == 1
    assert got["alone"]["component"] == got["copy"]["component"] != got["c0"]["component"] and got["alone"]["links"] == 0


def test_empty_and_long(spark):
    how = Similarity()
    none = spark.createDataFrame([], "tbl int, key string, text string")
    assert key_pairs(near_duplicates(none, how), how).count() == 0
    words = [f"w{i}" for i in range(120_000)]
    rows = [(0, "a", " ".join(words)), (0, "b", " ".join(words[:60_000] + ["x"] + words[60_000:]))]
    assert [tuple(r) for r in key_pairs(near_duplicates(spark.createDataFrame(rows, "tbl int, key string, text string"), how), how).collect()] == [(0, "a", "b")]


def test_plan_covers_small_sets():
    for t in (0.5, 0.7, 0.8, 0.9):
        plan = key_plan(t)
        assert plan[-1][0] == 1 and all(a[0] > b[0] for a, b in zip(plan, plan[1:]))


def test_hot_keys_are_split_into_blocks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 5)
    monkeypatch.setattr(near_dup, "HOT_LOADS", 0)
    how = Similarity(run=3, threshold=0.7, min_words=20)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(250)]
    rows = [(0, f"a{g}", " ".join(edited(rng, base, vocabulary))) for g in range(40)]
    rows += [(1, f"b{g}", " ".join(rng.choice(vocabulary) for _ in range(40))) for g in range(40)]
    df = spark.createDataFrame(rows, "tbl int, key string, text string")
    found = [tuple(r) for r in key_pairs(near_duplicates(df, how), how).collect()]
    want = brute(set(rows), how)
    assert len(want) > 50 and len(found) == len(set(found)) and set(found) == want


def test_split_holders_of_a_key_meet_exactly_once():
    owner = np.arange(50, dtype=np.int64) * 977
    at, key, side = near_dup._split_hot(np.arange(50), np.full(50, 7, np.uint64), np.full(50, 6), owner)
    met = Counter()
    for k in np.unique(key):
        held = [(int(a), int(s)) for a, s in zip(at[key == k], side[key == k])]
        met.update(frozenset((a, b)) for i, (a, s) in enumerate(held) for b, t in held[i + 1 :] if s != t or s == 0)
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def test_the_sketch_grows_with_the_input_up_to_its_bound():
    assert [near_dup.sketch_bits(n) for n in (1, 1 << 30, 1 << 34, 1 << 42, 1 << 60)] == [18, 18, 20, 24, 24]
