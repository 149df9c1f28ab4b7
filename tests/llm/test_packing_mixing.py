import random

import pytest

from bulaforge.llm import packing, tokens
from bulaforge.llm.mixing import Target, largest_total, mix, route, shares
from bulaforge.llm.packing import pack, plan
from bulaforge.llm.tokens import Tokenizer, encode, pieces_of, token_pieces

pytest.importorskip("tiktoken")


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_within_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 500])
    hist = {rng.randrange(1, capacity + 1): rng.randrange(1, 400) for _ in range(rng.randrange(1, capacity))}
    placed: dict[int, int] = {}
    for p in plan(hist, capacity):
        assert sum(k * v for k, v in p.lengths) <= capacity and p.containers > 0
        for k, v in p.lengths:
            placed[k] = placed.get(k, 0) + v * p.containers
    assert placed == hist
    assert plan({}, capacity) == []
    with pytest.raises(ValueError):
        plan({capacity + 1: 1}, capacity)


def test_least_squares_beat_greedy_packing():
    """Greedy packing puts 4 + 4 and 3 + 3 + 3 together: 300 + 400 containers of 10 instead of 600 of 4 + 3 + 3."""
    made = plan({4: 600, 3: 1200}, 10)
    assert sum(p.containers for p in made) == 600 and all(p.solved for p in made)


def test_one_length_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 2)
    got = pack(spark.range(1000).selectExpr("id", "0 AS piece_no", "CAST(if(id % 3 = 0, 7, 3) AS INT) AS n_tokens"), 10).collect()
    held: dict[int, int] = {}
    for r in got:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
    assert len(got) == 1000 and max(held.values()) <= 10 and sorted(held) == list(range(len(held))) and len(held) == 334 + 111


def test_tokens_of_parts_are_those_of_the_whole(monkeypatch):
    t = Tokenizer.public()
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["palavra", " ", "  ", "\n", "ção", "12", ",", ".", "😀", "\t", "a b", "x-y"]) for _ in range(400))
        whole = encode(text, t)
        monkeypatch.setattr(tokens, "PART_CHARS", rng.choice([1, 7, 50]))
        assert encode(text, t) == whole
        monkeypatch.undo()


def test_containers(spark):
    rows = [(i, 0, 1 + i * 7 % 50) for i in range(400)] + [(1000 + i, 0, 33) for i in range(300)] + [(0, 0, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, piece_no int, n_tokens int, salt_note string")
    got = pack(df, 50).collect()
    assert len(got) == len({(r["id"], r["piece_no"]) for r in got}) == 700
    held: dict[int, int] = {}
    for r in got:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
    assert max(held.values()) <= 50 and sorted(held) == list(range(len(held)))
    assert pack(df.limit(0), 50).count() == 0


def test_pieces_of_long_texts(spark):
    t = Tokenizer.public()
    text = "Água 😀 ação. " * 2000
    parts = pieces_of(text, t, 100)
    assert "".join(text[a:b] for a, b, _ in parts) == text and max(n for *_, n in parts) <= 100 and sum(n for *_, n in parts) == len(encode(text, t))
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "um")], "id int, t string")
    got = token_pieces(df, "id", "t", t, 100).collect()
    assert {r["id"] for r in got} == {1, 4} and len([r for r in got if r["id"] == 1]) == len(parts)


def test_route_meets_quotas_at_least_repetition():
    targets = [Target("a", 0.5, 1), Target("b", 0.5, 3)]
    flows = route({1: 100, 2: 20, 3: 40}, targets, 160)
    assert sum(f for (_, k), f in flows.items() if k == 0) == 80 and sum(f for (_, k), f in flows.items() if k == 1) == 80
    assert largest_total({1: 100, 2: 10}, targets, 1000) == 60 or largest_total({1: 100, 2: 10}, targets, 1000) == 61
    assert route({1: 100}, targets, 10) is None


def test_mix(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(f"p{rng.randrange(999)}" for _ in range(rng.randrange(5, 40))), rng.choice("aaaaaaabbc")) for i in range(600)]
    rows += [(1000, rows[0][1], "b"), (1001, rows[0][1], "a"), (1002, None, "a"), (1003, " ", "b"), (1004, "texto", "z"), (1005, "texto", None), rows[5]]
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 2), Target("c", 0.2, 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k bigint, body string, s string, n int")
    sample = mix(df, "k", "body", "s", targets, Tokenizer.public())
    got = sample.collect()
    source = {(k, s) for k, _, s in rows}
    assert all((r["doc_id"], r["source"]) in source for r in got)
    assert all(r["uses"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in got)
    assert len({(r["doc_id"], r["source"]) for r in got}) == len(got)
    for r in shares(sample, targets).collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.02
    again = mix(df, "k", "body", "s", targets, Tokenizer.public()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mix(df.limit(0), "k", "body", "s", targets, Tokenizer.public()).count() == 0
    assert mix(df, "k", "body", "s", [], Tokenizer.public()).count() == 0
    lone = shares(mix(df, "k", "body", "s", [Target("a", 0.5, 1), Target("none", 0.5, 9)], Tokenizer.public()), [Target("a", 0.5, 1)]).first()
    assert (lone["tokens"], lone["reached_share"]) == (0, 0.0)
