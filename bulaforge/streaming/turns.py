"""The keyed fold of a conversation over features that column expressions compute before it.

A turn arrives as a row of `functions.entities.turn_features`; the state is the question
that stands, cut at the place that names a species, with its product and topic. Nothing is
matched here, so stream and batch can't read a turn differently.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Standing:
    """The question that the next turn is read against; head and tail stand before and after its species."""

    query: str | None = None
    head: str | None = None
    tail: str | None = None
    product: str | None = None
    topic: str | None = None
    seen: int = 0

    def to_row(self) -> tuple:
        return tuple(asdict(self).values())


def follow(before: Standing, turn: dict) -> tuple[Standing, str | None]:
    """The standing question after a turn, and its rewritten form if it was a follow-up. A blank turn changes nothing."""
    if not turn["said"]:
        return before, None
    told = {k: turn[k] for k in ("said", "head", "tail", "product", "species", "opening")}
    topic = turn["topic"]
    changes = turn["brief"] and before.query and before.product and (turn["cue"] or told["species"] or (told["opening"] and topic != before.topic))
    if not changes:
        product = told["product"] or before.product
        return Standing(told["said"], told["head"], told["tail"], product, topic, before.seen + 1), None
    goal = f"para {told['species']}" if told["species"] else None
    if told["opening"]:
        lead = told["opening"] + before.product
        after = replace(before, query=f"{lead} {goal}?" if goal else f"{lead}?", head=f"{lead} ", tail="?", topic=topic)
    elif goal:
        after = replace(before, query=f"{before.head}{goal}{before.tail}")
    else:
        after = before
    return replace(after, seen=before.seen + 1), after.query
