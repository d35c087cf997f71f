"""Conversation repair against a search over edit sequences."""

import random

import brute_new as brute
import pytest

from sitegraph.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, pos string, conv string, block long, audit string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "own", "own", 1, "own") for r in rows], SCHEMA).repartition(3)
    got = conversations.repaired(spark, df).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(1, longest)):
            turn = r.choice([t, t, t, t, t + 3, None])
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"])
            text = r.choice(["Yes.", "No!", "what", " \t\r\n", "", None, "Long. " * 50, "é…", f"t{r.randrange(9)}?"])
            rows.append((r.choice([c, c, c, None]), turn, role, text))
    return rows


@pytest.mark.parametrize("seed,convs,longest", [(1, 60, 9), (2, 8, 25)])
def test_repairs(spark, seed, convs, longest):
    rows = made(seed, convs, longest)
    rows += rows[:20]  # repeated rows
    assert run(spark, rows) == brute.repairs(rows)


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 3)
    rows = [(7, t, ["user", "assistant", "system"][t * t % 3], ["a.", "b", "c!", f"d{t}."][t % 4]) for t in range(80)]
    rows += [(8, None, "user", "x" * 100_000 + ".")]
    assert run(spark, rows) == brute.repairs(rows)


def test_cells_of_any_split(spark):
    r = random.Random(3)
    for _ in range(30):
        cells = [conversations.ROW_CELLS[r.choice(["s", "u", "a", ""]), r.random() < .3, r.random() < .3] for _ in range(7)]
        k = r.randrange(1, 7)
        left = cells[0]
        for c in cells[1:]:
            left = conversations.combine(left, c)
        split = conversations.combine(conversations.span_cell(cells[:k]), conversations.span_cell(cells[k:]))
        assert left == split == conversations.span_cell(cells)


def test_empty_table(spark):
    assert run(spark, []) == {}
