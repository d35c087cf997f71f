"""Ranked lexical search against brute force."""

import random

import brute_new as brute
import pytest
from tables import docs  # noqa: F401

from sitegraph.llm import retrieval

ITEMS = "item_id long, text string, doc_id string, term string, score string"


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÜBER", "x1Y2", "日本"]
    text = lambda k: r.choice([" ", ", ", "\n", "--"]).join(r.choice(words) for _ in range(k))
    documents = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(n)]
    documents += [(n, None), (n + 1, ""), (n + 2, " .,;\x7f"), (n + 3, text(20_000)), (n + 4, "ZZZ" * 20_000)]
    documents += [(n + 5 + k, "same w1 w2") for k in range(30)]  # ties
    documents += documents[:5]  # repeated rows
    items = [(k, text(r.choice([1, 4, 20]))) for k in range(12)] + [(12, None), (13, "nowhere"), (14, "w1 w1 W1 same"), (15, "!?")]
    return documents, items


def run(spark, docs, documents, items):
    asked = spark.createDataFrame([(*i, "own", "own", "own") for i in items], ITEMS)
    got = retrieval.search(spark, docs(documents), asked).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("postings", [2_000_000, 60])
def test_search(spark, docs, monkeypatch, postings):
    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    documents, items = corpus(3, 300)
    assert run(spark, docs, documents, items) == sorted(brute.search(documents, items))


def test_no_doc_id_comes_last(spark, docs):
    got = run(spark, docs, [(None, "a b"), (4, "a b"), (3, "a b"), (9, "c")], [(1, "a")])
    assert [(r[1], r[2]) for r in got] == [(1, 3), (2, 4), (3, None)]


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a")]) == []
    assert run(spark, docs, [(1, "a")], []) == []
    assert run(spark, docs, [(1, ""), (2, None)], [(1, "a")]) == []
