"""Repeated byte strings against brute force; the merge sort against sorted()."""

import random

import brute_new as brute
import numpy as np
import pytest
from tables import docs  # noqa: F401

from sitegraph.llm import suffixes


def prose(r, n):
    return "".join(r.choice("abcdé fgh\n") for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    passage = [prose(r, n) for n in (399, 400, 401, 520, 760, 2000)]
    texts = []
    for k in range(60):
        parts = [prose(r, r.choice([0, 3, 150, 700]))]
        for _ in range(r.randrange(3)):
            p = r.choice(passage)
            cut = r.choice([0, 0, 1, 90, 200])
            parts += [p[cut:len(p) - r.choice([0, 0, 1, 30])], prose(r, r.choice([0, 1, 40, 300]))]
        texts.append("".join(parts))
    texts += ["x" * 900, "x" * 450, "y" * 399, "ab" * 400, "z" * 399 + "q" + "z" * 399, None, "", " \n", "a" * 400]
    texts += [prose(r, 300) * 4, prose(r, 30_000)]
    texts += [texts[0], texts[-1], "short", "short", texts[-1] + "tail", "head" + texts[-1][:600]]
    edited = list(passage[-1] * 3)
    for k in range(100, len(edited), 390):
        edited[k] = "#"
    return texts + ["".join(edited)]


def run(spark, docs, texts):
    got = suffixes.digest(spark, docs([(i, t) for i, t in enumerate(texts)])).collect()
    return [tuple(r)[1:] for r in sorted(got)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_digest(spark, docs, monkeypatch, seed, small):
    if small:  # many ranges
        monkeypatch.setattr(suffixes, "RANGE_BYTES", 200_000)
    texts = corpus(seed)
    assert run(spark, docs, texts) == brute.repeated_bytes(texts)


def test_repeated_ids_and_none(spark, docs):
    text = prose(random.Random(4), 500)
    rows = [(1, text), (1, text), (None, "a" + text), (None, None), (2, "b")]
    got = sorted((tuple(r)[0] or 0, *tuple(r)[1:4]) for r in suffixes.digest(spark, docs(rows)).collect())
    n = len(text.encode())
    assert got == [(0, 0, 0, 0), (0, n + 1, n, 1), (1, n, n, 1), (1, n, n, 1), (2, 1, 0, 0)]


def test_empty_table(spark, docs):
    assert run(spark, docs, []) == []


def test_merge_of_runs():
    r = random.Random(8)
    records = [("".join(r.choice("ab") for _ in range(r.randrange(12))).encode(), k, r.randrange(3), 0, 0, 0, 0) for k in range(500)]
    runs = [[] for _ in range(7)]
    for x in records:
        runs[r.choice([0, 1, 2, 4, 5, 6])].append(x)
    pieces = [suffixes.Piece(suffixes.encode(sorted(x))) for x in runs if x]
    seen, before = [], b""
    for run, at, shared in suffixes.merge(pieces):
        now = pieces[run].now
        if seen:
            assert shared == suffixes.common(before, now)
        seen.append((now, *pieces[run].places[at]))
        before = now
    assert seen == sorted(x[:3] for x in records)


def test_every_window_has_its_anchor():
    data = np.frombuffer(prose(random.Random(1), 5000).encode(), np.uint8)
    offsets = np.array([0, 1000, 1399, 1399, len(data)])
    place, low, high, _, first = suffixes.anchors(data, offsets)
    for k in range(len(offsets) - 1):
        own = slice(first[k], first[k + 1])
        windows = [w for lo, hi in zip(low[own], high[own]) for w in range(lo, hi + 1)]
        assert windows == list(range(offsets[k], max(offsets[k], offsets[k + 1] - 399)))
    assert ((place >= high) & (place - low <= 200)).all()
