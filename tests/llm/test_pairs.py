"""Near-duplicates, repeated passages, embeddings and components against brute force."""

import random

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import docs  # noqa: F401

from sitegraph.llm import embeddings, minhash, substrings
from sitegraph.llm.common import Tables, components, word_hashes

def hash_of(word):
    return word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word)]), True)[0]


VOCABULARY = [f"w{k}" for k in range(400)]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    texts = {}
    bases = [prose(r, r.choice([6, 20, 60, 200])) for _ in range(12)]
    for i in range(150):
        b = r.choice(bases)
        texts[i * 3] = r.choice([b, b.upper(), edited(r, b, 1), edited(r, b, 3), prose(r, 40), b.replace(" ", "\n\t")])
    texts |= {1: None, 2: "", 4: " \t", 5: "one two", 7: "ONE two", 8: "one", 10: prose(r, 30_000), 11: "x" * 50_000}
    texts[13] = texts[10] + " tail"
    return texts


def test_near_duplicates(spark, docs, corpus):
    got = minhash.near_duplicates(spark, docs(corpus.items()), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == helpers.near_duplicates(corpus)


def test_near_duplicate_chain_behind_a_hub(spark, docs):
    """Links that no star of the first round holds: a chain of small edits."""
    r = random.Random(9)
    w = [f"c{k}" for k in range(120)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(w)
        w[3 * i % 120] = f"e{i}"
    got = minhash.near_duplicates(spark, docs(texts.items()), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: v[1] for i, v in helpers.near_duplicates(texts).items()}


def test_leftover_pairs_with_repeated_rows(spark, docs, monkeypatch):
    """Most links are left to the last comparison, where rows are repeated and a doc_id has two texts."""
    monkeypatch.setattr(minhash, "WORTH", 2)
    r = random.Random(31)
    texts = {}
    for k in range(8):
        own = [[f"f{k}x{x}" for x in range(90)]]
        for i in range(14):
            w = list(r.choice(own))
            for x in r.sample(range(90), r.choice([1, 2, 2, 4])):
                w[x] = f"e{k}x{i}x{x}"
            own.append(w)
            texts[100 * k + i] = " ".join(w)
    got = minhash.near_duplicates(spark, docs([x for x in texts.items() for _ in range(1 + x[0] % 3)]), width=4).collect()
    want = helpers.near_duplicates(texts)
    assert 8 < len({v[1] for v in want.values()}) < len(texts) / 2
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: v[1] for i, v in want.items()}
    assert len(got) == sum(1 + i % 3 for i in texts)


def test_pairs_of_documents_with_several_entries():
    place = np.array([0, 1, 1, 2])
    i, j = minhash._entries(place, np.array([0, 1, 0]), np.array([1, 2, 2]))
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]


def test_leftover_pairs_of_small_sets(spark, docs):
    """Linked pairs that share a band, though their signatures agree in less than expected."""
    r = random.Random(8)
    texts = {}
    while len(texts) < 12:
        w = [f"s{r.randrange(10**9)}" for _ in range(8)]
        a, b = (minhash.signature(minhash.shingle_set(np.array([hash_of(x) for x in t], np.uint64), 4)) for t in (w, w[1:]))
        if (a == b).sum() < 104 and (minhash.bands(a) == minhash.bands(b)).any():
            texts |= {len(texts): " ".join(w), len(texts) + 1: " ".join(w[1:])}
    d, store = docs(texts.items()), Tables(spark, "test")
    rows = store.write(minhash.profile(d, 4), "profile")
    reps = rows.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *[c for c in rows.columns if c in ("bands", "sig")])
    members = reps.select("rep", "n", F.posexplode("bands").alias("band", "bucket"), F.col("rep").alias("root"))
    got = minhash.leftover_links(store, members, reps, minhash.shingle_sets(store, d, members, 4), 80)
    assert {(x["b"], x["a"]) for x in got.collect()} == {(k, k + 1) for k in range(0, 12, 2)}


def test_near_duplicates_nulls_and_repeated_rows(spark, docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None), (3, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(spark, docs(rows)).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (-1, -1, True), (-1, -1, True), (3, 3, True)])
    one = minhash.one_of_each(spark, docs(rows))
    assert one.columns == docs(rows).columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in one.where("text is not null").collect()) == [(-1, "a b c d e f"), (1, "a b c d e f")]
    assert minhash.near_duplicates(spark, docs([])).collect() == []


def test_rows_without_doc_id_all_stay(spark, docs):
    rows = [(None, ""), (None, None), (None, ""), (None, "a b c d e f"), (None, "A b c  d e f"), (None, "a b c d e f"), (1, "a b c d e f")]
    one = minhash.one_of_each(spark, docs(rows))
    assert sorted(map(repr, one.select("doc_id", "text").collect())) == sorted(map(repr, docs(rows).select("doc_id", "text").collect()))


def test_signature_agrees_with_similarity():
    r = np.random.default_rng(0)
    same = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = np.unique(base[:360]), np.unique(base[40:])
        same.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(same) - 320 / 400) < 0.02
    one = minhash.signature(np.array([77], np.uint64))
    assert (one == 77).all()


def test_repeated_passages(spark, docs):
    r = random.Random(1)
    shared = [prose(r, n) for n in (49, 50, 51, 80, 300)]
    texts = {}
    for i in range(60):
        parts = [prose(r, r.choice([0, 1, 5, 31, 70])) for _ in range(3)]
        texts[i] = "  ".join([parts[0], r.choice(shared), parts[1], r.choice(shared), parts[2]])
    texts |= {100: None, 101: "", 102: texts[3], 103: texts[3].replace(" ", "\n"), 104: shared[4] + " " + shared[4], 105: "x " * 400}
    want = helpers.without_repeats(texts)
    got = substrings.digest(spark, docs(texts.items())).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {
        i: (len(helpers.words(texts[i])), n, helpers.sha(kept)) for i, (kept, n) in want.items()}
    out = substrings.remove(spark, docs(texts.items()))
    assert out.columns == docs(texts.items()).columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {i: helpers.words(x["text"]) for i, x in rows.items()} == {i: kept for i, (kept, _) in want.items()}
    assert all(rows[i]["n_chars"] == len(rows[i]["text"]) for i in rows)
    assert all(rows[i]["text"] == (texts[i] or "") for i, (_, n) in want.items() if not n)


def test_repeated_passages_nulls_and_repeated_rows(spark, docs):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(5, p), (5, p), (None, p), (7, "x " + p), (7, p + " y"), (None, "z " + p)]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.digest(spark, docs(rows)).collect())
    assert got == sorted([(5, 60, 0), (5, 60, 0), (-1, 60, 0), (7, 61, 60), (7, 61, 60), (-1, 61, 0)])
    assert substrings.digest(spark, docs([])).collect() == []
    assert substrings.remove(spark, docs([])).collect() == []


def test_difference_cover():
    d = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert d == set(range(substrings.PERIOD))


@pytest.mark.parametrize("tile", [64, 1024])
def test_embeddings(spark, tile):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    rows = []
    for k in range(500):
        c = int(r.integers(40))
        rows.append([k, (base[c] + r.normal(size=16) * r.choice([0, 0.02, 0.15, 0.3])).astype("float32").tolist(), c % 3])
    for k, x in ((5, None), (6, [0.0] * 16), (7, [float("nan")] * 16), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, [None] * 16),
                 (12, [float("inf")] * 16), (13, [])):
        rows[k][1] = x
    rows[8][2], rows[9][2], rows[10][2] = None, 1, 1
    rows += [[20, *rows[20][1:]], [None, *rows[20][1:]]]
    df = spark.createDataFrame([tuple(x) for x in rows], "vec_id long, embedding array<float>, label int") \
        .withColumn("node", F.lit("own")).withColumn("n", F.lit("own"))
    usable = [m is not None and x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x)
              for _, x, m in rows]
    v = [np.array(x, float) if ok else None for (_, x, _), ok in zip(rows, usable)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if usable[a] and usable[b] and rows[a][2] == rows[b][2]
             and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= 0.98]
    assert len(links) > 1000
    root = helpers.groups(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = sorted((-1 if i is None else i, int(n[k]), -1 if i is None else least[root[k]]) for k, (i, _, _) in enumerate(rows))
    got = embeddings.near_duplicates(spark, df, tile=tile).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"],
                   -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(spark, df).collect() == []


def test_components(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    star = [(5, k) for k in range(2000, 2400)]
    mess = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    edges = chain + star + mess + [(9, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["root"] for x in components(Tables(spark, "test"), df).collect()}
    want = helpers.groups({n for e in edges for n in e}, edges)
    assert got == {n: w for n, w in want.items() if n in got}
    assert set(got) >= {n for a, b in edges if a != b for n in (a, b)}
