"""Sharding, quality rules, mixing, packing, WARC, toxicity, scoring and the pipeline."""

import base64
import collections
import hashlib
import math
import random
import time
import tracemalloc
import zlib

import duckdb
import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import docs  # noqa: F401

from sitegraph.llm import attention, mixing, packing, quality, scoring, sharding, toxicity, warc
from sitegraph.llm.common import Tables, added, distinct
from sitegraph.llm.tokens import encoder, tokenizer_path

TOKENIZER = tokenizer_path("word_bpe_49k.json")
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "Nu", "é") for b in ("ra", "st", "von", "x", "ly.", "tor,")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(i, prose(r, r.choice([1, 9, 10, 40, 300])), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "Z", None]))
           for i in range(200)]
    out += [(300 + i, "hot text", "en", "a") for i in range(150)]
    out += [(500, None, "en", "b"), (501, "", None, None), (502, " \t\n", "de", "c"), (None, "no id here", "en", "a"),
            (503, prose(r, 20_000), "en", "Z"), (7, "again seven", "en", "a"), (7, "again seven", "en", "a")]
    return out


def duck(rows, sql, columns):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall())


def test_sharding(spark, docs, rows):
    out = sharding.shard(spark, docs(rows), leaves=16).collect()
    assert len(out) == len(rows)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == want
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(spark, docs([]), leaves=16).collect() == []


def test_sharding_balances_and_keeps_copies_together(spark, docs):
    r = random.Random(4)
    rows = [(i, prose(r, r.randrange(5, 80)), "en", f"s{i % 7}") for i in range(3000)]
    rows += [(5000 + i, "a copy of this text", "en", f"s{i % 7}") for i in range(1500)]
    rows += [(9000 + i, f"copied text {i % 50}", "en", "x") for i in range(200)]
    out = sharding.shard(spark, docs(rows), target_bytes=sum(len(x[1].encode()) + 1 for x in rows) // 12 + 1).collect()
    size = collections.Counter()
    where = collections.defaultdict(set)
    for r in out:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert len(size) == 12 and max(size.values()) < 1.05 * min(size.values())
    assert sum(len(s) > 1 for s in where.values()) <= 12


def test_sharding_keeps_copies_of_long_texts_together(spark, docs):
    r = random.Random(6)
    rows = [(i, prose(r, 40), "en", f"s{i % 7}") for i in range(1500)]
    rows += [(5000 + 10 * i + k, f"long {i} " + "copied " * 60, "en", f"s{k}") for i in range(12) for k in range(2)]
    where = collections.defaultdict(set)
    for x in sharding.shard(spark, docs(rows), leaves=16).collect():
        where[x["text_crc32"]].add(x["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_quality_matches_oracle(spark, docs, rows):
    r = random.Random(8)
    more = [(1000 + i, prose(r, 60) + "\nsame line\nsame line" * (i % 3) + " ### $$" * (i % 2) * 30, "en", "a") for i in range(140)]
    unique = [x for x in rows if x[0] not in (None, 7)] + more
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.assess(spark, docs(unique)).select(*names).collect()
    assert sorted(tuple(x) for x in got) == duck(unique, quality.oracle(), ", ".join(names))
    assert any(not x["kept"] and not x["base_failed"] for x in got)
    assert "Python" not in quality.assess(spark, docs(unique))._jdf.queryExecution().toString()


def test_quality_stage_keeps_columns(spark, docs, rows):
    d = docs(rows)
    out = quality.passing(spark, d)
    assert out.dtypes == d.dtypes and 0 < out.count() < len(rows)
    assert quality.passing(spark, docs([])).collect() == []


def test_mixing(spark, docs, rows):
    out = mixing.mix(spark, docs(rows)).collect()
    size = {}
    for i, t, _, s in rows:
        size[s] = size.get(s, 0) + len(helpers.words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, held = 1.5 * sum(size.values()), set()
    while True:
        level = (budget - sum(2 * size[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        over = {s for s in order if s not in held and weight[s] * level > 2 * size[s]}
        if not over:
            break
        held |= over
    target = {s: 2 * size[s] if s in held else weight[s] * level for s in order}
    source = {(i, len(helpers.words(t))): s for i, t, _, s in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        s = source[r["doc_id"], r["size"]]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == size[s] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    unique = [x for x in rows if x[0] not in (None, 7)]
    got = mixing.mix(spark, docs(unique)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == duck(unique, mixing.oracle(), "doc_id, size, source_size, target, taken")
    full = mixing.mixed(spark, docs(rows))
    assert full.columns == docs(rows).columns
    assert sum(len(helpers.words(x["text"])) for x in full.collect()) == sum(taken.values())
    assert mixing.mix(spark, docs([])).collect() == []


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    from sitegraph.llm.common import text_bytes

    e = encoder(TOKENIZER)
    texts = ["", "  ", None, "A. B.,c", "ΑΣ. ΑΣ", "é., É, ’.", "don't. I'll, 12., 3.14.", "ﬁ. x., \x1c a", "İ. ǅ, ß.", "é., x",
             "a.b. c,,", "x" * 3000, "word " * 500]
    for group in (texts, ["<|endoftext|> x", "y <|startoftext|>"]):
        ids, first = e.texts(*text_bytes(pa.array(group)))
        for t, a, b in zip(group, first[:-1], first[1:]):
            assert ids[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_packing(spark, docs, rows):
    out = packing.pack(spark, docs(rows), TOKENIZER, with_ids=True).collect()
    e = encoder(TOKENIZER).tokenizer
    want = collections.Counter()
    for i, t, _, _ in rows:
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            want[i, at, len(part) // 4, zlib.crc32(part), len(ids), part] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(spark, docs([]), TOKENIZER).collect() == []


def test_patterns_hold_every_piece_with_little_room_left():
    r = np.random.default_rng(1)
    for counts in ({}, {5: 1}, {256: 3}, {200: 7, 60: 2}, dict(enumerate(r.integers(0, 400, 257).tolist())),
                   {int(c): int(n) for c, n in zip(r.integers(1, 257, 40), r.integers(1, 9000, 40))}):
        counts = {c: n for c, n in counts.items() if c and n}
        plan = packing.plan_patterns(counts, 256)
        held = collections.Counter()
        for pattern, copies in plan:
            assert sum(c * n for c, n in pattern.items()) <= 256
            for c, n in pattern.items():
                held[c] += n * copies
        assert all(held[c] >= n for c, n in counts.items()) and set(held) <= set(counts)
        if sum(counts.values()) > 10_000:
            used, total = sum(n for _, n in plan), sum(c * n for c, n in counts.items())
            assert used <= total / 256 * 1.01 + 2 or max(counts) > 128


def test_warc(spark):
    r = random.Random(6)
    bodies = [prose(r, 30), "", "<p>é\r\n\r\nWARC/1.1\r\n</p>", None, "x" * 200_000]
    rows = [(i, f"http://e.com/{i}\n", r.choice(bodies)) for i in range(120)] + [
        (None, None, "own"), (None, "u", bodies[0]), (5000, "u", "twice"), (5000, "u", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("own")).repartition(4)
    index = warc.write(spark, pages, file_bytes=5_000)
    out = warc.read(index, with_payload=True).collect()
    keeper = {}
    for i, _, h in rows:
        h = h or ""
        keeper[h] = max(keeper.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        h = h or ""
        k = keeper[h]
        revisit = k != -1 and i != k
        want.append((str(i), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                     "revisit" if revisit else "response", str(k if revisit else None), "" if revisit else h))
    assert sorted((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], str(x["refers_to"]), x["payload"])
                  for x in out) == sorted(want)
    some = index.where("page_id % 7 = 3")
    assert sorted(x["page_id"] for x in warc.read(some).collect()) == sorted(x["page_id"] for x in some.collect())
    assert index.select("file").distinct().count() > 4
    empty = warc.write(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(empty).collect() == []


def test_toxicity_learns_and_generalises(spark, docs):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        w = prose(r, r.randrange(20, 200)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w.insert(r.randrange(len(w)), r.choice(["Scum", "idiot.", "moron,", "trash"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if r.random() > 0.02 else 1 - int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "idiot idiot"), (2002, prose(r, 20_000))]
    labels += [(0, None), (None, 1), (77777, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("own"))
    learn = toxicity.remainder(F.col("doc_id"), 3) != 1
    out = toxicity.score(spark, docs(rows), table, learn).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    score = {x["doc_id"]: x["score"] for x in out}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((score[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert score[2000] == score[2001] < 0.5 and score[2002] < 0.5 and score[None] > 0.7
    one_class = toxicity.score(spark, docs(rows[:30]), table.where("toxic = 0"), learn).collect()
    assert {x["score"] for x in one_class} == {0.0}
    assert toxicity.score(spark, docs([]), table, learn).collect() == []


def test_toxicity_ranks_whichever_label_a_few_words_mark(spark, docs):
    r = random.Random(31)
    rows, labels = [], []
    for i in range(360):
        w = prose(r, r.randrange(60, 300)).split()
        marked = i % 5 == 0
        for _ in range(2 * marked):
            w.insert(r.randrange(len(w)), r.choice(["scum", "idiot", "moron", "trash"]))
        if i % 7 == 0:
            w += [w[-1]] * 200              # repeats of one pair say no more than the pair
        rows.append((i, " ".join(w)))
        labels.append((i, int(marked)))
    learn = toxicity.remainder(F.col("doc_id"), 3) != 1
    for swapped in (0, 1):
        table = spark.createDataFrame([(i, y ^ swapped) for i, y in labels], "doc_id long, toxic int")
        score = {x["doc_id"]: x["score"] for x in toxicity.score(spark, docs(rows), table, learn).collect()}
        held = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
        pairs = [(score[a] > score[b]) + (score[a] == score[b]) / 2 for a in held if a % 5 == 0 for b in held if b % 5]
        area = sum(pairs) / len(pairs)
        assert (area if not swapped else 1 - area) > 0.9


def test_toxicity_curve_never_turns_evidence_round():
    r = np.random.default_rng(5)
    y = (np.arange(40) < 8).astype(float)
    x = r.normal(0, 1, (40, toxicity.FEATURES)) - 0.7 * y[:, None]     # a few documents where all evidence misleads
    w = toxicity.fit_curve(x, y, np.ones(40))
    assert (w[:-1] >= 0).all() and w[:-1].max() > 0
    x = r.normal(0, 1, (4000, toxicity.FEATURES))
    y = (x[:, 3] + 0.3 * r.normal(0, 1, 4000) > 0).astype(float)       # many: the documents decide
    w = toxicity.fit_curve(x, y, np.ones(4000))
    assert w[3] > 3 and np.delete(w[:-1], 3).max() < 0.5


def test_toxicity_models_are_kneser_ney(spark):
    r = random.Random(14)
    texts = [(k, " ".join(r.choice("abcdefgh"[k % 2 * 2:6 + k % 2 * 2]) for _ in range(r.randrange(2, 9))), k % 2, 0) for k in range(14)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int, fold int")
    store = toxicity.Tables(spark, "test")
    counts = store.write(df.mapInArrow(toxicity._counted, "key long, head long, word long, c0 long, c1 long, c2 long, c3 long"), "counts")
    counts = counts.groupBy("key").agg(F.min("head").alias("head"), F.min("word").alias("word"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])
    model = toxicity._model(store, counts, (("c0", "c1"), ("c2", "c3")))
    pairs = [collections.Counter(p for _, t, y, _ in texts if y == c for p in zip([None, *t.split()], t.split())) for c in (0, 1)]
    after = [collections.Counter(w for _, w in p) for p in pairs]
    assert all(max(p.values()) > 1 for p in pairs)
    rate = lambda n: (sum(x == 1 for x in n) + 0.5) / (sum(x == 1 for x in n) + 2 * sum(x == 2 for x in n) + 1)

    def p(c, u, w):
        d1, d2, mass = rate(after[c].values()), rate(pairs[c].values()), sum(after[c].values())
        shared = sum(a[w] for a in after) / sum(sum(a.values()) for a in after)
        low = (max(after[c][w] - d1, 0) + sum(min(n, d1) for n in after[c].values()) * shared) / mass
        own = [n for (h, _), n in pairs[c].items() if h == u]
        return (max(pairs[c][u, w] - d2, 0) + sum(min(n, d2) for n in own) * low) / sum(own) if own else low

    assert math.isclose(sum(p(1, "c", w) for w in "abcdefgh"), 1)
    for batch, words, first in toxicity._words(df.toArrow().to_batches(), 1):
        got, _, known = model.difference(words, first)
        want = [math.log(p(1, u, w) / p(0, u, w)) for t in batch.column(1).to_pylist() for u, w in zip([None, *t.split()], t.split())]
        assert known.all() and np.allclose(got, want, atol=1e-5)


def test_scoring_base_is_exact_and_model_learns(spark, docs):
    r = random.Random(12)
    text = lambda n: " ".join(x for _ in range(n) for x in r.choice([("go", "to", "the", "Sea"), ("we", "eat", "fish."), ("12", "men")]))
    rows = [(i, text(r.choice([0, 1, 20, 60]))) for i in range(250)] + [(900, None), (901, "never seen words"), (902, text(4000)),
                                                                       (7, "twice"), (7, "twice")]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    out = scoring.score(spark, docs(rows), held, TOKENIZER).collect()
    count = collections.Counter()
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*map(helpers.lower, helpers.words(t)), None]
    for i, t in rows:
        if not is_held(i):
            count.update(tokens(t))
    scale = sum(count.values()) + len(count) + 1
    want = sorted((i, is_held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)),
                   sum(math.log10((count[x] + 1) / scale) for x in tokens(t))) for i, t in rows)
    got = sorted((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["base_score"]) for x in out)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert {x["train_tokens"] for x in out} == {sum(count.values())}
    unseen = [x for x in out if x["held_out"] and x["n_tokens"] > 20]
    assert sum(x["score"] for x in unseen) > 0.8 * sum(x["base_score"] for x in unseen)
    assert scoring.score(spark, docs([]), held, TOKENIZER).collect() == []


def test_classes_and_weights_come_from_all_training_texts(spark):
    r = np.random.default_rng(4)
    size, end, begin = 60, 60, 61
    texts = [r.integers(0, size, n).astype("<u4") for n in (0, 1, 2, 17, 40, 300)]
    rows = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "row long, ids binary").repartition(3)
    common = np.arange(5, 25)
    want = collections.Counter()
    for t in texts:
        for a, b in zip(t[:-1].tolist(), t[1:].tolist()):
            if 5 <= b < 25:
                want[a * 2 * scoring.COMMON + b - 5] += 1
            if 5 <= a < 25:
                want[b * 2 * scoring.COMMON + scoring.COMMON + a - 5] += 1
    cells, n = scoring.neighbours(rows, common, size)
    assert dict(zip(cells.tolist(), n.tolist())) == dict(want)
    classes = np.arange(size + 2) % attention.CLASSES
    start = attention.start_weights(classes)
    after = scoring.averaged(rows, start, classes, end, begin)
    moved = (after["e"] != start["e"]).any(axis=1)
    assert moved[np.unique(np.concatenate(texts))].all() and moved[begin]


def test_scorer_equals_plain_attention_and_sums_to_one():
    r = np.random.default_rng(0)
    size = 200
    classes = r.integers(0, attention.CLASSES - 1, size)
    classes[:attention.CLASSES] = np.arange(attention.CLASSES)
    w = attention.start_weights(classes)
    count = r.integers(1, 50, size).astype(float)
    within = np.log(count / np.bincount(classes, count, attention.CLASSES)[classes]).astype(np.float32)
    scorer = attention.Scorer(w, classes, within)
    stream, text, target = r.integers(0, size, 300), np.repeat([0, 1, 2, 3], [5, 120, 1, 174]), r.integers(0, size, 300)
    got = scorer.score(stream, text, target)
    width, stride = attention.WIDTH, attention.STRIDE
    for i in range(300):
        keys = [j for j in range(max((i // stride - 1) * stride, 0), i + 1) if text[j] == text[i]]
        e = w["e"].astype(float)
        a = e[stream[keys]] @ w["k"] @ (e[stream[i]] @ w["q"]) / math.sqrt(width) + w["d"][[i - j for j in keys]]
        a = np.exp(a - a.max())
        logits = (a / a.sum()) @ (e[stream[keys]] @ w["v"]) @ w["a"] + e[stream[i]] @ w["o"] + w["b"]
        want = logits[classes[target[i]]] - np.log(np.exp(logits).sum()) + within[target[i]]
        assert abs(got[i] - want) < 1e-4
    every = [scorer.score(stream, text, np.full(300, t)) for t in range(size)]
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-3)


def test_gradient():
    r = np.random.default_rng(1)
    classes = r.integers(0, attention.CLASSES, 50)
    w = {k: x.astype(float) for k, x in attention.start_weights(classes).items()}
    ids, goal = r.integers(0, 50, (4, attention.SPAN)), r.integers(0, attention.CLASSES, (4, attention.STRIDE))
    texts = np.sort(r.integers(0, 3, (4, attention.SPAN)), axis=1)
    weight = (r.random((4, attention.STRIDE)) < 0.8).astype(float)
    _, g = attention.gradient(w, ids, texts, goal, weight)
    for name in ("q", "k", "v", "d", "a", "o", "b", "e"):
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in w[name].shape)
            if name == "e" and at[0] not in g["e_rows"]:
                continue
            own = g["e"][list(g["e_rows"]).index(at[0]), at[1]] if name == "e" else g[name][at]
            keep = w[name][at]
            w[name][at] = keep + 1e-5
            up = attention.gradient(w, ids, texts, goal, weight)[0]
            w[name][at] = keep - 1e-5
            down = attention.gradient(w, ids, texts, goal, weight)[0]
            w[name][at] = keep
            assert abs((up - down) / 2e-5 - own) < 1e-5


def test_class_scores_are_held_for_few_positions_at_a_time():
    r = np.random.default_rng(3)
    classes = np.arange(2000) % attention.CLASSES
    w = attention.start_weights(classes)
    ids, texts = r.integers(0, 2000, (1024, attention.SPAN)), np.zeros((1024, attention.SPAN), int)
    goal, weight = classes[ids[:, attention.STRIDE:]], np.ones((1024, attention.STRIDE), np.float32)
    tracemalloc.start()
    attention.gradient(w, ids, texts, goal, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * goal.size * attention.CLASSES * 4


def test_large_class_scores_stay_finite():
    r = np.random.default_rng(5)
    size = 2 * attention.CLASSES
    classes = np.arange(size) % attention.CLASSES
    w = attention.start_weights(classes)
    w["b"] += np.linspace(-300, 300, attention.CLASSES, dtype=np.float32)
    stream, text, target = r.integers(0, size, 100), np.zeros(100, int), r.integers(0, size, 100)
    got = attention.Scorer(w, classes, np.zeros(size, np.float32)).score(stream, text, target)
    ids = attention.windows(stream, 0)[1:-1]
    goal, weight = classes[ids[:, attention.STRIDE:]], np.ones((len(ids), attention.STRIDE), np.float32)
    loss, g = attention.gradient(w, ids, np.zeros_like(ids), goal, weight)
    w["b"] += np.float32(500)
    assert np.isfinite(got).all()
    assert np.allclose(attention.Scorer(w, classes, np.zeros(size, np.float32)).score(stream, text, target), got, atol=0.01)
    other, h = attention.gradient(w, ids, np.zeros_like(ids), goal, weight)
    assert abs(loss - other) < 1e-3 and all(np.allclose(g[n], h[n], atol=1e-4) for n in g)


def test_runtime_kernels_give_the_numpy_results_in_less_time():
    r = np.random.default_rng(8)
    size, n = 3000, 3 * attention.CHUNK
    classes = r.integers(0, attention.CLASSES, size)
    w = attention.start_weights(classes)
    w["d"] += r.normal(0, 1, attention.SPAN).astype(np.float32)
    fast, plain = (attention.Scorer(w, classes, r.normal(0, 1, size).astype(np.float32) * 0, fast=x) for x in (True, False))
    assert fast.loops and not plain.loops
    took = {}
    for length in (1, 17, n * attention.STRIDE + 5, 40):        # a short one after a long one: buffers hold old windows
        stream, target = r.integers(0, size, (2, length))
        text = np.sort(r.integers(0, 1 + length // 90, length))
        got = []
        for scorer in (fast, plain):
            got.append(scorer.score(stream, text, target))
            runs = []
            for _ in range(5):
                at = time.process_time()
                scorer.score(stream, text, target)
                runs.append(time.process_time() - at)
            took[length, scorer.loops is None] = min(runs)
        assert got[0].shape == (length,) and np.allclose(*got, atol=1e-4)
    longest = n * attention.STRIDE + 5
    assert took[longest, False] < 0.8 * took[longest, True]
    for many in (n + 7, 5):
        ids, goal = r.integers(0, size, (many, attention.SPAN)), r.integers(0, attention.CLASSES, (many, attention.STRIDE))
        texts = np.sort(r.integers(-1, 2, (many, attention.SPAN)), axis=1)
        weight = (r.random((many, attention.STRIDE)) * (r.random((many, attention.STRIDE)) < 0.8)).astype(np.float32)
        (loss, g), (want, h) = (f(w, ids, texts, goal, weight) for f in (attention.gradient, attention.plain_gradient))
        assert abs(loss - want) < 1e-4 and g.keys() == h.keys()
        assert all(np.allclose(g[k], h[k], rtol=1e-3, atol=1e-6) for k in g)


def test_distinct_hashes_and_added_counts():
    r = np.random.default_rng(11)
    few = r.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)
    near = (np.uint64(1) << np.uint64(40)) + r.integers(0, 5, 300).astype(np.uint64)     # equal but for the low bits
    for keys in (np.zeros(0, np.uint64), few[:1], r.choice(few, 4000), near, np.concatenate([near, r.choice(few, 500)]),
                 np.array([(1 << 64) - 1, 0, (1 << 64) - 1], np.uint64)):
        for got, want in zip(distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert got.dtype == want.dtype and np.array_equal(got, want)
    keys, counts, want = np.zeros(0, np.int32), np.zeros(0, np.int64), collections.Counter()
    for n in (0, 7, 1, 0, 400, 400):
        new, c = np.unique(r.integers(0, 500, n).astype(np.int32), return_counts=True)
        want.update(dict(zip(new.tolist(), c.tolist(), strict=True)))
        keys, counts = added(keys, counts, new, c)
        assert keys.dtype == np.int32 and keys.tolist() == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(21)
    passage = prose(r, 70)
    texts = [prose(r, r.choice([5, 30, 120])) for _ in range(60)]
    texts += [texts[k] for k in (1, 1, 2)] + [texts[3].upper(), passage + " " + prose(r, 60), prose(r, 60) + " " + passage, "", None]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    path = str(tmp_path)
    docs(rows, extra=False).write.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    names = ["doc_id", "text"]
    d, steps = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, path)
        assert out.columns == d.columns
        out.write.parquet(f"{path}/{len(steps)}")
        d = spark.read.parquet(f"{path}/{len(steps)}")
        steps.append(sorted((x["doc_id"], x["text"]) for x in d.select(*names).collect()))
    kept = {x[0] for x in duck(rows, quality.oracle(), "doc_id, kept") if x[1]}
    assert steps[0] == [(i, t) for i, t, _, _ in rows if i in kept]
    near = helpers.near_duplicates(dict(steps[0]), width=5)
    assert steps[1] == [(i, t) for i, t in steps[0] if near[i][2]]
    cut = helpers.without_repeats(dict(steps[1]))
    assert [(i, helpers.words(t)) for i, t in steps[2]] == [(i, cut[i][0]) for i, _ in steps[1]]
    assert any(n for _, n in cut.values())
    mix = duck([(i, t, "en", f"s{i % 3}") for i, t in steps[2]], mixing.oracle(), "doc_id, size, taken")
    assert collections.Counter(i for i, _ in steps[3]) == collections.Counter({i: taken // size for i, size, taken in mix if taken})
    packed = corpus_pipeline.run(spark, path).collect()
    e = encoder(TOKENIZER).tokenizer
    assert sum(x["length"] for x in packed) == sum(len(e.encode(t, add_special_tokens=False).ids) + 1 for _, t in steps[3])


def kd_cells(points, leaves, first=0):
    """Brute force: (row, shard) of points (row, size, key, key, ...), cut by the definition with
    the same bucket widths."""
    if leaves == 1 or not points:
        return [(p[0], first) for p in points]
    spread = [max(p[k] for p in points) - min(p[k] for p in points) for k in range(2, 6)]
    dim = 2 + spread.index(max(spread))
    total, half = sum(p[1] for p in points), leaves // 2
    need, lo, hi = total * half / leaves, min(p[dim] for p in points), max(p[dim] for p in points)
    cut = None
    while cut is None:
        step = ((hi - lo) >> sharding.FAN_BITS) + 1
        below = sum(p[1] for p in points if p[dim] < lo)
        for p in sorted((p for p in points if lo <= p[dim] <= hi), key=lambda p: p[dim]):
            bucket = (p[dim] - lo) // step
            inside = sum(q[1] for q in points if lo <= q[dim] <= hi and (q[dim] - lo) // step == bucket)
            before = sum(q[1] for q in points if q[dim] < lo + bucket * step)
            if before + inside >= need:
                break
        start = lo + bucket * step
        if step == 1 or inside <= total * sharding.CLOSE:
            cut = start + step - 1 if before + inside - need <= need - before else start - 1
        else:
            assert below <= before
            lo, hi = start, min(hi, start + step - 1)
    left, right = [p for p in points if p[dim] <= cut], [p for p in points if p[dim] > cut]
    return kd_cells(left, half, first) + kd_cells(right, leaves - half, first + half)


@pytest.mark.parametrize("leaves", [1, 2, 5, 16])
def test_sharding_cuts_as_brute_force(spark, leaves):
    rng = random.Random(leaves)
    few = [0, 1 << 40, (1 << 62) - 1]
    rows = [(k, rng.choice([1, 5, 900]), rng.randrange(1 << 62), rng.choice(few), rng.choice(few) + rng.randrange(9), k << 40)
            for k in range(180)]
    store = Tables(spark, "test")
    points = store.write(spark.createDataFrame([(r[0], r[1], 7, *r[2:], 0) for r in rows], "doc_id long, size long, text_crc32 long, "
                                               + "".join(f"{d} long, " for d in sharding.DIMENSIONS) + "shard int").repartition(3), "points")
    got = sharding._grow(store, points, leaves).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in got) == sorted(kd_cells(rows, leaves))


def test_sharding_into_many_leaves(spark, docs):
    rng = random.Random(3)
    made = docs([(k, "w" * rng.randint(1, 60) + f" {k}", "en", f"s{k % 7}") for k in range(20_000)], extra=False)
    out = sharding.shard(spark, made, leaves=1024)
    rows = out.groupBy("shard").agg(F.sum("size").alias("b"), F.min("slot").alias("lo"), F.max("slot").alias("hi"),
                                    F.countDistinct("slot").alias("n")).collect()
    assert len(rows) == 1024 and all((r["lo"], r["hi"]) == (0, r["n"] - 1) for r in rows)
    mean = sum(r["b"] for r in rows) / 1024
    assert max(r["b"] for r in rows) < 1.5 * mean and min(r["b"] for r in rows) > 0.5 * mean


def test_slots_do_not_depend_on_the_file_split(spark, docs, rows):
    made = docs(rows)
    one, many = (sorted(sharding.shard(spark, made.repartition(n), leaves=4).collect(), key=str) for n in (1, 11))
    assert one == many
