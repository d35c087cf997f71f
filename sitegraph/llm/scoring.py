"""Language-model scores of whole texts: a word unigram base and a causal
self-attention model on subword ids (``attention.py``).

Words are counted over all training texts.  The commonest words (at most HEAD) form a
table that every worker gets; the others are joined by hash, so the vocabulary may
grow with the corpus.  One pass over the texts encodes them and looks up the common
words; it is a written table, so nothing is encoded twice.  Subword counts, which
give a token's probability in its class, and neighbour counts, which give the classes,
cover all training texts.  The attention weights start from a bounded seed sample of
windows and are then trained by every task on all of its training windows, one step's
worth at a time, and averaged, weighted by windows (parameter averaging).

Cases: null or empty text is the end alone; a null doc_id is a training row; repeated
rows are scored each; without training texts the base is 1/(V+1) and the model its
start; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm import attention
from sitegraph.llm.attention import CLASSES, SPAN, STRIDE
from sitegraph.llm.common import WORD_STEP_BYTES, Tables, added, mix, signed, text_bytes, text_steps, utf8
from sitegraph.llm.tokens import Spelled, encoder, forget_encoders

HEAD = 1 << 18
SEED_WINDOWS = 40_000
COMMON = 256                    # tokens whose neighbourhood tells token classes apart
SINGLES = 128                   # the most frequent tokens have a class each


def count_words(texts: DataFrame) -> DataFrame:
    """``h, c``: how often each word (A-Z lowered) stands in ``texts(text)``."""
    def counted(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in text_steps(batches, size=WORD_STEP_BYTES):
            new, back = Spelled(*text_bytes(batch.column(0))).words()
            keys, counts = added(keys, counts, new, np.bincount(back, minlength=len(new)))
            if len(keys) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["h", "c"])
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["h", "c"])

    return texts.select("text").mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Base:
    """What the unigram needs on the workers: totals and the common words."""

    def __init__(self, counts: DataFrame, n_texts: int):
        words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens = words + n_texts
        self.scale = self.tokens + distinct + (n_texts > 0) + 1
        self.end = n_texts
        total, self.least = 0, 1
        for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect():
            total += r["count"]
            if total > HEAD:
                self.least = 2 << r["p"]
                break
        head = counts.where(F.col("c") >= self.least).toArrow()
        keys, count = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], np.log10((count[order] + 1) / self.scale)

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct words: whether each is common, and its log10 probability."""
        if not len(self.keys):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        hit = self.keys[at] == words
        return hit, np.where(hit, self.logs[at], 0.0)


PROFILE = ("row long, doc_id long, held_out boolean, n_tokens long, known long, base double, ids binary,"
           " tail array<struct<h:long,n:long>>")


def profile(docs: DataFrame, held_out: Column, base: Base, tokenizer_path: str) -> DataFrame:
    def rows(batches):
        encode = encoder(tokenizer_path)
        end = math.log10((base.end + 1) / base.scale)
        tail_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
        for batch in text_steps(batches, size=WORD_STEP_BYTES):
            data, offsets = text_bytes(batch.column(3))
            spelled = Spelled(data, offsets)
            words, back = spelled.words()
            first = spelled.words_first
            hit, logs = base.look(words)
            known = np.concatenate([[0], np.cumsum(hit[back])])
            total = np.concatenate([[0], np.cumsum(logs[back])])
            rare = np.flatnonzero(~hit[back])
            of = np.searchsorted(first, rare, "right") - 1
            pair, n = np.unique(of * max(len(words), 1) + back[rare], return_counts=True)     # of a row and a word
            row, word = np.divmod(pair, max(len(words), 1))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(signed(words)[word]), pa.array(n)], names=["h", "n"])).cast(tail_type)
            ids, at = encode.texts(data, offsets, spelled)
            ids = ids.astype("<u4", copy=False)
            blobs = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(first) + 1),
                 pa.array(np.diff(known[first]) + (base.end > 0)), pa.array(np.diff(total[first]) + end),
                 pa.array(blobs, pa.binary()), tail],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "ids", "tail"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       held_out.alias("held_out"), utf8(F.col("text")).alias("text")).mapInArrow(rows, PROFILE)


def tail_sums(rows: DataFrame, counts: DataFrame, base: Base) -> DataFrame:
    """``row, tail_base, tail_known`` of the words outside the common ones."""
    each = rows.where("size(tail) > 0").select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.n")
    rare = counts.where(F.col("c") < base.least)
    c = F.coalesce("c", F.lit(0))
    return each.join(rare, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(base.scale)))).alias("tail_base"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))


# ---- the attention model --------------------------------------------------------

def _streams(column: pa.Array, end: int, begin: int):
    """Of a batch of id blobs: the stream (a begin mark before every text), the text
    number of every position, and its target (the next token, or the end)."""
    data, offsets = text_bytes(column)
    ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
    n = np.diff(offsets) // 4
    first = np.concatenate([[0], np.cumsum(n + 1)])
    text = np.repeat(np.arange(len(n)), n + 1)
    stream, target = np.full(first[-1], begin, np.int64), np.full(first[-1], end, np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    stream[inner] = ids
    inner[:] = True
    inner[first[1:] - 1] = False
    target[inner] = ids
    return stream, text, target, first


def training_windows(rows: DataFrame, rate: float, salt: int, end: int, begin: int, then=None, schema="window binary"):
    """A share of all windows of ``rows(row, ids)`` by hash, as SPAN + 1 tokens each (-1:
    outside the text); or what ``then`` makes of each batch iterator of them."""
    limit = np.uint64(min(int(rate * 2.0 ** 64), (1 << 64) - 1))

    def chosen(batches):
        for batch in text_steps(batches, "ids"):
            data, offsets = text_bytes(batch.column(1))
            ids, n = np.frombuffer(data.tobytes(), "<u4"), np.diff(offsets) // 4
            blocks = n // STRIDE + 1                 # of the begin mark and n ids
            row = np.repeat(np.arange(len(n)), blocks)
            block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            number = batch.column(0).to_numpy()[row].astype(np.uint64)
            pick = np.flatnonzero(mix(mix(number + np.uint64(salt)) + block.astype(np.uint64)) <= limit)
            if len(pick):
                at = block[pick][:, None] * STRIDE - STRIDE + np.arange(SPAN + 1)
                last = n[row[pick]][:, None]
                inner = (at >= 1) & (at <= last)
                place = np.where(inner, offsets[:-1][row[pick]][:, None] // 4 + at - 1, 0)
                w = np.where(inner, ids[place] if len(ids) else 0, -1).astype(np.int32)
                w[at == 0], w[at == last + 1] = begin, end
                yield w

    def rows_of(batches):
        for w in chosen(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in w], pa.binary())], names=["window"])

    return rows.select("row", "ids").mapInArrow(rows_of if then is None else lambda b: then(chosen(b)), schema)


def training_arrays(w: np.ndarray, classes: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """Windows as ``gradient`` takes them: ids, texts, class goals, weights."""
    outside = w < 0
    return (np.where(outside, begin, w)[:, :SPAN], np.where(outside, -1, 0)[:, :SPAN],
            classes[np.where(outside, begin, w)[:, STRIDE + 1:]],
            (~outside[:, STRIDE:SPAN] & ~outside[:, STRIDE + 1:]).astype(np.float32))


def neighbours(rows: DataFrame, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all texts of ``rows(row, ids)``: cells token * 2 * COMMON + column of the neighbour
    table, and their counts.  Column k is the ``common`` token k after the token, COMMON + k
    before it.  At most the vocabulary times 2 * COMMON cells, whatever the corpus."""
    column = np.full(size, -1, np.int32)
    column[common] = np.arange(len(common))
    wide = 2 * COMMON

    def counted(batches):
        forget_encoders()
        keys, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in text_steps(batches, "ids", WORD_STEP_BYTES):
            data, offsets = text_bytes(batch.column(1))
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int32)
            if len(ids) < 2:
                continue
            inside = np.ones(len(ids) - 1, bool)        # both of a pair are of one text
            edge = offsets // 4
            inside[edge[(edge > 0) & (edge < len(ids))] - 1] = False
            a, b = ids[:-1][inside], ids[1:][inside]
            after, before = column[b], column[a]
            new, n = np.unique(np.concatenate([a[after >= 0] * wide + after[after >= 0],
                                               b[before >= 0] * wide + before[before >= 0] + COMMON]), return_counts=True)
            keys, counts = added(keys, counts, new, n)
            if len(keys) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["cell", "n"])
                keys, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts)], names=["cell", "n"])

    got = rows.select("row", "ids").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def token_classes(cells: np.ndarray, n: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """A class per token.  The most frequent tokens and the end have one each; the others
    are put together by their ``neighbours`` (square roots of neighbour shares, leading
    singular directions, weighted k-means), or dealt out by number where they have none."""
    size = len(counts)
    groups = CLASSES - 1 - SINGLES
    out = np.arange(size) % groups
    by_count = np.argsort(-counts[:end], kind="stable")
    total = np.bincount(cells // (2 * COMMON), n, end)
    seen = by_count[total[by_count] > 0]
    if len(seen) >= groups:
        line = np.full(end, -1)
        line[seen] = np.arange(len(seen))
        token = cells // (2 * COMMON)
        x = np.zeros((len(seen), 2 * COMMON), np.float32)
        x[line[token], cells % (2 * COMMON)] = np.sqrt(n / total[token])
        weight = np.sqrt(counts[seen] + 1.0).astype(np.float32)
        x -= (weight @ x) / weight.sum()
        product = np.zeros((2 * COMMON, 2 * COMMON))
        for at in range(0, len(x), 4096):
            product += (x[at:at + 4096] * weight[at:at + 4096, None]).T @ x[at:at + 4096]
        values, vectors = np.linalg.eigh(product)
        x = x @ vectors[:, values.argsort()[::-1][:16]].astype(np.float32)
        centre = x[:groups].copy()         # the most frequent tokens
        for _ in range(12):
            near = ((centre ** 2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
            mass = np.bincount(near, weight, groups)
            for d in range(x.shape[1]):
                s = np.bincount(near, weight * x[:, d], groups)
                centre[:, d] = np.where(mass > 0, s / np.maximum(mass, 1e-9), centre[:, d])
        out[seen] = near
    single = by_count[:SINGLES]
    out[single] = groups + np.arange(len(single))
    out[end:] = CLASSES - 1
    return out


def fit(rows: DataFrame, size: int) -> tuple[attention.Weights, np.ndarray, np.ndarray]:
    """Weights, token classes and log-probabilities within the class, from the training
    ``rows(row, ids)`` over a vocabulary of ``size``."""
    end, begin = size, size + 1

    def counted(batches):
        forget_encoders()
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(text_bytes(b.column(1))[0].tobytes(), "<u4"), minlength=size)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["id", "n"])

    got = rows.select("row", "ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 2, np.int64)       # vocabulary values, whatever the corpus
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    n_windows = max(1, int(counts.sum()) // STRIDE)
    seed = training_windows(rows, SEED_WINDOWS / n_windows, 1, end, begin).toArrow().column(0)
    seed = np.frombuffer(b"".join(seed.to_pylist()), np.int32).reshape(-1, SPAN + 1)
    common = np.argsort(-counts[:end], kind="stable")[:COMMON]
    classes = token_classes(*neighbours(rows, common, size), counts, end)
    weights = attention.start_weights(classes)
    if len(seed):
        weights, _ = attention.train(weights, *training_arrays(seed, classes, begin), epochs=4, rate=0.02)
        weights = averaged(rows, weights, classes, end, begin)
    within = counts[:size] + 1.0
    log_within = np.zeros(size + 2, np.float32)
    log_within[:size] = np.log(within / np.bincount(classes[:size], within, CLASSES)[classes[:size]])
    return weights, classes, log_within


def averaged(rows: DataFrame, weights: attention.Weights, classes: np.ndarray, end: int, begin: int) -> attention.Weights:
    """Training by all tasks from ``weights`` on, each on all its windows, averaged in a tree."""
    names = sorted(weights)
    shapes = [weights[n].shape for n in names]

    def local(windows):
        forget_encoders()
        own, n = attention.train_stream(weights, (training_arrays(w, classes, begin) for w in windows), rate=0.003)
        if n:
            flat = np.concatenate([own[x].ravel() for x in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat.tobytes()], pa.binary())], names=["n", "w"])

    trained = training_windows(rows, 1.0, 2, end, begin, local, "n long, w binary").rdd \
        .map(lambda r: (r[0], np.frombuffer(r[1], np.float32) * np.float32(r[0])))
    # as deep as it takes for a combining task, and the driver, to get about 8 models each
    depth = max(2, math.ceil(math.log(max(2, trained.getNumPartitions()), 8)))
    n, total = trained.treeAggregate((0, np.zeros(1, np.float32)), lambda a, b: (a[0] + b[0], a[1] + b[1]),
                                     lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=depth)
    if not n:
        return weights
    parts = np.split(total / np.float32(n), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return {k: p.reshape(s).astype(np.float32) for k, p, s in zip(names, parts, shapes, strict=True)}


def model_scores(rows: DataFrame, model: tuple, size: int) -> DataFrame:
    """``row, score``: log10 probability of every text under the model."""
    end, begin = size, size + 1

    def scored(batches):
        forget_encoders()
        scorer = attention.Scorer(*model)
        for batch in text_steps(batches, "ids"):
            stream, text, target, first = _streams(batch.column(1), end, begin)
            logs = np.concatenate([[0.0], np.cumsum(scorer.score(stream, text, target), dtype=np.float64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(logs[first]) / math.log(10))], names=["row", "score"])

    return rows.select("row", "ids").mapInArrow(scored, "row long, score double")


def score(spark: SparkSession, docs: DataFrame, held_out: Column, tokenizer_path: str) -> DataFrame:
    """Rows ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    store = Tables(spark, "scoring")
    train = docs.where(~held_out)
    counts = store.write(count_words(train.select(utf8(F.col("text")).alias("text"))), "counts")
    base = Base(counts, train.count())
    size = encoder(tokenizer_path).size
    rows = store.write(profile(docs, held_out, base, tokenizer_path), "profile")
    tails = store.write(tail_sums(rows, counts, base), "tails")
    store.drop(counts)
    model = fit(rows.where("not held_out"), size)
    scores = store.write(model_scores(rows, model, size), "scores")
    light = store.write(rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base"), "light")
    store.drop(rows)
    return light.join(scores, "row").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(base.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score")
