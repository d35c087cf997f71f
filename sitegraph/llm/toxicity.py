"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of word pairs over a model of words.  A pair counts as often as it
stands in the distinct texts of the class; a word counts by the distinct words it follows
there (continuation counts).  A discount is taken off every count, estimated per class and
order from the counts of counts (n1 / (n1 + 2 n2)); what is taken off a pair goes to the
word model, what is taken off a word to one distribution shared by both classes, so rare
expressions back off gradually at every sample size.  A document's evidence is the
difference of its toxic and ordinary log-likelihoods, normalised by length, under the pair
and under the word model: the plain ones, of the whole text and of its most and least toxic
runs of words, and next to them the parts beyond a margin per word on either side, so either
label may be the one that a few words give away.  A pair counts once in a text, however often
it is repeated there.  A logistic curve turns evidence into a score; it is fitted on
documents that the counts behind their evidence did not see (two folds).  More evidence never
lowers a score (no weight is below 0), and with few documents the words beyond the margin decide.

The models are fitted on at most SAMPLE labelled documents of each class, chosen by
hash; everything is counted in Spark, and the tables that reach the driver and the
workers hold at most ENTRIES expressions (a larger least count beyond that).

Cases: a text without a word that the models know (null or empty, too) has no evidence and
gets the share of toxic labels, a word they do not know says nothing; a null or missing label is not
learned from; a document with several labels is toxic if any is; without labels of
both classes every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, mix, signed, text_bytes, text_steps, utf8, word_hashes

SAMPLE = 8000                   # labelled documents of each class
ENTRIES = 1_000_000             # expressions of each kind in a model
MARGIN = 1.5                    # log-likelihood difference of a word that is strong evidence
RUN = 50                        # words of the most and of the least toxic run
FEATURES = 14
# weights of the standardised features before any document (words beyond the margin, in the whole
# text and in a run), and in how many documents that counts
PRIOR, TRUST = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 1, 2, 1.0]), 15.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = np.zeros(256, bool)   # bytes of a word: digits, letters, all beyond ASCII
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def remainder(doc_id: Column, by: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % by


def _words(batches, column: int):
    """Per step: the batch, hashes of all its words, and each row's first word (n+1)."""
    for batch in (s for b in batches for s in text_steps([b])):
        data, offsets = text_bytes(batch.column(column))
        inside = _INSIDE[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        start[edge], end[edge - 1] = inside[edge], inside[edge - 1]
        starts = np.flatnonzero(start)
        yield batch, word_hashes(data, starts, np.flatnonzero(end) + 1, True), np.searchsorted(starts, offsets)


def _heads(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word in its text (0: none)."""
    before = np.concatenate([np.zeros(1, np.uint64), words])[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    return before


def _pairs(heads: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of each word with the word before it."""
    return mix(heads * _PAIR + words)


def _first_time(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word stands after its left one for the first time in its text."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    _, at = np.unique(mix(_pairs(_heads(words, first), words) + text * _PAIR), return_index=True)
    out = np.zeros(len(words), bool)
    out[at] = True
    return out


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, tuple[int, int]]:
    """At most about SAMPLE labelled documents of each class (doc_id, toxic, fold), and the
    numbers of labelled documents.  Its size is bounded, so it may be broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id") \
        .agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(learn)
    number = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    counts = (number.get(0, 0), number.get(1, 0))
    rate = F.when(F.col("toxic") == 1, F.lit(SAMPLE / max(counts[1], 1))).otherwise(F.lit(SAMPLE / max(counts[0], 1)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 34) / float(1 << 30)
    chosen = known.where(place < rate).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))
    return chosen, counts


def _counted(batches):
    """Occurrences of pairs: key, first word, second word, and counts by class and fold."""
    for batch, words, first in _words(batches, 1):
        cell = np.repeat(batch.column(2).to_numpy() * 2 + batch.column(3).to_numpy(), np.diff(first))
        heads = _heads(words, first)
        key, at, back = np.unique(_pairs(heads, words), return_index=True, return_inverse=True)
        counts = np.bincount(back * 4 + cell, minlength=4 * len(key)).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(key)), pa.array(signed(heads[at])), pa.array(signed(words[at])),
             *[pa.array(counts[:, c]) for c in range(4)]], names=["key", "head", "word", "c0", "c1", "c2", "c3"])


def discounts(once: list, twice: list) -> np.ndarray:
    """Kneser-Ney's n1 / (n1 + 2 n2), kept inside 0 and 1 where there are none."""
    n1, n2 = np.array(once, float), np.array(twice, float)
    return (n1 + 0.5) / (n1 + 2 * n2 + 1)


class Model:
    """Word and pair estimates of both classes as sorted arrays."""

    def __init__(self, words: tuple, pairs: tuple, heads: tuple, mass: np.ndarray, left: np.ndarray, off: tuple):
        """``words``: keys, continuation counts (n x 2); ``pairs``: keys, counts; ``heads``: first
        words with their pair counts and what the discounts left of them (n x 2 each); ``mass``:
        all continuation counts by class; ``left``: what the discounts left of them; ``off``: the
        discounts of words and of pairs by class."""
        order = np.argsort(words[0])
        self.words, count = words[0][order], words[1][order]
        shared = count.sum(axis=1) / mass.sum()
        self.p = (np.maximum(count - off[0], 0) + (mass - left) * shared[:, None]) / mass
        order = np.argsort(pairs[0])
        self.pairs, self.over = pairs[0][order], np.maximum(pairs[1][order] - off[1], 0).astype(np.float32)
        order = np.argsort(heads[0])
        self.heads, self.total = heads[0][order], heads[1][order]
        self.taken = self.total - heads[2][order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted key, or -1."""
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)

    def difference(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Toxic minus ordinary log-likelihood of each word after its left one, the same by the
        word model alone, and whether the word is known (if not, both are 0)."""
        before = _heads(words, first)
        out = np.zeros(len(words))
        at = self._find(self.words, words)
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return out, out, at >= 0
        p = self.p[at[known]]
        alone = np.zeros(len(words))
        alone[known] = np.log(p[:, 1]) - np.log(p[:, 0])
        head = self._find(self.heads, before[known])
        pair = self._find(self.pairs, _pairs(before, words)[known])
        both = np.flatnonzero(head >= 0)
        total, taken = self.total[head[both]], self.taken[head[both]]
        over = np.where(pair[both, None] >= 0, self.over[pair[both]], 0) if len(self.pairs) else 0
        p[both] = np.where(total > 0, (over + taken * p[both]) / np.maximum(total, 1e-9), p[both])
        out[known] = np.log(p[:, 1]) - np.log(p[:, 0])
        return out, alone, at >= 0

    def evidence(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document, by the pair and the word model: difference per distinct pair, and per word
        of its most and least toxic runs; then of all and of such a run the root of the part beyond
        the margin, on either side.  Every feature is larger where a text is more toxic.  And
        whether it has a known word."""
        plain, alone, known = self.difference(words, first)
        has = np.diff(np.concatenate([[0], np.cumsum(known)])[first]) > 0
        new = _first_time(words, first)
        distinct = np.diff(np.concatenate([[0], np.cumsum(new)])[first])
        out = np.zeros((len(first) - 1, FEATURES))
        column = 0
        for each in (plain * new, alone * new):
            above, below = np.maximum(each - MARGIN, 0), np.maximum(-each - MARGIN, 0)
            for values, ends in ((each, (1, -1)), (above, (1,)), (below, (1,))):
                upto = np.concatenate([[0], np.cumsum(values)])
                out[:, column] = (upto[first[1:]] - upto[first[:-1]]) / np.maximum(distinct, 1)
                for k in np.flatnonzero(has).tolist():
                    lo, hi = int(first[k]), int(first[k + 1])
                    run = min(RUN, hi - lo)
                    sums = upto[lo + run:hi + 1] - upto[lo:hi + 1 - run]
                    out[k, column + 1] = sums.max() / RUN
                    if len(ends) > 1:
                        out[k, column + 2] = sums.min() / RUN
                if values is not each:
                    side = slice(column, column + 2)
                    out[:, side] = np.sqrt(np.maximum(out[:, side], 0)) * (1 if values is above else -1)
                column += 1 + len(ends)
        return out, has


def _model(store: Tables, counts: DataFrame, cells: tuple[tuple[str, ...], tuple[str, ...]]) -> Model | None:
    """The model of the counts in ``cells`` (columns of the ordinary, of the toxic class)."""
    n0, n1 = (sum((F.col(c) for c in side), F.lit(0)) for side in cells)
    pairs = counts.select("key", "head", "word", n0.alias("n0"), n1.alias("n1")).where("n0 + n1 > 0")
    words = store.write(pairs.groupBy(F.col("word").alias("key")).agg(
        *[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")]), "words")
    off, least, both = [], [], ("n0", "n1")
    for rows in (words, pairs):
        few = rows.agg(*[F.sum((F.col(n) == k).cast("long")) for k in (1, 2) for n in both]).first()
        if few[0] is None:
            return None
        off.append(discounts(few[:2], few[2:]))
        sizes = rows.groupBy(F.least(F.greatest(*both), F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()
        total, at_least = 0, 1
        for r in sizes:
            total += r["count"]
            if total > ENTRIES:
                at_least = r["n"] + 1
                break
        least.append(at_least)

    def left(n: int, order: int) -> Column:
        return F.sum(F.greatest(F.col(both[n]) - float(off[order][n]), F.lit(0.0))).alias(f"left{n}")

    mass = words.agg(F.sum("n0"), F.sum("n1"), left(0, 0), left(1, 0)).first()
    if not mass[0] or not mass[1]:
        return None
    strong = F.greatest(*both)

    def fetch(df, n):
        t = df.toArrow()
        return t.column(0).to_numpy().view(np.uint64), *[
            np.stack([t.column(k).to_numpy(), t.column(k + 1).to_numpy()], axis=1).astype(float) for k in range(1, n, 2)]

    word = fetch(words.where(strong >= least[0]).select("key", "n0", "n1"), 3)
    kept = pairs.where(strong >= least[1])
    pair = fetch(kept.select("key", "n0", "n1"), 3)
    total = pairs.groupBy("head").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    head = fetch(total.join(kept.groupBy("head").agg(left(0, 1), left(1, 1)), "head")
                 .select("head", "n0", "n1", "left0", "left1"), 5)
    store.drop(words)
    return Model(word, pair, head, np.array(mass[:2], float), np.array(mass[2:], float), tuple(off))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression (Newton steps) with weights of 0 or more, drawn to PRIOR
    (per standard deviation) as by TRUST documents; bias last."""
    scale = x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    n = x.shape[1] - 1
    prior = np.append(PRIOR, 0.0)
    ridge = np.array([TRUST] * n + [1e-6])

    def loss(w):
        z = np.clip(x @ w, -30, 30)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * (w - prior) ** 2).sum() / 2

    w = prior.copy()
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * (w - prior)
        free = np.append((w[:n] > 0) | (slope[:n] < 0), True)
        curved = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.zeros(n + 1)
        step[free] = np.clip(np.linalg.solve(curved[np.ix_(free, free)], slope[free]), -5, 5)
        for part in (1.0, 0.5, 0.25, 0.1, 0.02, 0.001):
            to = w - part * step
            to[:n] = np.maximum(to[:n], 0)
            if (after := loss(to)) <= now:
                break
        else:
            break
        done, w, now = np.abs(to - w).max() < 1e-8, to, after
        if done:
            break
    w[:n] /= scale
    return w


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Rows ``doc_id, score``: learned from the labelled documents for which ``learn``
    (a condition on doc_id) holds."""
    store = Tables(spark, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    chosen, number = sample(spark, docs, labels, learn)
    chosen = store.write(chosen, "sample")
    own = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "fold")
    own = store.write(own.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"),
                                                            F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))
                      .select("doc_id", "text", "toxic", "fold"), "texts")
    counts = own.mapInArrow(_counted, "key long, head long, word long, c0 long, c1 long, c2 long, c3 long") \
        .groupBy("key").agg(F.min("head").alias("head"), F.min("word").alias("word"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])
    counts = store.write(counts, "counts")
    folds = [_model(store, counts, ((f"c{f}",), (f"c{2 + f}",))) for f in (0, 1)]
    final = _model(store, counts, (("c0", "c1"), ("c2", "c3")))
    curve = None
    if final is not None and None not in folds:
        def unseen(batches):
            for batch, words, first in _words(batches, 1):
                fold = batch.column(3).to_numpy()
                (x0, has0), (x1, has1) = (m.evidence(words, first) for m in folds)
                x = np.where(fold[:, None] == 0, x1, x0)[use := np.where(fold == 0, has1, has0)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).filter(pa.array(use)), *[pa.array(x[:, k]) for k in range(FEATURES)]],
                    names=["toxic", *names])

        names = [f"x{k}" for k in range(FEATURES)]
        got = own.mapInArrow(unseen, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow()
        y = got.column(0).to_numpy().astype(float)
        x = np.stack([got.column(n).to_numpy() for n in names], axis=1)
        share = [number[c] / max(1, (y == c).sum()) for c in (0, 1)]
        curve = fit_curve(x, y, np.where(y == 1, share[1], share[0]))
    store.drop(own, counts)

    def scored(batches):
        for batch, words, first in _words(batches, 1):
            if curve is None:
                p = np.zeros(batch.num_rows)
            else:
                x, has = final.evidence(words, first)
                p = 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))
                p = np.where(has, p, number[1] / sum(number))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return texts.mapInArrow(scored, "doc_id long, score double")
