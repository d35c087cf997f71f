"""Ranked lexical search in reverse: the items are indexed, the documents stream through.

The inverted index over the items' terms (term -> items that hold it, with repeats) goes to
every task.  Each document's counts of those terms are looked up in it; each task keeps the
``k`` best documents of every item in a heap and passes on only those, and the heaps of the
tasks are merged, some tasks at a time.  Two passes: term counts of each document (written:
document lengths and document frequencies are aggregates over them), then the scores.

The index is as large as the items' texts, so its size is counted before it is sent: of more
than ``POSTINGS`` entries, the items are cut into blocks by hash and every block is run against
all documents.

Cases: a document without terms is not counted and never listed; without doc_id it is listed
with null, after others of equal score; rows with equal doc_id are documents of their own; every
row of the items is an item of its own, one without terms gets no rows; empty tables give an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, signed, text_bytes, text_steps, utf8, word_hashes, word_spans

BEST = 10
#: Entries (item, term) of the index that is sent to the tasks: 20 bytes each.
POSTINGS = 2_000_000
#: Heaps of so many tasks are merged before all are.
MERGED = 256
NO_ID = (1 << 63) - 1

# FIXED VALUES: a term is a run of ASCII letters, digits and characters beyond ASCII.
BETWEEN = np.ones(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    BETWEEN[_low:_high + 1] = False
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(batches):
    """Per step: the batch, the hash of each term in it, the document (row) it is in, and
    the number of terms of each document."""
    for step in (s for b in batches for s in text_steps([b])):
        data, offsets = text_bytes(step.column(1))
        starts, ends, first = word_spans(data, offsets, BETWEEN)
        lengths = np.diff(first)
        yield step, signed(word_hashes(data, starts, ends, lower=True)), np.repeat(np.arange(len(lengths)), lengths), lengths


def _postings(batches):
    for step, terms, row, _ in _terms(batches):
        pairs, times = np.unique(np.stack([row, terms]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([step.column(0).take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(times.astype(np.int64))],
                                         names=["item", "term", "times"])


def _counts(vocabulary: np.ndarray):
    """Documents -> number of terms, and the counts of those in the sorted ``vocabulary``."""
    def run(batches):
        size = len(vocabulary)
        for step, terms, row, lengths in _terms(batches):
            at = np.searchsorted(vocabulary, terms)
            hit = at < size
            hit[hit] = vocabulary[at[hit]] == terms[hit]
            keys, times = np.unique(row[hit] * size + at[hit], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(lengths) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (keys % size, times)]
            out = pa.RecordBatch.from_arrays([step.column(0), pa.array(lengths), *lists], names=["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(lengths > 0))
    return run


class Index:
    """The inverted index of a block of items: ``term -> (items, repeats)`` as one array with
    the places where each term's entries start."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray):
        self.items, item_at = np.unique(item, return_inverse=True)
        self.vocabulary, term_at = np.unique(term, return_inverse=True)
        order = np.argsort(term_at, kind="stable")
        self.item, self.times = item_at[order].astype(np.int64), times[order].astype(np.int64)
        self.start = np.searchsorted(term_at[order], np.arange(len(self.vocabulary) + 1))

    def weigh(self, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms

    def scores(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """Documents with ``n`` terms and counts (row, term, tf) -> (row, item, score)."""
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        many = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(row, many) * len(self.items) + self.item[at]
        value = np.repeat(value, many) * self.times[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(value[order], first) if len(key) else value
        key = key[first]
        return key // len(self.items), key % len(self.items), total


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(index, k: int):
    """Term counts of documents -> the ``k`` best of this task for each item."""
    def run(batches):
        own = index.value
        heaps: dict[int, list] = {}
        floor = np.zeros(len(own.items), np.int64)  # what a document must reach to enter a full heap
        for b in batches:
            doc = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(b.column(2).offsets.to_numpy())
            row, item, score = own.scores(n, np.repeat(np.arange(len(n)), sizes), _flat(b.column(2)), _flat(b.column(3)))
            good = (score > 0) & (score >= floor[item])
            for r, i, s in zip(row[good].tolist(), item[good].tolist(), score[good].tolist(), strict=True):
                heap = heaps.setdefault(i, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -int(doc[r])))
                else:
                    heapq.heappushpop(heap, (s, -int(doc[r])))
                if len(heap) == k:
                    floor[i] = heap[0][0]
        rows = [(int(own.items[i]), None if d == -NO_ID else -d, s) for i, heap in heaps.items() for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "doc_id", "score"])
    return run


def _block(store: Tables, docs: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items."""
    spark = store.spark
    found = postings.toArrow()
    index = Index(*(found.column(c).to_numpy() for c in range(3)))
    counts = store.write(docs.mapInArrow(_counts(index.vocabulary), "doc_id long, n long, terms array<int>, times array<int>"), "counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(index.vocabulary), np.int64)
    for term, held in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = held
    index.weigh(df, n_docs, n_terms or 1)
    heaps = counts.mapInArrow(_ranked(spark.sparkContext.broadcast(index), k), "item long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = heaps.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))) \
        .where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each item: rows ``item_id, rank, doc_id, score``."""
    store = Tables(spark, "retrieval")
    asked = store.write(items.select(F.col("item_id"), utf8(F.col("text")).alias("text"))
                        .withColumn("item", F.monotonically_increasing_id()), "items")
    postings = store.write(asked.select("item", "text").mapInArrow(_postings, "item long, term long, times long"), "postings")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    blocks = max(1, math.ceil(2 * postings.count() / POSTINGS))  # twice as many as needed where hashing is even
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = [_block(store, texts, postings.where(block == b) if blocks > 1 else postings, k) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return asked.select("item", "item_id").join(out, "item").select("item_id", "rank", "doc_id", "score")


def oracle(k: int = BEST) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '{TERM_RE}')"
    return f"""
WITH d AS (SELECT doc_id, unnest({words}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
q AS (SELECT item_id, unnest({words}) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM len, total),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r
  FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= {k}"""
