"""Packing documents into token sequences by cutting-stock column generation.

Every document's ids are cut into full sequences and one remainder.  Remainder
lengths, rounded up to units, form a histogram of at most ``length / unit`` classes;
that histogram (never a document) reaches the driver, where a linear program over
patterns (how many pieces of each class share a sequence) is solved by column
generation: the dual prices feed a knapsack dynamic program that finds the next
pattern.  Rounded-down pattern counts plus a greedy cover of the rest fix every
slot; a piece's rank in its class names its slot.

Cases: null or empty text is the end id alone; repeated rows are packed each; a null
doc_id is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegraph.llm.common import WORD_STEP_BYTES, Tables, long_array, positions, text_bytes, text_steps, utf8

LENGTH = 4096
UNIT = 16
END_ID = 2
#: Column generation ends when the relaxation is within this share of its lower bound.
GAP = 2e-5
MOST_COLUMNS = 4000


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Rows ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): every
    document's ids with the end id, cut at multiples of ``length``."""
    id_type = pa.int64()
    fields = [("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        from sitegraph.llm.tokens import encoder

        encode = encoder(tokenizer_path)
        for batch in text_steps(batches, size=WORD_STEP_BYTES):
            out = []
            ids, first = encode.texts(*text_bytes(batch.column(1)))
            ids = ids.astype("<u4", copy=False)
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[lo:hi].tobytes() + end
                n = len(own) // 4
                for at in range(0, n, length):
                    part = own[4 * at:4 * (at + length)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n) + ((part,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)],
                names=[n for n, _ in fields])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")) \
        .mapInArrow(cut, schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, length: int = LENGTH, unit: int = UNIT,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset`` in that sequence."""
    store = Tables(spark, "packing")
    cls = F.ceil(F.col("length") / unit).cast("int")
    cut = store.write(pieces(docs, tokenizer_path, length, end_id, with_ids).withColumn("class", cls)
                      .withColumn("mixed", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    counts = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    plan = plan_patterns(counts, -(-length // unit))
    slots, first = [], {}
    sequence = 0
    for pattern, copies in plan:
        for c, n in sorted(pattern.items()):
            slots.append((c, first.get(c, 0), first.get(c, 0) + n * copies, n, sequence))
            first[c] = first.get(c, 0) + n * copies
        sequence += copies
    top = max(counts, default=0)
    before = np.cumsum([0] + [counts.get(c, 0) for c in range(top + 1)]).tolist()
    ranked = positions(store, cut, ["class", "mixed", "doc_id", "start", "ids_crc32"]) \
        .withColumn("rank", F.col("pos") - F.element_at(long_array(before), F.col("class") + 1))
    store.drop(cut)
    # patterns x classes: bounded by length / unit whatever the number of documents
    slot = F.broadcast(spark.createDataFrame(slots, "class int, low long, high long, each long, base long"))
    placed = ranked.join(slot, "class").where("rank >= low and rank < high") \
        .withColumn("sequence_id", F.expr("base + (rank - low) div each"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("pos")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         offset.alias("offset"), *(["ids"] if with_ids else []))


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{class: pieces}`` with how often each is used; they hold every piece."""
    classes = sorted(c for c, n in counts.items() if n)
    if not classes:
        return []
    size = np.array(classes)
    need = np.array([counts[c] for c in classes], float)
    columns, use = _relaxation(size, need, capacity)
    left = need.astype(np.int64)
    plan = []
    for a, x in sorted(zip(columns, use, strict=True), key=lambda p: -p[1]):
        copies = int(x + 1e-9)
        hit = a > 0
        if hit.any():
            copies = min(copies, int((left[hit] // a[hit]).min()))
        if copies and hit.any():
            left -= copies * a
            plan.append((a, copies))
    while left.any():                      # what rounding left: largest class first
        a, room = np.zeros_like(left), capacity
        for k in np.flatnonzero(left)[::-1]:
            a[k] = min(left[k], room // size[k])
            room -= a[k] * size[k]
        hit = a > 0
        copies = int((left[hit] // a[hit]).min())
        left -= copies * a
        plan.append((a, copies))
    return [({classes[k]: int(a[k]) for k in np.flatnonzero(a)}, n) for a, n in plan]


def _relaxation(size: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Revised simplex on: as few sequences as possible that cover ``need``.

    The basis starts with one single-class pattern per class.  The entering column
    is the pattern of the greatest dual worth, or the surplus of a class whose price
    went negative."""
    n = len(size)
    columns = [np.eye(n, dtype=np.int64)[k] * (capacity // size[k]) for k in range(n)]
    inverse = np.diag(1.0 / np.array([columns[k][k] for k in range(n)]))
    cost = np.ones(n)
    x = inverse @ need
    for _ in range(MOST_COLUMNS):
        price = cost @ inverse
        k = int(price.argmin())
        if price[k] < -1e-9:
            column, c = np.zeros(n, np.int64), 0.0
            column[k] = -1
        else:
            column, worth = _knapsack(size, np.maximum(price, 0), capacity)
            if worth <= 1 + GAP:
                break
            c = 1.0
        d = inverse @ column
        able = d > 1e-10
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        inverse[out] /= d[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(d[others], inverse[out])
        columns[out], cost[out] = column, c
    keep = cost > 0
    return [columns[k] for k in np.flatnonzero(keep)], x[keep]


def _knapsack(size: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern worth most at these prices (dynamic program over the room)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(size, room, "right"))
        best[room] = best[room - 1]
        if fit:
            worth = best[room - size[:fit]] + price[:fit]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-15:
                best[room], took[room] = worth[k], k
    column, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            column[took[room]] += 1
            room -= size[took[room]]
    return column, float(best[capacity])
