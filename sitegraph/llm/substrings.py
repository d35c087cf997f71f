"""Removal of repeated passages by difference-cover anchors.

A window of 50 words is repeated in a document when its word sequence also starts in
a document with a smaller doc_id.  Hashing every window would move a row per word.
Instead, 20-word anchors are hashed only at positions p with p mod 31 in a difference
cover: any two residues differ by one of the cover's differences, so two equal
windows share an anchor at the same depth (less than 31) inside both.  Anchors found
in two or more documents are extended: only the windows that hold one, at any such
depth, are hashed in full (128 bits) and compared by their smallest doc_id.  Exact
copies (equal word sequences) are settled first and bring no anchors.

Cases: null text has no words; a row without doc_id neither removes nor loses words;
rows with equal doc_id do not remove each other's words; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import (Tables, in_filter, key_filter, signed, slot_of, text_bytes, text_steps, utf8,
                                  window_hashes, word_hashes, word_spans)

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every residue modulo 31 is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _sequence(words: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a whole word sequence, as two signed longs."""
    if not len(words):
        return 0, 0
    return tuple(int(signed(window_hashes(words, len(words), k))[0]) for k in (0, 1))


def cover_positions(n: int) -> np.ndarray:
    """Word positions whose anchors a document of ``n`` words has."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    return at[_IN_COVER[at % PERIOD]]


def _documents(batches, column: str = "text"):
    """Per step: the batch, and for each row its text bytes and word hashes."""
    for batch in (s for b in batches for s in text_steps([b], column)):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        starts, ends, first = word_spans(data, offsets)
        yield batch, data, offsets, word_hashes(data, starts, ends), first


def _profile(batches):
    for batch, data, offsets, words, first in _documents(batches):
        out = {"n_words": [], "seq_a": [], "seq_b": [], "full_sha256": [], "anchors": []}
        anchors = window_hashes(words, ANCHOR)
        for k in range(batch.num_rows):
            lo, n = first[k], int(first[k + 1] - first[k])
            a, b = _sequence(words[lo:lo + n])
            text = data[offsets[k]:offsets[k + 1]].tobytes()
            out["n_words"].append(n)
            out["seq_a"].append(a)
            out["seq_b"].append(b)
            out["full_sha256"].append(hashlib.sha256(b" ".join(text.split())).hexdigest())
            out["anchors"].append(signed(anchors[lo + cover_positions(n)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["seq_a"], pa.int64()),
             pa.array(out["seq_b"], pa.int64()), pa.array(out["full_sha256"]),
             pa.array(out["anchors"], pa.list_(pa.int64()))],
            names=["doc_id", *out])


def _text(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), *more)


class Repeats:
    """What is repeated in ``docs``: ``rows`` (per row: counts, hashes, whether it is
    a copy) and ``windows`` (per affected row: the starts of repeated windows)."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.docs = docs
        store = self.store = Tables(spark, "substrings")
        profile = store.write(_text(docs).mapInArrow(
            _profile, "doc_id long, n_words long, seq_a long, seq_b long, full_sha256 string, anchors array<long>"),
            "profile")
        key = ["seq_a", "seq_b", "n_words"]
        first = profile.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("first_id"))
        rows = profile.drop("anchors").join(first, key, "left")
        copy = (F.col("n_words") >= WINDOW) & F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
        self.rows = store.write(rows.select("doc_id", *key, "full_sha256", copy.alias("copy")), "rows")
        self.windows = self._windows(profile)
        store.drop(profile)

    def _windows(self, profile: DataFrame) -> DataFrame:
        store = self.store
        own = self.rows.where("not copy and doc_id is not null and n_words >= 50").select("doc_id", "seq_a").distinct()
        # anchors, by document: their order gives their positions
        leaders = store.write(profile.select("doc_id", "seq_a", "anchors").join(own, ["doc_id", "seq_a"], "left_semi"),
                              "leaders")
        shared = leaders.select("doc_id", F.explode("anchors").alias("anchor")).groupBy("anchor") \
            .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
        shared = store.write(shared, "shared")
        seen = key_filter(shared, F.col("anchor"))

        def likely(batches):
            for batch in batches:
                doc, seq, anchor, at, slot = (batch.column(k) for k in range(5))
                keep = in_filter(seen, slot.to_numpy())
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (doc, seq, anchor, at)],
                                                 names=["doc_id", "seq_a", "anchor", "at"])

        placed = leaders.select("doc_id", "seq_a", F.posexplode("anchors").alias("at", "anchor")) \
            .select("doc_id", "seq_a", "anchor", "at", slot_of(F.col("anchor"))) \
            .mapInArrow(likely, "doc_id long, seq_a long, anchor long, at int")
        hits = placed.join(shared, "anchor").groupBy("doc_id", "seq_a").agg(F.collect_list("at").alias("at"))
        hits = store.write(hits, "hits")
        store.drop(leaders, shared)

        suspects = store.write(self._with_text(hits), "suspects")
        store.drop(hits)
        windows = store.write(suspects.mapInArrow(
            _full_windows, "doc_id long, seq_a long, at array<int>, a array<long>, b array<long>"), "windows")
        store.drop(suspects)
        each = windows.select("doc_id", "seq_a", F.explode(F.arrays_zip("at", "a", "b")).alias("w")) \
            .select("doc_id", "seq_a", "w.*")
        least = store.write(each.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                            .where("lo < hi").select("a", "b", "lo"), "least")
        repeated = each.join(least, ["a", "b"]).where("lo < doc_id") \
            .groupBy("doc_id", "seq_a").agg(F.collect_list("at").alias("starts"))
        out = store.write(repeated, "repeated")
        store.drop(windows, least)
        return out

    def _with_text(self, marked: DataFrame) -> DataFrame:
        """``marked(doc_id, seq_a, ...)`` with the texts of its documents."""
        ids = key_filter(marked, F.col("doc_id"))

        def chosen(batches):
            for b in batches:
                b = b.filter(pa.array(in_filter(ids, b.column(2).to_numpy())))
                for batch, _, _, words, first in _documents([b]):
                    seq = [_sequence(words[first[k]:first[k + 1]])[0] for k in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.int64()), batch.column(1)],
                                                     names=["doc_id", "seq_a", "text"])

        texts = _text(self.docs, slot_of(F.col("doc_id").cast("long")).alias("slot")).where("doc_id is not null") \
            .mapInArrow(chosen, "doc_id long, seq_a long, text string")
        return texts.join(marked, ["doc_id", "seq_a"])


def _full_windows(batches):
    """Every window that holds a shared anchor at a depth under the period, hashed in full."""
    for batch, _, _, words, first in _documents(batches):
        at, a, b = [], [], []
        for k in range(batch.num_rows):
            own = words[first[k]:first[k + 1]]
            n = len(own) - WINDOW + 1
            hits = cover_positions(len(own))[np.sort(np.array(batch.column(3)[k].as_py()))]
            held = np.zeros(len(own) + 1, np.int64)
            np.add.at(held, np.maximum(hits - (PERIOD - 1), 0), 1)
            np.add.at(held, hits + 1, -1)
            starts = np.flatnonzero(np.cumsum(held)[:n] > 0)
            at.append(starts.astype(np.int32))
            a.append(signed(window_hashes(own, WINDOW, 0)[starts]))
            b.append(signed(window_hashes(own, WINDOW, 1)[starts]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(a, pa.list_(pa.int64())),
             pa.array(b, pa.list_(pa.int64()))], names=["doc_id", "seq_a", "at", "a", "b"])


def kept_mask(n_words: int, starts) -> np.ndarray:
    """Which words no repeated window covers."""
    cover = np.zeros(n_words + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + WINDOW, n_words), -1)
    return np.cumsum(cover)[:n_words] == 0


def _kept(batches):
    for batch in (s for b in batches for s in text_steps([b])):
        out = []
        for text, starts in zip(batch.column(2), batch.column(3), strict=True):
            words = text.as_buffer().to_pybytes().split()
            mask = kept_mask(len(words), starts.values.to_numpy())
            left = b" ".join([w for w, keep in zip(words, mask.tolist(), strict=True) if keep])
            out.append((int((~mask).sum()), hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out])],
            names=["doc_id", "seq_a", "n_removed", "kept_sha256"])


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept_sha256``."""
    found = Repeats(spark, docs)
    part = found.store.write(found._with_text(found.windows).mapInArrow(
        _kept, "doc_id long, seq_a long, n_removed long, kept_sha256 string").distinct(), "cut")
    empty = hashlib.sha256(b"").hexdigest()
    return found.rows.join(part, ["doc_id", "seq_a"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"))


def _cut_text(batches):
    for batch in (s for b in batches for s in text_steps([b])):
        data, offsets = text_bytes(batch.column(1))
        starts, ends, first = word_spans(data, offsets)
        texts = []
        for k in range(batch.num_rows):
            whole = batch.column(1)[k].as_py()
            lo, n, marks = first[k], int(first[k + 1] - first[k]), batch.column(2)[k].as_py()
            if batch.column(3)[k].as_py():
                texts.append("")
            elif not marks:
                texts.append(whole)
            else:
                # keep the white space of what stays: each kept run of words is a slice of the text
                mask = kept_mask(n, marks)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                runs = [data[starts[lo + i]:ends[lo + j - 1]].tobytes() for i, j in zip(edge[::2], edge[1::2], strict=True)]
                texts.append(b" ".join(runs).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type)], names=["row", "text"])


def remove(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (and ``n_chars`` counted
    anew); every row stays, a document repeated as a whole with an empty text."""
    found = Repeats(spark, docs)
    cut = found.rows.join(found.windows, ["doc_id", "seq_a"], "left").where("copy or starts is not null") \
        .groupBy("doc_id", "seq_a").agg(F.first("starts").alias("starts"), F.max("copy").alias("copy"))

    def sequence(batches):
        for batch, _, _, words, first in _documents(batches):
            seq = [_sequence(words[first[k]:first[k + 1]])[0] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], names=[*batch.schema.names, "seq_a"])

    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), row.alias("row"))
    row_type = packed.schema["row"].dataType.simpleString()
    keyed = packed.mapInArrow(sequence, f"doc_id long, text string, row {row_type}, seq_a long")
    out = keyed.join(cut, ["doc_id", "seq_a"], "left").select("row", "text", "starts", F.coalesce("copy", F.lit(False))) \
        .mapInArrow(_cut_text, f"row {row_type}, text string")
    values = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])
