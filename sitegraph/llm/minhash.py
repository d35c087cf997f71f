"""Near-duplicate documents by one-permutation hashing.

A document's set of word shingles is hashed once.  The hash range is cut into BINS
equal bins, a bin keeps its smallest hash, and an empty bin takes the value of the
first full bin in a fixed random order of its own (optimal densification), so that
two sets agree in any bin with their Jaccard similarity.  Bands of ROWS bins are the
buckets.  Equal sets are one class, compared once.

Candidate pairs are stars: in every round each bucket names a hub, and only members
not yet connected with it are paired with it.  A pair is confirmed on the two full
sets.  After a round, the hub has been compared with all, so it leaves the bucket; a
bucket whose members are all connected is done.  Rounds go on while stars still
connect much.  The members left over, blocks of them against blocks, are then compared inside the
tasks: every pair of a bucket that is not connected yet and whose set sizes allow the
similarity is confirmed on the full sets, in the first bucket that both share, and the
task returns a spanning forest of the links.  No bucket pair that could connect two
components stays untested, and no stage has more rows than members and blocks.

Cases: null or empty text has an empty set, linked with nothing; a row without doc_id
has no component and is kept, each such row; rows with equal doc_id and equal text share one result;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import (Tables, components, forest, in_filter, key_filter, mix, powers, signed, slot_of, text_bytes,
                                  text_steps, utf8, window_hashes, word_hashes, word_spans)

BANDS = 32
ROWS = 5
BINS = BANDS * ROWS
PERCENT = 80
#: Star rounds end when fewer than this share of a round's pairs are links.
WORTH = 0.1
#: Members, and shingles, of a block in the last comparison.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(61)
#: For every bin, the order in which it looks for a full bin: _TURN[i, j] is the turn of bin j.
_TURN = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1)
_BAND_BASE = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_ROW_BASE = powers(np.uint64(0x9E6C63D0876A9A7F), ROWS)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles (fewer words: the sequence)."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set, densified; BINS values."""
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    full, at = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    out[full] = hashes[at]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = hashes[at][_TURN[np.ix_(empty, full)].argmin(axis=1)]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS) * _ROW_BASE).sum(axis=1, dtype=np.uint64) ^ _BAND_BASE)


def _sets(batches, width: int, lower: bool, column: int = 1):
    for batch in (s for b in batches for s in text_steps([b])):
        data, offsets = text_bytes(batch.column(column))
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, lower)
        yield batch, [shingle_set(words[first[k]:first[k + 1]], width) for k in range(batch.num_rows)]


def profile(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands, text_hash``: equal (n, a, b) are equal sets."""
    def rows(batches):
        for batch, sets in _sets(batches, width, True):
            a = [int(signed(s.sum(dtype=np.uint64)[None])[0]) for s in sets]
            b = [int(signed(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None])[0]) for s in sets]
            keys = [signed(bands(signature(s))) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()),
                 pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column(2)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "text_hash"])

    text = utf8(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")) \
        .mapInArrow(rows, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, text_hash long")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Rows ``doc_id, text_hash, n_shingles, set_a, set_b, component_id, kept``."""
    store = Tables(spark, "minhash")
    rows = store.write(profile(docs, width), "profile")
    key = ["n_shingles", "set_a", "set_b"]
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = store.write(classes, "classes")
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi") \
        .dropDuplicates([*key, "doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    reps = store.write(reps, "reps")
    links = confirmed_links(store, docs, reps, width, percent)
    roots = store.write(components(store, links), "roots")
    label = rows.join(classes, key, "left").join(roots, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return label.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b", own.alias("component_id"),
                        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns kept;
    rows without doc_id all stay."""
    store = Tables(spark, "minhash")
    kept = near_duplicates(spark, docs, **how).where("kept and doc_id is not null") \
        .groupBy("doc_id", "n_shingles", "set_a", "set_b").agg(F.min("text_hash").alias("text_hash"))
    kept = store.write(kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("_doc"),
                        F.xxhash64(utf8(F.col("text"))).alias("_text"))
    found = keyed.join(kept, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    without = docs.where(F.col("doc_id").cast("long").isNull())
    return found.dropDuplicates(["_doc", "_text"]).select("row.*").unionAll(without)


def confirmed_links(store: Tables, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: confirmed links that connect whatever the links of all bucket pairs connect."""
    members = reps.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    many = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    left = store.write(members.join(many, "bucket").withColumn("root", F.col("rep")), "members")
    sets = shingle_sets(store, docs, left, width)
    links, round_no = None, 0
    while not left.isEmpty():
        hub = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(round_no)).alias("h"), "rep", "n", "root"))
                                         .alias("hub"))
        hubs = store.write(hub.select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"),
                                      F.col("hub.root").alias("hub_root")), "hubs")
        able = (F.col("root") != F.col("hub_root")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        pairs = store.write(left.join(hubs, "bucket").where(able).select("rep", "hub").distinct(), "pairs")
        found = store.write(confirm(pairs, sets, percent), "found")
        links = found if links is None else links.unionAll(found)
        roots = store.write(components(store, links), "roots")
        rest = left.join(hubs.select("bucket", "hub"), "bucket").where("rep <> hub").drop("hub", "root") \
            .join(roots, F.col("rep") == F.col("node"), "left") \
            .select("rep", "n", "band", "bucket", F.coalesce("root", "rep").alias("root"))
        open_ = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        after = store.write(rest.join(open_, "bucket"), "members")
        much = found.count() >= WORTH * pairs.count()
        store.drop(left, hubs, pairs)
        left, round_no = after, round_no + 1
        if not much:
            return links.unionAll(store.write(leftover_links(store, left, reps, sets, percent), "found"))
    return links if links is not None else store.spark.createDataFrame([], "a long, b long")


def leftover_links(store: Tables, members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a forest of the links between members of a bucket that are not connected
    yet.  A pair is looked at in the first band that both members share."""
    count = members.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    blocks = members.join(count, "bucket").join(reps.select("rep", "bands"), "rep") \
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))) \
        .groupBy("bucket", "block").agg(F.first("band").alias("band"), F.collect_list(F.struct("rep", "root", "n", "bands")).alias("m"))
    blocks = store.write(blocks, "blocks")
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("m").alias("m2"))
    work = blocks.join(other, "bucket").where("block <= block2").select(
        "bucket", "block", "block2", "band", "m", "m2")

    def side(column, k):
        v = column[k].values
        rep, root, n, keys = (v.field(f) for f in ("rep", "root", "n", "bands"))
        return rep.to_numpy(), root.to_numpy(), n.to_numpy(), keys.flatten().to_numpy().reshape(-1, BANDS)

    def looked(batches):
        for b in batches:
            bucket, block, block2, band = (b.column(c).to_pylist() for c in range(4))
            out = []
            for k in range(b.num_rows):
                (ra, ca, na, sa), (rb, cb, nb, sb) = side(b.column(4), k), side(b.column(5), k)
                able = (ca[:, None] != cb[None, :]) & (
                    100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :]))
                if block[k] == block2[k]:
                    able &= ra[:, None] < rb[None, :]
                i, j = np.nonzero(able)
                keep = np.zeros(len(i), bool)
                for at in range(0, len(i), 8192):
                    keep[at:at + 8192] = (sa[i[at:at + 8192]] == sb[j[at:at + 8192]]).argmax(axis=1) == band[k]
                if keep.any():
                    ids, at = np.unique(np.concatenate([ra[i[keep]], rb[j[keep]]]), return_inverse=True)
                    out.append((f"{bucket[k]} {block[k]} {block2[k]}", ids.tolist(), at.astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True), (pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)],
                    names=["task", "ids", "pairs"])

    jobs = store.write(work.mapInArrow(looked, "task string, ids array<long>, pairs binary"), "jobs")
    store.drop(blocks)
    held = jobs.select("task", F.posexplode("ids").alias("at", "doc_id")).join(sets, "doc_id") \
        .groupBy("task").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "set"))).alias("held"))

    def confirmed(batches):
        for b in batches:
            for k in range(b.num_rows):
                own = b.column(1)[k].values
                place, values = own.field("at").to_numpy(), own.field("set")
                ids = own.field("doc_id").to_numpy()[np.unique(place, return_index=True)[1]]
                sized = [np.sort(values[x].values.to_numpy()) for x in range(len(values))]
                i, j = _entries(place, *np.frombuffer(b.column(0)[k].as_py(), np.int32).reshape(2, -1))
                linked = np.zeros(len(i), bool)
                for x in np.unique(i):
                    at = np.flatnonzero(i == x)
                    others = [sized[y] for y in j[at]]
                    flat, size = np.concatenate(others), np.array([len(o) for o in others])
                    where = np.minimum(np.searchsorted(sized[x], flat), len(sized[x]) - 1)
                    common = np.add.reduceat((sized[x][where] == flat).astype(np.int64), np.cumsum(size) - size)
                    linked[at] = 100 * common >= percent * (len(sized[x]) + size - common)
                child, parent = forest(ids, place[i[linked]], place[j[linked]])
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["a", "b"])

    return jobs.join(held, "task").select("pairs", "held").mapInArrow(confirmed, "a long, b long")


def _entries(place: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents as pairs of entries; ``place``: the document of every entry,
    sorted (a doc_id with several texts has an entry for each)."""
    for _ in range(2):
        lo, hi = np.searchsorted(place, i), np.searchsorted(place, i, "right")
        row = np.repeat(np.arange(len(i)), hi - lo)
        at = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        i, j = j[row], lo[row] + at
    return i, j


def shingle_sets(store: Tables, docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``doc_id, set`` of the documents among ``members``, from their whole texts; repeated
    rows once."""
    ids = store.write(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    wanted = key_filter(ids, F.col("doc_id"))

    def rows(batches):
        for b in batches:
            b = b.filter(pa.array(in_filter(wanted, b.column(2).to_numpy())))
            for batch, sets in _sets([b], width, True):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([int(signed(s.sum(dtype=np.uint64)[None])[0]) for s in sets], pa.int64()),
                     pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set_a", "set"])

    key = F.col("doc_id").cast("long")
    texts = docs.where("doc_id is not null").select(key.alias("doc_id"), utf8(F.col("text")).alias("text"),
                                                    slot_of(key).alias("slot"))
    return store.write(texts.mapInArrow(rows, "doc_id long, set_a long, set array<long>").where("size(set) > 0")
                       .join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a"]).select("doc_id", "set"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity.  The member's set moves once per
    pair, the hub's once per hub: a hub with many members is split by the skew join."""
    with_member = pairs.join(sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("own")), "rep")
    both = with_member.join(sets.select(F.col("doc_id").alias("hub"), F.col("set").alias("other")), "hub")
    common = F.size(F.array_intersect("own", "other"))
    enough = 100 * common >= percent * (F.size("own") + F.size("other") - common)
    return both.where(enough).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
