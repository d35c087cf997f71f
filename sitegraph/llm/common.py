"""Helpers shared by the operators: written tables, global positions, Arrow batches."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sitegraph
from sitegraph.session import checkpoint_root

#: Bytes of text that one vectorised step in a Python worker takes at most (a longer
#: document is a step of its own); a step needs about 50 times that in arrays.
STEP_BYTES = 1 << 19
#: Rows of an Arrow batch while a table is written: batches of whole texts stay small
#: on both sides of the pipe to Python.
BATCH_ROWS = 1000
#: Bytes of a step where larger steps pay: a distinct word is looked up once per step.
WORD_STEP_BYTES = 1 << 21


class Tables:
    """Tables written to the shared checkpoint folder, so that a lost executor
    costs a re-read and no recomputation.  ``drop`` removes the ones named."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # Python workers find this package where the driver found it (a cluster without
        # that path gets it by --py-files)
        home, env = os.path.dirname(os.path.dirname(sitegraph.__file__)), spark.sparkContext.environment
        if home not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.parquet(where)
        finally:
            self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._table_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._table_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for keyed exchanges that AQE does not size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(store: Tables, df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with ``name``: each row's place (from 0, gapless) in ``order``.

    Range-partitioned and sorted in parallel, written once, then shifted by the
    row counts of the partitions before.  Only those counts (one per partition)
    reach the driver.  ``order`` should end in a column that tells rows apart,
    so that no key is too large for a partition.
    """
    spark = store.spark
    placed = (df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    kept = store.write(placed, "positions")
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())
    starts, at = {}, 0
    for p, n in counts:
        starts[p], at = at, at + n
    if not starts:
        return kept.withColumn(name, F.col("_at")).drop("_at")
    array = [starts.get(p, 0) for p in range(max(starts) + 1)]
    offset = F.element_at(long_array(array), (part + 1).cast("int"))
    return kept.withColumn(name, offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def long_array(values: list[int]) -> Column:
    """A constant array<bigint> (folded once at planning)."""
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def utf8(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``size`` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(byte_lengths(b.column(b.schema.get_field_index(column))))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield b.slice(at, to - at)
            at = to


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n+1 offsets (null: no bytes)."""
    lengths = byte_lengths(column)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column) or not offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    if np.array_equal(np.diff(bounds), lengths):
        return data[bounds[0]:bounds[-1]], offsets
    return np.concatenate([data[a:a + n] for a, n in zip(bounds[:-1], lengths, strict=True)]), offsets


# ---- words and their hashes -------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and per document the index of its first
    word (n+1 values).  A word is a run of bytes outside ``space`` (0x20 and 0x09-0x0D)."""
    full = ~space[data]
    start, end = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start[edge] = full[edge]
    end[edge - 1] = full[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if ``lower``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = (_BYTE_LOWER if lower else _BYTE)[data[np.repeat(starts, lengths) + within]]
    values *= powers(_BASE, int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 64-bit hashes: the distinct ones, sorted, the first place of each, and each place's
    row in them.  Places take the low bits of the sorted numbers, which a plain sort brings in
    order; where two hashes share all the others, ``np.unique`` sorts them."""
    if not len(keys):
        return np.unique(keys, return_index=True, return_inverse=True)
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(new)
    values = ordered[starts]
    if not (values[1:] > values[:-1]).all():
        return np.unique(keys, return_index=True, return_inverse=True)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return values, order[starts], back


def added(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``keys`` and their counts (changed), with those of sorted distinct ``new`` added."""
    at = np.searchsorted(keys, new)
    old = at < len(keys)
    old[old] = keys[at[old]] == new[old]
    counts[at[old]] += n[old]
    return np.insert(keys, at[~old], new[~old]), np.insert(counts, at[~old], n[~old])


_ROLL = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _ROLL)


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes, for every start in the array."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_ROLL[which], len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE[which], n) + np.uint64(width))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pack_array(values: np.ndarray) -> str:
    """A numpy array as text for a closure or table cell."""
    head = f"{values.dtype.str}|{','.join(map(str, values.shape))}|"
    return head + base64.b64encode(np.ascontiguousarray(values).tobytes()).decode()


def unpack_array(text: str) -> np.ndarray:
    kind, shape, body = text.split("|", 2)
    return np.frombuffer(base64.b64decode(body), kind).reshape([int(x) for x in shape.split(",") if x])


# ---- connected components -----------------------------------------------------

def components(store: Tables, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root: the smallest node
    reachable.  Alternating large-star and small-star steps (Kiveris et al. 2014):
    each step is a minimum per node (combined before the exchange) and a join, so
    hub nodes are split by the skew join and no group is gathered.  Every round is
    a written table; the loop ends when a round changes nothing.
    """
    now = store.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "links")
    before = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = store.write(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        store.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) with the same parts as the links i-j."""
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        new = new[new][root]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def local_path(uri: str):
    """File system and path of a shared folder, for byte-range reads in tasks."""
    import pyarrow.fs as fs

    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path) if at.scheme else uri
    return fs.FileSystem.from_uri(uri)


# ---- a bounded pre-filter ------------------------------------------------------

FILTER_BITS = 25


def key_filter(df: DataFrame, key: Column) -> np.ndarray:
    """Bitmap of 2^FILTER_BITS bits (4 MB whatever the input) with a bit for each
    key of ``df``.  It only saves moving rows that an exact join would drop: it lets
    all keys through, and others by chance."""
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)
    words = df.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def slot_of(key: Column) -> Column:
    """A row's bit in ``key_filter`` bitmaps, for ``in_filter``."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def in_filter(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63)) & 1 == 1
