"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``WIDTH`` = 400 bytes covers it that also starts anywhere else.  In
sorted order a suffix has its longest common prefix with any other one beside it, so the sort
answers which suffixes share 400 bytes with another.  The sort is a merge sort that carries
common prefixes along:

* a task sorts its suffixes into runs, cuts each run at common splitters and sends the pieces
  front coded: the length of the prefix shared with the suffix before, and the bytes after it;
* the pieces of a range are merged by a loser tree whose nodes hold the prefix length that
  loser and winner share.  Two suffixes are compared only where both share equally much with
  the last one given out, and only from there on: no known prefix is read again;
* splitters end in the suffix's place, so a suffix that occurs any number of times is spread
  over ranges; the two suffixes on either side of a range's edge are compared afterwards.

Moving 400 bytes for each byte of text is out of the question, so not every suffix is sorted.
Every window of 400 bytes chooses an anchor in itself, by its content alone: the place of the
least hash of ``GRAM`` = 200 bytes, so equal windows choose at equal depth.  Sorted are

1. the suffixes at anchors whose 200 bytes occur again.  One with a common prefix of m bytes
   tells of the windows that start at it up to m - 400 bytes later;
2. the same anchors with the bytes before and in them read backwards, which tells of the windows
   that end with the 200 bytes or before, and of how far each anchor's left side occurs again.
   If the 200 bytes occur just twice, both sides belong to one match, and all is known;
3. the windows around their anchor that may still be repeated by both sides, with those of all
   anchors with the same 200 bytes at the same depth.

Every window is thus decided by the sort of bytes; hashes only choose what is sorted.

Cases: a null text is empty; rows are documents of their own whatever their doc_id, so of two
equal texts of 400 bytes or more nothing stays; texts under 400 bytes stay whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, signed, text_bytes, text_steps, utf8, window_hashes

WIDTH = 400
GRAM = 200
#: Bytes of suffixes that a task sorts into one run, and that one range of the merge gets
#: (about; before front coding).  Both should grow with the input, as a run has a piece per range.
RUN_BYTES = 32 << 20
RANGE_BYTES = 48 << 20
#: Suffixes that the splitters are taken from (at most about this many reach the driver).
SAMPLE = 20_000


# ---- anchors ---------------------------------------------------------------------

def anchors(data: np.ndarray, offsets: np.ndarray):
    """Of documents in a row: each anchor's place, the first and last window that chose it (as
    places in ``data``), the hash of its ``GRAM`` bytes, and per document its first anchor."""
    none = np.zeros(0, np.int64)
    span = WIDTH - GRAM + 1
    if len(data) < WIDTH:
        return none, none, none, none, np.zeros(len(offsets), np.int64)
    grams = window_hashes(data.astype(np.uint64) + np.uint64(1), GRAM)
    # place in the low bits: of equal hashes the leftmost counts
    value = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    low, width = value, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(value) - span + 1
    low = np.minimum(low[:n], low[span - width:span - width + n])
    inside = np.zeros(n + 1, np.int64)  # windows that no document's end cuts
    whole = np.diff(offsets) >= WIDTH
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - WIDTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:n]))
    chosen = (low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else none
    last = np.concatenate([new[1:], [len(chosen)]])[:len(new)] - 1
    place = chosen[new]
    return place, windows[new], windows[last], signed(grams[place]), np.searchsorted(place, offsets)


def _steps(batches, column: int):
    for step in (s for b in batches for s in text_steps([b], b.schema.names[column])):
        data, offsets = text_bytes(step.column(column))
        yield step, data, offsets


def _profile(batches):
    """(digest, text) -> (digest, n_bytes, gram hashes of its anchors)"""
    for step, data, offsets in _steps(batches, 1):
        _, _, _, gram, first = anchors(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [step.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(gram))],
            names=["digest", "n_bytes", "grams"])


def _anchored(batches):
    """(cls, text, own) -> per class: cls, text, and of its anchors in ``own`` the places, those of
    the anchors before and after, first and last windows, grams, and whether these occur just twice."""
    for step, data, offsets in _steps(batches, 1):
        place, low, high, gram, first = anchors(data, offsets)
        for k in range(step.num_rows):
            own, begin = np.sort(step.column(2)[k].values.to_numpy()), offsets[k]
            at = first[k] + (own >> 1)
            before = np.where(at > first[k], place[at - 1], begin - 1)
            after = np.where(at + 1 < first[k + 1], place[np.minimum(at + 1, len(place) - 1)], place[at] + 1)
            columns = (place[at] - begin, before - begin, after - begin, low[at] - begin, high[at] - begin, gram[at], own & 1)
            yield step.column(0)[k].as_py(), data[begin:offsets[k + 1]].tobytes(), zip(*(c.tolist() for c in columns), strict=True)


def _forward(batches):
    """Suffixes at anchors: (bytes, cls, place, first window, last window, gram, twice)."""
    for cls, text, own in _anchored(batches):
        for p, _, after, lo, hi, g, twice in own:
            yield text[p:after - 1 + WIDTH], cls, p, lo, hi, g, twice


def _backward(batches):
    """The bytes up to the end of each anchor's gram, backwards."""
    for cls, text, own in _anchored(batches):
        for p, before, _, lo, hi, g, twice in own:
            yield text[max(0, before + 1 + GRAM - WIDTH):p + GRAM][::-1], cls, p, lo, hi, g, twice


def _windows(batches):
    """(cls, text, from, to) -> the windows that start at from..to, ends included."""
    for batch in batches:
        for k in range(batch.num_rows):
            cls, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer().to_pybytes()
            marked = np.zeros(len(text) + 2, np.int64)
            np.add.at(marked, batch.column(2)[k].values.to_numpy(), 1)
            np.add.at(marked, batch.column(3)[k].values.to_numpy() + 1, -1)
            for p in np.flatnonzero(np.cumsum(marked) > 0).tolist():
                yield text[p:p + WIDTH], cls, p, p, p, 0, 0


# ---- front coding ------------------------------------------------------------------

def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    return known + ((differ & -differ).bit_length() - 1) // 8


_CODEC = "zstd"
#: Numbers that go with a suffix, after cls: at, low, high, gram, twice.
FIELDS = 5


def encode(run: list) -> bytes:
    """A sorted run, front coded."""
    n = len(run)
    shared = np.zeros(n, np.int32)
    tails, before = [], b""
    for k, record in enumerate(run):
        now = record[0]
        shared[k] = s = common(before, now)
        tails.append(now[s:])
        before = now
    parts = [np.array([n], np.int64), shared, np.array([len(t) for t in tails], np.int32)]
    parts += [np.array([r[c] for r in run], np.int64) for c in range(1, 2 + FIELDS)]
    raw = b"".join([*(p.tobytes() for p in parts), *tails])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


class Piece:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, packed: bytes):
        size = int(np.frombuffer(packed[:8], np.int64)[0])
        raw = pa.decompress(packed[8:], size, codec=_CODEC, asbytes=True)
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        at = 8
        self.shared = np.frombuffer(raw, np.int32, n, at).tolist()
        lengths = np.frombuffer(raw, np.int32, n, at + 4 * n)
        at += 8 * n
        self.columns = [np.frombuffer(raw, np.int64, n, at + 8 * n * c) for c in range(1 + FIELDS)]
        at += 8 * n * (1 + FIELDS)
        self.ends = (at + np.cumsum(lengths)).tolist()
        self.starts = (at + np.cumsum(lengths) - lengths).tolist()
        self.places = list(zip(self.columns[0].tolist(), self.columns[1].tolist(), strict=True))
        self.raw, self.n, self.at, self.now = raw, n, -1, b""

    def step(self) -> int:
        """Go to the next suffix; the prefix length it shares with the one before, -1 at the end."""
        self.at = k = self.at + 1
        if k >= self.n:
            return -1
        s = self.shared[k]
        self.now = self.now[:s] + self.raw[self.starts[k]:self.ends[k]]
        return s


def merge(pieces: list):
    """Suffixes of sorted pieces in order: (piece, its index there, prefix length shared with the
    suffix given out before).  ``shared[r]``: what run r's suffix shares with the last one given out."""
    size = 1
    while size < len(pieces):
        size *= 2
    shared = [p.step() for p in pieces] + [-1] * (size - len(pieces))
    loser = [0] * size

    def wins(a: int, b: int) -> bool:
        """Whether run a's suffix comes before run b's; sets what the loser shares with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        p, q = pieces[a], pieces[b]
        u, v = p.now, q.now
        h = common(u, v, x)
        if h < len(u) and h < len(v):
            first = u[h] < v[h]
        elif len(u) != len(v):
            first = len(u) < len(v)
        else:
            first = p.places[p.at] < q.places[q.at]
        shared[b if first else a] = h
        return first

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        first = wins(a, b)
        loser[node] = b if first else a
        return a if first else b

    top = build(1) if size > 1 else 0
    while shared[top] >= 0:
        piece = pieces[top]
        yield top, piece.at, shared[top]
        shared[top] = piece.step()
        node = (top + size) >> 1
        while node:
            other = loser[node]
            if not wins(top, other):
                loser[node], top = top, other
            node >>= 1


# ---- the distributed sort ------------------------------------------------------------

_RUN = pa.schema([("part", pa.int64()), ("run", pa.binary())])
_MERGED = "cls long, at long, low long, high long, gram long, twice long, m long, part long, edge int, suffix binary"
_MERGED_ARROW = pa.schema([("cls", pa.int64()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                           ("gram", pa.int64()), ("twice", pa.int64()), ("m", pa.int64()), ("part", pa.int64()), ("edge", pa.int32()),
                           ("suffix", pa.binary())])


def _runs(records, splitters):
    """Sorted runs of a task's suffixes, cut at the splitters."""
    def task(batches):
        cuts = splitters.value
        held, size = [], 0

        def out():
            held.sort()
            ends = [bisect_left(held, c) for c in cuts] + [len(held)]
            begin = 0
            for part, end in enumerate(ends):
                if end > begin:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([encode(held[begin:end])], pa.binary())], schema=_RUN)
                begin = end

        for r in records(batches):
            held.append(r)
            size += len(r[0]) + 100
            if size > RUN_BYTES:
                yield from out()
                held, size = [], 0
        yield from out()
    return task


def _sampled(records):
    def task(batches):
        for r in records(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.binary()), pa.array([r[1]]), pa.array([r[2]])], names=["suffix", "cls", "at"])
    return task


def merged_part(part: int, pieces: list):
    """Neighbours of one range: per suffix the longer prefix shared with the one before or after
    (as far as this range tells); the first (edge 1) and the last (2; 3: both) with their bytes."""
    pieces = [Piece(p) for p in pieces]
    first = last = b""
    runs, ids, shared = [], [], []
    for run, at, s in merge(pieces):
        if not runs:
            first = pieces[run].now
            s = 0
        runs.append(run)
        ids.append(at)
        shared.append(s)
        last = pieces[run].now
    run, ids = np.array(runs, np.int64), np.array(ids, np.int64)
    shared = np.array([*shared, 0], np.int64)
    n = len(run)
    begin = np.cumsum([0, *(p.n for p in pieces)])[:-1]
    columns = [np.concatenate([p.columns[c] for p in pieces])[begin[run] + ids] for c in range(1 + FIELDS)]
    edge = np.zeros(n, np.int32)
    edge[0] += 1
    edge[-1] += 2
    bytes_at = pa.array([first, *[None] * (n - 2), last] if n > 1 else [first], pa.binary())
    for k in range(0, n, 20_000):
        cut = slice(k, k + 20_000)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[cut]) for c in columns), pa.array(np.maximum(shared[:-1], shared[1:])[cut]),
             pa.array(np.full(n, part, np.int64)[cut]), pa.array(edge[cut]), bytes_at[k:k + 20_000]], schema=_MERGED_ARROW)


def _merged(batches):
    """Rows (part, run) sorted by part -> ``merged_part`` of each."""
    part, held = None, []
    for b in batches:
        for p, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if p != part and held:
                yield from merged_part(part, held)
                held = []
            part = p
            held.append(run.as_buffer().to_pybytes())
    if held:
        yield from merged_part(part, held)


def neighbours(store: Tables, texts: DataFrame, records, count: int) -> DataFrame:
    """``cls, at, low, high, gram, twice, m`` of about ``count`` suffixes that ``records`` takes from
    ``texts(cls, text, ...)``; m: the longest prefix that each shares with any other of them.  A
    suffix beside the edge of a range may have two rows, of which the larger m counts."""
    spark = store.spark
    rate = max(1, count // SAMPLE)
    parts = max(1, min(-(-count * (WIDTH + GRAM) // RANGE_BYTES), SAMPLE // 4))
    sample = texts.where(F.pmod(F.xxhash64("cls"), F.lit(rate)) == 0).mapInArrow(_sampled(records), "suffix binary, cls long, at long")
    keys = sorted((bytes(r[0]), r[1], r[2]) for r in sample.where(F.pmod(F.xxhash64("at"), F.lit(3)) == 0).collect()) if parts > 1 else []
    cuts = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
    splitters = spark.sparkContext.broadcast(sorted(set(cuts)))
    runs = texts.mapInArrow(_runs(records, splitters), "part long, run binary")
    ranged = runs.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part")
    out = store.write(ranged.mapInArrow(_merged, _MERGED), "merged")
    # suffixes on either side of a range's edge
    edges = sorted((r["part"], r["edge"], r["cls"], r["at"], r["low"], r["high"], r["gram"], r["twice"], bytes(r["suffix"]))
                   for r in out.where("edge > 0").collect())
    seams = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a[0] != b[0]:
            m = common(a[-1], b[-1])
            seams += [(*x[2:-1], m) for x in (a, b)]
    plain = out.select("cls", "at", "low", "high", "gram", "twice", "m")
    if not seams:
        return plain
    return plain.unionAll(spark.createDataFrame(seams, "cls long, at long, low long, high long, gram long, twice long, m long"))


# ---- windows ------------------------------------------------------------------------

_OPEN = pa.schema([("cls", pa.int64()), ("gram", pa.int64()), ("near", pa.int64()), ("far", pa.int64())])


def _undecided(batches):
    """Per class the anchors' (at, low, high, gram, twice, left, m) and the known repeated starts
    (begin, end) -> of each anchor with windows before it that may be repeated and are not known
    to be: its gram, and the depths from..to."""
    for b in batches:
        out = []
        for cls, rows, sure in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            at, low, high, gram, twice, left, m = (np.array([r[c] for r in rows], np.int64) for c in (
                "at", "low", "high", "gram", "twice", "left", "m"))
            known = np.zeros(int(max(high.max(), (at + m).max())) + 2, np.int64)
            np.add.at(known, np.array([r["begin"] for r in sure], np.int64), 1)
            np.add.at(known, np.array([r["end"] for r in sure], np.int64) + 1, -1)
            open_ = np.concatenate([[0], np.cumsum(np.cumsum(known) == 0)])  # undecided starts before a place
            top, bottom = np.minimum(np.minimum(high, at - 1), at + m - WIDTH), np.maximum(low, at - left)
            some = (twice == 0) & (top >= bottom)
            some[some] = open_[top[some] + 1] > open_[bottom[some]]
            out += [(cls, g, p - t, p - lo) for g, p, t, lo in zip(*(x[some].tolist() for x in (gram, at, top, bottom)), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_OPEN)


def repeated_windows(store: Tables, texts: DataFrame) -> DataFrame:
    """``cls, starts, ends``: first and last start of runs of repeated windows, of the classes
    that have any.  ``texts(cls, text, own)``: own, of each anchor whose gram occurs again twice
    its id, plus 1 if the gram occurs just twice."""
    own = texts.select("cls", "text", "own")
    count = texts.agg(F.sum(F.size("own"))).first()[0] or 0
    right = neighbours(store, own, _forward, count).withColumn("left", F.lit(0).cast("long"))
    left = neighbours(store, own, _backward, count).withColumn("left", F.col("m") - GRAM).withColumn("m", F.lit(0).cast("long"))
    best = store.write(right.unionByName(left).groupBy("cls", "at").agg(
        F.max("m").alias("m"), F.max("left").alias("left"), *[F.first(c).alias(c) for c in ("low", "high", "gram", "twice")]), "anchors")

    def span(begin, end, when):
        return F.when(when & (begin <= end), F.struct(begin.alias("begin"), end.alias("end")))

    at, first, last = F.col("at"), F.col("at") - F.col("left"), F.col("at") + F.col("m") - WIDTH
    one_match = F.col("twice") == 1
    spans = F.array_compact(F.array(span(first, last, one_match), span(at, last, ~one_match), span(first, at - (WIDTH - GRAM), ~one_match)))
    rows = best.groupBy("cls").agg(F.collect_list(F.struct("at", "low", "high", "gram", "twice", "left", "m")).alias("rows"),
                                   F.flatten(F.collect_list(spans)).alias("sure"))
    rows = store.write(rows, "by class")
    open_ = rows.mapInArrow(_undecided, "cls long, gram long, near long, far long")
    depths = store.write(open_.groupBy("gram").agg(F.min("near").alias("near"), F.max("far").alias("far")), "depths")
    # windows to sort: of every anchor with such a gram, those at such depths that may be repeated
    begin = F.greatest(F.col("low"), at - F.col("far"), first)
    end = F.least(F.col("high"), at - F.col("near"), last)
    ranges = best.join(depths, "gram").select("cls", begin.alias("begin"), end.alias("end")).where("begin <= end")
    ranges = store.write(ranges.groupBy("cls").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"),
                                                   F.sum(F.col("end") - F.col("begin") + 1).alias("n")), "ranges")
    windows = ranges.agg(F.sum("n")).first()[0] or 0
    sure = rows.select("cls", F.inline("sure"))
    if windows:
        tried = store.write(texts.select("cls", "text").join(ranges.drop("n"), "cls"), "tried")
        pairs = neighbours(store, tried, _windows, windows).where(F.col("m") >= WIDTH)
        sure = sure.unionAll(pairs.select("cls", at.alias("begin"), at.alias("end")))
    return store.write(sure.groupBy("cls").agg(F.collect_list("begin").alias("starts"), F.collect_list("end").alias("ends")), "repeated")


def gone(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes a repeated window covers."""
    marked = np.zeros(n + 1, np.int64)
    np.add.at(marked, starts, 1)
    np.add.at(marked, ends + WIDTH, -1)
    return np.cumsum(marked)[:n] > 0


def _cut(batches):
    """(digest, text, starts, ends) -> (digest, n_removed, n_spans, kept_sha256)"""
    for step, data, offsets in _steps(batches, 1):
        out = []
        for k in range(step.num_rows):
            text = data[offsets[k]:offsets[k + 1]]
            lost = gone(len(text), step.column(2)[k].values.to_numpy(), step.column(3)[k].values.to_numpy())
            spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
            out.append((int(lost.sum()), spans, hashlib.sha256(text[~lost].tobytes()).hexdigest()))
        counts, spans, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([step.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)],
                                         names=["digest", "n_removed", "n_spans", "kept_sha256"])


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    store = Tables(spark, "suffixes")
    text = utf8(F.col("text"))
    hashed = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
    rows = store.write(docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "rows")
    profile = hashed.mapInArrow(_profile, "digest string, n_bytes long, grams array<long>")
    classes = store.write(profile.where(F.col("n_bytes") >= WIDTH).groupBy("digest")
                          .agg(F.count("*").alias("copies"), F.first("grams").alias("grams"))
                          .withColumn("cls", F.monotonically_increasing_id()), "classes")
    each = classes.select("cls", F.posexplode("grams").alias("id", "gram"))
    grams = store.write(each.groupBy("gram").count().where("count > 1"), "grams")
    marked = (F.col("id") * 2 + F.when(F.col("count") == 2, 1).otherwise(0)).cast("long")
    own = each.join(grams, "gram").groupBy("cls").agg(F.collect_list(marked).alias("own"))
    own = classes.select("digest", "cls").join(own, "cls")
    # one text of each such class: all copies of it are equal
    texts = store.write(hashed.join(own.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
                        .join(own, "digest").select("digest", "cls", "text", "own"), "texts")
    store.drop(grams)
    found = repeated_windows(store, texts)
    cut = store.write(texts.select("digest", "cls", "text").join(found, "cls").select("digest", "text", "starts", "ends")
                      .mapInArrow(_cut, "digest string, n_removed long, n_spans long, kept_sha256 string"), "cut")
    copied = classes.select("digest", (F.col("copies") > 1).alias("copied"))
    empty, zero = hashlib.sha256(b"").hexdigest(), F.lit(0).cast("long")
    copied_too = F.coalesce("copied", F.lit(False))
    return rows.join(copied, "digest", "left").join(cut, "digest", "left").select(
        "doc_id", "n_bytes",
        F.when(copied_too, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied_too, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied_too, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
