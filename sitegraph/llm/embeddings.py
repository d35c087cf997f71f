"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are compared only within a label (and a dimension).  Equal vectors are one
class with a count.  Unit vectors are turned into the corpus' principal axes and
ordered by cells of the leading axes; runs of TILE rows are tiles.  Two tiles are
compared only if their boxes over the leading axes come within the distance that the
threshold allows.  Inside a pair of tiles products are accumulated over the leading
axes first: what remains is at most the product of the suffix norms, and pairs that
cannot reach the threshold stop there.  A pair of tiles returns link counts and a
spanning forest of its links, never the links themselves, so a group of any size
costs rows in proportion to its members.

Cases: null label, null or zero vector, null or non-finite component: no links;
repeated rows are vectors of their own; a row without vec_id counts as a vector but
names no component; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, components, forest, positions

THRESHOLD = 0.98
TILE = 1024
LEADING = 8                     # axes of a tile's box
STEPS = (16, 32)                # axes after which hopeless pairs stop
#: Rounding of double products of unit vectors; closer pairs are computed from the vectors as given.
EDGE = 1e-9


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, widest first) of the unit vectors, per dimension."""
    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column(1).to_numpy()
            for d in np.unique(size).tolist():
                u = _units(_matrix(b.column(0).filter(pa.array(size == d)), d))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()),
                                              pa.array(list(m), pa.list_(pa.float64()))], names=["size", "i", "row"])

    cells = classes.select("embedding", "size").mapInArrow(moments, "size int, i int, row array<double>") \
        .select("size", "i", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    out = {}
    # dimension squared values per dimension, whatever the number of vectors
    got = cells.toArrow()
    size, i, j, v = (got.column(k).to_numpy() for k in range(4))
    for d in np.unique(size).tolist():
        m = np.zeros((d, d))
        pick = size == d
        m[i[pick], j[pick]] = v[pick]
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        out[d] = vectors[:, values.argsort()[::-1]]
    return out


def compare(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, b) of turned unit vectors with cosine at least ``threshold``."""
    steps = [s for s in STEPS if s < a.shape[1]] + [a.shape[1]]
    tail = lambda m, s: np.sqrt(np.maximum((m[:, s:] ** 2).sum(axis=1), 0))
    dots = a[:, :steps[0]] @ b[:, :steps[0]].T
    i, j = np.nonzero(dots + np.outer(tail(a, steps[0]), tail(b, steps[0])) >= threshold - EDGE)
    dots = dots[i, j]
    for lo, hi in zip(steps, steps[1:], strict=False):
        if not len(i):
            break
        if len(i) * 4 > a.shape[0] * b.shape[0]:
            dots = dots + (a[:, lo:hi] @ b[:, lo:hi].T)[i, j]
        else:
            dots = dots + np.concatenate([np.einsum("nd,nd->n", a[i[k:k + 65536], lo:hi], b[j[k:k + 65536], lo:hi])
                                          for k in range(0, len(i), 65536)])
        hope = dots + tail(a, hi)[i] * tail(b, hi)[j] >= threshold - EDGE
        i, j, dots = i[hope], j[hope], dots[hope]
    near = np.abs(dots - threshold) <= EDGE
    for k in np.flatnonzero(near):
        x, y = xa[i[k]], xb[j[k]]
        dots[k] = (x @ y) / math.sqrt((x @ x) * (y @ y))
    keep = dots >= threshold
    return i[keep], j[keep]


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept``."""
    store = Tables(spark, "embeddings")
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = store.write(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.size(v).alias("size"),
        F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2")),
        "rows")
    classes = rows.where("usable").groupBy("label", "size", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    classes = store.write(classes, "classes")
    placed = store.write(tiles(store, classes, tile), "placed")
    found = store.write(_pairs(store, placed, threshold), "found")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(store, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    members = placed.select(F.col("pos").alias("of"), "label", "size", "h1", "h2", "rep", "m") \
        .join(links, F.col("of") == F.col("node"), "left").drop("node") \
        .join(parts, F.col("of") == F.col("node"), "left").drop("node") \
        .withColumn("root", F.coalesce("root", "of"))
    members = store.write(members, "members")
    least = members.groupBy("root").agg(F.min("rep").alias("component"))
    known = members.join(least, "root").select("label", "size", "h1", "h2", "component",
                                               (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("linked"))
    out = rows.where("usable").join(known, ["label", "size", "h1", "h2"]) \
        .select("vec_id", F.col("linked").cast("long").alias("n_links"),
                F.when(F.col("vec_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def tiles(store: Tables, classes: DataFrame, tile: int) -> DataFrame:
    """``classes`` with their place ``pos`` in PCA order, ``tile`` and ``lead`` (leading coordinates)."""
    basis = axes(classes)

    def turned(batches):
        for b in batches:
            size = b.column(b.schema.get_field_index("size")).to_numpy()
            lead = np.zeros((b.num_rows, LEADING))
            for d in np.unique(size).tolist():
                pick = size == d
                u = _units(_matrix(b.column(b.schema.get_field_index("embedding")).filter(pa.array(pick)), d))
                lead[pick, :min(d, LEADING)] = u @ basis[d][:, :LEADING]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(lead), pa.list_(pa.float64()))],
                                             names=[*b.schema.names, "lead"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", lead array<double>"
    cell = lambda k: F.floor(F.get("lead", F.lit(k)) / 0.2)
    ordered = classes.mapInArrow(turned, schema).select("*", cell(0).alias("c0"), cell(1).alias("c1"), cell(2).alias("c2"),
                                                        F.get("lead", F.lit(3)).alias("c3"))
    placed = positions(store, ordered, ["label", "size", "c0", "c1", "c2", "c3", "h1", "h2"])
    return placed.withColumn("tile", F.expr(f"pos div {tile}"))


def _pairs(store: Tables, placed: DataFrame, threshold: float) -> DataFrame:
    """``node, n, other``: link counts per class, and forest edges."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + EDGE
    basis = axes(placed)
    low = F.array(*[F.min(F.get("lead", F.lit(k))) for k in range(LEADING)])
    high = F.array(*[F.max(F.get("lead", F.lit(k))) for k in range(LEADING)])
    key = ["label", "size", "tile"]
    boxes = store.write(placed.groupBy(*key).agg(low.alias("lo"), high.alias("hi")), "boxes")
    cell = lambda x: F.floor(x / reach).cast("int")
    left = boxes.select(*key, "lo", "hi", F.explode(F.sequence(cell(F.get("lo", F.lit(0))), cell(F.get("hi", F.lit(0))))).alias("at"))
    right = boxes.select("label", "size", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
                         F.explode(F.sequence(cell(F.get("lo", F.lit(0))) - 1, cell(F.get("hi", F.lit(0))) + 1)).alias("at"))
    gap = sum((F.pow(F.greatest(F.get("lo2", F.lit(k)) - F.get("hi", F.lit(k)), F.get("lo", F.lit(k)) - F.get("hi2", F.lit(k)),
                                F.lit(0.0)), 2) for k in range(LEADING)), F.lit(0.0))
    pairs = left.join(right, ["label", "size", "at"]).where((F.col("tile") <= F.col("tile2")) & (gap <= reach * reach)) \
        .select("label", "size", "tile", "tile2").distinct()

    def packed(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        x = _matrix(table.column("embedding"), size)
        return pa.table({k: table.column(k).slice(0, 1) for k in key} | {
            "nodes": [table.column("pos").to_numpy().tobytes()], "counts": [table.column("m").to_numpy().tobytes()],
            "x": [x.tobytes()]})

    label = placed.schema["label"].dataType.simpleString()
    packs = store.write(placed.select(*key, "pos", "m", "embedding").groupBy(*key).applyInArrow(
        packed, f"label {label}, size int, tile long, nodes binary, counts binary, x binary"), "packs")
    other = packs.select("label", "size", F.col("tile").alias("tile2"), F.col("nodes").alias("nodes2"),
                         F.col("counts").alias("counts2"), F.col("x").alias("x2"))
    work = pairs.join(packs, key).join(other, ["label", "size", "tile2"]).select(
        "size", "tile", "tile2", "nodes", "counts", "x", "nodes2", "counts2", "x2")

    def links(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(k)[r].as_py() for k, n in enumerate(b.schema.names)}
                yield _compared(row, basis[row["size"]], threshold)

    return work.mapInArrow(links, "node long, n long, other long")


def _compared(row: dict, basis: np.ndarray, threshold: float) -> pa.RecordBatch:
    side = []
    for s in ("", "2"):
        x = np.frombuffer(row["x" + s]).reshape(-1, row["size"])
        side.append((np.frombuffer(row["nodes" + s], np.int64), np.frombuffer(row["counts" + s], np.int64), x, _units(x) @ basis))
    (na, ca, xa, a), (nb, cb, xb, b) = side
    i, j = compare(a, b, xa, xb, threshold)
    if row["tile"] == row["tile2"]:
        i, j = i[i < j], j[i < j]
    nodes, where = np.unique(np.concatenate([na, nb]), return_inverse=True)
    i_all, j_all = where[i], where[len(na) + j]
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, i_all, cb[j])
    np.add.at(n, j_all, ca[i])
    child, parent = forest(nodes, i_all, j_all)
    has = n > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes[has], child])), pa.array(np.concatenate([n[has], np.zeros(len(child), np.int64)])),
         pa.array([None] * int(has.sum()) + parent.tolist(), pa.int64())], names=["node", "n", "other"])
