"""K-d tree sharding.

Documents are points in metadata space: size, source, language and doc_id.  Rows
with equal text are one weighted point (so copies share a shard); a group heavier
than an eighth of a shard is dealt into several points.  The tree halves its
cells at distributed weighted medians: per level one aggregate finds each cell's
widest dimension, then histogram rounds narrow the median of all cells at once.
The cells are a table, joined with the rows by the cell that each row carries, so
plans do not grow with the number of leaves; only row counts reach the driver.

Cases: null text has size 1 and the group of the empty text; null source or
language is a coordinate of its own; repeated rows are separate rows of one group;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, positions, utf8

GRID = 31                       # bits of a coordinate
FAN_BITS = 12                   # a histogram round cuts the range of each open cell into 2^this buckets
DIMENSIONS = ("x_size", "x_source", "x_lang", "x_id")
#: A cut is fine enough when the bucket it falls in weighs less than this share of its cell.
CLOSE = 1 / 1024
#: A point weighs at most this share of a shard (heavier groups of copies are dealt out).
POINT_SHARE = 1 / 8


def _spread(c: Column) -> Column:
    """A string as a coordinate: its hash on the grid (null: a hash of its own)."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(c, F.lit("\x00null"))), 64 - GRID)


def shard(spark: SparkSession, docs: DataFrame, leaves: int | None = None,
          target_bytes: int | None = None) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot``: leaves of near-equal bytes.

    Give the number of ``leaves``, or ``target_bytes`` for a leaf."""
    store = Tables(spark, "kdtree")
    text = utf8(F.col("text"))
    rows = store.write(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.lit(7)).alias("digest"), _spread(F.col("source")).alias("source"),
        _spread(F.col("lang")).alias("lang")), "rows")
    total, low, high = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id")).first()
    if total is None:
        leaves, total = 1, 0
    leaves = leaves or max(1, math.ceil(total / target_bytes))
    heavy = max(1, int(total / leaves * POINT_SHARE))

    # one point per group of equal texts and deal; a group's metadata is that of its smallest row
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("id"),
                                        F.min("source").alias("src"), F.min("lang").alias("lng"))
    span = max(1, (high or 0) - (low or 0) + 1)
    coordinate = {
        "x_size": F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(1.0)) * ((1 << GRID) - 1),
        "x_source": F.col("src"), "x_lang": F.col("lng"),
        "x_id": F.coalesce((F.col("id") - F.lit(low or 0)) / F.lit(float(span)), F.lit(0.0)) * ((1 << GRID) - 1),
    }
    deals = F.ceil(F.col("bytes") / heavy)
    placed = rows.join(groups, "digest").withColumn(
        "deal", F.when(deals > 1, F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(11)), deals)).otherwise(F.lit(0)))
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        *[F.shiftleft(c.cast("long"), 63 - GRID - 1).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64("digest", "deal", F.lit(k)), GRID + 2)).alias(d)
          for k, (d, c) in enumerate(coordinate.items())], F.lit(0).cast("int").alias("shard"))
    points = store.write(placed, "points")
    store.drop(rows)

    return _number(store, _grow(store, points, leaves))


def _grow(store: Tables, points: DataFrame, leaves: int) -> DataFrame:
    """``points`` (a table, all in ``shard`` 0) in their leaves.  A level halves every cell of two
    or more leaves; a cell is named by its first leaf, and each row carries the name of its
    cell on."""
    cells = store.write(store.spark.range(1).select(F.lit(0).cast("int").alias("shard"), F.lit(leaves).alias("leaves")), "cells")
    for _ in range((leaves - 1).bit_length()):
        cuts = _cuts(store, points, cells.where("leaves > 1"))
        right = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1) > F.col("cut")
        moved = points.join(cuts, "shard", "left").select(
            "doc_id", "size", "text_crc32", *DIMENSIONS,
            F.when(right, F.col("shard") + F.expr("leaves div 2")).otherwise(F.col("shard")).cast("int").alias("shard"))
        below = store.write(moved, "level")
        half = F.expr("cast(leaves div 2 as int)")
        cells = store.write(cuts.select("shard", half.alias("leaves")).unionAll(
            cuts.select((F.col("shard") + half).alias("shard"), (F.col("leaves") - half).alias("leaves"))), "cells")
        store.drop(points, cuts)
        points = below
    return points


def _cuts(store: Tables, points: DataFrame, cells: DataFrame) -> DataFrame:
    """(shard, leaves, dim, cut): the weighted median of each cell along its widest dimension;
    keys up to the cut stay left.  All cells are narrowed together: a round cuts the range of
    each open cell into buckets, sums the sizes in them and goes into the bucket that holds the
    median.  The table of cells stays in Spark; a round tells the driver how many are open."""
    ends = points.join(cells, "shard").groupBy("shard").agg(
        F.max("leaves").alias("leaves"), F.sum("size").alias("w"),
        *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    # the widest dimension, the first of equals
    wide = F.array_max(F.array(*[F.struct(
        (F.col(f"hi_{d}") - F.col(f"lo_{d}")).alias("spread"), F.lit(-k).alias("k"),
        F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for k, d in enumerate(DIMENSIONS)]))
    now = store.write(ends.withColumn("v", wide).selectExpr(
        "shard", "leaves", "-v.k as dim", "v.lo as lo", "v.hi as hi", "cast(null as bigint) as cut", "0L as below",
        "cast(w as double) * (leaves div 2) / leaves as need", f"w * {CLOSE} as close"), "cuts")
    while now.where("cut is null").limit(1).count():
        open_ = now.where("cut is null").withColumn("step", F.expr(f"shiftright(hi - lo, {FAN_BITS}) + 1"))
        at = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        hist = points.join(open_.select("shard", "dim", "lo", "hi", "step"), "shard").withColumn("at", at) \
            .where("at between lo and hi").groupBy("shard", F.expr("(at - lo) div step").alias("bucket")) \
            .agg(F.sum("size").alias("w"))
        upto = hist.selectExpr("shard", "bucket", "w", "sum(w) over (partition by shard order by bucket"
                               " rows between unbounded preceding and current row) as upto")
        found = upto.join(open_.select("shard", "below", "need"), "shard").where("below + upto >= need") \
            .groupBy("shard").agg(F.min(F.struct("bucket", "w", "upto")).alias("m"))
        met = now.join(open_.select("shard", "step"), "shard", "left").join(found, "shard", "left").selectExpr(
            "shard", "leaves", "dim", "lo", "hi", "cut", "below", "need", "close", "step",
            "lo + m.bucket * step as first", "m.w as w", "below + m.upto as after")
        after = store.write(met.selectExpr(
            "shard", "leaves", "dim", "coalesce(if(cut is null, first, null), lo) as lo",
            "if(cut is null, least(hi, first + step - 1), hi) as hi",
            # a bucket that is light enough, or a single key, is the cut: on the side nearer to the median
            "case when cut is not null then cut when first is null then hi when step = 1 or w <= close then"
            " if(after - need <= need - (after - w), first + step - 1, first - 1) end as cut",
            "if(cut is null, coalesce(after - w, below), below) as below", "need", "close"), "cuts")
        store.drop(now)
        now = after
    return now


def _number(store: Tables, rows: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, in the order of doc_id and text_crc32, so slots
    do not depend on how files are split (rows alike in both are exchangeable; the row number
    that ends the order only keeps many of them out of one task)."""
    named = rows.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("row"))
    placed = positions(store, named, ["shard", "doc_id", "text_crc32", "size", "row"])
    store.drop(rows)
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))
    return placed.join(first, "shard").selectExpr("doc_id", "size", "text_crc32", "shard", "pos - first as slot")
