"""Mixing sources to target weights by hash-threshold histograms.

Each source's words are summed; weights (5, 2, 1, repeating over the sources in code
point order, null last) share a budget, and a source whose share passes a number of
repeats of itself is held there, its excess going to the others by weight.  A
document's hash is its place in [0, 2^60).  Per source, words are summed by hash
bucket; the running sum finds the bucket where the target falls, and only that bucket
is split further, until it is one hash.  A document is taken once more when its hash
is up to the threshold: a filter, without a sort.  Growing a target only adds
documents (thresholds are nested).

Cases: null text has size 0; null source is a source of its own; rows equal in doc_id
and text share a hash and are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, positions, utf8

WEIGHTS = (5, 2, 1)
BUDGET = 1.5                    # of all words
REPEATS = 2                     # a target is at most this many times its source
HASH_BITS = 60
ROUND_BITS = 10                 # a round splits a bucket into 2^10
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(utf8(text), F.lit(WORD)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A document's hash: the first 60 bits of an MD5 over doc_id and text."""
    both = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(utf8(text).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(store: Tables, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
            repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` of ``rows(source, size)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("last", F.col("source").isNull())
    ranked = positions(store, sizes, ["last", "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod("pos", F.lit(len(weights))) + 1).cast("int"))
    ranked = store.write(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:                 # ends: each round holds at least one more source
        top = F.lit(False) if level is None else F.col("weight") * F.lit(level) > repeats * F.col("source_size")
        n, kept, open_ = ranked.agg(
            F.count_if(top), F.sum(F.when(top, repeats * F.col("source_size")).otherwise(0)),
            F.sum(F.when(top, 0).otherwise(F.col("weight")))).first()
        if n == held or not open_:
            break
        held, level = n, (budget * total - kept) / open_
    level = level or 0.0
    return ranked.select("source", "source_size",
                         F.least(F.col("weight") * F.lit(level), (repeats * F.col("source_size")).cast("double"))
                         .alias("target"))


def plan(store: Tables, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
         repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """Light rows of ``docs`` and, per source: its size, target, whole ``times`` that all
    its documents are taken, and the hash ``cut`` up to which they are taken once more."""
    rows = store.write(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                   place(F.col("doc_id"), F.col("text")).alias("h")), "rows")
    aims = targets(store, rows, weights, budget, repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = store.write(aims.withColumn("times", times.cast("long")).withColumn(
        "need", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    return rows, store.write(thresholds(store, rows, aims).withColumnRenamed("source", "of"), "cuts")


def copies() -> Column:
    """How often a document joined with its source's plan is taken."""
    return F.col("times") + F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """Rows ``doc_id, size, source_size, target, copies, taken``."""
    rows, cuts = plan(Tables(spark, "mixing"), docs, **how)
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies())
    return joined.select("doc_id", "size", "source_size", "target", "copies",
                         (F.col("size") * F.col("copies")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken.  The
    plan of the few sources is joined; texts are filtered where they are read."""
    _, cuts = plan(Tables(spark, "mixing"), docs, **how)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashed = docs.select(row.alias("row"), "source", place(F.col("doc_id"), F.col("text")).alias("h"))
    joined = hashed.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select("row", copies().alias("copies"))
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def thresholds(store: Tables, rows: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with ``cut``: the hash up to which a source's words come nearest to ``need``."""
    open_ = store.write(aims.select(F.col("source").alias("of"), "need", F.lit(0).cast("long").alias("lo"),
                                    F.lit(0).cast("long").alias("below")).where("need > 0"), "open")
    closed = None
    for shift in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        bucket = F.shiftright("h", shift)
        if shift == HASH_BITS - ROUND_BITS:
            sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("w"), F.count("*").alias("n")) \
                .join(open_, F.col("source").eqNullSafe(F.col("of")))
        else:
            inside = F.shiftright("h", shift + ROUND_BITS) == F.shiftright("lo", shift + ROUND_BITS)
            sums = rows.join(open_, F.col("source").eqNullSafe(F.col("of")) & inside) \
                .groupBy("of", "need", "lo", "below", bucket.alias("bucket")) \
                .agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        running = sums.selectExpr("of", "need", "bucket", "n", "w", "below", "below + sum(w) over (partition by of order by"
                                  " bucket rows between unbounded preceding and current row) as upto")
        hit = running.where("upto >= need and upto - w < need").selectExpr(
            "of", "need", f"shiftleft(bucket, {shift}) as lo", "upto - w as below", "w", "n")
        hit = store.write(hit, "boundary")
        # one row (or one hash) is left: nearest of with and without it
        last = F.lit(shift == 0) | (F.col("n") == 1)
        nearer = F.col("below") + F.col("w") - F.col("need") <= F.col("need") - F.col("below")
        cut = hit.where(last).select("of", F.when(nearer, F.col("lo") + F.lit((1 << shift) - 1)).otherwise(F.col("lo") - 1)
                                     .alias("cut"))
        closed = cut if closed is None else closed.unionAll(cut)
        open_ = hit.where(~last).select("of", "need", "lo", "below")
        if open_.isEmpty():
            break
    if closed is None:
        return aims.withColumn("cut", F.lit(None).cast("long"))
    return aims.join(closed, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def oracle() -> str:
    """The same rows in DuckDB SQL: targets in closed form (sources in the order in which
    they would be held), thresholds by a running sum in hash order."""
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15)
                       AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM s),
o AS (SELECT *, coalesce(sum({REPEATS} * source_size) OVER before, 0) AS held,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight, sum(source_size) OVER () AS total,
             row_number() OVER (ORDER BY {REPEATS} * source_size / weight, source) AS k
      FROM w WINDOW before AS (ORDER BY {REPEATS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT ({BUDGET} * total - held) / open_weight AS level FROM o
      WHERE weight * (({BUDGET} * total - held) / open_weight) <= {REPEATS} * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(weight * level, {REPEATS} * source_size) AS target FROM w, l),
n AS (SELECT *, CAST(floor(target / source_size) AS BIGINT) AS times,
             target - floor(target / source_size) * source_size AS need FROM t WHERE source_size > 0),
r AS (SELECT d.source, h, sum(size) AS w, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto
      FROM d GROUP BY d.source, h),
c AS (SELECT r.source, CASE WHEN upto - need <= need - (upto - w) THEN h ELSE h - 1 END AS cut
      FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source WHERE need > 0 AND upto >= need AND upto - w < need)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (coalesce(n.times, 0) + CASE WHEN d.h <= c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source"""
