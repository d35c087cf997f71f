"""Quality rules with thresholds from mergeable quantile sketches (native Spark SQL).

Every whole text is measured in one projection.  Rates (symbols, repeated lines,
repeated windows, word length) go into log-linear histograms per language and
source: a value keeps its first 7 binary digits, so a bucket is within 1/128 of its
values, counts of any two parts add up to the count of the whole, and quantiles come
from running counts.  A document fails a rate that lies far outside the quartiles of
its own language and source (``REACH`` interquartile ranges, plus a slack, beyond
them).  The quartiles of a group of n rows stand for n rows, those of its language for
``PRIOR`` rows more: they are averaged with these weights at every size, so a small group
leans on its language, a large one on itself, and nothing switches in between.

Cases: null text counts as empty (no words: the base rule fails); null language or
source is a group of its own; repeated rows are judged alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, utf8

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
DIGITS = 7                      # binary digits a bucket keeps
REACH = 6
PRIOR = 100                     # rows that the quartiles of the language count for
#: rate -> (numerator, denominator, scale, slack); a rate is an integer in 1/scale.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1_000_000, 20_000),
    "line_rate": ("n_dup_lines", "n_lines", 1_000_000, 500_000),
    "repeat_rate": ("n_repeat_words", "n_words", 1_000_000, 150_000),
    "word_length": ("word_chars", "n_words", 1_000, 2_000),
}
#: Rates that may also be too low.
BOTH_SIDES = ("word_length",)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words inside windows that occur twice or more among the words of a text."""
    last = F.size(words) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.aggregate(
            F.sort_array(F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(
                F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["to"], i)).alias("n"), (i + WINDOW).alias("to")),
            lambda a: a["n"]))

    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(count(h)))
    return F.when(last >= 1, repeated).otherwise(0).cast("long")


def measures(text: Column) -> list[Column]:
    """The measures of a text as columns (``text`` must not be null)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).alias("n_repeat_words")))
        .alias("_w"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        .alias("_l"),
    ]


def measure(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and one struct ``m`` of measures, rates and ``base_failed``."""
    flat = docs.select(*keep, *measures(utf8(F.col("text")))).withColumn("m", F.struct(
        "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words"))
    rates = [F.coalesce(F.expr(f"try_divide({scale}L * m.{top}, m.{bottom})"), F.lit(0)).cast("long").alias(rate)
             for rate, (top, bottom, scale, _) in RATES.items()]
    failed = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    return flat.select(*[c for c in flat.columns if c not in ("_w", "_l", "word_chars", "n_symbols", "m")],
                       F.struct("m.*", *rates, failed.alias("base_failed")).alias("m"))


def bucket(value: Column) -> Column:
    """A whole number cut to its first DIGITS binary digits."""
    spare = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return let(spare, lambda s: F.call_function("shiftleft", F.call_function("shiftright", value, s), s))


def fences(measured: DataFrame) -> DataFrame:
    """Per language and source: the range ``lo_<rate>`` .. ``hi_<rate>`` that passes."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(f"m.{r}")).alias("bucket"))
                                for r in RATES]))
    sketch = measured.select("lang", "source", rates.alias("v")).groupBy("lang", "source", "v.rate", "v.bucket") \
        .agg(F.count("*").alias("n"))
    spoken = sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    own = _quartiles(sketch, ["lang", "source"])
    wide = _quartiles(spoken, ["lang"]).selectExpr("lang as _lang", "rate as _rate", "q1 as l1", "q3 as l3")
    joined = own.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rate") == F.col("_rate")))
    for q, of_language in (("q1", "l1"), ("q3", "l3")):
        joined = joined.withColumn(q, F.expr(f"(rows * {q} + {PRIOR} * {of_language}) div (rows + {PRIOR})"))
    slack = F.element_at(F.create_map(*[F.lit(x) for r, v in RATES.items() for x in (r, v[3])]), F.col("rate"))
    reach = (F.col("q3") - F.col("q1")) * REACH + slack
    ranges = joined.select("lang", "source", "rate", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    return ranges.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{side}_{r}") for r in RATES for side in ("lo", "hi")])


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    keys = ", ".join([*by, "rate"])
    running = sketch.selectExpr(*by, "rate", "bucket",
                                f"sum(n) over (partition by {keys} order by bucket rows between unbounded preceding"
                                " and current row) as upto", f"sum(n) over (partition by {keys}) as rows")
    return running.groupBy(*by, "rate").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("bucket"))).alias("q3"))


def judge(measured: DataFrame, ranges: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: joined with the ranges of its language and source."""
    ranges = ranges.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = ~F.col("m.base_failed")
    for r in RATES:
        inside &= F.col(f"m.{r}") <= F.col(f"hi_{r}")
        if r in BOTH_SIDES:
            inside &= F.col(f"m.{r}") >= F.col(f"lo_{r}")
    out = measured.join(ranges, measured["lang"].eqNullSafe(ranges["_lang"])
                        & measured["source"].eqNullSafe(ranges["_source"]))
    return out.withColumn("kept", inside).drop(*ranges.columns)


def assess(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows ``doc_id``, the measures and rates, ``base_failed`` and ``kept``."""
    store = Tables(spark, "quality")
    measured = store.write(measure(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]), "measures")
    return judge(measured, store.write(fences(measured), "fences")).select("doc_id", "m.*", "kept")


def passing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    store = Tables(spark, "quality")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = store.write(measure(docs, [row.alias("row"), F.col("lang"), F.col("source")]), "measures")
    return judge(measured, store.write(fences(measured), "fences")).where("kept").select("row.*")


def oracle() -> str:
    """The same rows in DuckDB SQL, from the definitions."""
    rate_rows = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r}' AS rate, "
        f"CAST(CASE WHEN {bottom} = 0 THEN 0 ELSE ({scale} * {top}) // {bottom} END AS BIGINT) AS v FROM m"
        for r, (top, bottom, scale, _) in RATES.items())
    slack = " ".join(f"WHEN '{r}' THEN {v[3]}" for r, v in RATES.items())
    low = ", ".join(f"'{r}'" for r in BOTH_SIDES)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, len(f) AS n_lines, len(f) - len(list_distinct(f)) AS n_dup_lines FROM
       (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS f FROM d)),
m AS (SELECT d.doc_id, lang, source, len(w) AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             n_lines, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
r AS ({rate_rows}),
b AS (SELECT *, CASE WHEN v < 128 THEN v
                     ELSE (v // CAST(pow(2, length(bin(v)) - 7) AS BIGINT)) * CAST(pow(2, length(bin(v)) - 7) AS BIGINT)
                END AS bucket FROM r),
own AS (SELECT lang, source, rate, count(*) AS n,
               min(CASE WHEN 4 * upto >= n_all THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * n_all THEN bucket END) AS q3
        FROM (SELECT *, count(*) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto,
                     count(*) OVER (PARTITION BY lang, source, rate) AS n_all FROM b) GROUP BY lang, source, rate),
wide AS (SELECT lang, rate, min(CASE WHEN 4 * upto >= n_all THEN bucket END) AS l1,
                min(CASE WHEN 4 * upto >= 3 * n_all THEN bucket END) AS l3
         FROM (SELECT *, count(*) OVER (PARTITION BY lang, rate ORDER BY bucket) AS upto,
                      count(*) OVER (PARTITION BY lang, rate) AS n_all FROM b) GROUP BY lang, rate),
q AS (SELECT own.lang, source, own.rate, (n * q1 + {PRIOR} * l1) // (n + {PRIOR}) AS q1, (n * q3 + {PRIOR} * l3) // (n + {PRIOR}) AS q3
      FROM own JOIN wide ON own.rate = wide.rate AND own.lang IS NOT DISTINCT FROM wide.lang),
f AS (SELECT *, {REACH} * (q3 - q1) + CASE rate {slack} END AS reach FROM q),
ok AS (SELECT r.doc_id, bool_and(r.v <= q3 + reach AND (r.rate NOT IN ({low}) OR r.v >= q1 - reach)) AS inside
       FROM r JOIN f ON r.rate = f.rate AND r.lang IS NOT DISTINCT FROM f.lang
                    AND r.source IS NOT DISTINCT FROM f.source GROUP BY r.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT base.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM base JOIN ok USING (doc_id)"""
