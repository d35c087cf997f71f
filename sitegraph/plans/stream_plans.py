"""Registered queries: streaming ingest, stream dedupe, change feed,
throughput (batch and streaming) and streaming attempt counters.

Each streaming query writes its input (derived from the driver tables) as
files into the shared checkpoint folder, runs the stream with
``trigger(availableNow=True)`` until the input is used up, and returns the
final state read back from the sink, which must equal the batch answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.plans.catalog import register
from sitegraph.plans.discovery import BATCH_CTE, UPSERT_SQL, upsert_batch
from sitegraph.session import scratch_path
from sitegraph.sources.fixtures import fixture, with_fixtures
from sitegraph.streaming import ingest as T


def _batch_chunks(spark, sf):
    """Crawl rows in arrival order: page rows, then hop rows, then late
    duplicates of first hops (which must lose)."""
    rows = upsert_batch(spark, sf)
    return [rows.filter(F.col("part") == k).drop("part") for k in range(3)]


@register("stream_ingest", UPSERT_SQL)
def q_stream_ingest(spark, sf):
    source = T.write_chunks(_batch_chunks(spark, sf), scratch_path(spark, "ingest-src"))
    base = fixture(spark, sf, "fx_crawl").select("page_id", "url", "status_code", "content_type")
    store = T.CrawlStore(spark, scratch_path(spark, "crawl-store")).create(base)
    T.run_ingest(spark, source, store)
    return store.current().select("url", "page_id", "status_code", "content_type", "change")


@register("stream_dedupe", with_fixtures(["fx_hops"], f"WITH {BATCH_CTE} SELECT url, status_code, content_type FROM b"))
def q_stream_dedupe(spark, sf):
    """The first row of each URL to arrive, whole."""
    chunks = [c.coalesce(1).sortWithinPartitions("seq") for c in _batch_chunks(spark, sf)]
    source = T.write_chunks(chunks, scratch_path(spark, "dedupe-src"))
    return T.run_dedupe(spark, source, order="seq").select("url", "status_code", "content_type")


@register("stream_changes", f"SELECT url, status_code, change FROM ({UPSERT_SQL.strip()}) WHERE change IS NOT NULL")
def q_stream_changes(spark, sf):
    """The change feed: every row a micro-batch wrote (new or updated).  Which
    micro-batch wrote it depends on file grouping, so the batch id is not part
    of the compared result."""
    source = T.write_chunks(_batch_chunks(spark, sf), scratch_path(spark, "changes-src"))
    base = fixture(spark, sf, "fx_crawl").select("page_id", "url", "status_code", "content_type")
    store = T.CrawlStore(spark, scratch_path(spark, "changes-store")).create(base)
    T.run_ingest(spark, source, store)
    return store.log().select("url", "status_code", "change")


THROUGHPUT_SQL = with_fixtures(["fx_attempts"], """
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS urls
FROM fx_attempts WHERE outcome = 'ok' GROUP BY 1, 2""")


@register("throughput", THROUGHPUT_SQL)
def q_throughput(spark, sf):
    return T.throughput(fixture(spark, sf, "fx_attempts").filter(F.col("outcome") == "ok"))


@register("stream_throughput", THROUGHPUT_SQL)
def q_stream_throughput(spark, sf):
    # event-time watermarks need TIMESTAMP (the table stores TIMESTAMP_NTZ; session zone is UTC)
    ok = fixture(spark, sf, "fx_attempts").filter(F.col("outcome") == "ok").select(
        F.col("ts").cast("timestamp").alias("ts"), "url")
    span = ok.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    n = 4
    step = max((span["hi"] - span["lo"]).total_seconds() / n, 1.0)
    chunks = []
    for k in range(n):
        lo = F.lit(span["lo"]) + F.expr(f"make_dt_interval(0, 0, 0, {k * step})")
        hi = F.lit(span["lo"]) + F.expr(f"make_dt_interval(0, 0, 0, {(k + 1) * step})")
        cond = (F.col("ts") >= lo) & ((F.col("ts") < hi) if k < n - 1 else F.lit(True))
        chunks.append(ok.filter(cond))
    source = T.write_chunks(chunks, scratch_path(spark, "throughput-src"))
    # rows of one chunk arrive in any file order: the watermark trails by more
    # than a chunk's span, so no row is ever late (results stay whole)
    delay = f"{int(step) + 3600} seconds"
    return T.run_throughput(spark, source, watermark=delay)


@register("stream_attempts", with_fixtures(["fx_attempts"], """
SELECT url, CAST(count_if(outcome <> 'ok') AS BIGINT) AS failures, CAST(count_if(outcome = 'ok') AS BIGINT) AS successes,
       count_if(outcome <> 'ok' AND before_ok) > 5 AS over_limit
FROM (SELECT *, count_if(outcome = 'ok') OVER (PARTITION BY url ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS before_ok FROM fx_attempts) GROUP BY url"""))
def q_stream_attempts(spark, sf):
    att = fixture(spark, sf, "fx_attempts").select("url", "outcome", "ts", "event_id")
    # three parts in the order of their times: a micro-batch each (all files that are new), read by three runs
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = att.agg(F.percentile_approx(at, [0.3, 0.7])).first()[0] or (0, 0)
    source, folder = scratch_path(spark, "attempts-src"), scratch_path(spark, "attempts")
    for part in (at < lo, (at >= lo) & (at < hi), at >= hi):
        T.write_chunks([att.filter(part)], source)
        out = T.run_attempt_counter(spark, source, max_files=1 << 20, folder=folder)
    return out


# -- T1 in full: fetches -> crawl step per micro-batch -------------------------

from sitegraph.plans.common import fetches_frame  # noqa: E402
from sitegraph.plans import page_plans as PP  # noqa: E402
from sitegraph.plans import discovery as DS  # noqa: E402
from sitegraph.settings import CrawlSettings  # noqa: E402

CRAWL_SETTINGS = CrawlSettings()


def _run_crawl_stream(spark, sf):
    fetches = fetches_frame(spark, sf)
    # arrival order: pages in three waves, so link targets discovered in one
    # micro-batch are crawled (updated) by a later one
    en, de = F.col("url").contains("/en/"), F.col("url").contains("/de/")
    waves = [fetches.filter(en), fetches.filter(~en & de), fetches.filter(~en & ~de)]
    source = T.write_chunks(waves, scratch_path(spark, "crawl-src"))
    empty = spark.createDataFrame([], ", ".join(
        f"{c} {'int' if c == 'status_code' else 'string'}" for c in CRAWL_SETTINGS.output_columns()))
    store = T.CrawlStore(spark, scratch_path(spark, "crawl-stream")).create(empty)
    T.run_crawl(spark, source, store, CRAWL_SETTINGS, fixture(spark, sf, "fx_robots"), order="page_id",
                max_files=64)
    return store


def _strip(sql: str) -> str:
    return sql.strip()


STREAM_CRAWL_SQL = f"""
WITH a AS (SELECT url, status_code, crawl_status FROM ({_strip(PP._page_rows_sql(CRAWL_SETTINGS))})),
b AS (SELECT url, status_code, crawl_status FROM ({_strip(DS._hop_sql(cut=True, robots=False))})),
l AS (SELECT DISTINCT url_to AS url FROM ({_strip(PP.ORACLES_CRAWL_LINKS)}))
SELECT url, status_code, crawl_status FROM a
UNION ALL SELECT url, status_code, crawl_status FROM b WHERE url NOT IN (SELECT url FROM a)
UNION ALL SELECT url, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM l
  WHERE url NOT IN (SELECT url FROM a) AND url NOT IN (SELECT url FROM b)"""


@register("stream_crawl", STREAM_CRAWL_SQL)
def q_stream_crawl(spark, sf):
    return _run_crawl_stream(spark, sf).current().select("url", "status_code", "crawl_status")


@register("stream_crawl_inlinks", f"SELECT DISTINCT url_from, url_to FROM ({_strip(PP.ORACLES_CRAWL_LINKS)})")
def q_stream_crawl_inlinks(spark, sf):
    return _run_crawl_stream(spark, sf).edges()


@register("stream_two_sources", STREAM_CRAWL_SQL)
def q_stream_two_sources(spark, sf):
    """Two sources ingested into one store in two runs: the same table as one batch."""
    fetches, robots = fetches_frame(spark, sf), fixture(spark, sf, "fx_robots")
    empty = spark.createDataFrame([], ", ".join(
        f"{c} {'int' if c == 'status_code' else 'string'}" for c in CRAWL_SETTINGS.output_columns()))
    store = T.CrawlStore(spark, scratch_path(spark, "crawl-two")).create(empty)
    for part in (F.col("url").contains("/en/"), ~F.col("url").contains("/en/")):
        source = T.write_chunks([fetches.filter(part)], scratch_path(spark, "crawl-part"))
        T.run_crawl(spark, source, store, CRAWL_SETTINGS, robots, order="page_id", max_files=64)
    return store.current().select("url", "status_code", "crawl_status")


@register("crawl_batch", STREAM_CRAWL_SQL)
def q_crawl_batch(spark, sf):
    from sitegraph.operators.crawl import build_crawl

    crawl, _ = build_crawl(fetches_frame(spark, sf), CRAWL_SETTINGS, fixture(spark, sf, "fx_robots"),
                           order="page_id")
    return crawl.select("url", "status_code", "crawl_status")
