"""Discovery and crawl-state maintenance over URL-keyed tables.

The crawl table is keyed by ``url``; a row with ``status_code IS NULL`` is
*discovered* (known, not fetched), any other row is *crawled*.  Every operator
is a join on ``url`` (one exchange per side, AQE picks broadcast for a small
side and splits skewed keys) or an aggregate with map-side partial
aggregation, so hot URLs never concentrate unbounded data in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.status import crawl_status


def crawled(crawl: DataFrame) -> DataFrame:
    return crawl.filter(F.col("status_code").isNotNull())


def link_targets(links: DataFrame, dst: str = "url_to") -> DataFrame:
    return links.select(F.col(dst).alias("url")).filter(F.col("url").isNotNull()).distinct()


def new_urls(links: DataFrame, crawl: DataFrame, dst: str = "url_to") -> DataFrame:
    """Distinct link targets not yet in the crawl table."""
    return link_targets(links, dst).join(crawl.select("url"), "url", "left_anti")


def uncrawled_urls(links: DataFrame, crawl: DataFrame, dst: str = "url_to") -> DataFrame:
    """Distinct link targets that are not crawled (unknown or only discovered)."""
    return link_targets(links, dst).join(crawled(crawl).select("url"), "url", "left_anti")


def urls_in_crawl(links: DataFrame, crawl: DataFrame, dst: str = "url_to") -> DataFrame:
    """Distinct link targets that the crawl table already holds."""
    return link_targets(links, dst).join(crawl.select("url"), "url", "left_semi")


def insert_discovered(crawl: DataFrame, urls: DataFrame) -> DataFrame:
    """Add unknown URLs as discovered rows (all other columns NULL); known
    URLs are left as they are."""
    fresh = urls.select("url").distinct().join(crawl.select("url"), "url", "left_anti")
    return crawl.unionByName(fresh, allowMissingColumns=True)


def dedupe_batch(batch: DataFrame, seq: str) -> DataFrame:
    """One row per URL inside a batch: the one with the smallest ``seq``.
    ``min_by`` aggregates partially on the map side, so a URL repeated a
    huge number of times never gathers its rows in one task."""
    cols = [c for c in batch.columns if c != "url"]
    first = F.min_by(F.struct(*cols), F.col(seq))
    return batch.groupBy("url").agg(first.alias("_r")).select("url", "_r.*")


def upsert(crawl: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """First-write-wins upsert of crawl rows.

    Unknown URL -> inserted (``change='new'``); discovered URL -> overwritten
    (``'updated'``); crawled URL -> kept as is.  Untouched rows have
    ``change`` NULL.  Duplicate URLs inside the batch: smallest ``seq`` wins.
    Replaying the same batch is a no-op (everything is crawled by then).
    """
    b = dedupe_batch(batch, seq).drop(seq)
    old_cols = [c for c in crawl.columns if c not in ("url", "change")]
    new_cols = [c for c in b.columns if c != "url"]
    old = crawl.select("url", *old_cols, F.lit(True).alias("_old"))
    new = b.select("url", *new_cols, F.lit(True).alias("_new"))
    j = old.alias("o").join(new.alias("n"), "url", "full_outer")
    was_discovered = F.col("o._old").isNotNull() & F.col("o.status_code").isNull()
    take_new = F.col("n._new").isNotNull() & (F.col("o._old").isNull() | was_discovered)
    change = (F.when(F.col("o._old").isNull(), F.lit("new"))
              .when(F.col("n._new").isNotNull() & was_discovered, F.lit("updated")))

    def pick(c):
        if c in new_cols and c in old_cols:
            return F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        if c in new_cols:  # batch-only column
            return F.when(take_new, F.col(f"n.{c}")).alias(c)
        return F.col(f"o.{c}").alias(c)  # columns the batch does not carry stay

    cols = old_cols + [c for c in new_cols if c not in old_cols]
    return j.select("url", *[pick(c) for c in cols], change.alias("change"))


def changes(upserted: DataFrame) -> DataFrame:
    """The change feed of an upsert: rows that were new or updated."""
    return upserted.filter(F.col("change").isNotNull())


def build_inlinks(links: DataFrame, crawl: DataFrame, src: str = "url_from", dst: str = "url_to") -> DataFrame:
    """Unique (url_from, url_to) edges whose both ends are in the crawl table."""
    urls = crawl.select("url")
    e = links.select(F.col(src).alias("url_from"), F.col(dst).alias("url_to")).distinct()
    e = e.join(urls.withColumnRenamed("url", "url_to"), "url_to", "left_semi")
    return e.join(urls.withColumnRenamed("url", "url_from"), "url_from", "left_semi").select("url_from", "url_to")


def pending(crawl: DataFrame) -> DataFrame:
    """The URL queue: discovered, not crawled."""
    return crawl.filter(F.col("status_code").isNull()).select("url")


def progress(crawl: DataFrame) -> DataFrame:
    """One row: total, crawled, pending, percent (truncated crawled/total*100)."""
    total = F.count(F.lit(1))
    done = F.count("status_code")
    return crawl.agg(total.alias("total"), done.alias("crawled")).select(
        "total", "crawled", (F.col("total") - F.col("crawled")).alias("pending"),
        F.when(F.col("total") > 0, F.expr("(crawled * 100) div total"))
        .otherwise(F.lit(0).cast("bigint")).alias("percent"))


def failed_urls(attempts: DataFrame, max_retries: int = 5, url: str = "url", ts: str = "ts",
                outcome: str = "outcome", ok_value: str = "ok", seq: str | None = "event_id") -> DataFrame:
    """Failure rows: a URL whose failures before its first success exceed
    the retry limit gets status 0 and the lower-cased issue of its last such
    failure as crawl status.

    Two aggregates and one join on url: the first success time per URL, then
    the failures before it counted with partial aggregation (a hot URL is
    pre-aggregated on the map side, never collected)."""
    order = F.struct(F.col(ts), F.col(seq)) if seq else F.struct(F.col(ts))
    first_ok = (attempts.filter(F.col(outcome) == ok_value)
                .groupBy(url).agg(F.min(order).alias("_first_ok")))
    fails = attempts.filter(F.col(outcome) != ok_value).withColumn("_order", order)
    before = fails.join(first_ok, url, "left").filter(
        F.col("_first_ok").isNull() | (F.col("_order") < F.col("_first_ok")))
    agg = before.groupBy(url).agg(F.count(F.lit(1)).alias("failures"),
                                  F.max_by(F.col(outcome), F.col("_order")).alias("_issue"))
    return agg.filter(F.col("failures") > max_retries).select(
        F.col(url).alias("url"), F.lit(0).alias("status_code"),
        F.lower("_issue").alias("crawl_status"), "failures")


def list_crawl(fetch_rows: DataFrame, urls: DataFrame) -> DataFrame:
    """List mode: exactly the listed URLs are processed; robots.txt is not
    read (every row is allowed) and no links are followed."""
    rows = fetch_rows.join(urls.select("url").distinct(), "url", "left_semi")
    rows = rows.withColumn("robots_txt", F.lit("allowed"))
    return rows.withColumn("crawl_status", crawl_status())
