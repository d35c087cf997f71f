"""Redirect flattening: a fetch with a redirect history becomes one crawl row
per hop.

Per hop: the hop URL (normalised), its own status, content type and
x-robots-tag, the URL it redirects to (the next hop, or the fetch's final
URL for the last hop), its robots status and its crawl status.  Unless
external links are kept, the chain stops at the first external hop (that hop
and the later ones are dropped); when robots.txt is respected and blocked
redirects are not followed, blocked hops are skipped one by one.

All chain logic is positional inside the fetch row (``posexplode`` plus
array lookups), so no window or shuffle is needed; the only exchange is the
robots host join.  The history array is bounded by the redirect limit of the
fetcher.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.functions.status import crawl_status
from sitegraph.settings import CrawlSettings


def initial_url(history="history", url="url") -> Column:
    """First hop of the history, else the URL itself (trimmed)."""
    first = F.get(F.col(history), 0)
    return F.trim(F.coalesce(first["url"], F.col(url)))


def _header(headers: Column, name: str) -> Column:
    lowered = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(F.try_element_at(lowered, F.lit(name)), F.lit(""))


@lru_cache(maxsize=16)
def _first_domain(url: str) -> Column:
    return U.domain(initial_url("history", url))


@lru_cache(maxsize=1)
def _hop_urls() -> Column:
    return F.transform("history", lambda h: U.normalise(h["url"]))


def _leaves(hop: Column, root: Column) -> Column:
    """``is_external`` of a normalised hop (NULL: no URL, not external)."""
    return F.coalesce((U.normal_domain(hop) != "") & (U.normal_domain(hop) != root), F.lit(False))


def redirect_rows(fetches: DataFrame, settings: CrawlSettings, robots: DataFrame | None = None,
                  url: str = "url", keep: tuple = ("page_id",)) -> DataFrame:
    """Hop rows of every redirected fetch."""
    keep = [k for k in keep if k in fetches.columns]
    f = fetches.filter(F.size("history") > 0).select(*keep, url, "history")
    root = (F.lit(settings.root_domain) if settings.root_domain is not None
            else _first_domain(url))
    f = f.withColumn("_root", root).withColumn("_hop_urls", _hop_urls())
    if not settings.has("external_links"):
        # 1-based position of the first external hop, 0 when none
        first_ext = F.array_position(F.transform("_hop_urls", lambda u: _leaves(u, F.col("_root"))), True)
        f = f.withColumn("_cut", F.when(first_ext > 0, first_ext - 1))
    else:
        f = f.withColumn("_cut", F.lit(None).cast("int"))
    hops = f.select(*keep, url, "_hop_urls", "_cut", F.posexplode("history").alias("hop", "h"))
    hops = hops.filter(F.col("_cut").isNull() | (F.col("hop") < F.col("_cut")))
    nxt = F.try_element_at(F.col("_hop_urls"), F.col("hop") + 2)
    rows = hops.select(
        *keep, F.col("hop").cast("int").alias("hop"),
        F.try_element_at(F.col("_hop_urls"), F.col("hop") + 1).alias("url"),
        F.col("h")["status_code"].alias("status_code"),
        _header(F.col("h")["headers"], "content-type").alias("content_type"),
        _header(F.col("h")["headers"], "x-robots-tag").alias("x_robots_tag"),
        F.coalesce(nxt, F.col(url)).alias("redirect_url"))
    if robots is None or settings.list_mode:
        rows = rows.withColumn("robots_txt", F.lit("allowed"))
    else:
        from sitegraph.operators.robots import with_robots_status

        rows = with_robots_status(rows, "url", robots, settings.agent)
    if settings.has("respect_robots_txt") and not settings.has("follow_blocked_redirects"):
        rows = rows.filter(F.col("robots_txt") != "blocked")
    return rows.withColumn("crawl_status", crawl_status(
        "url", meta_robots=None, canonical_tag=None, canonical_http_header=None))
