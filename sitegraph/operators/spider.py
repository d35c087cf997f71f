"""Spider crawl: from the start URLs over the links that the fetched pages hold.

The links of all fetched pages are extracted once (resolved, normalised, internal, not
excluded, allowed by robots.txt as the settings say) and written; the closure over them
(``closure``) then moves only URLs: no round reads a body or the fetch table again, and no
body is ever in an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.closure import spider_closure
from sitegraph.operators.crawl import crawl_links
from sitegraph.settings import CrawlSettings


def spider_crawl(fetches: DataFrame, start: DataFrame, settings: CrawlSettings,
                 robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, fetched): every URL a crawl from ``start(url)`` comes to; those
    without a row in ``fetches`` are reached but hold no links."""
    reached = spider_closure(crawl_links(fetches, settings, robots), start)
    crawled = fetches.select("url", F.lit(True).alias("fetched")).distinct()
    return reached.join(crawled, "url", "left").select("url", "depth", F.coalesce("fetched", F.lit(False)).alias("fetched"))
