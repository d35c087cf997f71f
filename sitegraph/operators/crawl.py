"""One crawl step over a batch of fetches: the consumer side of a crawl.

The bodies are read once (``read_pages``: items and link array in one projection).  From
the result, each fetch becomes its page row plus one row per redirect hop (page row first,
then the hops in order), and the links it contributes;
:class:`sitegraph.streaming.ingest.CrawlStore` applies both (first-write-wins upsert, link
targets inserted as discovered, unique edges recorded).

``order`` names the column that says in which order the fetches arrived: of several rows
for one URL the first to arrive counts, so there is no default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.extract import body_gate, extract_links, header_info, links_of, project_items, read_pages, rows_of
from sitegraph.operators.redirects import redirect_rows
from sitegraph.session import checkpoint_root
from sitegraph.settings import CrawlSettings


def crawl_rows(read: DataFrame, settings: CrawlSettings, order: str, robots: DataFrame | None = None) -> DataFrame:
    """Crawl rows of read pages with ``_seq`` = (arrival key, 0 for the page row / hop
    number + 1 for redirect hops)."""
    out_cols = settings.output_columns()
    keep = [order] if order not in out_cols else []
    pages = rows_of(read, settings, robots, keep=tuple(keep))
    pages = pages.select(*keep, *out_cols,
                         F.struct(F.col(order).alias("k"), F.lit(0).alias("n")).alias("_seq"))
    hops = redirect_rows(read, settings, robots, keep=tuple(keep))
    hops = project_items(hops.withColumn("_sub", F.col("hop") + 1), settings, keep=[*keep, "_sub"])
    hops = hops.select(*keep, *out_cols,
                       F.struct(F.col(order).alias("k"), F.col("_sub").alias("n")).alias("_seq"))
    return pages.unionByName(hops)


def crawl_links(fetches: DataFrame, settings: CrawlSettings, robots: DataFrame | None = None) -> DataFrame:
    """(url_from, url_to) links of the fetched pages (bodies gated as in a crawl)."""
    gated = body_gate(header_info(fetches), settings).filter(F.col("html").isNotNull())
    return extract_links(gated.select("url", "html"), settings, robots)


def build_crawl(fetches: DataFrame, settings: CrawlSettings, robots: DataFrame | None = None, *,
                order: str) -> tuple[DataFrame, DataFrame]:
    """Batch crawl over a whole fetch table: (crawl table, inlinks).

    Page and redirect rows (first write wins per URL, by ``order``), link targets that no
    fetch produced as discovered rows, unique edges.  What the bodies say is written to the
    checkpoint folder first, so they are read once.  The streaming crawl arrives at the same
    table batch by batch."""
    from sitegraph.operators.state import dedupe_batch

    checkpoint_root(fetches.sparkSession)
    read = read_pages(fetches, settings).checkpoint()
    rows = dedupe_batch(crawl_rows(read, settings, order, robots), "_seq").drop("_seq")
    links = links_of(read, settings, robots)
    discovered = (links.select(F.col("url_to").alias("url")).distinct()
                  .join(rows.select("url"), "url", "left_anti"))
    crawl = rows.unionByName(discovered, allowMissingColumns=True)
    inlinks = links.distinct() if settings.has("unique_inlinks") else links.where(F.lit(False))
    return crawl, inlinks
