"""Link-graph operators: inlinks lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inlinks_of(crawl: DataFrame, edges: DataFrame, url: str | DataFrame | None = None, key: str = "url",
               src: str = "url_from", dst: str = "url_to") -> DataFrame:
    """(url, inlink): the pages linking to ``url`` (every URL when ``None``).

    With a URL the target side is one row, so the edge scan is probe-only
    (AQE broadcasts the single target), and so with a frame of URLs; without it this is the full
    inlinks report, one shuffle join per side.
    """
    targets = crawl.select(F.col(key).alias("_dst"), F.col("url").alias("url"))
    sources = crawl.select(F.col(key).alias("_src"), F.col("url").alias("inlink"))
    links = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))
    if url is not None:
        # one target: filter the edges first, de-duplicate the few that are left
        targets = (targets.join(url.select("url"), "url", "left_semi") if isinstance(url, DataFrame)
                   else targets.filter(F.col("url") == F.lit(url)))
        hit = links.join(targets, "_dst").dropDuplicates(["_src", "_dst"])
    else:
        # full report: distinct edges hashed on both ends (spreads hub targets)
        hit = links.distinct().join(targets, "_dst")
    return hit.join(sources, "_src").select("url", "inlink")
