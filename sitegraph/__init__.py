"""sitegraph: site-crawl analytics expressed as Spark DataFrame plans.

Fetched pages come in as a table; everything else (page extraction, URL
normalisation, robots evaluation, crawl status, redirect flattening,
discovery, link-graph reports, filters and views) is built from
``pyspark.sql`` columns, joins, aggregates, windows and Structured
Streaming so that Catalyst plans it and it runs unchanged on a cluster.
"""

from sitegraph.session import get_session, checkpoint_root  # noqa: F401
from sitegraph.settings import CrawlSettings  # noqa: F401

__all__ = ["get_session", "checkpoint_root", "CrawlSettings"]
