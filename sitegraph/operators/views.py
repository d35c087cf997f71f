"""Named report views over a crawl table and its link graph.

Every view only returns crawled rows (``status_code IS NOT NULL``), the
predicate the filter layer always adds.  Text tests are case-insensitive
"contains" with ASCII-only folding, like the reference's LIKE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.text import ascii_lower


def _crawled():
    return F.col("status_code").isNotNull()


# FIXED VALUES: view name -> (kind, argument).
STATUS_VIEWS = {
    "status_codes_200": (200, 200),
    "status_codes_3xx": (300, 399),
    "status_codes_4xx": (400, 499),
    "status_codes_5xx": (500, 599),
}
BROKEN_VIEWS = {
    "broken_inlinks_non_ok": None,
    "broken_inlinks_3xx": (300, 399),
    "broken_inlinks_4xx": (400, 499),
    "broken_inlinks_5xx": (500, 599),
}
CONTENT_TYPE_VIEWS = {
    "content_type_html": "html",
    "content_type_image": "image",
    "content_type_css": "css",
    "content_type_font": "font",
    "content_type_json": "json",
    "content_type_xml": "xml",
    "content_type_javascript": "javascript",
}
CRAWL_STATUS_VIEWS = {
    "crawl_status_ok": "ok",
    "crawl_status_not_ok": "not ok",
    "crawl_status_canonicalised": "canonicalised",
    "crawl_status_blocked_by_robots": "blocked",
    "crawl_status_noindex": "noindex",
}


# FIXED VALUES: View menu (group, entry label) -> view name.
MENU_VIEWS = {
    ("All Crawl Data", ""): "crawl",
    ("Internal Links", "All Non 200"): "broken_inlinks_non_ok",
    ("Internal Links", "Redirects (3xx)"): "broken_inlinks_3xx",
    ("Internal Links", "Client Error (4xx)"): "broken_inlinks_4xx",
    ("Internal Links", "Server Error (5xx)"): "broken_inlinks_5xx",
    ("Status Codes", "OK (200)"): "status_codes_200",
    ("Status Codes", "Redirects (3xx)"): "status_codes_3xx",
    ("Status Codes", "Client Error (4xx)"): "status_codes_4xx",
    ("Status Codes", "Server Error (5xx)"): "status_codes_5xx",
    ("Content Types", "HTML"): "content_type_html",
    ("Content Types", "Image"): "content_type_image",
    ("Content Types", "CSS"): "content_type_css",
    ("Content Types", "Font"): "content_type_font",
    ("Content Types", "JSON"): "content_type_json",
    ("Content Types", "XML"): "content_type_xml",
    ("Content Types", "JavaScript"): "content_type_javascript",
    ("Crawl Status", "OK"): "crawl_status_ok",
    ("Crawl Status", "Not OK"): "crawl_status_not_ok",
    ("Crawl Status", "Canonicalised"): "crawl_status_canonicalised",
    ("Crawl Status", "Blocked By Robots"): "crawl_status_blocked_by_robots",
    ("Crawl Status", "Noindex"): "crawl_status_noindex",
}


def menu_view(group: str, label: str, crawl: DataFrame, edges: DataFrame | None = None, **kw) -> DataFrame:
    """The view behind a View-menu entry."""
    return view(MENU_VIEWS[(group, label)], crawl, edges, **kw)


def broken_inlinks(crawl: DataFrame, edges: DataFrame, status_range: tuple | None = None,
                   key: str = "url", src: str = "url_from", dst: str = "url_to",
                   dedupe: bool = True) -> DataFrame:
    """(url_from, url_to, status_code) for links whose target is not ok.

    ``status_range=None`` means "status differs from 200", else an inclusive
    range.  ``key`` is the crawl column the edge ends refer to (``url`` for a
    URL-keyed graph, a surrogate id otherwise).  ``dedupe=False`` skips the
    edge distinct for an inlinks table that is unique by construction.

    Plan shape: the target predicate is applied to the crawl side before the
    join; that side is what AQE measures and broadcasts when small, else the
    join on the target is a sort-merge join whose hub partition AQE splits (the
    target side has one row per key, so it is replicated to the splits).  Only
    the links that survive are de-duplicated, hashed on both ends.
    """
    code = F.col("status_code")
    pred = (code != 200) if status_range is None else code.between(*status_range)
    targets = crawl.filter(_crawled() & pred).select(
        F.col(key).alias("_dst"), F.col("url").alias("url_to"), "status_code")
    sources = crawl.select(F.col(key).alias("_src"), F.col("url").alias("url_from"))
    links = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))
    hit = links.join(targets, "_dst")
    if dedupe:
        hit = hit.dropDuplicates(["_src", "_dst"])
    return hit.join(sources, "_src").select("url_from", "url_to", "status_code")


def status_codes(crawl: DataFrame, lo: int, hi: int) -> DataFrame:
    return crawl.filter(_crawled() & F.col("status_code").between(lo, hi))


def content_type(crawl: DataFrame, kind: str) -> DataFrame:
    return crawl.filter(_crawled() & ascii_lower(F.col("content_type")).contains(kind))


def crawl_status_view(crawl: DataFrame, which: str) -> DataFrame:
    s = ascii_lower(F.col("crawl_status"))
    if which == "ok":
        pred = F.col("crawl_status") == "ok"
    elif which == "not ok":
        pred = ~s.contains("ok")
    else:
        pred = s.contains(which)
    return crawl.filter(_crawled() & pred)


def onpage_length(crawl: DataFrame, column: str) -> DataFrame:
    """url, the column, its length in characters; longest first."""
    return (crawl.filter(_crawled())
            .select("url", column, F.length(F.coalesce(F.col(column), F.lit(""))).alias("length"))
            .orderBy(F.col("length").desc(), F.col("url")))


def view(name: str, crawl: DataFrame, edges: DataFrame | None = None, **kw) -> DataFrame:
    """Any named view by name (menu entry -> DataFrame)."""
    if name in BROKEN_VIEWS:
        if edges is None:
            raise ValueError(f"{name} needs the inlinks table")
        return broken_inlinks(crawl, edges, BROKEN_VIEWS[name], **kw)
    if name in STATUS_VIEWS:
        return status_codes(crawl, *STATUS_VIEWS[name])
    if name in CONTENT_TYPE_VIEWS:
        return content_type(crawl, CONTENT_TYPE_VIEWS[name])
    if name in CRAWL_STATUS_VIEWS:
        return crawl_status_view(crawl, CRAWL_STATUS_VIEWS[name])
    if name == "crawl":
        return crawl.filter(_crawled())
    raise KeyError(f"unknown view {name!r}")


ALL_VIEWS = ["crawl", *BROKEN_VIEWS, *STATUS_VIEWS, *CONTENT_TYPE_VIEWS, *CRAWL_STATUS_VIEWS]


def register_views(crawl: DataFrame, edges: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Register every named view as a temporary view (after a crawl load), so
    the same reports are reachable from ``spark.sql``.  Returns the names."""
    names = []
    for name in ALL_VIEWS:
        if name in BROKEN_VIEWS and edges is None:
            continue
        view(name, crawl, edges).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
