"""Registered queries: status columns, report views and the filter layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.functions.filters import apply_filters, regexp_search
from sitegraph.functions.status import is_canonicalised, status_text
from sitegraph.operators import views as V
from sitegraph.operators.links import inlinks_of
from sitegraph.plans.catalog import register
from sitegraph.plans.common import crawl_frame, sql_with_crawl
from sitegraph.plans.sqlparts import status_names_sql
from sitegraph.settings import NON_STANDARD
from sitegraph.sources.fixtures import fixture

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def low(expr: str) -> str:
    return f"translate({expr}, {AZ})"


# -- D1-D3 ------------------------------------------------------------------

@register("status_text", sql_with_crawl(f"""
SELECT c.page_id, c.status_code, coalesce(sn.name, '{NON_STANDARD}') AS status_text
FROM fx_crawl c LEFT JOIN {status_names_sql()} ON sn.code = c.status_code
WHERE c.status_code IS NOT NULL"""))
def q_status_text(spark, sf):
    c = crawl_frame(spark, sf)
    return c.filter(F.col("status_code").isNotNull()).select(
        "page_id", "status_code", status_text("status_code").alias("status_text"))


@register("is_canonicalised", sql_with_crawl("""
SELECT page_id, url, canonical_tag,
       (coalesce(canonical_tag, '') <> '' AND coalesce(canonical_tag, '') <> url) AS is_canonicalised
FROM fx_crawl"""))
def q_is_canonicalised(spark, sf):
    c = crawl_frame(spark, sf)
    return c.select("page_id", "url", "canonical_tag",
                    is_canonicalised("url", "canonical_tag").alias("is_canonicalised"))


@register("crawl_status", sql_with_crawl("SELECT page_id, url, status_code, crawl_status FROM crawl"))
def q_crawl_status(spark, sf):
    return crawl_frame(spark, sf).select("page_id", "url", "status_code", "crawl_status")


# -- V1-V20 -----------------------------------------------------------------

def _broken_sql(rng):
    pred = "t.status_code <> 200" if rng is None else f"t.status_code BETWEEN {rng[0]} AND {rng[1]}"
    return sql_with_crawl(f"""
SELECT s.url AS url_from, t.url AS url_to, t.status_code
FROM (SELECT DISTINCT from_id, to_id FROM fx_edges) e
JOIN crawl t ON t.page_id = e.to_id
JOIN crawl s ON s.page_id = e.from_id
WHERE t.status_code IS NOT NULL AND {pred}""", ("fx_edges",))


def _broken_builder(rng):
    def build(spark, sf):
        return V.broken_inlinks(crawl_frame(spark, sf), fixture(spark, sf, "fx_edges"), rng,
                                key="page_id", src="from_id", dst="to_id")
    return build


for _name, _rng in V.BROKEN_VIEWS.items():
    register(_name, _broken_sql(_rng))(_broken_builder(_rng))


def _simple_view_builder(name):
    def build(spark, sf):
        return V.view(name, crawl_frame(spark, sf))
    return build


for _name, (_lo, _hi) in V.STATUS_VIEWS.items():
    register(_name, sql_with_crawl(
        f"SELECT * FROM crawl WHERE status_code BETWEEN {_lo} AND {_hi}"))(_simple_view_builder(_name))

for _name, _kind in V.CONTENT_TYPE_VIEWS.items():
    register(_name, sql_with_crawl(
        f"SELECT * FROM crawl WHERE status_code IS NOT NULL AND contains({low('content_type')}, '{_kind}')"
    ))(_simple_view_builder(_name))

_CS_SQL = {
    "ok": "crawl_status = 'ok'",
    "not ok": f"NOT contains({low('crawl_status')}, 'ok')",
}
for _name, _which in V.CRAWL_STATUS_VIEWS.items():
    _pred = _CS_SQL.get(_which, f"contains({low('crawl_status')}, '{_which}')")
    register(_name, sql_with_crawl(
        f"SELECT * FROM crawl WHERE status_code IS NOT NULL AND {_pred}"))(_simple_view_builder(_name))


# -- Q1-Q17 -----------------------------------------------------------------

def _filter_builder(filters, columns=None, view_name="crawl"):
    def build(spark, sf):
        return apply_filters(V.view(view_name, crawl_frame(spark, sf)), filters, columns)
    return build


# name -> (filters, oracle WHERE clause)
FILTER_CASES = {
    "filter_equals": ([("status_code", "Equals", "404")], "status_code = 404"),
    "filter_not_equals": ([("content_type", "Does Not Equal", "text/html; charset=utf-8")],
                          "content_type <> 'text/html; charset=utf-8'"),
    "filter_begins": ([("url", "Begins With", "HTTPS://BLOG.")],
                      f"starts_with({low('url')}, 'https://blog.')"),
    "filter_ends": ([("url", "Ends With", "?UTM_SOURCE=FEED")],
                    f"ends_with({low('url')}, '?utm_source=feed')"),
    "filter_contains": ([("url", "Contains", "/Fr/")], f"contains({low('url')}, '/fr/')"),
    "filter_not_contains": ([("canonical_tag", "Does Not Contain", "utm_")],
                            f"NOT contains({low('canonical_tag')}, 'utm_')"),
    "filter_gt": ([("status_code", "Greater Than", "300")], "status_code > 300"),
    "filter_ge": ([("url", "Greater Than Or Equal To", "https://m")], "url >= 'https://m'"),
    "filter_lt": ([("status_code", "Less Than", "abc")], "TRUE"),
    "filter_le": ([("crawl_status", "Less Than Or Equal To", "moved permanently")],
                  "crawl_status <= 'moved permanently'"),
    "filter_multi": ([("Content Type", "Contains", "TEXT"), ("status_code", "Greater Than Or Equal To", "200"),
                      ("url", "Contains", "")],
                     f"contains({low('content_type')}, 'text') AND status_code >= 200"),
    "filter_status_text": ([("status_code", "Begins With", "30")],
                           "starts_with(CAST(status_code AS VARCHAR), '30')"),
}

for _name, (_filters, _where) in FILTER_CASES.items():
    register(_name, sql_with_crawl(
        f"SELECT * FROM crawl WHERE status_code IS NOT NULL AND ({_where})"))(_filter_builder(_filters))

register("sort_asc", sql_with_crawl("SELECT * FROM crawl WHERE status_code IS NOT NULL ORDER BY status_code, url"))(
    _filter_builder([("status_code", "Sort Smallest To Largest", ""), ("url", "Sort A-Z", "")]))
register("sort_desc", sql_with_crawl("SELECT * FROM crawl WHERE status_code IS NOT NULL ORDER BY url DESC"))(
    _filter_builder([("url", "Sort Z-A", "")]))
register("query_view", sql_with_crawl(
    f"SELECT url, status_code, crawl_status FROM crawl WHERE status_code IS NOT NULL "
    f"AND contains({low('content_type')}, 'html') AND NOT contains({low('url')}, '/en/') ORDER BY url DESC"))(
    _filter_builder([("url", "Does Not Contain", "/EN/"), ("url", "Sort Z-A", "")],
                    ["URL", "Status Code", "Crawl Status"], view_name="content_type_html"))


@register("filter_regexp", sql_with_crawl(
    "SELECT * FROM crawl WHERE status_code IS NOT NULL AND regexp_matches(url, '/(fr|de)/[0-9]+')"))
def q_filter_regexp(spark, sf):
    c = crawl_frame(spark, sf)
    return c.filter(F.col("status_code").isNotNull() & regexp_search("url", "/(fr|de)/[0-9]+"))


@register("inlinks_of", sql_with_crawl("""
SELECT t.url AS url, s.url AS inlink
FROM (SELECT DISTINCT from_id, to_id FROM fx_edges) e
JOIN fx_crawl t ON t.page_id = e.to_id
JOIN fx_crawl s ON s.page_id = e.from_id""", ("fx_edges",)))
def q_inlinks_of(spark, sf):
    c = fixture(spark, sf, "fx_crawl")
    return inlinks_of(c, fixture(spark, sf, "fx_edges"), key="page_id", src="from_id", dst="to_id")


@register("inlinks_of_url", sql_with_crawl("""
SELECT t.url AS url, s.url AS inlink
FROM (SELECT DISTINCT from_id, to_id FROM fx_edges) e
JOIN fx_crawl t ON t.page_id = e.to_id
JOIN fx_crawl s ON s.page_id = e.from_id
WHERE t.url = (SELECT min(url) FROM fx_crawl WHERE page_id IN (SELECT to_id FROM fx_edges))""", ("fx_edges",)))
def q_inlinks_of_url(spark, sf):
    """The inlinks of one URL (the least that has any), looked up as a report would."""
    c, edges = fixture(spark, sf, "fx_crawl"), fixture(spark, sf, "fx_edges")
    linked = c.join(edges.select(F.col("to_id").alias("page_id")), "page_id", "left_semi").select(F.min("url").alias("url"))
    return inlinks_of(c, edges, url=linked, key="page_id", src="from_id", dst="to_id")
