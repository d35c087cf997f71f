"""Frames shared by several registered queries, in Spark and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegraph.functions.status import crawl_status
from sitegraph.plans.sqlparts import crawl_status_sql
from sitegraph.sources.fixtures import fixture, with_fixtures


def crawl_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture crawl table with its computed ``crawl_status`` column."""
    return fixture(spark, sf_dir, "fx_crawl").withColumn("crawl_status", crawl_status())


CRAWL_CTE = f"crawl AS (SELECT c.*, {crawl_status_sql('c')} AS crawl_status FROM fx_crawl c)"


def sql_with_crawl(body: str, extra_fixtures: tuple = ()) -> str:
    """Oracle text: fixtures, then the ``crawl`` CTE, then ``body``."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = f"WITH {CRAWL_CTE},\n{body[5:]}"
    else:
        body = f"WITH {CRAWL_CTE}\n{body}"
    return with_fixtures(["fx_crawl", *extra_fixtures], body)


# -- pages: cleaned markup, raw link values, fetches --------------------------

from pyspark.sql import functions as F  # noqa: E402

from sitegraph.functions import html as H  # noqa: E402
from sitegraph.operators.extract import with_markup  # noqa: E402
from sitegraph.plans import sqlparts as S  # noqa: E402


def html_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_html with ``_clean`` and ``_head`` columns."""
    return with_markup(fixture(spark, sf_dir, "fx_html"))


def raw_link_values(page_tags="_tags", head_tags="_htags"):
    """Every raw href/src in a page: anchors, links, images, scripts, base."""
    return F.concat(H.anchor_hrefs(page_tags), H.attr_values(H.of_kind(page_tags, "link"), "href"),
                    H.image_srcs(page_tags), H.script_srcs(page_tags), H.base_hrefs(head_tags))


def raw_links_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, href) for every raw link value of fx_html."""
    return html_frame(spark, sf_dir).select("page_id", "url", F.explode(raw_link_values()).alias("href"))


HTML_CTE = (f"pg AS (SELECT page_id, url, html, c, {S.head_sql('c')} AS h FROM "
            f"(SELECT page_id, url, html, {S.clean_html_sql('html')} AS c FROM fx_html))")

RAW_LINKS_CTE = (
    "raw AS (SELECT page_id, url, unnest(list_concat("
    f"{S.attr_values_sql(S.tags_sql('c', 'a'), 'href')}, "
    f"{S.attr_values_sql(S.tags_sql('c', 'link'), 'href')}, "
    f"{S.attr_values_sql(S.tags_sql('c', 'img'), 'src')}, "
    f"{S.attr_values_sql(S.tags_sql('c', 'script'), 'src')}, "
    f"{S.attr_values_sql(S.tags_sql('h', 'base'), 'href')})) AS href FROM pg)")


def sql_with_pages(body: str, ctes: tuple = (), fixtures: tuple = ("fx_html",)) -> str:
    """Oracle text over fx_html: the ``pg`` CTE, extra CTEs, then ``body``."""
    all_ctes = ",\n".join((HTML_CTE, *ctes))
    body = body.strip()
    if body.upper().startswith("WITH "):
        text = f"WITH {all_ctes},\n{body[5:]}"
    else:
        text = f"WITH {all_ctes}\n{body}"
    return with_fixtures(list(fixtures), text)


def fetches_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched responses: one row per crawled page with headers, body and
    the redirect history (hops in order)."""
    crawl = fixture(spark, sf_dir, "fx_crawl").filter(F.col("status_code").isNotNull())
    html = fixture(spark, sf_dir, "fx_html").select("page_id", "html")
    hops = fixture(spark, sf_dir, "fx_hops")
    empty = F.create_map().cast("map<string,string>")
    ordered = F.sort_array(F.collect_list(F.struct("hop", F.col("hop_url").alias("url"), "status_code")))
    history = hops.groupBy("page_id").agg(F.transform(ordered, lambda h: F.struct(
        h["url"].alias("url"), h["status_code"].alias("status_code"), empty.alias("headers"))).alias("history"))
    link = F.when(F.col("canonical_http_header") != "",
                  F.concat(F.lit("<"), F.col("canonical_http_header"), F.lit('>; rel="canonical"'))
                  ).otherwise(F.lit(""))
    headers = F.create_map(F.lit("Content-Type"), F.col("content_type"),
                           F.lit("X-Robots-Tag"), F.col("x_robots_tag"), F.lit("Link"), link)
    return (crawl.join(html, "page_id").join(history, "page_id", "left")
            .select("page_id", "url", "status_code", headers.alias("headers"), "html",
                    F.coalesce("history", F.array().cast(history.schema["history"].dataType)).alias("history")))


FETCH_CTE = ("f AS (SELECT c.page_id, c.url, c.status_code, c.content_type, c.x_robots_tag, "
             "CASE WHEN c.canonical_http_header <> '' THEN '<' || c.canonical_http_header || "
             "'>; rel=\"canonical\"' ELSE '' END AS link_header, x.html "
             "FROM fx_crawl c JOIN fx_html x ON x.page_id = c.page_id WHERE c.status_code IS NOT NULL)")
