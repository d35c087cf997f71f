"""Registered queries: URL columns (domain, resolve, normalise, robots address,
external test, exclusions, robots-page test, start-URL repair, URL lists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators.extract import exclusion_predicate
from sitegraph.plans import sqlparts as S
from sitegraph.plans.catalog import register
from sitegraph.plans.common import RAW_LINKS_CTE, raw_links_frame, sql_with_pages
from sitegraph.session import scratch_path
from sitegraph.sources.fixtures import table, with_fixtures
from sitegraph.sources.io import read_url_list

# Exclusion rules used by the registered exclusion queries (one per operator).
EXCLUSION_RULES = [
    ("Equal to (=)", "https://tiontion.example.net/en/7026?utm_source=feed"),
    ("Contain", "/fr/"),
    ("Start with", "https://blog."),
    ("End with", ".html"),
    ("Regex match", r"https?://m\."),
]
_EX_SQL = [
    "url = 'https://tiontion.example.net/en/7026?utm_source=feed'",
    "contains(url, '/fr/')",
    "starts_with(url, 'https://blog.')",
    "ends_with(url, '.html')",
    r"regexp_matches(url, '^(?:https?://m\.)')",
]
_EX_NAMES = ["ex_equal", "ex_contain", "ex_start", "ex_end", "ex_regex"]


@register("url_domain", sql_with_pages(
    f"SELECT page_id, href, {S.domain_sql('href')} AS domain FROM raw", (RAW_LINKS_CTE,)))
def q_url_domain(spark, sf):
    return raw_links_frame(spark, sf).select("page_id", "href", U.domain("href").alias("domain"))


@register("url_resolve", sql_with_pages(
    f"SELECT page_id, href, {S.resolve_sql('url', 'href')} AS resolved FROM raw", (RAW_LINKS_CTE,)))
def q_url_resolve(spark, sf):
    return raw_links_frame(spark, sf).select("page_id", "href", U.resolve("url", "href").alias("resolved"))


@register("url_normalise", sql_with_pages(
    f"SELECT page_id, href, {S.normalise_sql('r')} AS normalised FROM "
    f"(SELECT page_id, href, {S.resolve_sql('url', 'href')} AS r FROM raw)", (RAW_LINKS_CTE,)))
def q_url_normalise(spark, sf):
    return (raw_links_frame(spark, sf)
            .withColumn("_r", U.resolve("url", "href"))
            .select("page_id", "href", U.normalise("_r").alias("normalised")))


@register("robots_url", with_fixtures([], f"SELECT page_id, url, {S.robots_url_sql('url')} AS robots_url FROM pages"))
def q_robots_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", U.robots_url("url").alias("robots_url"))


@register("is_external", sql_with_pages(
    f"SELECT page_id, href, link, ({S.is_external_sql('link', 'root')}) AS is_external FROM "
    f"(SELECT page_id, href, {S.normalise_sql('r')} AS link, root FROM "
    f"(SELECT page_id, href, {S.resolve_sql('url', 'href')} AS r, {S.domain_sql('url')} AS root FROM raw)) "
    f"WHERE link IS NOT NULL", (RAW_LINKS_CTE,)))
def q_is_external(spark, sf):
    df = (raw_links_frame(spark, sf)
          .withColumn("_r", U.resolve("url", "href"))
          .withColumn("_root", U.domain("url"))
          .withColumn("link", U.normalise("_r"))
          .filter(F.col("link").isNotNull()))
    return df.select("page_id", "href", "link", U.is_external("link", F.col("_root")).alias("is_external"))


@register("exclusions", with_fixtures([], "SELECT page_id, url, " + ", ".join(
    f"{s} AS {n}" for s, n in zip(_EX_SQL, _EX_NAMES)) + ", (" + " OR ".join(_EX_SQL) + ") AS excluded FROM pages"))
def q_exclusions(spark, sf):
    pages = table(spark, sf, "pages")
    flags = [exclusion_predicate("url", [r]).alias(n) for r, n in zip(EXCLUSION_RULES, _EX_NAMES)]
    return pages.select("page_id", "url", *flags, exclusion_predicate("url", EXCLUSION_RULES).alias("excluded"))


@register("exclusions_anti", with_fixtures([], "SELECT page_id, url FROM pages WHERE NOT ("
                                           + " OR ".join(_EX_SQL) + ")"))
def q_exclusions_anti(spark, sf):
    return table(spark, sf, "pages").filter(~exclusion_predicate("url", EXCLUSION_RULES)).select("page_id", "url")


@register("is_robots_page", with_fixtures([], f"""
SELECT page_id, u, (NOT {S.is_external_sql('u', 'root')} AND {S.url_parts_sql('u')['path']} = '/robots.txt')
       AS is_robots_page
FROM (SELECT page_id, url AS u, {S.domain_sql('url')} AS root FROM pages
      UNION ALL SELECT page_id, {S.robots_url_sql('url')} AS u, {S.domain_sql('url')} AS root FROM pages
      UNION ALL SELECT page_id, 'https://elsewhere.example.org/robots.txt' AS u, {S.domain_sql('url')} AS root
      FROM pages)"""))
def q_is_robots_page(spark, sf):
    pages = table(spark, sf, "pages").withColumn("root", U.domain("url"))
    cands = (pages.select("page_id", F.col("url").alias("u"), "root")
             .unionByName(pages.select("page_id", U.robots_url("url").alias("u"), "root"))
             .unionByName(pages.select("page_id", F.lit("https://elsewhere.example.org/robots.txt").alias("u"),
                                       "root")))
    return cands.select("page_id", "u", U.is_robots_page("u", F.col("root")).alias("is_robots_page"))


def _typed_sql():
    strip = "regexp_replace(url, '^https?://', '')"
    return (f"SELECT page_id, url AS typed FROM pages UNION ALL "
            f"SELECT page_id, '  ' || {strip} || ' ' AS typed FROM pages UNION ALL "
            f"SELECT page_id, 'bad host.example.com/' || page_id AS typed FROM pages")


def _start_sql():
    t = "trim(typed)"
    u = f"(CASE WHEN {S.rx(t, U.HAS_SCHEME)} THEN {t} ELSE 'http://' || {t} END)"
    p = S.url_parts_sql("u")
    return with_fixtures([], f"""
SELECT page_id, typed, CASE WHEN {p['has_authority']} AND {p['authority']} <> '' AND NOT contains({p['authority']}, ' ')
       THEN {S.normalise_sql('u')} END AS start_url
FROM (SELECT page_id, typed, {u} AS u FROM ({_typed_sql()}))""")


@register("start_url", _start_sql())
def q_start_url(spark, sf):
    pages = table(spark, sf, "pages")
    strip = F.regexp_replace("url", r"^https?://", "")
    typed = (pages.select("page_id", F.col("url").alias("typed"))
             .unionByName(pages.select("page_id", F.concat(F.lit("  "), strip, F.lit(" ")).alias("typed")))
             .unionByName(pages.select("page_id", F.concat(F.lit("bad host.example.com/"),
                                                           F.col("page_id").cast("string")).alias("typed"))))
    return typed.select("page_id", "typed", U.start_url("typed").alias("start_url"))


def _list_lines(pages):
    strip = F.regexp_replace("url", r"^https?://", "")
    return (pages.select(F.col("url").alias("value"))
            .unionByName(pages.select(F.col("url").alias("value")))
            .unionByName(pages.select(F.concat(F.lit(" "), F.col("url")).alias("value")))
            .unionByName(pages.select(strip.alias("value")))
            .unionByName(pages.select(F.concat(F.lit("mailto:x@"), strip).alias("value"))))


@register("list_urls", with_fixtures([], """
SELECT DISTINCT value AS url FROM (
  SELECT url AS value FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT ' ' || url FROM pages
  UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages
  UNION ALL SELECT 'mailto:x@' || regexp_replace(url, '^https?://', '') FROM pages)
WHERE regexp_matches(regexp_replace(value, '^[\\x{00}-\\x{20}]+', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]')"""))
def q_list_urls(spark, sf):
    path = scratch_path(spark, "url-list")
    _list_lines(table(spark, sf, "pages")).write.mode("overwrite").text(path)
    return read_url_list(spark, path)
