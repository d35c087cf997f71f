"""Registered queries: discovery, crawl-state maintenance, redirects,
save/load and CSV export round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.operators import redirects as RD
from sitegraph.operators import state as ST
from sitegraph.operators.closure import spider_closure
from sitegraph.operators.views import crawl_status_view
from sitegraph.plans import sqlparts as S
from sitegraph.plans.catalog import register
from sitegraph.plans.common import CRAWL_CTE, crawl_frame, fetches_frame
from sitegraph.plans.robots_plans import robots_ctes
from sitegraph.plans.url_plans import q_list_urls
from sitegraph.session import scratch_path
from sitegraph.settings import CrawlSettings
from sitegraph.sources import io
from sitegraph.sources.fixtures import fixture, with_fixtures

DEFAULT = CrawlSettings()


# -- link table used by discovery: page links (edges) + links to redirecting URLs

def links_frame(spark, sf):
    crawl = fixture(spark, sf, "fx_crawl").select("page_id", "url")
    edges = (fixture(spark, sf, "fx_edges")
             .join(crawl.select(F.col("page_id").alias("from_id"), F.col("url").alias("url_from")), "from_id")
             .join(crawl.select(F.col("page_id").alias("to_id"), F.col("url").alias("url_to")), "to_id")
             .select("url_from", "url_to"))
    hops = (fixture(spark, sf, "fx_hops").join(crawl, "page_id")
            .select(F.col("url").alias("url_from"), F.col("hop_url").alias("url_to")))
    return edges.unionByName(hops)


LINKS_CTE = ("fx_links AS (SELECT s.url AS url_from, t.url AS url_to FROM fx_edges e "
             "JOIN fx_crawl s ON s.page_id = e.from_id JOIN fx_crawl t ON t.page_id = e.to_id "
             "UNION ALL SELECT p.url AS url_from, h.hop_url AS url_to FROM fx_hops h "
             "JOIN fx_crawl p ON p.page_id = h.page_id)")
FX = ["fx_crawl", "fx_edges", "fx_hops"]


def sql_links(body: str) -> str:
    body = body.strip()
    text = f"WITH {LINKS_CTE},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {LINKS_CTE}\n{body}"
    return with_fixtures(FX, text)


@register("new_urls", sql_links(
    "SELECT DISTINCT url_to AS url FROM fx_links WHERE url_to NOT IN (SELECT url FROM fx_crawl)"))
def q_new_urls(spark, sf):
    return ST.new_urls(links_frame(spark, sf), fixture(spark, sf, "fx_crawl"))


@register("uncrawled_of", sql_links(
    "SELECT DISTINCT url_to AS url FROM fx_links WHERE url_to NOT IN "
    "(SELECT url FROM fx_crawl WHERE status_code IS NOT NULL)"))
def q_uncrawled_of(spark, sf):
    return ST.uncrawled_urls(links_frame(spark, sf), fixture(spark, sf, "fx_crawl"))


@register("url_in_crawl", sql_links(
    "SELECT DISTINCT url_to AS url FROM fx_links WHERE url_to IN (SELECT url FROM fx_crawl)"))
def q_url_in_crawl(spark, sf):
    return ST.urls_in_crawl(links_frame(spark, sf), fixture(spark, sf, "fx_crawl"))


@register("insert_discovered", sql_links(
    "SELECT * FROM fx_crawl UNION ALL SELECT NULL, url, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM "
    "(SELECT DISTINCT url_to AS url FROM fx_links WHERE url_to NOT IN (SELECT url FROM fx_crawl))"))
def q_insert_discovered(spark, sf):
    crawl = fixture(spark, sf, "fx_crawl")
    return ST.insert_discovered(crawl, ST.new_urls(links_frame(spark, sf), crawl))


def upsert_batch(spark, sf):
    """A crawl batch from the redirect fixtures: the final page first, then
    each hop, then a late duplicate of every first hop (must lose).  ``part``
    is the arrival order for the streaming queries."""
    hops = fixture(spark, sf, "fx_hops")
    pages = hops.filter(F.col("hop") == 0).select(
        F.col("final_url").alias("url"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), (F.col("page_id") * 4).alias("seq"), F.lit(0).alias("part"))
    hop_rows = hops.select(F.col("hop_url").alias("url"), "status_code", F.lit("").alias("content_type"),
                           (F.col("page_id") * 4 + F.col("hop") + 1).alias("seq"), F.lit(1).alias("part"))
    late = hops.filter(F.col("hop") == 0).select(
        F.col("hop_url").alias("url"), F.lit(500).alias("status_code"), F.lit("").alias("content_type"),
        (F.col("page_id") * 4 + 9).alias("seq"), F.lit(2).alias("part"))
    return pages.unionByName(hop_rows).unionByName(late)


BATCH_CTE = ("batch AS (SELECT final_url AS url, 200 AS status_code, 'text/html' AS content_type, page_id * 4 AS seq "
             "FROM fx_hops WHERE hop = 0 UNION ALL SELECT hop_url, status_code, '', page_id * 4 + hop + 1 "
             "FROM fx_hops UNION ALL SELECT hop_url, 500, '', page_id * 4 + 9 FROM fx_hops WHERE hop = 0), "
             "b AS (SELECT url, arg_min(status_code, seq) AS status_code, arg_min(content_type, seq) AS content_type "
             "FROM batch GROUP BY url)")

UPSERT_SQL = with_fixtures(["fx_crawl", "fx_hops"], f"""
WITH {BATCH_CTE},
o AS (SELECT page_id, url, status_code, content_type FROM fx_crawl),
j AS (SELECT o.url AS ourl, o.page_id, o.status_code AS os, o.content_type AS oc, n.url AS nurl,
             n.status_code AS ns, n.content_type AS nc,
             (n.url IS NOT NULL AND (o.url IS NULL OR o.status_code IS NULL)) AS take_new
      FROM o FULL OUTER JOIN b n ON o.url = n.url)
SELECT coalesce(ourl, nurl) AS url, page_id,
       CASE WHEN take_new THEN ns ELSE os END AS status_code,
       CASE WHEN take_new THEN nc ELSE oc END AS content_type,
       CASE WHEN ourl IS NULL THEN 'new' WHEN nurl IS NOT NULL AND os IS NULL THEN 'updated' END AS change
FROM j""")


@register("upsert_crawl", UPSERT_SQL)
def q_upsert_crawl(spark, sf):
    before = fixture(spark, sf, "fx_crawl").select("page_id", "url", "status_code", "content_type")
    return ST.upsert(before, upsert_batch(spark, sf).drop("part"), "seq")


@register("inlinks_build", sql_links(
    "SELECT DISTINCT url_from, url_to FROM fx_links WHERE url_to IN (SELECT url FROM fx_crawl) "
    "AND url_from IN (SELECT url FROM fx_crawl)"))
def q_inlinks_build(spark, sf):
    return ST.build_inlinks(links_frame(spark, sf), fixture(spark, sf, "fx_crawl"))


@register("pending_urls", with_fixtures(["fx_crawl"], "SELECT url FROM fx_crawl WHERE status_code IS NULL"))
def q_pending_urls(spark, sf):
    return ST.pending(fixture(spark, sf, "fx_crawl"))


PROGRESS_SQL = ("SELECT count(*) AS total, count(status_code) AS crawled, count(*) - count(status_code) AS pending, "
                "CASE WHEN count(*) > 0 THEN (count(status_code) * 100) // count(*) ELSE 0 END AS percent "
                "FROM fx_crawl")


@register("crawl_progress", with_fixtures(["fx_crawl"], PROGRESS_SQL))
def q_crawl_progress(spark, sf):
    return ST.progress(fixture(spark, sf, "fx_crawl"))


def _saved_crawl(spark, sf, settings=DEFAULT):
    folder = scratch_path(spark, "saved-crawl")
    io.save_crawl(spark, folder, crawl_frame(spark, sf), settings)
    return io.load_crawl(spark, folder)


@register("resume_state", with_fixtures(["fx_crawl"], PROGRESS_SQL))
def q_resume_state(spark, sf):
    return ST.progress(_saved_crawl(spark, sf)["crawl"])


@register("resume_queue", with_fixtures(["fx_crawl"], "SELECT url FROM fx_crawl WHERE status_code IS NULL"))
def q_resume_queue(spark, sf):
    """The queue a resumed crawl starts with: saved, loaded, what is not crawled yet."""
    folder = scratch_path(spark, "resume")
    io.save_crawl(spark, folder, crawl_frame(spark, sf), DEFAULT)
    return io.resume_crawl(spark, folder, register=False)["pending"].select("url")


@register("crawl_roundtrip", with_fixtures(["fx_crawl"], f"WITH {CRAWL_CTE} SELECT * FROM crawl"))
def q_crawl_roundtrip(spark, sf):
    return _saved_crawl(spark, sf)["crawl"]


@register("csv_roundtrip", with_fixtures(["fx_crawl"], f"""
WITH {CRAWL_CTE} SELECT * FROM crawl WHERE status_code IS NOT NULL AND NOT contains(lower(crawl_status), 'ok')"""))
def q_csv_roundtrip(spark, sf):
    view = crawl_status_view(crawl_frame(spark, sf), "not ok")
    path = scratch_path(spark, "csv-export")
    io.export_csv(view, path)
    return io.read_csv_export(spark, path, schema=view.schema)


@register("failed_urls", with_fixtures(["fx_attempts"], """
WITH fo AS (SELECT url, ts AS fts, event_id AS fid FROM (SELECT url, ts, event_id,
              row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS rn FROM fx_attempts WHERE outcome = 'ok')
            WHERE rn = 1),
bf AS (SELECT a.* FROM fx_attempts a LEFT JOIN fo ON fo.url = a.url WHERE a.outcome <> 'ok'
       AND (fo.url IS NULL OR a.ts < fo.fts OR (a.ts = fo.fts AND a.event_id < fo.fid)))
SELECT url, 0 AS status_code, lower(arg_max(outcome, ts)) AS crawl_status, count(*) AS failures
FROM bf GROUP BY url HAVING count(*) > 5"""))
def q_failed_urls(spark, sf):
    return ST.failed_urls(fixture(spark, sf, "fx_attempts"), DEFAULT.max_retries)


@register("list_crawl", with_fixtures(["fx_crawl"], f"""
WITH c0 AS (SELECT page_id, url, status_code, content_type, canonical_tag, canonical_http_header, meta_robots,
                   x_robots_tag, 'allowed' AS robots_txt FROM fx_crawl
            WHERE status_code IS NOT NULL AND url IN (SELECT url FROM pages))
SELECT c.*, {S.crawl_status_sql('c')} AS crawl_status FROM c0 c"""))
def q_list_crawl(spark, sf):
    rows = ST.crawled(fixture(spark, sf, "fx_crawl")).drop("robots_txt")
    return ST.list_crawl(rows, q_list_urls(spark, sf)).drop("change")


@register("spider_closure", with_fixtures(["fx_crawl", "fx_edges"], """
WITH RECURSIVE r(id) AS (SELECT page_id FROM fx_crawl WHERE contains(url, '/de/')
                         UNION SELECT e.to_id FROM r JOIN fx_edges e ON e.from_id = r.id)
SELECT c.page_id, c.url FROM r JOIN fx_crawl c ON c.page_id = r.id"""))
def q_spider_closure(spark, sf):
    crawl = fixture(spark, sf, "fx_crawl").select("page_id", "url")
    start = crawl.filter(F.col("url").contains("/de/"))
    reach = spider_closure(fixture(spark, sf, "fx_edges"), start, key="page_id", src="from_id", dst="to_id")
    return reach.join(crawl, "page_id").select("page_id", "url")


# -- redirects ---------------------------------------------------------------

def _hop_sql(cut: bool, robots: bool) -> str:
    norm = S.normalise_sql("hop_url")
    ext = S.is_external_sql("hn", "root")
    body = f"""
WITH f AS (SELECT page_id, url FROM fx_crawl WHERE status_code IS NOT NULL AND page_id IN (SELECT page_id FROM fx_html)),
h AS (SELECT h.page_id, h.hop, {norm} AS hn, h.status_code FROM fx_hops h JOIN f ON f.page_id = h.page_id),
rt AS (SELECT page_id, {S.domain_sql('hn')} AS root FROM h WHERE hop = 0),
hx AS (SELECT h.*, rt.root, {ext} AS ext FROM h JOIN rt ON rt.page_id = h.page_id),
cut AS (SELECT page_id, min(hop) FILTER (WHERE ext) AS c FROM hx GROUP BY page_id),
hk AS (SELECT hx.* FROM hx JOIN cut ON cut.page_id = hx.page_id WHERE {'cut.c IS NULL OR hx.hop < cut.c' if cut else 'TRUE'}),
hr AS (SELECT hk.page_id, hk.hop, hk.hn AS url, hk.status_code, '' AS content_type, '' AS x_robots_tag,
              coalesce(nx.hn, f.url) AS redirect_url
       FROM hk JOIN f ON f.page_id = hk.page_id LEFT JOIN hx nx ON nx.page_id = hk.page_id AND nx.hop = hk.hop + 1),
{",".join(robots_ctes())},
ha AS (SELECT hr.*, CASE WHEN allowed THEN 'allowed' ELSE 'blocked' END AS robots_txt FROM
       {__import__('sitegraph.plans.robots_plans', fromlist=['allowed_sql']).allowed_sql('hr')} hr)
SELECT page_id, hop, url, status_code, content_type, x_robots_tag, redirect_url, robots_txt,
       {S.crawl_status_sql('ha', meta_robots=None, canonical_tag=None, canonical_http_header=None)} AS crawl_status
FROM ha ha {"WHERE robots_txt <> 'blocked'" if robots else ''}"""
    return with_fixtures(["fx_crawl", "fx_hops", "fx_html", "fx_robots"], body)


def _redirects(spark, sf, settings):
    return RD.redirect_rows(fetches_frame(spark, sf), settings, fixture(spark, sf, "fx_robots")).select(
        "page_id", "hop", "url", "status_code", "content_type", "x_robots_tag", "redirect_url", "robots_txt",
        "crawl_status")


@register("redirect_rows", _hop_sql(cut=False, robots=False))
def q_redirect_rows(spark, sf):
    return _redirects(spark, sf, DEFAULT.with_items("external_links"))


@register("redirect_cut", _hop_sql(cut=True, robots=False))
def q_redirect_cut(spark, sf):
    return _redirects(spark, sf, DEFAULT)


@register("redirect_blocked", _hop_sql(cut=True, robots=True))
def q_redirect_blocked(spark, sf):
    return _redirects(spark, sf, DEFAULT.with_items(drop=("follow_blocked_redirects",)))


@register("initial_url", with_fixtures(["fx_crawl", "fx_hops", "fx_html"], """
SELECT c.page_id, c.url, trim(coalesce(h.hop_url, c.url)) AS initial_url, h.hop_url IS NOT NULL AS redirected
FROM fx_crawl c JOIN fx_html x ON x.page_id = c.page_id LEFT JOIN fx_hops h ON h.page_id = c.page_id AND h.hop = 0
WHERE c.status_code IS NOT NULL"""))
def q_initial_url(spark, sf):
    f = fetches_frame(spark, sf)
    return f.select("page_id", "url", RD.initial_url().alias("initial_url"),
                    (F.size("history") > 0).alias("redirected"))


# -- scale versions over fx_crawl_big / fx_edges_big ---------------------------

from sitegraph.operators.views import broken_inlinks  # noqa: E402


@register("broken_inlinks_big", with_fixtures(["fx_crawl_big", "fx_edges_big"], """
SELECT s.url AS url_from, t.url AS url_to, t.status_code
FROM (SELECT DISTINCT from_id, to_id FROM fx_edges_big) e
JOIN fx_crawl_big t ON t.id = e.to_id JOIN fx_crawl_big s ON s.id = e.from_id
WHERE t.status_code IS NOT NULL AND t.status_code <> 200"""))
def q_broken_inlinks_big(spark, sf):
    return broken_inlinks(fixture(spark, sf, "fx_crawl_big"), fixture(spark, sf, "fx_edges_big"),
                          key="id", src="from_id", dst="to_id")


def big_batch(spark, sf):
    """Every known URL fetched again (first seen wins) plus one new URL per page."""
    c = fixture(spark, sf, "fx_crawl_big")
    again = c.select("url", F.lit(200).alias("status_code"), F.col("id").alias("seq"))
    fresh = c.select(F.concat("url", F.lit("/next")).alias("url"), F.lit(200).alias("status_code"),
                     (F.col("id") + F.lit(10**12)).alias("seq"))
    return again.unionByName(fresh)


@register("upsert_crawl_big", with_fixtures(["fx_crawl_big"], """
WITH b AS (SELECT url, 200 AS status_code FROM fx_crawl_big UNION ALL SELECT url || '/next', 200 FROM fx_crawl_big),
j AS (SELECT o.url AS ourl, o.id, o.status_code AS os, n.url AS nurl, n.status_code AS ns,
             (n.url IS NOT NULL AND (o.url IS NULL OR o.status_code IS NULL)) AS take_new
      FROM fx_crawl_big o FULL OUTER JOIN b n ON o.url = n.url)
SELECT coalesce(ourl, nurl) AS url, id, CASE WHEN take_new THEN ns ELSE os END AS status_code,
       CASE WHEN ourl IS NULL THEN 'new' WHEN nurl IS NOT NULL AND os IS NULL THEN 'updated' END AS change
FROM j"""))
def q_upsert_crawl_big(spark, sf):
    return ST.upsert(fixture(spark, sf, "fx_crawl_big"), big_batch(spark, sf), "seq")


@register("inlinks_big", with_fixtures(["fx_crawl_big", "fx_edges_big"], """
SELECT t.url AS url, count(*) AS inlinks
FROM (SELECT DISTINCT from_id, to_id FROM fx_edges_big) e JOIN fx_crawl_big t ON t.id = e.to_id
GROUP BY t.url"""))
def q_inlinks_big(spark, sf):
    """Unique inlinks per URL (the inlinks report at scale)."""
    crawl = fixture(spark, sf, "fx_crawl_big")
    e = fixture(spark, sf, "fx_edges_big").select("from_id", "to_id").distinct()
    return (e.groupBy("to_id").agg(F.count(F.lit(1)).alias("inlinks"))
            .join(crawl.select(F.col("id").alias("to_id"), "url"), "to_id").select("url", "inlinks"))


# -- C9 over extracted links: pages whose bodies link along fx_edges --------------

def site_fetches(spark, sf):
    """Every page fetched, its body linking to its targets in fx_edges, all on the host
    of the first page; one page in six links to a private area as well."""
    pages = fixture(spark, sf, "fx_crawl").select("page_id")
    edges = fixture(spark, sf, "fx_edges").groupBy(F.col("from_id").alias("page_id")).agg(
        F.array_sort(F.collect_set("to_id")).alias("to"))
    links = F.array_join(F.transform(F.coalesce("to", F.array().cast("array<bigint>")), lambda t: F.concat(
        F.lit('<p><a title="a > b" href="../p/'), t.cast("string"), F.lit('#x">n</a></p>'))), "")
    private = F.when(F.col("page_id") % 6 == 0, F.concat(
        F.lit('<a href="/private/'), F.col("page_id").cast("string"), F.lit('">x</a><a href="http://other.example.org/">o</a>'))) \
        .otherwise(F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    return pages.join(edges, "page_id", "left").select(
        F.concat(F.lit("http://site.example.com/p/"), F.col("page_id").cast("string")).alias("url"),
        F.lit(200).alias("status_code"), F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        F.concat(F.lit("<html><body><!-- <a href='/no'> -->"), links, private, F.lit("</body></html>")).alias("html"),
        F.array().cast("array<struct<url:string,status_code:int,headers:map<string,string>>>").alias("history"))


@register("spider_crawl", with_fixtures(["fx_crawl", "fx_edges"], """
WITH RECURSIVE p AS (SELECT page_id FROM fx_crawl),
l AS (SELECT DISTINCT 'http://site.example.com/p/' || from_id AS a, 'http://site.example.com/p/' || to_id AS b FROM fx_edges
      WHERE from_id IN (SELECT page_id FROM p)),
r(url) AS (SELECT 'http://site.example.com/p/' || (SELECT min(page_id) FROM p WHERE page_id % 3 = 0)
           UNION SELECT l.b FROM r JOIN l ON l.a = r.url)
SELECT url, url IN (SELECT 'http://site.example.com/p/' || page_id FROM p) AS fetched FROM r"""))
def q_spider_crawl(spark, sf):
    from sitegraph.operators.spider import spider_crawl

    first = fixture(spark, sf, "fx_crawl").where("page_id % 3 = 0").agg(F.min("page_id").alias("page_id"))
    start = first.select(F.concat(F.lit("http://site.example.com/p/"), F.col("page_id").cast("string")).alias("url"))
    robots = spark.createDataFrame([("site.example.com", "User-agent: *\nDisallow: /private/*$", 200)],
                                   "host string, robots_text string, status_code int")
    return spider_crawl(site_fetches(spark, sf), start, DEFAULT, robots).select("url", "fetched")
