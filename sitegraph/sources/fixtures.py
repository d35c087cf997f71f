"""Derived input frames (``fx_*``) built from the driver tables.

The driver tables hold raw pages, orders, line items and events; a crawl needs
statuses, headers, robots files, redirect hops and link graphs.  Each frame is
one SQL text that runs unchanged in Spark SQL (with the base tables bound as
DataFrame parameters) and in DuckDB (where the base tables are views), so the
same text is the first CTE of the oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("pages", "orders", "lineitem", "events")

FX_SQL = {
    "fx_crawl": """
SELECT page_id, url,
 CASE WHEN page_id % 17 = 16 THEN CAST(NULL AS INT) WHEN page_id % 10 = 6 THEN 301 WHEN page_id % 10 = 7 THEN 302 WHEN page_id % 10 = 8 THEN 404 WHEN page_id % 10 = 9 THEN 503 WHEN page_id % 29 = 5 THEN 0 ELSE 200 END AS status_code,
 CASE page_id % 12 WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/css' WHEN 3 THEN 'font/woff2' WHEN 4 THEN 'application/json' WHEN 5 THEN 'application/xml' WHEN 6 THEN 'application/javascript' WHEN 7 THEN 'image/svg+xml' ELSE 'text/html; charset=utf-8' END AS content_type,
 CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '[?#].*$', '') WHEN 1 THEN url ELSE '' END AS canonical_tag,
 CASE page_id % 19 WHEN 3 THEN 'https://canon.example.com/' || page_id ELSE '' END AS canonical_http_header,
 CASE page_id % 11 WHEN 4 THEN 'noindex, follow' WHEN 5 THEN 'index' ELSE '' END AS meta_robots,
 CASE page_id % 13 WHEN 2 THEN 'noindex, nofollow' ELSE '' END AS x_robots_tag,
 CASE WHEN url LIKE '%/fr/%' THEN 'blocked' ELSE 'allowed' END AS robots_txt
 FROM {pages}""",
    "fx_edges": """
SELECT p.page_id AS from_id, p.page_id - p.page_id % 25 + ((p.page_id % 25) * 7 + k.k * 3 + 1) % 25 AS to_id
 FROM {pages} p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 2) k WHERE p.page_id % 3 <> 2""",
    "fx_crawl_big": """
SELECT o_orderkey AS id, 'https://s' || (o_custkey % 50) || '.example.com/p/' || o_orderkey AS url,
 CASE WHEN o_orderkey % 17 = 16 THEN CAST(NULL AS INT) WHEN o_orderkey % 10 = 6 THEN 301 WHEN o_orderkey % 10 = 8 THEN 404 WHEN o_orderkey % 10 = 9 THEN 503 ELSE 200 END AS status_code FROM {orders}""",
    "fx_edges_big": """
SELECT l_orderkey AS from_id, (l_partkey * 31 + l_suppkey * 7) % (SELECT count(*) FROM {orders}) AS to_id FROM {lineitem}""",
    "fx_robots": """
SELECT DISTINCT host, 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /fr/1' || chr(10) || 'User-agent: Googlebot' || chr(10) || 'User-agent: Bingbot   # shared' || chr(10) || CASE length(host) % 3 WHEN 0 THEN 'Disallow: /*.html$' WHEN 1 THEN 'Disallow: /' || chr(10) || 'Allow: /en/' ELSE 'Disallow:' END AS robots_text,
 CASE length(host) % 4 WHEN 0 THEN 404 ELSE 200 END AS status_code
 FROM (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host FROM {pages}) h""",
    "fx_hops": """
SELECT p.page_id, k.k AS hop, 'https://hop' || CASE WHEN p.page_id % 4 = 3 AND k.k = 1 THEN '.external.example.org/' ELSE '.example.com/' END || p.page_id || '/' || k.k AS hop_url, CASE WHEN k.k = 0 THEN 301 ELSE 302 END AS status_code, p.url AS final_url
 FROM {pages} p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE p.page_id % 10 IN (6, 7) AND k.k <= p.page_id % 3""",
    "fx_attempts": """
SELECT event_id, ts, 'https://h' || user_id || '.example.com/' || (event_id % 3) AS url, CASE WHEN event_type IN ('error','signup','view','click') THEN 'connection refused' ELSE 'ok' END AS outcome FROM {events}""",
    "fx_html": """
SELECT page_id, url, replace(replace(html, '<meta charset="utf-8">', '<meta charset="utf-8">' ||
 CASE WHEN page_id % 2 = 0 THEN '<meta name="description" content="  Desc  ' || page_id || ' &amp; more ">' ELSE '' END ||
 CASE WHEN page_id % 11 = 4 THEN '<meta name="robots" content="noindex, follow">' ELSE '' END ||
 CASE WHEN page_id % 11 = 5 THEN '<meta name="googlebot" content="noindex"><meta name="robots" content="index">' ELSE '' END ||
 CASE WHEN page_id % 7 < 2 THEN '<link rel="canonical" href="' || CASE WHEN page_id % 7 = 0 THEN '/canon/' || page_id ELSE url END || '">' ELSE '' END ||
 CASE WHEN page_id % 5 = 0 THEN '<link rel="alternate" hreflang="de" href="/de/' || page_id || '"><link rel="next" href="?page=2"><link rel="prev" href="?page=0">' ELSE '' END ||
 CASE WHEN page_id % 9 = 0 THEN '<base href="/base/' || page_id || '/">' ELSE '' END ||
 '<link rel="stylesheet" href="/s.css"><script src="/app.js"></script>'),
 '</article>', '<h2>Two ' || page_id || ' <i>x</i> tail</h2><h2> </h2><img src="img/' || page_id || '.png"><a rel="nofollow" href="/nf/' || page_id || '">n</a><a href=''../up''>u</a><a href="mailto:a@example.com">m</a><a href="//cdn.example.com/x">c</a><a href="https://other.example.org/o#f">o</a></article>') AS html FROM {pages}""",
    # every page fetched twice, its markup without the end tags that HTML leaves out
    "fx_open": """
SELECT page_id, url, visit, '<html><body><ul><li class=a>one ' || page_id || '.' || visit || '<li>two<ul><li class=a>in</ul><li class=a>three</ul><p>p1 <b>x</b><p>p2<div>d</div><table><tr><td>c1<td>' || page_id || '<tr><td>c3</table><select><option>o1<option>' || visit || '</select><dl><dt>t1<dd>d1<dt>t2</dl><b>y</body></html>' AS html
 FROM (SELECT page_id, url, 0 AS visit FROM {pages} UNION ALL SELECT page_id, url, 1 AS visit FROM {pages}) f""",
}

# Spark-side texts where the shared text multiplies rows with a CROSS JOIN
# against a constant table: the same rows come from a generator (explode), so
# no join (and no nested-loop plan) is needed.
SPARK_SQL = {
    "fx_edges": """
SELECT p.page_id AS from_id, p.page_id - p.page_id % 25 + ((p.page_id % 25) * 7 + k * 3 + 1) % 25 AS to_id
 FROM {pages} p LATERAL VIEW explode(array(0, 1, 2, 2)) kk AS k WHERE p.page_id % 3 <> 2""",
    "fx_hops": """
SELECT p.page_id, k AS hop, 'https://hop' || CASE WHEN p.page_id % 4 = 3 AND k = 1 THEN '.external.example.org/' ELSE '.example.com/' END || p.page_id || '/' || k AS hop_url, CASE WHEN k = 0 THEN 301 ELSE 302 END AS status_code, p.url AS final_url
 FROM {pages} p LATERAL VIEW explode(array(0, 1, 2)) kk AS k WHERE p.page_id % 10 IN (6, 7) AND k <= p.page_id % 3""",
}

_USES = {
    "fx_crawl": ("pages",),
    "fx_edges": ("pages",),
    "fx_crawl_big": ("orders",),
    "fx_edges_big": ("orders", "lineitem"),
    "fx_robots": ("pages",),
    "fx_hops": ("pages",),
    "fx_attempts": ("events",),
    "fx_html": ("pages",),
    "fx_open": ("pages",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read lazily (pruning and pushdown reach the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame as a lazy Spark plan over the driver tables."""
    binds = {t: table(spark, sf_dir, t) for t in _USES[name]}
    return spark.sql(SPARK_SQL.get(name, FX_SQL[name]), **binds)


def fixture_sql(name: str) -> str:
    """The same frame as plain SQL over the pre-registered DuckDB views."""
    return FX_SQL[name].format(**{t: t for t in BASE_TABLES}).strip()


def with_fixtures(names: list[str], body: str) -> str:
    """``WITH fx_a AS (...), fx_b AS (...) <body>`` for the oracle."""
    body = body.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({fixture_sql(n)})" for n in names)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
