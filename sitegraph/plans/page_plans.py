"""Registered queries: link kinds, on-page items, directives, full page rows,
link extraction, header projection, body gate and settings projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import urls as U
from sitegraph.functions.text import clean_list
from sitegraph.operators import extract as X
from sitegraph.operators.robots import with_robots_status
from sitegraph.plans import oracle_patterns as OP
from sitegraph.plans import sqlparts as S
from sitegraph.plans.catalog import register
from sitegraph.plans.common import FETCH_CTE, fetches_frame, html_frame, sql_with_pages
from sitegraph.plans.robots_plans import AGENT, allowed_sql, robots_ctes
from sitegraph.settings import CrawlSettings
from sitegraph.sources.fixtures import fixture, with_fixtures

DEFAULT = CrawlSettings()
SEP = DEFAULT.extraction_separator

# query name -> link kind (raw values per page, document order, duplicates kept)
LINK_KIND_QUERIES = {
    "links_all": "href_all",
    "links_follow": "href_follow",
    "links_canonical": "canonical",
    "links_hreflang": "hreflang",
    "links_pagination": "pagination",
    "links_images": "images",
    "links_stylesheets": "stylesheets",
    "links_javascript": "javascript",
}


def _kind_builder(kind):
    def build(spark, sf):
        return html_frame(spark, sf).select("page_id", F.explode(X.link_kind(kind)).alias("href"))
    return build


for _q, _k in LINK_KIND_QUERIES.items():
    register(_q, sql_with_pages(f"SELECT page_id, unnest({S.link_kind_sql(_k, 'c', 'h')}) AS href FROM pg"))(
        _kind_builder(_k))


BASE_CTE = (f"pb AS (SELECT *, coalesce({S.normalise_sql('r')}, url) AS base FROM "
            f"(SELECT *, CASE WHEN b1 IS NOT NULL THEN {S.resolve_sql('url', 'b1')} END AS r FROM "
            f"(SELECT *, ({S.link_kind_sql('base', 'c', 'h')})[1] AS b1 FROM pg)))")


@register("base_url", sql_with_pages("SELECT page_id, url, base AS base_url FROM pb", (BASE_CTE,)))
def q_base_url(spark, sf):
    return html_frame(spark, sf).select("page_id", "url", X.base_url("url").alias("base_url"))


_TEXT_ITEMS = {
    "onpage_h1": (lambda: H.joined(H.direct_texts("_clean", "h1"), SEP),
                  S.joined_sql(S.direct_texts_sql("c", "h1"), SEP), "h1"),
    "onpage_h2": (lambda: H.joined(H.direct_texts("_clean", "h2"), SEP),
                  S.joined_sql(S.direct_texts_sql("c", "h2"), SEP), "h2"),
    "onpage_title": (lambda: H.joined(H.direct_texts("_head", "title"), SEP),
                     S.joined_sql(S.direct_texts_sql("h", "title"), SEP), "page_title"),
    "onpage_description": (lambda: H.meta_description("_htags", SEP),
                           S.joined_sql(S.attr_values_sql(
                               S.tags_sql("h", "meta"), "content",
                               lambda t: f"({S.has_attr_sql(t, 'name')} AND {S.attr_sql(t, 'name')} = 'description')"),
                               SEP), "meta_description"),
    "meta_robots": (lambda: H.meta_robots("_tags", AGENT), S.meta_robots_sql("c", AGENT), "meta_robots"),
}


def _text_builder(expr, col):
    def build(spark, sf):
        return html_frame(spark, sf).select("page_id", expr().alias(col))
    return build


for _q, (_e, _sql, _col) in _TEXT_ITEMS.items():
    register(_q, sql_with_pages(f"SELECT page_id, {_sql} AS {_col} FROM pg"))(_text_builder(_e, _col))


CANON_SQL = (f"coalesce(CASE WHEN cr IS NOT NULL THEN {S.normalise_sql('cr')} END, '')")


@register("canonical_tag", sql_with_pages(
    f"SELECT page_id, {CANON_SQL} AS canonical_tag FROM (SELECT *, CASE WHEN c1 IS NOT NULL THEN "
    f"{S.resolve_sql('base', 'c1')} END AS cr FROM (SELECT *, ({S.link_kind_sql('canonical', 'c', 'h')})[1] AS c1 "
    f"FROM pb))", (BASE_CTE,)))
def q_canonical_tag(spark, sf):
    df = html_frame(spark, sf).withColumn("_base", X.base_url("url"))
    first = F.get(H.canonical_hrefs("_htags"), 0)
    return df.select("page_id", F.coalesce(F.when(first.isNotNull(), U.normalise(first, base=F.col("_base"))),
                                           F.lit("")).alias("canonical_tag"))


@register("canonical_header", sql_with_pages(
    f"SELECT page_id, url, {S.canonical_header_sql('link_header')} AS canonical_http_header FROM f",
    (FETCH_CTE,), fixtures=("fx_crawl", "fx_html")))
def q_canonical_header(spark, sf):
    f = X.header_info(fetches_frame(spark, sf))
    return f.select("page_id", "url", "canonical_http_header")


@register("clean_list", sql_with_pages(
    f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_raw, CAST(len({S.clean_list_sql('t')}) AS BIGINT) AS n_clean, "
    f"array_to_string({S.clean_list_sql('t')}, '|') AS cleaned FROM "
    f"(SELECT page_id, {S.direct_texts_sql('c', 'h2')} AS t FROM pg)"))
def q_clean_list(spark, sf):
    df = html_frame(spark, sf).withColumn("_t", H.direct_texts("_clean", "h2"))
    return df.select("page_id", F.size("_t").cast("bigint").alias("n_raw"),
                     F.size(clean_list(F.col("_t"))).cast("bigint").alias("n_clean"),
                     F.array_join(clean_list(F.col("_t")), "|").alias("cleaned"))


# -- S3 header projection, S2 body gate ---------------------------------------

@register("header_info", sql_with_pages(
    "SELECT page_id, url, status_code, content_type, x_robots_tag, "
    f"{S.canonical_header_sql('link_header')} AS canonical_http_header FROM f",
    (FETCH_CTE,), fixtures=("fx_crawl", "fx_html")))
def q_header_info(spark, sf):
    f = X.header_info(fetches_frame(spark, sf))
    return f.select("page_id", "url", "status_code", "content_type", "x_robots_tag", "canonical_http_header")


@register("body_gate", sql_with_pages(
    "SELECT page_id, url, content_type, (contains(content_type, 'text') AND html IS NOT NULL) AS has_body FROM f",
    (FETCH_CTE,), fixtures=("fx_crawl", "fx_html")))
def q_body_gate(spark, sf):
    f = X.body_gate(X.header_info(fetches_frame(spark, sf)), DEFAULT)
    return f.select("page_id", "url", "content_type", F.col("html").isNotNull().alias("has_body"))


# -- X10 link extraction, U12 valid links -------------------------------------

def _link_sql(settings: CrawlSettings) -> str:
    kinds = ", ".join(S.link_kind_sql(k, "c", "h") for k in X.enabled_kinds(settings))
    return (f"pl AS (SELECT page_id, url, base, {S.domain_sql('url')} AS root, "
            f"unnest(list_concat({kinds})) AS href FROM pb), "
            f"pr AS (SELECT *, {S.resolve_sql('base', 'href')} AS r FROM pl), "
            f"pn AS (SELECT page_id, url, root, href, {S.normalise_sql('r')} AS link FROM pr)")


VALID_SQL = f"(link IS NOT NULL AND {S.is_crawlable_sql('link')} AND NOT {S.is_external_sql('link', 'root')})"


ORACLES_EXTRACT_LINKS = sql_with_pages(
    f"SELECT DISTINCT url_from, url_to FROM {allowed_sql('cand', url='url_to')} WHERE allowed",
    (BASE_CTE, _link_sql(DEFAULT),
     f"cand AS (SELECT DISTINCT url AS url_from, link AS url_to FROM pn WHERE {VALID_SQL})", *robots_ctes()),
    fixtures=("fx_html", "fx_robots"))


# links of crawled pages whose body passes the gate (text content types)
ORACLES_CRAWL_LINKS = ORACLES_EXTRACT_LINKS.replace(
    "FROM fx_html))",
    "FROM fx_html WHERE page_id IN (SELECT page_id FROM fx_crawl WHERE status_code IS NOT NULL "
    "AND contains(content_type, 'text'))))", 1)
ORACLES_CRAWL_LINKS = with_fixtures(["fx_crawl"], ORACLES_CRAWL_LINKS)


@register("extract_links", sql_with_pages(
    f"SELECT DISTINCT url_from, url_to FROM {allowed_sql('cand', url='url_to')} WHERE allowed",
    (BASE_CTE, _link_sql(DEFAULT),
     f"cand AS (SELECT DISTINCT url AS url_from, link AS url_to FROM pn WHERE {VALID_SQL})", *robots_ctes()),
    fixtures=("fx_html", "fx_robots")))
def q_extract_links(spark, sf):
    pages = fixture(spark, sf, "fx_html").select("url", "html")
    return X.extract_links(pages, DEFAULT, fixture(spark, sf, "fx_robots"))


@register("valid_links", sql_with_pages(
    f"SELECT page_id, href, link, crawlable, internal, robots_txt, (crawlable AND internal AND robots_txt = 'allowed') "
    f"AS valid FROM (SELECT page_id, href, link, crawlable, internal, CASE WHEN allowed THEN 'allowed' ELSE 'blocked' "
    f"END AS robots_txt FROM {allowed_sql('pc', url='link')})",
    (BASE_CTE, _link_sql(DEFAULT),
     f"pc AS (SELECT page_id, href, link, {S.is_crawlable_sql('link')} AS crawlable, "
     f"NOT {S.is_external_sql('link', 'root')} AS internal FROM pn WHERE link IS NOT NULL)", *robots_ctes()),
    fixtures=("fx_html", "fx_robots")))
def q_valid_links(spark, sf):
    df = (html_frame(spark, sf).withColumn("_base", X.base_url("url")).withColumn("_root", U.domain("url"))
          .select("page_id", "_base", "_root",
                  F.explode(F.concat(*[X.link_kind(k) for k in X.enabled_kinds(DEFAULT)])).alias("href"))
          .withColumn("_r", U.resolve(F.col("_base"), F.col("href")))
          .withColumn("link", U.normalise("_r"))
          .filter(F.col("link").isNotNull())
          .select("page_id", "href", "link", U.is_crawlable("link").alias("crawlable"),
                  (~U.is_external("link", F.col("_root"))).alias("internal")))
    df = with_robots_status(df, "link", fixture(spark, sf, "fx_robots"), AGENT)
    return df.withColumn("valid", F.col("crawlable") & F.col("internal") & (F.col("robots_txt") == "allowed"))


# -- X22 full page rows, S4 settings projection, V21 on-page length, S1 scan ---

def _gated_fetch_ctes() -> tuple:
    """f (fetches) -> g (body gated, cleaned, head, base) in SQL."""
    return (
        FETCH_CTE,
        "g0 AS (SELECT *, CASE WHEN contains(content_type, 'text') THEN html END AS body FROM f)",
        f"g1 AS (SELECT *, {S.clean_html_sql('body')} AS c FROM g0)",
        f"g2 AS (SELECT *, {S.head_sql('c')} AS h FROM g1)",
        f"g3 AS (SELECT *, ({S.link_kind_sql('base', 'c', 'h')})[1] AS b1 FROM g2)",
        f"g4 AS (SELECT *, CASE WHEN b1 IS NOT NULL THEN {S.resolve_sql('url', 'b1')} END AS br FROM g3)",
        f"g AS (SELECT *, coalesce({S.normalise_sql('br')}, url) AS base, "
        f"({S.link_kind_sql('canonical', 'c', 'h')})[1] AS c1, body IS NOT NULL AND length(body) > 0 AS has_body "
        f"FROM g4)",
    )


# (type, selector) -> SQL over the cleaned markup ``c`` / head ``h``; filled
# below for the selectors the registered queries use
EXTRACTION_SQL: dict = {}


def _items_sql(settings: CrawlSettings) -> str:
    sep = settings.extraction_separator

    def item(e):
        return f"CASE WHEN has_body THEN {e} ELSE '' END"

    from sitegraph.settings import extraction_column_name

    base_cols = [c for c in settings.output_columns()][: len(settings.output_columns()) - len(settings.extractions)]
    custom = "".join(
        f"{item(EXTRACTION_SQL[(kind, value)])} AS {extraction_column_name(name, base_cols)}, "
        for name, kind, value in settings.extractions)

    canon = f"coalesce(CASE WHEN c1 IS NOT NULL THEN {S.normalise_sql('cr')} END, '')"
    return (
        f"it0 AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN {S.resolve_sql('base', 'c1')} END AS cr FROM g), "
        f"it AS (SELECT page_id, url, status_code, content_type, x_robots_tag, {custom}"
        f"{S.canonical_header_sql('link_header')} AS canonical_http_header, "
        f"{item(S.joined_sql(S.direct_texts_sql('c', 'h1'), sep))} AS h1, "
        f"{item(S.joined_sql(S.direct_texts_sql('c', 'h2'), sep))} AS h2, "
        f"{item(S.joined_sql(S.direct_texts_sql('h', 'title'), sep))} AS page_title, "
        f"{item(_TEXT_ITEMS['onpage_description'][1])} AS meta_description, "
        f"{item(canon)} AS canonical_tag, "
        f"{item(S.meta_robots_sql('c', settings.agent))} AS meta_robots FROM it0)")


def _page_rows_sql(settings: CrawlSettings) -> str:
    cols = settings.output_columns()
    sel = ", ".join(f"coalesce(CAST(r.{c} AS VARCHAR), '')" + f" AS {c}" if c != "status_code" else "r.status_code"
                    for c in cols)
    body = (f"SELECT r.page_id, {sel} FROM (SELECT a.*, "
            f"{S.crawl_status_sql('a')} AS crawl_status, '' AS redirect_url FROM "
            f"(SELECT x.*, CASE WHEN allowed THEN 'allowed' ELSE 'blocked' END AS robots_txt "
            f"FROM {allowed_sql('it')} x) a) r")
    return sql_with_pages(body, (*_gated_fetch_ctes(), _items_sql(settings), *robots_ctes()),
                          fixtures=("fx_crawl", "fx_html", "fx_robots"))


@register("page_rows", _page_rows_sql(DEFAULT))
def q_page_rows(spark, sf):
    return X.page_rows(fetches_frame(spark, sf), DEFAULT, fixture(spark, sf, "fx_robots"))


ITEMS_SETTINGS = CrawlSettings(crawl_items=("url", "status_code", "h1", "h2", "page_title", "robots_txt",
                                            "crawl_status"), extraction_separator="; ")


@register("project_items", _page_rows_sql(ITEMS_SETTINGS))
def q_project_items(spark, sf):
    return X.page_rows(fetches_frame(spark, sf), ITEMS_SETTINGS, fixture(spark, sf, "fx_robots"))


@register("onpage_length", sql_with_pages(
    f"SELECT url, page_title, CAST(length(page_title) AS INTEGER) AS length FROM "
    f"(SELECT url, {S.joined_sql(S.direct_texts_sql('h', 'title'), SEP)} AS page_title FROM pg) "
    f"ORDER BY length DESC, url"))
def q_onpage_length(spark, sf):
    from sitegraph.operators.views import onpage_length

    titled = html_frame(spark, sf).select(
        "url", H.joined(H.direct_texts("_head", "title"), SEP).alias("page_title"),
        F.lit(200).alias("status_code"))
    return onpage_length(titled, "page_title")


@register("scan_pages", "SELECT page_id, url, 200 AS status_code, html, 0 AS n_headers, 0 AS n_hops FROM pages")
def q_scan_pages(spark, sf):
    from sitegraph.sources.io import scan_pages

    df = scan_pages(spark, f"{sf.rstrip('/')}/pages.parquet")
    return df.select("page_id", "url", "status_code", "html",
                     F.size("headers").alias("n_headers"), F.size("history").alias("n_hops"))


# -- X1 node table, X20 / X21 custom extractions --------------------------------

from sitegraph.operators import dom as D  # noqa: E402
from sitegraph.operators import selectors as SEL  # noqa: E402


def _tree_ctes(source: str, key: str) -> tuple:
    """``tree``: the tokens of ``source(key, c)`` with their levels, by a recursion over the tokens
    of a page that carries the list of open elements."""
    toks = f"regexp_extract_all(c, {S.lit(OP.RE_TOKEN)}, 0)"
    kind = (f"CASE WHEN starts_with(tok, '</') THEN 'close' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' "
            f"WHEN starts_with(tok, '<') THEN 'other' ELSE 'text' END")
    voids = ", ".join(S.lit(t) for t in OP.VOID_TAGS)

    def table(name: str, values: dict) -> str:
        rows = "".join(f" WHEN {S.lit(t)} THEN {v}" for t, v in values.items())
        return f"CASE {name}{rows}"

    def names(which: int) -> dict:
        return {t: "[" + ", ".join(S.lit(x) for x in v[which]) + "]::VARCHAR[]" for t, v in OP.ENDED_BY.items()}

    weight = lambda x: table(x, OP.WEIGHTS) + " ELSE 100 END"
    places = "range(1, len(open) + 1)"
    return (
        f"t0 AS (SELECT {key}, unnest({toks}) AS tok, unnest(range(0, len({toks}))) AS pos FROM {source})",
        f"t1 AS (SELECT *, {kind} AS kind, lower(regexp_extract(tok, {S.lit(OP.RE_TAG_NAME)}, 1)) AS tg FROM t0)",
        f"t2 AS (SELECT *, CASE WHEN kind IN ('open', 'close') THEN tg END AS tag, "
        f"kind = 'open' AND (tg IN ({voids}) OR ends_with(tok, '/>')) AS void, "
        f"{table('tg', names(0))} ELSE [] END AS ended, {table('tg', names(1))} ELSE [] END AS bounds FROM t1)",
        f"tree AS (SELECT DISTINCT {key}, -1::BIGINT AS pos, ''::VARCHAR AS tok, ''::VARCHAR AS kind, NULL::VARCHAR AS tag, "
        f"0::BIGINT AS level, []::VARCHAR[] AS open FROM t2 UNION ALL "
        f"SELECT {key}, pos, tok, kind, tag, "
        f"CASE WHEN kind = 'open' THEN len(cut) + 1 WHEN kind = 'close' AND near IS NOT NULL THEN near ELSE len(open) END AS level, "
        f"CASE WHEN kind = 'open' AND NOT void THEN list_append(cut, tag) WHEN kind = 'open' THEN cut "
        f"WHEN kind = 'close' AND near IS NOT NULL THEN open[:near - 1] ELSE open END AS open FROM ("
        f"SELECT *, CASE WHEN fence IS NULL THEN open ELSE open[:fence - 1] END AS cut, "
        f"CASE WHEN len(list_filter({places}, lambda i: i > own AND {weight('open[i]')} > {weight('tag')})) = 0 THEN own END AS near "
        f"FROM (SELECT *, list_min(list_filter({places}, lambda i: i > bound AND list_contains(ended, open[i]))) AS fence FROM ("
        f"SELECT t.{key}, t.pos, t.tok, t.kind, t.tag, t.void, t.ended, r.open, "
        f"coalesce(list_max(list_filter(range(1, len(r.open) + 1), lambda i: list_contains(t.bounds, r.open[i]))), 0) AS bound, "
        f"list_max(list_filter(range(1, len(r.open) + 1), lambda i: r.open[i] = t.tag)) AS own "
        f"FROM tree r JOIN t2 t ON t.{key} = r.{key} AND t.pos = r.pos + 1))))",
    )


def _dom_sql() -> str:
    text = sql_with_pages(f"""
SELECT url, CAST(pos AS BIGINT) AS pos, kind, tag, CAST(level AS INTEGER) AS level,
       CASE WHEN kind = 'text' THEN {S.decode_sql('tok')} END AS text
FROM tree JOIN pg USING (page_id) WHERE pos >= 0""", _tree_ctes("pg", "page_id"))
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("dom_nodes", _dom_sql())
def q_dom_nodes(spark, sf):
    pages = fixture(spark, sf, "fx_html").select("url", "html")
    return D.node_table(pages).select("url", F.col("pos").cast("bigint").alias("pos"), "kind", "tag", "level", "text")


# Custom extractions used by the registered selector queries.
CSS_EXTRACTIONS = [("Ad text", "CSS Selector", "div.ad"), ("Second heading", "CSS Selector", "article h2"),
                   ("Nav first", "CSS Selector", "nav li a")]
XPATH_EXTRACTIONS = [("H2 text", "XPath", "//h2/text()"), ("Nofollow", "XPath", '//a[@rel="nofollow"]/@href'),
                     ("Nav", "XPath", "//nav//li/a"), ("Title", "XPath", "/html/head/title/text()")]


def _extraction_builder(extractions):
    def build(spark, sf):
        pages = fixture(spark, sf, "fx_html").select("url", "html")
        return SEL.extraction_table(pages, CrawlSettings(extractions=tuple(extractions)))
    return build


def _segment(c: str, tag: str) -> str:
    """Inner markup of the first ``tag`` element (greedy to its last end tag)."""
    return f"regexp_extract({c}, {S.lit(f'(?is)<{tag}\\b[^>]*>(.*)</{tag}\\s*>')}, 1)"


def _inners(seg: str, tag: str) -> str:
    return f"regexp_extract_all({seg}, {S.lit(OP.element_re(tag))}, 1)"


def _text_of(inner: str) -> str:
    """Whole text of an element's inner markup: tags removed, entities decoded."""
    return S.decode_sql(S.rx_replace(inner, OP.RE_ANY_TAG, ""))


def _first_text(inners: str) -> str:
    return f"coalesce({S.collapse_ws_sql(_text_of(f'({inners})[1]'))}, '')"


_AD_DIVS = (f"list_filter(regexp_extract_all(c, {S.lit('(?is)<div\\b[^>]*>.*?</div\\s*>')}, 0), lambda e: "
            f"list_contains(string_split_regex(trim({S.attr_sql(S.rx_extract('e', '^<[^>]*>'), 'class')}), "
            f"'\\s+'), 'ad'))")
_AD_INNER = f"list_transform({_AD_DIVS}, lambda e: {S.rx_extract('e', '(?is)^<div[^>]*>(.*)</div\\s*>$', 1)})"

CUSTOM_CSS_SQL = sql_with_pages(f"""
SELECT url, {_first_text(_AD_INNER)} AS ad_text,
       {_first_text(_inners(_segment('c', 'article'), 'h2'))} AS second_heading,
       {_first_text(_inners(_segment('c', 'nav'), 'a'))} AS nav_first
FROM pg""")

_NAV_TEXTS = f"list_transform({_inners(_segment('c', 'nav'), 'a')}, lambda x: {_text_of('x')})"
_NOFOLLOW = S.attr_values_sql(S.tags_sql("c", "a"), "href", S.rel_is_sql("nofollow"))

CUSTOM_XPATH_SQL = sql_with_pages(f"""
SELECT url, {S.joined_sql(S.direct_texts_sql('c', 'h2'), SEP)} AS h2_text,
       {S.joined_sql(_NOFOLLOW, SEP)} AS nofollow,
       {S.joined_sql(_NAV_TEXTS, SEP)} AS nav,
       {S.joined_sql(S.direct_texts_sql('h', 'title'), SEP)} AS title
FROM pg""")

register("custom_css", CUSTOM_CSS_SQL)(_extraction_builder(CSS_EXTRACTIONS))
register("custom_xpath", CUSTOM_XPATH_SQL)(_extraction_builder(XPATH_EXTRACTIONS))

EXTRACTION_SETTINGS = CrawlSettings(extractions=tuple(CSS_EXTRACTIONS[:1] + XPATH_EXTRACTIONS[:1]))


EXTRACTION_SQL[("CSS Selector", "div.ad")] = _first_text(_AD_INNER)
EXTRACTION_SQL[("XPath", "//h2/text()")] = S.joined_sql(S.direct_texts_sql("c", "h2"), SEP)


@register("custom_extractions", _page_rows_sql(EXTRACTION_SETTINGS))
def q_custom_extractions(spark, sf):
    return X.page_rows(fetches_frame(spark, sf), EXTRACTION_SETTINGS, fixture(spark, sf, "fx_robots"))


# What the markup of fx_open says with implied end tags, stated from the page's own values.
OPEN_EXTRACTIONS = {
    ("First li", "CSS Selector", "li.a"): ["'one ' || page_id || '.' || visit"],
    ("All li", "XPath", "//li"): ["'one ' || page_id || '.' || visit", "'twoin'", "'in'", "'three'"],
    ("Child li", "XPath", "//body/ul/li/text()"): ["'one ' || page_id || '.' || visit", "'two'", "'three'"],
    ("Inner li", "CSS Selector", "ul ul > li.a"): ["'in'"],
    ("Paragraphs", "XPath", "//p"): ["'p1 x'", "'p2'"],
    ("Divs", "XPath", "/html/body/div"): ["'d'"],
    ("Cells", "XPath", "//table/tr/td/text()"): ["'c1'", "page_id", "'c3'"],
    ("Rows", "XPath", "//tr"): ["'c1' || page_id", "'c3'"],
    ("Options", "XPath", "//select/option"): ["'o1'", "visit"],
    ("Terms", "XPath", "//dl/dt"): ["'t1'", "'t2'"],
    ("Bold", "XPath", "//b/text()"): ["'x'", "'y'"],
}


def _open_sql() -> str:
    from sitegraph.settings import extraction_column_name

    columns = ", ".join(f"{f' || {S.lit(SEP)} || '.join(parts)} AS {extraction_column_name(name, [])}"
                        for (name, _, _), parts in OPEN_EXTRACTIONS.items())
    return with_fixtures(["fx_open"], f"SELECT url, visit, {columns} FROM fx_open")


@register("custom_unclosed", _open_sql())
def q_custom_unclosed(spark, sf):
    """Eleven selectors in one pass over pages with implied end tags, two visits per URL."""
    settings = CrawlSettings(extractions=tuple(OPEN_EXTRACTIONS))
    return SEL.extraction_table(fixture(spark, sf, "fx_open"), settings, keep=("visit",))


# Places of fx_open's start tags: element, level, parent and the token that ends it.
OPEN_ELEMENTS = [
    (0, "html", 1, None, 51), (1, "body", 2, 0, 50), (2, "ul", 3, 1, 13), (3, "li", 4, 2, 5), (5, "li", 4, 2, 11),
    (7, "ul", 5, 5, 10), (8, "li", 6, 7, 10), (11, "li", 4, 2, 13), (14, "p", 3, 1, 19), (16, "b", 4, 14, 18),
    (19, "p", 3, 1, 21), (21, "div", 3, 1, 23), (24, "table", 3, 1, 33), (25, "tr", 4, 24, 30), (26, "td", 5, 25, 28),
    (28, "td", 5, 25, 30), (30, "tr", 4, 24, 33), (31, "td", 5, 30, 33), (34, "select", 3, 1, 39), (35, "option", 4, 34, 37),
    (37, "option", 4, 34, 39), (40, "dl", 3, 1, 47), (41, "dt", 4, 40, 43), (43, "dd", 4, 40, 45), (45, "dt", 4, 40, 47),
    (48, "b", 3, 1, 50),
]


@register("dom_unclosed", with_fixtures(["fx_open"], "SELECT url, visit, pos, tag, level, parent, stop FROM fx_open, (VALUES "
          + ", ".join("(" + ", ".join("NULL" if v is None else S.lit(v) if isinstance(v, str) else f"{v}::INTEGER" for v in row) + ")"
                      for row in OPEN_ELEMENTS) + ") v(pos, tag, level, parent, stop)"))
def q_dom_unclosed(spark, sf):
    nodes = D.node_table(fixture(spark, sf, "fx_open"), keep=("visit",)).where("kind = 'open'")
    return nodes.select("url", "visit", "pos", "tag", "level", "parent", F.col("end").alias("stop"))
