"""Registered queries: robots source, rules, agent choice, patterns, allowed
test and robots status column."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.operators import robots as R
from sitegraph.plans import oracle_patterns as OP
from sitegraph.plans import sqlparts as S
from sitegraph.plans.catalog import register
from sitegraph.settings import CrawlSettings
from sitegraph.sources.fixtures import fixture, table, with_fixtures
from sitegraph.sources.io import robots_source

AGENT = CrawlSettings().agent


def robots_ctes(agent: str = AGENT) -> list[str]:
    """CTE chain over fx_robots ending in ``rpatt(host, kind, path, pattern, is_prefix)``."""
    split = r"string_split_regex(robots_text, '\r?\n')"
    s = "trim(regexp_replace(regexp_replace(raw, '#.*$', ''), '\\s+$', ''))"
    kind = (f"CASE WHEN {S.rx('s', OP.RE_AGENT)} THEN 'agent' WHEN {S.rx('s', OP.RE_DISALLOW)} THEN 'disallow' "
            f"WHEN {S.rx('s', OP.RE_ALLOW)} THEN 'allow' END")
    esc = S.rx_replace("body", r"([\\.^$|?*+()\[\]{}])", r"\\\1")
    return [
        f"rlines AS (SELECT lower(host) AS host, unnest(range(0, len({split}))) AS line, unnest({split}) AS raw "
        f"FROM fx_robots WHERE status_code = 200)",
        f"rcls AS (SELECT host, line, {kind} AS kind, "
        f"regexp_replace(regexp_extract(s, '^[^:]*:(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS value "
        f"FROM (SELECT host, line, {s} AS s FROM rlines))",
        "rgrp AS (SELECT host, line, kind, value, sum(CASE WHEN kind = 'agent' AND (prev IS NULL OR prev <> 'agent') "
        "THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        "AS grp FROM (SELECT *, lag(kind) OVER (PARTITION BY host ORDER BY line) AS prev FROM rcls "
        "WHERE kind IS NOT NULL))",
        "rrules AS (SELECT host, line, grp, kind, CASE WHEN kind = 'agent' THEN regexp_extract(value, '^(\\S*)', 1) "
        "ELSE value END AS value FROM rgrp)",
        f"ra1 AS (SELECT host, lower(value) AS tok, CASE WHEN value <> '*' AND contains({S.lit(agent.lower())}, "
        f"lower(value)) THEN length(value) END AS spec, value = '*' AS star FROM rrules "
        f"WHERE kind = 'agent' AND value <> '')",
        "ra2 AS (SELECT host, max(spec) AS mx, bool_or(star) AS has_star FROM ra1 GROUP BY host)",
        "rchosen AS (SELECT * FROM (SELECT ra2.host, CASE WHEN mx IS NOT NULL THEN (SELECT max(tok) FROM ra1 "
        "WHERE ra1.host = ra2.host AND ra1.spec = ra2.mx) WHEN has_star THEN '*' END AS agent FROM ra2) "
        "WHERE agent IS NOT NULL)",
        "rgroups AS (SELECT DISTINCT r.host, r.grp FROM rrules r JOIN rchosen c ON c.host = r.host "
        "AND c.agent = lower(r.value) WHERE r.kind = 'agent')",
        "rarules AS (SELECT r.host, r.kind, r.value AS path FROM rrules r JOIN rgroups g ON g.host = r.host "
        "AND g.grp = r.grp WHERE r.kind IN ('allow', 'disallow') AND r.value <> '')",
        f"rpatt AS (SELECT host, kind, path, '^' || replace({esc}, '\\*', '.*') || CASE WHEN ends THEN '$' "
        f"ELSE '' END AS pattern, NOT contains(path, '*') AND NOT ends_with(path, '$') AS is_prefix FROM "
        f"(SELECT *, ends_with(path, '$') AS ends, CASE WHEN ends_with(path, '$') THEN "
        f"regexp_replace(path, '\\$$', '') ELSE path END AS body FROM rarules))",
    ]


def allowed_sql(src: str, url: str = "url") -> str:
    """``(src.*, allowed)`` for every row of ``src`` (a CTE or subquery name)."""
    pq = S.path_and_query_sql(f"u.{url}")
    match = f"(CASE WHEN r.is_prefix THEN starts_with(u._pq, r.path) ELSE regexp_matches(u._pq, r.pattern) END)"
    return (f"(SELECT m.* EXCLUDE (_rid, _host, _pq, _a, _d), (_d IS NULL OR (_a IS NOT NULL AND _a >= _d)) "
            f"AS allowed FROM (SELECT u.*, max(CASE WHEN r.kind = 'allow' AND {match} THEN length(r.path) END) AS _a, "
            f"max(CASE WHEN r.kind = 'disallow' AND {match} THEN length(r.path) END) AS _d "
            f"FROM (SELECT *, {S.host_sql(f'u.{url}')} AS _host, {pq} AS _pq, row_number() OVER () AS _rid "
            f"FROM {src} u) u LEFT JOIN rpatt r ON r.host = u._host GROUP BY ALL) m)")


def sql_with_robots(body: str, fixtures=("fx_robots",), extra_ctes=()) -> str:
    ctes = ",\n".join([*extra_ctes, *robots_ctes()])
    body = body.strip()
    text = f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
    return with_fixtures(list(fixtures), text)


@register("robots_source", with_fixtures(["fx_robots"], """
SELECT lower(host) AS host, CASE WHEN status_code = 200 THEN robots_text END AS robots_text, status_code
FROM fx_robots"""))
def q_robots_source(spark, sf):
    return robots_source(fixture(spark, sf, "fx_robots"))


@register("robots_rules", sql_with_robots(
    "SELECT host, CAST(line AS BIGINT) AS line, CAST(grp AS BIGINT) AS grp, kind, value FROM rrules"))
def q_robots_rules(spark, sf):
    return R.parse_rules(fixture(spark, sf, "fx_robots")).select(
        "host", F.col("line").cast("bigint").alias("line"), F.col("grp").cast("bigint").alias("grp"),
        "kind", "value")


@register("robots_agent", sql_with_robots("SELECT host, agent FROM rchosen"))
def q_robots_agent(spark, sf):
    return R.choose_agent(R.parse_rules(fixture(spark, sf, "fx_robots")), AGENT)


@register("robots_patterns", sql_with_robots("SELECT host, kind, path, pattern, is_prefix FROM rpatt"))
def q_robots_patterns(spark, sf):
    return R.rule_patterns(R.agent_rules(R.parse_rules(fixture(spark, sf, "fx_robots")), AGENT))


@register("robots_allowed", sql_with_robots(
    f"SELECT page_id, url, allowed FROM {allowed_sql('pages')}"))
def q_robots_allowed(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    out = R.with_robots_status(pages, "url", fixture(spark, sf, "fx_robots"), AGENT)
    return out.select("page_id", "url", (F.col("robots_txt") == "allowed").alias("allowed"))


@register("robots_status", sql_with_robots(
    f"SELECT page_id, url, CASE WHEN allowed THEN 'allowed' ELSE 'blocked' END AS robots_txt "
    f"FROM {allowed_sql('pages')}"))
def q_robots_status(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return R.with_robots_status(pages, "url", fixture(spark, sf, "fx_robots"), AGENT) \
        .select("page_id", "url", "robots_txt")

