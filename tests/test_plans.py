"""Plan-shape guards for the properties the design relies on at scale."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sitegraph.operators.extract import extract_links
from sitegraph.settings import CrawlSettings
from sitegraph.sources.fixtures import fixture

QUERIES = E.queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def scans(plan: str):
    out = []
    for line in plan.split("\n"):
        if "FileScan" in line:
            loc = re.search(r"\[file:[^\]]*/([^/\]]+)\]", line)
            schema = re.search(r"ReadSchema: (struct<.*?>)\s*$", line.strip())
            out.append((loc.group(1) if loc else "?", schema.group(1) if schema else ""))
    return out


@pytest.mark.parametrize("name", ["crawl_status", "broken_inlinks_non_ok", "filter_contains", "upsert_crawl",
                                  "robots_allowed", "new_urls", "pending_urls"])
def test_no_html_read_where_not_needed(spark, name):
    for table, schema in scans(physical(QUERIES[name](spark, SF_SMALL))):
        assert "html" not in schema, (name, table, schema)


def test_extraction_has_no_shuffle_without_robots(spark):
    pages = fixture(spark, SF_SMALL, "fx_html").select("url", "html")
    plan = physical(extract_links(pages, CrawlSettings()))
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert not exchanges, exchanges


@pytest.mark.parametrize("name", ["extract_links", "robots_allowed", "page_rows", "upsert_crawl", "failed_urls",
                                  "broken_inlinks_big", "upsert_crawl_big", "inlinks_big", "custom_css"])
def test_no_pairwise_joins(spark, name):
    plan = physical(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["broken_inlinks_big", "upsert_crawl_big", "extract_links", "robots_allowed"])
def test_no_unchecked_broadcast_hints(spark, name):
    # broadcasts come only from AQE's measured-size decision, never from a hint
    assert "ResolvedHint" not in analyzed(QUERIES[name](spark, SF_SMALL)), name


def test_expression_trees_stay_small(spark):
    # let-binding keeps URL expressions linear (a nested normalise(resolve()) once planned at 1.6 MB)
    plan = QUERIES["extract_links"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 300_000
