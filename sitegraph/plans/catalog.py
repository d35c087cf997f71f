"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can state the same result, a DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from sitegraph.plans import (  # noqa: F401
        crawl_reports, discovery, url_plans, page_plans, robots_plans, stream_plans, idna_plans,
    )


def queries() -> dict[str, Builder]:
    load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
