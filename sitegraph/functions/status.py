"""Crawl status columns (status text, canonicalised test, full crawl status).

All are plain ``Column`` expressions: they evaluate inside whole-stage codegen
and need no join (the status-name table is a literal map folded into the plan).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.settings import NON_STANDARD, STATUS_NAMES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _status_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS_NAMES.items()))


def status_text(code) -> Column:
    """HTTP code -> words; unknown code -> ``non-standard response``; NULL stays NULL."""
    code = _col(code)
    return F.when(code.isNotNull(),
                  F.coalesce(F.try_element_at(_status_map(), code.cast("int")), F.lit(NON_STANDARD)))


def is_canonicalised(url, canonical) -> Column:
    """A canonical that is non-blank and differs from the URL."""
    c = _blank(canonical)
    return (c != "") & (c != _col(url))


def crawl_status(url="url", status_code="status_code", x_robots_tag="x_robots_tag",
                 robots_txt="robots_txt", meta_robots="meta_robots",
                 canonical_tag="canonical_tag", canonical_http_header="canonical_http_header",
                 status_override=None) -> Column:
    """Ordered, comma-joined status flags; a leading ``ok`` is dropped when
    other flags follow.  Tests are case-sensitive.  NULL for undiscovered rows.

    Any of the inputs may be ``None`` (column not produced): it then counts as
    blank.  ``status_override`` replaces the status text (failure rows).
    """
    def val(c):
        return F.lit("") if c is None else _blank(c)

    flags = [
        F.when(val(x_robots_tag).contains("noindex"), F.lit("blocked by x-robots-tag")),
        F.when(val(robots_txt).contains("blocked"), F.lit("blocked by robots.txt")),
        F.when(val(meta_robots).contains("noindex"), F.lit("noindex")),
        F.when(is_canonicalised(url, val(canonical_tag)), F.lit("canonicalised")),
        F.when(is_canonicalised(url, val(canonical_http_header)), F.lit("header canonicalised")),
    ]
    text = status_text(status_code) if status_override is None else status_override
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | f.isNotNull()
    head = F.when(~((text == "ok") & any_flag), text)
    return F.when(_col(status_code).isNotNull(), F.concat_ws(", ", head, *flags))
