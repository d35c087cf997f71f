"""The filter / sort / projection layer: (column, operator, value) triples to
Column predicates and sort orders, always restricted to crawled rows.

Matching rules (as the reference's SQL store applies them):
  * Begins / Ends / Contains / Does Not Contain are case-insensitive (A-Z
    only) and take the value literally (``%``, ``_`` and ``\\`` included);
  * Equals and the order comparisons are case-sensitive;
  * on the integer ``status_code`` a numeric value compares numerically, a
    non-numeric one compares as text, which orders after every number;
    text operators see the number's decimal text;
  * NULL fails every test, including Does Not Contain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.text import ascii_lower
from sitegraph.settings import FILTER_OPERATORS, SORT_ASC, SORT_DESC

INT_COLUMNS = {"status_code"}

_CMP = {
    "Equals": lambda a, b: a == b,
    "Does Not Equal": lambda a, b: a != b,
    "Greater Than": lambda a, b: a > b,
    "Greater Than Or Equal To": lambda a, b: a >= b,
    "Less Than": lambda a, b: a < b,
    "Less Than Or Equal To": lambda a, b: a <= b,
}
# number (column) vs non-numeric text (value): numbers order first.
_NUM_VS_TEXT = {
    "Equals": False,
    "Does Not Equal": True,
    "Greater Than": False,
    "Greater Than Or Equal To": False,
    "Less Than": True,
    "Less Than Or Equal To": True,
}


def column_name(label: str) -> str:
    """Header label -> column name (lower case, spaces to ``_``)."""
    return label.strip().lower().replace(" ", "_")


def _number(value: str):
    v = value.strip()
    try:
        return int(v)
    except ValueError:
        try:
            return float(v)
        except ValueError:
            return None


def predicate(column: str, operator: str, value: str) -> Column:
    """One filter triple as a Column predicate."""
    if operator not in FILTER_OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    c = F.col(column)
    if operator in _CMP:
        if column in INT_COLUMNS:
            num = _number(value)
            if num is None:
                return c.isNotNull() & F.lit(_NUM_VS_TEXT[operator])
            return _CMP[operator](c, F.lit(num))
        return _CMP[operator](c, F.lit(value))
    text = c.cast("string") if column in INT_COLUMNS else c
    t, v = ascii_lower(text), ascii_lower(F.lit(value))
    if operator == "Begins With":
        return t.startswith(v)
    if operator == "Ends With":
        return t.endswith(v)
    if operator == "Contains":
        return t.contains(v)
    return ~t.contains(v)  # Does Not Contain: NULL stays NULL -> dropped


def crawled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status_code").isNotNull())


def apply_filters(df: DataFrame, filters: list[tuple[str, str, str]] | None = None,
                  columns: list[str] | str | None = None) -> DataFrame:
    """Filters (AND-ed, blank values skipped), sorts (in list order), crawled
    rows only, then the projection (``None``/``'*'`` = all columns)."""
    preds, orders = [], []
    for column, operator, value in filters or []:
        column = column_name(column)
        if operator in SORT_ASC:
            orders.append(F.col(column).asc())
        elif operator in SORT_DESC:
            orders.append(F.col(column).desc())
        elif value is not None and str(value) != "":
            preds.append(predicate(column, operator, str(value)))
    out = df.filter(reduce(lambda a, b: a & b, preds, F.col("status_code").isNotNull()))
    if orders:
        out = out.orderBy(*orders)
    if columns and columns != "*":
        out = out.select(*[column_name(c) for c in columns])
    return out


def regexp_search(column: str, pattern: str) -> Column:
    """The SQL REGEXP function: unanchored search."""
    return F.col(column).rlike(pattern)


def with_sort(filters: list[tuple[str, str, str]], column: str, operator: str) -> list[tuple[str, str, str]]:
    """Header-click sort: the new sort replaces any earlier sort, filters stay."""
    if operator not in SORT_ASC + SORT_DESC:
        raise ValueError(f"unknown sort {operator!r}")
    kept = [f for f in filters if f[1] not in SORT_ASC + SORT_DESC]
    return kept + [(column, operator, "")]
