"""Small text helpers shared by the filter layer and the HTML extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Whitespace as Python's str.split() sees it (ASCII controls, NBSP, NEL, the
# Unicode space separators).  Same class syntax in Java regex and RE2.
WS_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only (the case rule of SQL LIKE in the reference store)."""
    return F.translate(c, _UPPER, _LOWER)


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace -> one space, trimmed (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(c, WS_CLASS + "+", " "))


def clean_list(arr: Column) -> Column:
    """Collapse whitespace in every entry and drop blank entries."""
    return F.filter(F.transform(arr, collapse_ws), lambda x: x != "")
