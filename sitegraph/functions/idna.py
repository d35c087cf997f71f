"""Host names outside ASCII as DNS writes them (``xn--`` labels), built-in functions only.

A label with a character beyond ASCII becomes ``xn--`` and its Punycode (RFC 3492).  The
code is a fold over the label's foreign characters in the order in which a decoder inserts
them, by code point, then by place: each adds the number of steps the decoder makes from
one insertion to the next, as a number of variable length.  A label is at most 63
characters, so the folds are short; a longer one is no DNS label and stays as written.
Which characters IDNA allows is not checked.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREIGN = r"[^\x00-\x7F]"
LONGEST = 63
# Fixed values of RFC 3492, section 5.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits of the longest number: code points below 2^21 times 64 places, 10 values a digit at least.
MOST_DIGITS = 9


@lru_cache(maxsize=64)
def _long(v) -> Column:
    return F.lit(v).cast("long")


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else _long(b))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_host(host: Column) -> Column:
    """A lower-cased host with its foreign labels encoded; others are returned as they are."""
    labels = F.transform(F.split(host, r"\.", -1), lambda x: F.when(
        x.rlike(FOREIGN) & (F.length(x) <= LONGEST), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
    return F.when(host.rlike(FOREIGN), F.array_join(labels, ".")).otherwise(host)


def punycode(label: Column) -> Column:
    """The Punycode of a label of at most LONGEST characters."""
    codes = F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    plain = F.regexp_replace(label, FOREIGN, "")
    start = F.struct(_long(FIRST_CODE).alias("code"), _long(0).alias("at"), F.length(plain).cast("long").alias("held"),
                     _long(FIRST_BIAS).alias("bias"),
                     F.when(plain == "", F.lit("")).otherwise(F.concat(plain, F.lit("-"))).alias("out"))
    return _let(codes, lambda cs: F.aggregate(_insertions(cs), start, _insert, lambda s: s["out"]))


def _insertions(codes: Column) -> Column:
    """(code, place among the characters inserted so far, is it the first) in a decoder's order."""
    placed = F.array_sort(F.filter(
        F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.cast("long").alias("i"))),
        lambda x: x["code"] >= FIRST_CODE))
    return F.transform(placed, lambda x, k: F.struct(
        x["code"].alias("code"),
        F.size(F.filter(F.slice(codes, F.lit(1), x["i"].cast("int")), lambda c: c <= x["code"])).cast("long").alias("at"),
        (k == 0).alias("first")))


def _insert(s: Column, e: Column) -> Column:
    steps = (e["code"] - s["code"]) * (s["held"] + 1) + e["at"] - s["at"]
    return _let(steps, lambda d: F.struct(
        e["code"].alias("code"), (e["at"] + 1).alias("at"), (s["held"] + 1).alias("held"),
        _bias(d, s["held"] + 1, e["first"]).alias("bias"), F.concat(s["out"], _number(d, s["bias"])).alias("out")))


def _number(value: Column, bias: Column) -> Column:
    """``value`` in digits whose last one is known by lying below its threshold."""
    def digit(a, k):
        return _let(F.least(F.greatest(k * BASE - bias, _long(T_MIN)), _long(T_MAX)), lambda t: F.when(
            a["rest"] < 0, a).when(a["rest"] < t, F.struct(
                _long(-1).alias("rest"), F.concat(a["out"], _digit(a["rest"])).alias("out"))).otherwise(F.struct(
                    _div(a["rest"] - t, BASE - t).alias("rest"),
                    F.concat(a["out"], _digit(t + F.pmod(a["rest"] - t, BASE - t))).alias("out"))))

    return F.aggregate(F.sequence(_long(1), _long(MOST_DIGITS)),
                       F.struct(value.alias("rest"), F.lit("").alias("out")), digit, lambda a: a["out"])


def _digit(value: Column) -> Column:
    return F.substring(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1))


def _bias(steps: Column, held: Column, first: Column) -> Column:
    part = BASE - T_MIN
    limit = part * T_MAX // 2
    damped = _let(_div(steps, F.when(first, _long(DAMP)).otherwise(_long(2))), lambda d: d + _div(d, held))
    return F.aggregate(
        F.sequence(_long(1), _long(6)), F.struct(damped.alias("d"), _long(0).alias("k")),
        lambda a, _: F.when(a["d"] > limit, F.struct(_div(a["d"], part).alias("d"), (a["k"] + BASE).alias("k"))).otherwise(a),
        lambda a: a["k"] + _div((part + 1) * a["d"], a["d"] + SKEW))
