"""The element tree of a page, read off its tokens.

``page_tokens`` is a page as an array of tokens (start tags with their attributes, end tags,
text), ``nesting`` the tree over them: for each token its level, the start tag of the element
around it, and for each start tag the token that ends it.  An element's content is thus a slice
of the token array, and "inside" is a comparison of places.

Which elements are open is a stack that every tag pushes on and pops from, with the end tags
that HTML lets an author leave out; no built-in function carries a stack, so this one walk over
a page's tag names is an Arrow UDF (``nesting``).  It gets names and numbers only; tokens, texts
and attributes stay in the JVM, and no row meets another one: pages with equal URLs, repeated
fetches among them, are read each by itself.

What ends an element:

* its end tag, which also ends what is open inside it; an end tag without an open element of its
  name is ignored, and so is one that would have to leave a heavier element (``WEIGHT``: a
  ``</b>`` does not end a ``div``);
* a start tag that may not stand inside it (``ENDS``), looked for inside the nearest element of
  ``WITHIN``: an ``li`` ends the ``li`` before it, not the one around its list;
* the end of the page.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.session import workers_find_package

# FIXED VALUES: start tag -> the open elements it ends (HTML's optional end tags).
_BLOCKS = ("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
           "header hr main menu nav ol p pre section table ul").split()
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr", "td", "th"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
    **{name: ("p",) for name in _BLOCKS},
}
# FIXED VALUES: elements that such a search does not leave.
WITHIN = {
    **{name: ("ul", "ol", "menu") for name in ("li",)}, **{name: ("dl",) for name in ("dt", "dd")},
    **{name: ("table",) for name in ("td", "th", "tr", "thead", "tbody", "tfoot")},
    **{name: ("select", "datalist") for name in ("option", "optgroup")}, "body": (),
    **{name: ("table", "td", "th", "caption", "button", "object") for name in _BLOCKS},
}
# FIXED VALUES: an end tag does not leave an element of more weight than its own (100 where not given).
WEIGHT = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
          "head": 200, "body": 200, "html": 220}

#: Pages of an Arrow batch that are Python objects at a time.
PAGES = 16

TREE = "struct<level: array<int>, parent: array<int>, end: array<int>, hits: array<bigint>>"


def page_tokens(html) -> Column:
    """array<struct<tok, kind, tag, void, names, values, text>> of a page; kind: open, close,
    text, or other (doctype and the like)."""
    def token(t):
        kind = (F.when(t.startswith("</"), F.lit("close")).when(t.rlike("^<[A-Za-z]"), F.lit("open"))
                .when(t.rlike("^<[!?/]"), F.lit("other")).otherwise(F.lit("text")))
        return F.transform(F.array(F.struct(t.alias("tok"), kind.alias("kind"))), fields)[0]

    def fields(x):
        t, kind = x["tok"], x["kind"]
        tag = F.when(kind.isin("open", "close"), F.lower(F.regexp_extract(t, H.RE_TAG_NAME, 1)))
        start = F.when(kind == "open", H.parsed(t))
        return F.struct(t.alias("tok"), kind.alias("kind"), tag.alias("tag"),
                        ((kind == "open") & (H.is_void(tag) | t.endswith("/>"))).alias("void"),
                        start["names"].alias("names"), start["values"].alias("values"),
                        F.when(kind == "text", H.decode_entities(t)).alias("text"))

    return F.transform(F.regexp_extract_all(H.clean(html), F.lit(H.RE_TOKEN), F.lit(0)), token)


def marks(tokens) -> Column:
    """Per token what the walk needs: ``b`` a start tag, ``br/`` a void one, ``/b`` an end tag, '' else."""
    return F.transform(H._c(tokens), lambda t: F.coalesce(
        F.concat(F.when(t["kind"] == "close", "/").otherwise(""), t["tag"], F.when(t["void"], "/").otherwise("")), F.lit("")))


class Steps:
    """Steps of selectors as bits: bit i is met by an element if it matches step i and, unless
    the selector starts there, an element around it (``desc``) or its parent (``child``) meets
    bit i - 1; a selector's ``root`` step is met by outermost elements only."""

    def __init__(self, anywhere: int = 0, root: int = 0, desc: int = 0, child: int = 0):
        self.anywhere, self.root, self.desc, self.child = anywhere, root, desc, child


def walk(names: list[str], matches: list[int] | None, steps: Steps):
    """(level, parent, end, hits) of a page's tokens: one pass with a stack of open elements."""
    n = len(names)
    level, parent, end, hits = [0] * n, [-1] * n, [-1] * n, [0] * n
    tags, places, met, around = [], [], [0], [0]  # met, around: steps met by the innermost element; by it or one around it

    def leave(to: int, at: int) -> None:
        for p in places[to:]:
            end[p] = at
        del tags[to:], places[to:], met[to + 1:], around[to + 1:]

    for k, mark in enumerate(names):
        if not mark:
            level[k] = len(tags)
        elif mark[0] == "/":
            name, at = mark[1:], len(tags) - 1
            weight = WEIGHT.get(name, 100)
            while at >= 0 and tags[at] != name:
                at = -1 if WEIGHT.get(tags[at], 100) > weight else at - 1
            level[k] = len(tags) if at < 0 else at + 1
            if at >= 0:
                leave(at, k)
                parent[k] = places[-1] if places else -1
                continue
        else:
            void = mark[-1] == "/"
            name = mark[:-1] if void else mark
            if name in ENDS:
                to, at = len(tags), len(tags) - 1
                while at >= 0 and tags[at] not in WITHIN[name]:
                    if tags[at] in ENDS[name]:
                        to = at
                    at -= 1
                leave(to, k)
            level[k] = len(tags) + 1
            if matches:
                ways = steps.anywhere | (around[-1] << 1 & steps.desc) | (met[-1] << 1 & steps.child)
                hits[k] = matches[k] & (ways if tags else ways | steps.root)
            parent[k] = places[-1] if places else -1
            if void:
                end[k] = k
            else:
                tags.append(name)
                places.append(k)
                met.append(hits[k])
                around.append(around[-1] | hits[k])
            continue
        parent[k] = places[-1] if places else -1
    leave(0, n)
    return level, parent, end, hits


def trees(names: pa.Array, matches: pa.Array, steps: Steps) -> pa.StructArray:
    """``walk`` of every page of a batch.  Only PAGES pages are Python objects at a time; what
    is found grows as plain numbers."""
    columns = {"level": array("i"), "parent": array("i"), "end": array("i"), "hits": array("q")}
    ends, missing = array("i", [0]), []
    for at in range(0, len(names), PAGES):
        for page, bits in zip(names.slice(at, PAGES).to_pylist(), matches.slice(at, PAGES).to_pylist(), strict=True):
            for column, values in zip(columns.values(), walk(page or [], bits, steps), strict=True):
                column.extend(values)
            ends.append(len(columns["level"]))
            missing.append(page is None)
    offsets = pa.array(np.frombuffer(ends, np.int32))
    kinds = [np.int32, np.int32, np.int32, np.int64]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(column, kind))) for column, kind in zip(columns.values(), kinds, strict=True)]
    return pa.StructArray.from_arrays(lists, names=list(columns), mask=pa.array(missing, pa.bool_()))


def nesting(tokens, matches: Column | None = None, steps: Steps | None = None) -> Column:
    """The tree of a token array, and which elements meet which steps (``matches``: per token
    the steps that it matches by itself)."""
    steps = steps or Steps()

    def tree(names: pa.Array, matches: pa.Array) -> pa.Array:
        return trees(names, matches, steps)

    workers_find_package()
    bits = matches if matches is not None else F.array().cast("array<bigint>")
    return F.arrow_udf(tree, TREE)(marks(tokens), bits)


def node_table(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple = ()) -> DataFrame:
    """One row per token: (url, *keep, pos, kind, tag, void, attrs, text, level, parent, end).
    ``parent``: place of the enclosing element's start tag, null at the root; ``end``: of a start
    tag, the token that ends the element (its end tag, the start tag that implies it, or the number
    of tokens); its own place if it is void.  ``keep`` carries columns that tell pages apart."""
    read = pages.select(F.col(url).alias("url"), *keep, page_tokens(html).alias("_tok"))
    read = read.withColumn("_tree", nesting("_tok"))
    at = lambda name: F.get(F.col(f"_tree.{name}"), F.col("pos"))
    rows = read.select("url", *keep, "_tree", F.posexplode("_tok").alias("pos", "t"))
    return rows.select("url", *keep, "pos", "t.kind", "t.tag", "t.void", F.when(F.col("t.kind") == "open", F.col("t.tok")).alias("attrs"),
                       "t.text", at("level").alias("level"), F.when(at("parent") >= 0, at("parent")).alias("parent"),
                       F.when(at("end") >= 0, at("end")).alias("end"))
