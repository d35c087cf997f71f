"""Custom extractions: a CSS-selector and an XPath subset evaluated on the
node table.

Supported CSS: ``tag``, ``*``, ``#id``, ``.class`` (several), ``[attr]``,
``[attr="v"]``, descendant (space) and child (``>``) combinators.
Supported XPath: steps ``//name`` (descendant) and ``/name`` (child) from the
document root, ``*``, predicates ``[@a]``, ``[@a="v"]``,
``[contains(@a, "v")]``, and a final ``/text()`` or ``/@attr``.  Anything
else raises at plan time.

Semantics (as the crawler applies them):
* CSS: the whole text of the first matching element, whitespace collapsed;
  '' when nothing matches;
* XPath: every result (direct text children, attribute values, or element
  text) in document order, cleaned (blank entries dropped, whitespace
  collapsed) and joined by the extraction separator.

Selectors are short settings strings.  All selectors of a page are matched together: their
steps are bits, a token's own matches are one number, and the walk that builds the element tree
(``dom.nesting``) carries the steps met so far along its stack.  An element's text is a slice of
the token array.  Everything stays inside the page's row: no join, no exchange, no page key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions.text import collapse_ws
from sitegraph.operators.dom import Steps, nesting, page_tokens
from sitegraph.settings import CrawlSettings, extraction_column_name

#: Steps matched by one walk (bits of a long); more selectors take further walks.
MOST_STEPS = 62


@dataclass(frozen=True)
class Compound:
    tag: str = "*"
    preds: tuple = ()  # (kind, attr, value): kind in has / eq / contains / class


@dataclass(frozen=True)
class Selector:
    steps: tuple  # ((combinator, Compound), ...), combinator 'desc' or 'child'
    output: str = "element"  # element | text | attr
    attr: str | None = None


class SelectorError(ValueError):
    pass


_CSS_COMPOUND = re.compile(r"""([A-Za-z][A-Za-z0-9-]*|\*)?((?:[#.][A-Za-z0-9_-]+|\[[^\]]+\])*)$""")
_CSS_PART = re.compile(r"""#([A-Za-z0-9_-]+)|\.([A-Za-z0-9_-]+)|\[\s*([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


def parse_css(text: str) -> Selector:
    tokens = re.sub(r"\s*>\s*", " > ", text.strip()).split()
    steps, comb = [], "desc"
    for tok in tokens:
        if tok == ">":
            comb = "child"
            continue
        m = _CSS_COMPOUND.match(tok)
        if not m:
            raise SelectorError(f"unsupported CSS selector part {tok!r}")
        preds = []
        if "".join(p.group(0) for p in _CSS_PART.finditer(m.group(2) or "")) != (m.group(2) or ""):
            raise SelectorError(f"unsupported CSS selector part {tok!r}")
        for p in _CSS_PART.finditer(m.group(2) or ""):
            if p.group(1):
                preds.append(("eq", "id", p.group(1)))
            elif p.group(2):
                preds.append(("class", "class", p.group(2)))
            else:
                val = next((v for v in p.group(4, 5, 6) if v is not None), None)
                preds.append(("has", p.group(3).lower(), None) if val is None else ("eq", p.group(3).lower(), val))
        steps.append((comb, Compound((m.group(1) or "*").lower(), tuple(preds))))
        comb = "desc"
    if not steps or comb == "child":
        raise SelectorError("empty CSS selector, or one that ends in a combinator")
    return Selector(tuple(steps))


_XP_STEP = re.compile(r"""(//|/)(text\(\)|[A-Za-z][A-Za-z0-9-]*|\*|@[A-Za-z_:][-A-Za-z0-9_:.]*)((?:\[[^\]]*\])*)""")
_XP_PRED = re.compile(r"""\[\s*(?:@([-\w:.]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?|contains\(\s*@([-\w:.]+)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\))\s*\]""")


def parse_xpath(text: str) -> Selector:
    pos, steps, output, attr = 0, [], "element", None
    s = text.strip()
    while pos < len(s):
        m = _XP_STEP.match(s, pos)
        if not m:
            raise SelectorError(f"unsupported XPath at {s[pos:]!r}")
        pos = m.end()
        axis, name, preds_text = m.groups()
        if name == "text()" or name.startswith("@"):
            if pos != len(s) or axis != "/" or preds_text:
                raise SelectorError("text() and @attr are only supported as the last step")
            output, attr = ("text", None) if name == "text()" else ("attr", name[1:].lower())
            break
        preds = []
        for p in _XP_PRED.finditer(preds_text):
            if p.group(1):
                val = p.group(2) if p.group(2) is not None else p.group(3)
                preds.append(("has", p.group(1).lower(), None) if val is None else ("eq", p.group(1).lower(), val))
            else:
                preds.append(("contains", p.group(4).lower(), p.group(5) if p.group(5) is not None else p.group(6)))
        if preds_text and len(preds) != preds_text.count("["):
            raise SelectorError(f"unsupported XPath predicate {preds_text!r}")
        steps.append(("desc" if axis == "//" else "child", Compound(name.lower(), tuple(preds))))
    if not steps:
        raise SelectorError("XPath selects no element")
    return Selector(tuple(steps), output, attr)


def parse(kind: str, selector: str) -> Selector:
    if kind == "CSS Selector":
        return parse_css(selector)
    if kind == "XPath":
        return parse_xpath(selector)
    raise SelectorError(f"extraction type {kind!r} is not evaluated")


def _matches(c: Compound, t: Column) -> Column:
    cond = t["kind"] == "open" if c.tag == "*" else (t["kind"] == "open") & (t["tag"] == c.tag)
    for kind, a, v in c.preds:
        if kind == "has":
            cond = cond & H.has_attr(t, a)
        elif kind == "eq":
            cond = cond & (H.attr(t, a) == v)
        elif kind == "contains":
            cond = cond & H.attr(t, a).contains(v)
        else:  # class
            cond = cond & F.array_contains(F.split(F.trim(H.attr(t, a)), r"\s+", -1), v)
    return cond


def _program(selectors: list[tuple[str, Selector]]) -> tuple[Column, Steps, list[int]]:
    """Own matches per token, the steps, and the bit of each selector's last step."""
    steps, last, tests = Steps(), [], []
    for kind, sel in selectors:
        for k, (comb, compound) in enumerate(sel.steps):
            bit = 1 << len(tests)
            if k:
                where = comb
            else:
                where = "root" if kind == "XPath" and comb == "child" else "anywhere"
            setattr(steps, where, getattr(steps, where) | bit)
            tests.append((bit, compound))
        last.append(bit)

    def own(t):
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(_matches(c, t), F.lit(bit)).otherwise(F.lit(0)).cast("bigint")
                                                    for bit, c in tests])

    return F.transform("_tok", own), steps, last


def _value(kind: str, sel: Selector, bit: int, sep: str) -> Column:
    """The extraction of one selector from ``_tok``, ``_texts`` and ``_tree``."""
    tree, tokens, texts = F.col("_tree"), F.col("_tok"), F.col("_texts")
    met = lambda mask: mask.bitwiseAND(F.lit(bit).cast("bigint")) != 0
    hits = F.array_compact(F.transform(tree["hits"], lambda h, k: F.when(met(h), k)))

    def text(k):
        return F.array_join(F.slice(texts, k + 2, F.greatest(F.get(tree["end"], k) - k - 1, F.lit(0))), "")

    if kind == "CSS Selector":
        first = F.get(hits, 0)
        return F.when(first.isNotNull(), collapse_ws(text(first))).otherwise(F.lit(""))
    if sel.output == "attr":
        values = F.filter(F.transform(hits, lambda k: H.attr(F.get(tokens, k), sel.attr)), lambda v: v.isNotNull())
    elif sel.output == "text":  # text tokens right inside a hit
        def inside(t, k):
            around = F.get(tree["parent"], k)
            return F.when((t["kind"] == "text") & (around >= 0), F.when(met(F.get(tree["hits"], around)), t["text"]))
        values = F.array_compact(F.transform(tokens, inside))
    else:
        values = F.transform(hits, text)
    return H.joined(values, sep)


def with_extractions(pages: DataFrame, settings: CrawlSettings, html: str = "html") -> DataFrame:
    """``pages`` with a column per custom extraction ('' where nothing is found or there is no body)."""
    chosen = [(extraction_column_name(name, []), kind, parse(kind, value)) for name, kind, value in settings.extractions]
    out = pages.withColumn("_tok", page_tokens(html)) \
        .withColumn("_texts", F.transform("_tok", lambda t: F.coalesce(t["text"], F.lit(""))))
    while chosen:
        n, used = 1, len(chosen[0][2].steps)
        if used > MOST_STEPS:
            raise SelectorError(f"a selector of more than {MOST_STEPS} steps")
        while n < len(chosen) and used + len(chosen[n][2].steps) <= MOST_STEPS:
            used += len(chosen[n][2].steps)
            n += 1
        own, steps, last = _program([(kind, sel) for _, kind, sel in chosen[:n]])
        out = out.withColumn("_tree", nesting("_tok", own, steps))
        out = out.withColumns({name: F.coalesce(_value(kind, sel, bit, settings.extraction_separator), F.lit(""))
                               for (name, kind, sel), bit in zip(chosen[:n], last, strict=True)}).drop("_tree")
        chosen = chosen[n:]
    return out.drop("_tok", "_texts")


def extraction_table(pages: DataFrame, settings: CrawlSettings, url: str = "url", html: str = "html",
                     keep: tuple = ()) -> DataFrame:
    """(url, *keep, one column per extraction) of every page row."""
    return with_extractions(pages.select(F.col(url).alias("url"), *keep, F.col(html).alias("html")), settings).drop("html")


def extract(pages: DataFrame, name: str, kind: str, selector: str, sep: str, url: str = "url", html: str = "html") -> DataFrame:
    """(url, value) of one custom extraction from every page row."""
    settings = CrawlSettings(extractions=((name, kind, selector),), extraction_separator=sep)
    return extraction_table(pages, settings, url, html)
