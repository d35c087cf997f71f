"""Page extraction as Column expressions over an ``html`` string column.

There is no HTML parser on the executors, so markup is read with Java regular
expressions that take a page from left to right:

* comments are removed and the bodies of ``script`` / ``style`` emptied in one
  pass in document order (``clean``): whichever starts first wins, a ``<!--`` in
  a script or in an attribute value is no comment, and a script or comment never
  closed runs to the end of the page;
* the head is the text before ``</head>`` or ``<body`` (whole page if
  neither), ``/html/head/...`` selectors look there, ``//...`` selectors in
  the whole page;
* a tag is its name followed by white space, ``/`` or ``>``, then anything up to
  the first ``>`` outside quoted attribute values; it is parsed once into its name
  and its attributes from left to right (``parsed``), which the extractors look up:
  the first of a name counts; names are case-insensitive, values are compared
  case-sensitively, as XPath does;
* "direct text" of an element: a stack of open elements runs over its tokens;
  text outside any child counts, every tag starts a new entry; an end tag closes
  the innermost element of its name and is ignored if there is none;
* numeric entities and the named ones of HTML 4 are decoded in one pass.

Patterns use possessive repeats wherever going back cannot help, so the cost is
linear in the page.  Approximation (documented in the README): an element that is
never closed has no text.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.text import clean_list

NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

#: The rest of a tag after its name: quoted attribute values may hold ">".
REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
END_OF_NAME = r"(?=[\s/>])"
RE_SKIP = (rf"(?is)(<script{END_OF_NAME}{REST}>)(?:.*?(?=</script[\s/>])|.*+)"
           rf"|(<style{END_OF_NAME}{REST}>)(?:.*?(?=</style[\s/>])|.*+)"
           rf"|<!--(?:.*?-->|.*+)|(</?[a-z]{REST}(?:>|\z))")
RE_HEAD = r"(?is)^(.*?)(?:</head\s*>|<body\b)"
RE_TOKEN = rf"(?is)</?[a-z]{REST}(?:>|\z)|<[!?/][^>]*+(?:>|\z)|[^<]++|<"
RE_TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9:_-]*)"
RE_ENTITY = r"&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]*;|[^&]++|&"
# FIXED VALUES: HTML void elements (never have an end tag).
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr"]


def is_void(tag: Column) -> Column:
    return F.array_contains(F.split(F.lit(" ".join(VOID_TAGS)), " "), tag)


def tag_re(name: str) -> str:
    return rf"(?i)<{name}{END_OF_NAME}{REST}(?:>|\z)"


def start_split_re(name: str) -> str:
    return rf"(?i)<{name}{END_OF_NAME}"


def piece_re(name: str) -> str:
    """Inside the text that follows one start tag: rest of the tag, then the
    content up to the first end tag."""
    return rf"(?is)^{REST}>(.*?)</{name}\s*+>"


def element_contents(segment, name: str) -> Column:
    """Inner markup of every ``name`` element that has an end tag, in order.

    The markup is split at each start tag first and the end tag is searched
    only inside its own piece, so the cost is linear in the page even when a
    page opens thousands of elements it never closes (a lazy scan from every
    start tag to the page end would be quadratic).  A start tag also ends the
    previous element of the same name."""
    parts = F.split(_c(segment), start_split_re(name), -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    closed = F.filter(rest, lambda p: p.rlike(piece_re(name)))
    return F.transform(closed, lambda p: F.regexp_extract(p, piece_re(name), 1))


#: One attribute: its name, then its value if it has one (quotes included).  The first match
#: takes the tag's name along.
RE_ATTR = r"""(?s)(?:^<[^\s/>]++)?+[\s/]*+([^\s=/>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _character(code: Column) -> Column:
    """The character of a code point (U+FFFD for none)."""
    ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(0xFFFD)).cast("bigint")), 8, "0")), "UTF-32")


def decode_entities(s: Column) -> Column:
    """Numeric and named entities decoded in one pass (so ``&amp;lt;`` is ``&lt;``)."""
    # two literals, made one map constant when the query is planned
    named = F.map_from_arrays(F.split(F.lit(" ".join(NAMED_ENTITIES)), " "), F.split(F.lit(" ".join(NAMED_ENTITIES.values())), " "))

    def one(t):
        digits = F.regexp_extract(t, r"^&#[xX]?([0-9A-Fa-f]+)", 1)
        code = F.when(t.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        return F.when(t.rlike("^&#[0-9xX]"), _character(code)).otherwise(
            F.when(t.rlike("^&[A-Za-z]"), F.coalesce(F.try_element_at(named, F.rtrim(F.substring(t, 2, 99), F.lit(";"))), t))
            .otherwise(t))

    tokens = F.regexp_extract_all(s, F.lit(RE_ENTITY), F.lit(0))
    return F.when(s.contains("&"), F.array_join(F.transform(tokens, one), "")).otherwise(s)


def clean(html) -> Column:
    """Comments removed, script/style bodies emptied, in document order."""
    return F.regexp_replace(_c(html), RE_SKIP, "$1$2$3")


def head(cleaned) -> Column:
    c = _c(cleaned)
    return F.when(c.rlike(RE_HEAD), F.regexp_extract(c, RE_HEAD, 1)).otherwise(c)


def tags(segment, name: str) -> Column:
    """All start tags ``<name ...>`` in document order."""
    return _whole(F.regexp_extract_all(_c(segment), F.lit(tag_re(name)), F.lit(0)))


def _whole(tag_array: Column) -> Column:
    """Tags that the page ends in are no tags; patterns take them along so that no
    part of the page is read twice."""
    return F.filter(tag_array, lambda t: t.endswith(">"))


# FIXED VALUES: start tags collected in one pass over the page / the head.
PAGE_TAGS = ["a", "link", "img", "script", "meta"]
HEAD_TAGS = ["link", "base", "meta"]


def multi_tag_re(names: list[str]) -> str:
    return r"(?i)<(?:" + "|".join(names) + rf"){END_OF_NAME}{REST}(?:>|\z)"


def start_tags(segment, names: list[str]) -> Column:
    """Start tags of several kinds in one pass over the markup, document order, each
    parsed once.  Tags never overlap, so filtering this by name equals a pass per kind."""
    return F.transform(_whole(F.regexp_extract_all(_c(segment), F.lit(multi_tag_re(names)), F.lit(0))), parsed)


def parsed(tag: Column) -> Column:
    """A start tag as (tag, names, values): its lower-case name, and the names and
    entity-decoded values of its attributes ('' without a value)."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(RE_ATTR), F.lit(1)), F.lower)

    def value(v):
        quoted = (F.length(v) >= 2) & (v.startswith('"') & v.endswith('"') | v.startswith("'") & v.endswith("'"))
        return decode_entities(F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))

    return F.struct(F.lower(F.regexp_extract(tag, RE_TAG_NAME, 1)).alias("tag"), names.alias("names"),
                    F.transform(F.regexp_extract_all(tag, F.lit(RE_ATTR), F.lit(2)), value).alias("values"))


def of_kind(tag_array, name: str) -> Column:
    """The tags of one element name out of a mixed tag array."""
    return F.filter(_c(tag_array), lambda t: t["tag"] == name)


def attr(tag: Column, name: str) -> Column:
    """Value of a parsed tag's attribute (null when absent)."""
    return F.get(tag["values"], (F.array_position(tag["names"], name) - 1).cast("int"))


def has_attr(tag: Column, name: str) -> Column:
    return F.array_contains(tag["names"], name)


def attr_values(tag_array: Column, name: str, where=None) -> Column:
    """``attr`` of every tag that has it (and satisfies ``where``)."""
    chosen = tag_array if where is None else F.filter(tag_array, where)
    return F.filter(F.transform(chosen, lambda t: attr(t, name)), lambda v: v.isNotNull())


def direct_texts(segment, name: str) -> Column:
    """Direct text entries of every ``name`` element, raw (not cleaned)."""
    strings = F.array().cast("array<string>")
    start = F.struct(strings.alias("open"), strings.alias("texts"), F.lit("").alias("text"))

    def step(acc, t):
        tag = F.lower(F.regexp_extract(t, RE_TAG_NAME, 1))
        at = F.array_position(acc["open"], tag)
        opened = F.when(t.startswith("</"), F.when(at > 0, F.slice(acc["open"], (at + 1).cast("int"), F.size(acc["open"])))
                        .otherwise(acc["open"])) \
            .otherwise(F.when(is_void(tag) | t.endswith("/>"), acc["open"])
                       .otherwise(F.concat(F.array(tag), acc["open"])))
        top = F.size(acc["open"]) == 0
        at_tag = F.struct(opened.alias("open"),
                          F.when(top, F.concat(acc["texts"], F.array(acc["text"]))).otherwise(acc["texts"]).alias("texts"),
                          F.when(top, F.lit("")).otherwise(acc["text"]).alias("text"))
        at_text = F.struct(acc["open"].alias("open"), acc["texts"].alias("texts"),
                           F.when(top & ~t.rlike("(?s)^<[!?/]"), F.concat(acc["text"], t)).otherwise(acc["text"]).alias("text"))
        return F.when(t.rlike("(?is)^</?[a-z]"), at_tag).otherwise(at_text)

    def split_text(x):
        tokens = F.regexp_extract_all(x, F.lit(RE_TOKEN), F.lit(0))
        texts = F.aggregate(tokens, start, step, lambda acc: F.concat(acc["texts"], F.array(acc["text"])))
        return F.transform(texts, decode_entities)

    return F.flatten(F.transform(element_contents(segment, name), split_text))


def joined(arr: Column, sep: str) -> Column:
    return F.array_join(clean_list(arr), sep)


# -- link kinds ---------------------------------------------------------------

def rel_is(value: str):
    return lambda t: attr(t, "rel") == value


def anchor_hrefs(page_tags) -> Column:
    return attr_values(of_kind(page_tags, "a"), "href")


def anchor_hrefs_follow(page_tags) -> Column:
    no_nofollow = lambda t: ~F.coalesce(attr(t, "rel").contains("nofollow"), F.lit(False))
    return attr_values(of_kind(page_tags, "a"), "href", no_nofollow)


def canonical_hrefs(head_tags) -> Column:
    return attr_values(of_kind(head_tags, "link"), "href", rel_is("canonical"))


def hreflang_hrefs(head_tags) -> Column:
    return attr_values(of_kind(head_tags, "link"), "href",
                       lambda t: rel_is("alternate")(t) & has_attr(t, "hreflang"))


def pagination_hrefs(head_tags) -> Column:
    return attr_values(of_kind(head_tags, "link"), "href", lambda t: rel_is("next")(t) | rel_is("prev")(t))


def image_srcs(page_tags) -> Column:
    return attr_values(of_kind(page_tags, "img"), "src")


def stylesheet_hrefs(page_tags) -> Column:
    return attr_values(of_kind(page_tags, "link"), "href", rel_is("stylesheet"))


def script_srcs(page_tags) -> Column:
    return attr_values(of_kind(page_tags, "script"), "src")


def base_hrefs(head_tags) -> Column:
    return attr_values(of_kind(head_tags, "base"), "href")


# -- on-page items ------------------------------------------------------------

def meta_contents(page_tags, name_value: str) -> Column:
    return attr_values(of_kind(page_tags, "meta"), "content",
                       lambda t: attr(t, "name") == name_value)


def meta_description(head_tags, sep: str) -> Column:
    return joined(meta_contents(head_tags, "description"), sep)


def meta_robots(page_tags, agent: str) -> Column:
    """Contents of the first meta whose lower-case name is contained in the
    agent name, then of ``name="robots"``, joined by ``', '``."""
    metas = of_kind(page_tags, "meta")
    names = attr_values(metas, "name")
    agent_l = F.lit(agent.lower())
    ua = F.get(F.filter(names, lambda n: agent_l.contains(F.lower(n))), 0)
    ua_rules = attr_values(metas, "content", lambda t: attr(t, "name") == ua)
    ua_rules = F.coalesce(ua_rules, F.array().cast("array<string>"))
    robots = meta_contents(page_tags, "robots")
    return F.array_join(F.concat(ua_rules, robots), ", ")


def canonical_header(link_header) -> Column:
    """``Link`` header containing ``rel=`` -> part before the first ``;``
    without angle brackets; else ''."""
    h = F.coalesce(_c(link_header), F.lit(""))
    first = F.split_part(h, F.lit(";"), F.lit(1))
    return F.when(h.contains("rel="), F.translate(first, "<>", "")).otherwise(F.lit(""))
