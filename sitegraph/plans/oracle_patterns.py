"""Patterns and constants of the DuckDB oracles, stated on their own: nothing here
comes from the operators, so an error in one of their patterns shows as a difference."""

# FIXED VALUES: URL parts (scheme, authority, path, query, fragment).
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
HAS_QUERY = r"^[^#]*\?"
STRIP_ANYWHERE = r"[\t\r\n]"
UNRESERVED = r"^[A-Za-z0-9._~\-]$"
PATH_SAFE = r"A-Za-z0-9\-._~!$&'()*+,;=:@/"
QUERY_SAFE = r"A-Za-z0-9\-._~!$&'()*+,;=:@/?"
# White space as Python's str.split() sees it.
WS_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# FIXED VALUES: entity -> character, for the entities of the given pages (``&amp;`` last).
ENTITIES = [
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

# HTML as the given pages write it: attribute values without '>', headings with one
# level of markup.  The cases beyond that are expected values in tests/test_html_cases.py.
MARK = "\u0001"
RE_SCRIPT_BODY = r"(?is)(<script\b[^>]*>).*?</script\s*>"
RE_STYLE_BODY = r"(?is)(<style\b[^>]*>).*?</style\s*>"
RE_HEAD = r"(?is)^(.*?)(?:</head\s*>|<body\b)"
RE_CHILD = r"(?is)<([a-z][a-z0-9]*)\b[^>]*>[^<]*</[a-z][a-z0-9]*\s*>"
RE_ANY_TAG = r"(?s)<[^>]*>"
RE_TOKEN = r"(?s)<[^>]*>|[^<]+"
RE_TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"
# FIXED VALUES: HTML void elements.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr"]

# FIXED VALUES: HTML's optional end tags: start tag -> what it ends, and what bounds the search.
ENDED_BY = {
    "li": (["li"], ["ul", "ol", "menu"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]),
    "td": (["td", "th"], ["table"]), "th": (["td", "th"], ["table"]), "tr": (["tr", "td", "th"], ["table"]),
    "option": (["option"], ["select", "datalist"]), "optgroup": (["option", "optgroup"], ["select", "datalist"]),
    "body": (["head"], []),
    **{t: (["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"], ["table"]) for t in ("thead", "tbody", "tfoot")},
    **{t: (["p"], ["table", "td", "th", "caption", "button", "object"]) for t in (
        "address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure",
        "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
        "section", "table", "ul")},
}
# FIXED VALUES: weights of elements (100 where not given): an end tag does not leave a heavier one.
WEIGHTS = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
           "head": 200, "body": 200, "html": 220}

RE_AGENT = r"(?i)^user-agent\s*:"
RE_ALLOW = r"(?i)^allow\s*:"
RE_DISALLOW = r"(?i)^disallow\s*:"


def tag_re(name: str) -> str:
    return rf"(?i)<{name}\b[^>]*>"


def element_re(name: str) -> str:
    return rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"


def start_split_re(name: str) -> str:
    return rf"(?i)<{name}\b"


def piece_re(name: str) -> str:
    return rf"(?is)^[^>]*>(.*?)</{name}\s*>"


def attr_re(name: str) -> str:
    return rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def has_attr_re(name: str) -> str:
    return rf"(?is)\s{name}(?:\s*=|[\s/>])"
