"""Crawl settings and the fixed values that decide output shape.

Values in the ``FIXED VALUES`` blocks must stay exactly as written: they are
the column names, item names, labels and HTTP status names a crawl table is
defined by.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES: crawl table columns, in output order (status_code is an int,
# everything else a string).  ``canonical_http_header`` is stored as a real
# column here.
CRAWL_COLUMNS = [
    "url",
    "crawl_status",
    "status_code",
    "content_type",
    "h1",
    "h2",
    "page_title",
    "meta_description",
    "canonical_tag",
    "robots_txt",
    "redirect_url",
    "meta_robots",
    "x_robots_tag",
    "canonical_http_header",
]

# FIXED VALUES: default crawl items (output columns plus switches).
DEFAULT_CRAWL_ITEMS = [
    "url",
    "crawl_status",
    "status_code",
    "content_type",
    "page_title",
    "meta_description",
    "h1",
    "unique_inlinks",
    "respect_nofollow",
    "canonicals",
    "canonical_tag",
    "pagination",
    "hreflang",
    "canonical_http_header",
    "robots_txt",
    "redirect_url",
    "meta_robots",
    "x_robots_tag",
    "respect_robots_txt",
    "report_on_status",
    "follow_blocked_redirects",
]

# FIXED VALUES: the filter dialog operators and sort labels.
FILTER_OPERATORS = [
    "Equals",
    "Does Not Equal",
    "Begins With",
    "Ends With",
    "Contains",
    "Does Not Contain",
    "Greater Than",
    "Greater Than Or Equal To",
    "Less Than",
    "Less Than Or Equal To",
]
SORT_ASC = ["Sort A-Z", "Sort Smallest To Largest"]
SORT_DESC = ["Sort Z-A", "Sort Largest To Smallest"]

# FIXED VALUES: exclusion rule operators.
EXCLUSION_OPERATORS = ["Equal to (=)", "Contain", "Start with", "End with", "Regex match"]

# FIXED VALUES: custom extraction types that are evaluated.
EXTRACTION_TYPES = ["CSS Selector", "XPath"]

# FIXED VALUES: HTTP status code -> first registered name (underscores
# already turned into spaces).  Codes outside this table read
# "non-standard response".
STATUS_NAMES = {
    100: "continue",
    101: "switching protocols",
    102: "processing",
    103: "checkpoint",
    122: "uri too long",
    200: "ok",
    201: "created",
    202: "accepted",
    203: "non authoritative info",
    204: "no content",
    205: "reset content",
    206: "partial content",
    207: "multi status",
    208: "already reported",
    226: "im used",
    300: "multiple choices",
    301: "moved permanently",
    302: "found",
    303: "see other",
    304: "not modified",
    305: "use proxy",
    306: "switch proxy",
    307: "temporary redirect",
    308: "permanent redirect",
    400: "bad request",
    401: "unauthorized",
    402: "payment required",
    403: "forbidden",
    404: "not found",
    405: "method not allowed",
    406: "not acceptable",
    407: "proxy authentication required",
    408: "request timeout",
    409: "conflict",
    410: "gone",
    411: "length required",
    412: "precondition failed",
    413: "request entity too large",
    414: "request uri too large",
    415: "unsupported media type",
    416: "requested range not satisfiable",
    417: "expectation failed",
    418: "im a teapot",
    421: "misdirected request",
    422: "unprocessable entity",
    423: "locked",
    424: "failed dependency",
    425: "unordered collection",
    426: "upgrade required",
    428: "precondition required",
    429: "too many requests",
    431: "header fields too large",
    444: "no response",
    449: "retry with",
    450: "blocked by windows parental controls",
    451: "unavailable for legal reasons",
    499: "client closed request",
    500: "internal server error",
    501: "not implemented",
    502: "bad gateway",
    503: "service unavailable",
    504: "gateway timeout",
    505: "http version not supported",
    506: "variant also negotiates",
    507: "insufficient storage",
    509: "bandwidth limit exceeded",
    510: "not extended",
    511: "network authentication required",
}
NON_STANDARD = "non-standard response"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CrawlSettings:
    """Everything that changes what a crawl produces.

    ``root_domain=None`` means "each page is its own site": the domain of the
    page a link was found on is the root it is compared against.  That is the
    multi-site generalisation of a single-site crawl.
    """

    mode: str = "Spider"
    crawl_items: tuple = tuple(DEFAULT_CRAWL_ITEMS)
    extraction_separator: str = " | "
    # short agent name used for robots groups and agent-specific meta robots
    agent: str = "Googlebot"
    user_agent: str = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"
    root_domain: str | None = None
    starting_url: str | None = None
    exclusions: tuple = ()
    extractions: tuple = ()
    max_retries: int = 5
    extra: dict = field(default_factory=dict)

    def has(self, item: str) -> bool:
        return item in self.crawl_items

    @property
    def spider(self) -> bool:
        return "Spider" in self.mode

    @property
    def list_mode(self) -> bool:
        return self.mode == "List"

    def with_items(self, *add: str, drop: tuple = ()) -> "CrawlSettings":
        items = [i for i in self.crawl_items if i not in drop]
        items += [a for a in add if a not in items]
        return replace(self, crawl_items=tuple(items))

    def output_columns(self) -> list[str]:
        """Enabled crawl columns in fixed order, then extraction columns."""
        cols = [c for c in CRAWL_COLUMNS if c in self.crawl_items]
        return cols + [extraction_column_name(n, cols) for n, _, _ in self.extractions]

    def as_rows(self) -> list[tuple[str, str]]:
        """(setting, value) rows for the config table; passwords never stored."""
        rows = [
            ("MODE", self.mode),
            ("CRAWL_ITEMS", ", ".join(self.crawl_items)),
            ("EXTRACTION_SEPARATOR", self.extraction_separator),
            ("UA_SHORT", self.agent),
            ("USER_AGENT", self.user_agent),
            ("MAX_RETRIES", str(self.max_retries)),
        ]
        if self.root_domain is not None:
            rows.append(("ROOT_DOMAIN", self.root_domain))
        if self.starting_url is not None:
            rows.append(("STARTING_URL", self.starting_url))
        rows += [(k, str(v)) for k, v in self.extra.items()]
        return [(k, v) for k, v in rows if not k.upper().endswith("_PASSWORD")]


def extraction_column_name(name: str, existing: list[str]) -> str:
    """Lower-case, spaces to ``_``; ``_custom`` appended on a clash."""
    col = name.strip().lower().replace(" ", "_")
    if col in existing or col in CRAWL_COLUMNS:
        col = f"{col}_custom"
    return col
