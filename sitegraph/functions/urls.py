"""URL columns: parse, resolve, normalise, domain, robots address, predicates.

Every function maps Columns to a Column built from regexp / higher-order
functions, so a whole link table is processed inside codegen with no Python
UDF.  Behaviour follows the crawler being re-expressed:

* ``resolve(base, href)``: reference resolution as Python's ``urljoin`` does
  it (left-trimmed href; scheme-relative, absolute-path, query-only,
  fragment-only and relative paths; dot segments removed, empty middle
  segments dropped on a merge).
* ``normalise(url)``: lower-case scheme and host, hosts beyond ASCII in their ``xn--``
  form, default port removed, dot
  segments removed, path and query percent-encoded (see ``percent_encode``),
  empty path -> ``/``, userinfo kept, fragment dropped; NULL when there is no
  host or the port is not a number in 0..65535.
"""

from __future__ import annotations

from functools import lru_cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.idna import ascii_host
from sitegraph.functions.text import WS_CLASS

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
URL_RE = r"(?s)^(?:(" + SCHEME + r"):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
HAS_SCHEME = r"^" + SCHEME + r":"
HAS_AUTHORITY = r"^(?:" + SCHEME + r":)?//"
HAS_QUERY = r"^[^#]*\?"

# Characters kept as they are in a path / query (RFC 3986 unreserved,
# sub-delims, ':' '@' '/', and '?' for queries); '%' is handled on its own.
PATH_SAFE = r"A-Za-z0-9\-._~!$&'()*+,;=:@/"
QUERY_SAFE = PATH_SAFE + "?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions below refer to their input many times (one regex per URL
    part); binding a computed input to a variable keeps the expression tree
    linear instead of multiplying it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Stands between the pieces of a URL while it is taken apart (in no URL that a page can hold as text).
_CUT = "\u0001\uffff\u0001"


def once_per_name(build):
    """Expressions over column names alone are built once per process (a build is some hundred
    calls to the JVM)."""
    kept = lru_cache(maxsize=64)(build)

    @wraps(build)
    def call(url, base=None):
        args = (url,) if base is None else (url, base)
        return (kept if all(isinstance(a, str) for a in args) else build)(*args)
    return call


def parts(url) -> Column:
    """Components of a URL as a struct (strings; '' when absent), by one match of URL_RE.
    Bind it with ``let`` before its fields are used."""
    def fields(x):
        v, a, auth = x["u"], x["a"], F.get(x["a"], 1)
        hostport = F.regexp_replace(auth, r"^.*@", "")
        return F.struct(
            F.get(a, 0).alias("scheme"), v.rlike(HAS_AUTHORITY).alias("has_authority"), auth.alias("authority"),
            F.regexp_extract(auth, r"^(.*)@", 1).alias("userinfo"), auth.contains("@").alias("has_userinfo"),
            F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1).alias("host"),
            F.regexp_extract(hostport, r"^(?>\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port"),
            F.get(a, 2).alias("path"), F.get(a, 3).alias("query"), v.rlike(HAS_QUERY).alias("has_query"),
            F.get(a, 4).alias("fragment"))

    def cut(v):
        pieces = F.split(F.regexp_replace(v, URL_RE, _CUT.join(f"${k}" for k in range(1, 6))), _CUT, 5)
        return F.struct(v.alias("u"), pieces.alias("a"))

    return let(let(_c(url), cut), fields)


@once_per_name
def host(url) -> Column:
    """Lower-cased host as a lenient parser sees it: a string with no scheme
    and no leading ``/`` is read as ``//`` + string (so ``page.html`` has host
    ``page.html``)."""
    u = _c(url)
    u = F.when(u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+\-]*:|/)"), u).otherwise(F.concat(F.lit("//"), u))
    return let(F.lower(parts(u)["host"]), ascii_host)


def _port_ok(port: Column) -> Column:
    return (port == "") | (port.rlike(r"^[0-9]{1,5}$") & (port.try_cast("int") <= 65535))


@once_per_name
def domain(url) -> Column:
    """Host without one leading ``www.``; '' when there is none or it is unparsable."""
    u = _c(url)
    u2 = F.when(u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+\-]*:|/)"), u).otherwise(F.concat(F.lit("//"), u))

    def dom(p, h):
        ok = h.isNotNull() & _port_ok(p["port"]) & ~h.rlike(WS_CLASS)
        return F.when(ok, F.regexp_replace(h, r"^www\.", "")).otherwise(F.lit(""))

    return let(parts(u2), lambda p: let(ascii_host(F.lower(p["host"])), lambda h: dom(p, h)))


def remove_dot_segments(path: Column, drop_empty_middle: bool = False) -> Column:
    """Resolve ``.`` and ``..`` segments.

    ``drop_empty_middle=True`` is the merge rule of ``urljoin`` (empty middle
    segments vanish, a ``..`` may pop the root, the leading ``/`` is restored
    by the caller); ``False`` is the parser's rule (root kept)."""
    def short(p):
        work = p.contains("/.") | ~p.startswith("/")
        if drop_empty_middle:
            work = work | p.contains("//")
        return F.when(work, _remove_dots(p, drop_empty_middle)).otherwise(p)

    return let(path, short)


def _remove_dots(path: Column, drop_empty_middle: bool) -> Column:
    segs = F.split(path, "/", -1)
    if drop_empty_middle:
        n = F.size(segs)
        middle = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
        segs = F.when(n >= 2, F.concat(F.slice(segs, 1, 1), middle, F.slice(segs, -1, 1))).otherwise(segs)

    def step(acc, s):
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", popped).otherwise(F.concat(acc, F.array(s)))

    out = F.aggregate(segs, _empty_str_array(), step)
    if drop_empty_middle:
        last = F.element_at(segs, -1)
        out = F.when(last.isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
        return F.array_join(out, "/")
    first = F.get(out, 0)
    out = F.when(path.startswith("/") & (first.isNull() | (first != "")),
                 F.concat(F.array(F.lit("")), out)).otherwise(out)
    out = F.when(path.endswith("/.") | path.endswith("/.."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    return F.array_join(out, "/")


def _lead_slash(p: Column) -> Column:
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


STRIP_ANYWHERE = r"[\t\r\n]"  # removed from URLs before splitting, as Python's URL parser does


def resolve(base, href) -> Column:
    """Resolve ``href`` (left-trimmed, tab/CR/LF removed) against the absolute URL ``base``."""
    return let(base_parts(base), lambda b: resolve_at(b, href))


def base_parts(base) -> Column:
    """What ``resolve_at`` needs of a base URL: taken apart once for all links of a page."""
    return F.struct(_c(base).alias("url"), parts(base).alias("p"))


def resolve_at(base: Column, href) -> Column:
    """``resolve`` against a base taken apart by ``base_parts``."""
    h = F.regexp_replace(F.regexp_replace(_c(href), STRIP_ANYWHERE, ""), "^" + WS_CLASS + "+", "")
    return let(h, lambda v: _resolve(base["url"], base["p"], v))


def _resolve(base: Column, b: Column, h: Column) -> Column:
    b_root = F.concat(b["scheme"], F.lit("://"), b["authority"])
    b_noquery = F.concat(b_root, b["path"])
    b_nofrag = F.concat(b_noquery, F.when(b["has_query"], F.concat(F.lit("?"), b["query"])).otherwise(F.lit("")))
    h_rest = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
    h_path = F.regexp_extract(h, r"(?s)^([^?#]*)", 1)  # read where h has no scheme and no host
    base_dir = F.regexp_extract(b["path"], r"^(.*/)", 1)
    merged = F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), h_path)
    return (
        F.when(h.rlike(HAS_SCHEME), h)
        .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
        .when(h == "", base)
        .when(h.startswith("#"), F.concat(b_nofrag, h))
        .when(h.startswith("?"), F.concat(b_noquery, h))
        .when(h.startswith("/"), F.concat(b_root, _lead_slash(remove_dot_segments(h_path, True)), h_rest))
        .otherwise(F.concat(b_root, _lead_slash(remove_dot_segments(merged, True)), h_rest))
    )


UNRESERVED = r"^[A-Za-z0-9._~\-]$"


def _escape_char(t: Column) -> Column:
    """The character a ``%XX`` token stands for (ASCII range only)."""
    return F.call_function("chr", F.conv(F.substring(t, 2, 2), 16, 10).cast("int"))


def percent_encode(s: Column, safe: str) -> Column:
    """Percent-encode one URL component the way the crawler's URL stack does:

    * every character outside ``safe`` becomes UTF-8 ``%XX``;
    * a component with a stray ``%`` (not followed by two hex digits) gets
      every ``%`` encoded as ``%25`` (existing escapes included);
    * otherwise existing escapes are upper-cased, and escapes of unreserved
      characters (letters, digits, ``-._~``) are decoded."""
    return let(s, lambda v: F.when(v.rlike(f"^[{safe}]*+\\z"), v).otherwise(_percent_encode(v, safe)))


def _percent_encode(s: Column, safe: str) -> Column:
    tokens = F.regexp_extract_all(
        s, F.lit(f"[{safe}]+|%[0-9A-Fa-f]{{2}}|%|[^{safe}%]+"), F.lit(0))
    n_pct = F.length(s) - F.length(F.replace(s, F.lit("%"), F.lit("")))
    n_esc = F.size(F.regexp_extract_all(s, F.lit("%[0-9A-Fa-f]{2}"), F.lit(0)))
    stray = n_pct != n_esc

    def enc(t):
        escape = t.rlike("^%[0-9A-Fa-f]{2}$")
        ch = _escape_char(t)
        return (F.when(escape & stray, F.concat(F.lit("%25"), F.substring(t, 2, 2)))
                .when(escape & ch.rlike(UNRESERVED), ch)
                .when(escape, F.upper(t))
                .when(t == "%", F.lit("%25"))
                .when(t.rlike(f"^[{safe}]"), t)
                .otherwise(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))))

    return F.array_join(F.transform(tokens, enc), "")


@once_per_name
def normalise(url, base=None) -> Column:
    """Clean a URL (optionally resolving it against ``base`` first)."""
    u = F.regexp_replace(F.regexp_replace(_c(url), STRIP_ANYWHERE, ""), "^" + WS_CLASS + "+", "")
    if base is not None:
        u = resolve(base, u)
    return let(parts(u), _normalise)


def _normalise(p: Column) -> Column:
    return let(ascii_host(F.lower(p["host"])), lambda h: _joined(p, h))


def _joined(p: Column, h: Column) -> Column:
    scheme = F.lower(p["scheme"])
    port_num = p["port"].try_cast("int")
    default_port = (((scheme == "http") & (port_num == 80)) | ((scheme == "https") & (port_num == 443)))
    port = F.when((p["port"] == "") | default_port, F.lit("")).otherwise(
        F.concat(F.lit(":"), port_num.cast("string")))
    userinfo = F.when(p["has_userinfo"], F.concat(p["userinfo"], F.lit("@"))).otherwise(F.lit(""))
    path = let(percent_encode(remove_dot_segments(p["path"]), PATH_SAFE),
               lambda x: F.when(x == "", F.lit("/")).otherwise(_lead_slash(x)))
    query = let(percent_encode(p["query"], QUERY_SAFE),
                lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    out = F.concat(scheme, F.lit("://"), userinfo, h, port, path, query)
    ok = p["has_authority"] & (h != "") & _port_ok(p["port"]) & ~h.rlike(WS_CLASS) & (scheme != "")
    return F.when(ok, out)


@once_per_name
def robots_url(url) -> Column:
    """``scheme://host/robots.txt`` of a URL (no port, no query)."""
    return let(parts(url), lambda p: let(ascii_host(F.lower(p["host"])), lambda h: F.when(
        h != "", F.concat(F.lower(p["scheme"]), F.lit("://"), h, F.lit("/robots.txt")))))


def path_and_query(url) -> Column:
    """Path plus ``?query`` (the part robots rules are matched against)."""
    return let(parts(url), lambda p: F.concat(
        p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))))


def is_external(url, root_domain, list_mode: bool = False) -> Column:
    """Domain differs from the root domain; never in List mode or without host."""
    if list_mode:
        return F.lit(False)
    root = F.lit(root_domain) if isinstance(root_domain, str) else root_domain
    return let(domain(url), lambda d: (d != "") & (d != root))


def is_crawlable(url) -> Column:
    """http(s) scheme with a non-empty host."""
    return let(parts(url), lambda p: F.lower(p["scheme"]).isin("http", "https") & p["has_authority"] & (p["host"] != ""))


def normal_domain(url) -> Column:
    """``domain`` of a normalised URL, whose scheme and host are plain to see."""
    return F.regexp_extract(_c(url), r"^[^:/]++://(?:[^/?#]*@)?(?:www\.)?(\[[^\]]*\]|[^:/?#]*+)", 1)


def is_normal_crawlable(url) -> Column:
    """``is_crawlable`` of a normalised URL."""
    return _c(url).startswith("http://") | _c(url).startswith("https://")


def is_robots_page(url, root_domain, list_mode: bool = False) -> Column:
    """Internal URL whose path is ``/robots.txt``."""
    return ~is_external(url, root_domain, list_mode) & (parts(url)["path"] == "/robots.txt")


def start_url(raw) -> Column:
    """Repair a typed start URL: trim, default ``http://``, reject an empty
    host or a space in the host (NULL), then normalise."""
    u = F.trim(_c(raw))
    u = F.when(u.rlike(HAS_SCHEME), u).otherwise(F.concat(F.lit("http://"), u))

    def repair(v):
        p = parts(v)
        bad = (~p["has_authority"]) | (p["authority"] == "") | p["authority"].contains(" ")
        return F.when(~bad, normalise(v))

    return let(u, repair)


def list_url_ok(line) -> Column:
    """A URL-list line with both a scheme and a network location."""
    u = F.regexp_replace(_c(line), "^[\\x{00}-\\x{20}]+", "")
    return u.rlike(r"^" + SCHEME + r"://[^/?#]")
