"""Reusable SQL fragments for the DuckDB oracle queries."""

from __future__ import annotations

from sitegraph.settings import NON_STANDARD, STATUS_NAMES


def status_names_sql() -> str:
    """The status-name table as an inline VALUES list (for SQL oracles)."""
    rows = ", ".join(f"({k}, '{v}')" for k, v in STATUS_NAMES.items())
    return f"(VALUES {rows}) AS sn(code, name)"


def crawl_status_sql(alias: str = "c", url="url", status_code="status_code",
                     x_robots_tag="x_robots_tag", robots_txt="robots_txt",
                     meta_robots="meta_robots", canonical_tag="canonical_tag",
                     canonical_http_header="canonical_http_header", text=None) -> str:
    """SQL form of :func:`crawl_status` (DuckDB), given the status text expr."""
    def v(c):
        return "''" if c is None else f"coalesce({alias}.{c}, '')"

    u = f"{alias}.{url}"
    flags = [
        f"CASE WHEN contains({v(x_robots_tag)}, 'noindex') THEN 'blocked by x-robots-tag' END",
        f"CASE WHEN contains({v(robots_txt)}, 'blocked') THEN 'blocked by robots.txt' END",
        f"CASE WHEN contains({v(meta_robots)}, 'noindex') THEN 'noindex' END",
        f"CASE WHEN {v(canonical_tag)} <> '' AND {v(canonical_tag)} <> {u} THEN 'canonicalised' END",
        f"CASE WHEN {v(canonical_http_header)} <> '' AND {v(canonical_http_header)} <> {u} THEN 'header canonicalised' END",
    ]
    text = text or f"coalesce((SELECT name FROM {status_names_sql()} WHERE sn.code = {alias}.{status_code}), '{NON_STANDARD}')"
    any_flag = " OR ".join(f"({f}) IS NOT NULL" for f in flags)
    head = f"CASE WHEN NOT (({text}) = 'ok' AND ({any_flag})) THEN {text} END"
    return (f"CASE WHEN {alias}.{status_code} IS NOT NULL THEN concat_ws(', ', {head}, "
            + ", ".join(flags) + ") END")


# ---------------------------------------------------------------------------
# Text and URL expressions in DuckDB SQL.  Each takes SQL expression text.

from sitegraph.plans import oracle_patterns as U  # noqa: E402
from sitegraph.plans.oracle_patterns import WS_CLASS  # noqa: E402


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def rx_extract(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, {group})"


def rx_replace(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


def collapse_ws_sql(e: str) -> str:
    return f"trim({rx_replace(e, WS_CLASS + '+', ' ')})"


def clean_list_sql(arr: str) -> str:
    return f"list_filter(list_transform({arr}, lambda x: {collapse_ws_sql('x')}), lambda x: x <> '')"


def url_parts_sql(u: str) -> dict:
    auth = rx_extract(u, U.URL_RE, 2)
    hostport = rx_replace(auth, r"^.*@", "")
    return {
        "scheme": rx_extract(u, U.URL_RE, 1),
        "has_authority": rx(u, U.HAS_AUTHORITY),
        "authority": auth,
        "userinfo": rx_extract(auth, r"^(.*)@", 1),
        "has_userinfo": f"contains({auth}, '@')",
        "host": rx_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1),
        "port": rx_extract(hostport, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1),
        "path": rx_extract(u, U.URL_RE, 3),
        "query": rx_extract(u, U.URL_RE, 4),
        "has_query": rx(u, U.HAS_QUERY),
    }


def _lenient(u: str) -> str:
    return f"CASE WHEN {rx(u, r'^(?:[a-zA-Z][a-zA-Z0-9+\-]*:|/)')} THEN {u} ELSE '//' || {u} END"


def port_ok_sql(port: str) -> str:
    return (f"({port} = '' OR ({rx(port, r'^[0-9]{1,5}$')} AND TRY_CAST({port} AS INTEGER) <= 65535))")


def host_sql(u: str) -> str:
    return f"lower({url_parts_sql(_lenient(u))['host']})"


def domain_sql(u: str) -> str:
    p = url_parts_sql(_lenient(u))
    h = f"lower({p['host']})"
    ok = f"{u} IS NOT NULL AND {port_ok_sql(p['port'])} AND NOT {rx(h, WS_CLASS)}"
    return f"CASE WHEN {ok} THEN {rx_replace(h, r'^www\.', '')} ELSE '' END"


def dots_sql(path: str, drop_empty_middle: bool = False) -> str:
    segs = f"string_split({path}, '/')"
    if drop_empty_middle:
        segs = (f"CASE WHEN len({segs}) >= 2 THEN list_concat([{segs}[1]], "
                f"list_filter({segs}[2:len({segs})-1], lambda s: s <> ''), [{segs}[-1]]) ELSE {segs} END")
    step = ("CASE WHEN s = '.' THEN acc WHEN s = '..' THEN "
            "(CASE WHEN len(acc) > 0 THEN acc[1:len(acc)-1] ELSE acc END) ELSE list_append(acc, s) END")
    out = f"list_reduce({segs}, lambda acc, s: {step}, []::VARCHAR[])"
    if drop_empty_middle:
        out = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({out}, '') ELSE {out} END)"
        return f"array_to_string({out}, '/')"
    out = (f"(CASE WHEN starts_with({path}, '/') AND ({out}[1] IS NULL OR {out}[1] <> '') "
           f"THEN list_concat([''], {out}) ELSE {out} END)")
    out = (f"(CASE WHEN ends_with({path}, '/.') OR ends_with({path}, '/..') "
           f"THEN list_append({out}, '') ELSE {out} END)")
    return f"array_to_string({out}, '/')"


def _lead_slash_sql(p: str) -> str:
    return f"(CASE WHEN starts_with({p}, '/') THEN {p} ELSE '/' || {p} END)"


def resolve_sql(base: str, href: str) -> str:
    b = url_parts_sql(base)
    h = rx_replace(rx_replace(href, U.STRIP_ANYWHERE, ""), "^" + WS_CLASS + "+", "")
    hp = url_parts_sql(h)
    b_root = f"({b['scheme']} || '://' || {b['authority']})"
    b_noquery = f"({b_root} || {b['path']})"
    b_nofrag = f"({b_noquery} || CASE WHEN {b['has_query']} THEN '?' || {b['query']} ELSE '' END)"
    h_rest = rx_extract(h, r"(?s)^[^?#]*(.*)$", 1)
    base_dir = rx_extract(b["path"], r"^(.*/)", 1)
    merged = f"(CASE WHEN {base_dir} = '' THEN '/' ELSE {base_dir} END || {hp['path']})"
    return (f"(CASE WHEN {rx(h, U.HAS_SCHEME)} THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {b['scheme']} || ':' || {h} "
            f"WHEN {h} = '' THEN {base} "
            f"WHEN starts_with({h}, '#') THEN {b_nofrag} || {h} "
            f"WHEN starts_with({h}, '?') THEN {b_noquery} || {h} "
            f"WHEN starts_with({h}, '/') THEN {b_root} || {_lead_slash_sql(dots_sql(hp['path'], True))} || {h_rest} "
            f"ELSE {b_root} || {_lead_slash_sql(dots_sql(merged, True))} || {h_rest} END)")


def _escape_char_sql(t: str) -> str:
    hexd = "'0123456789ABCDEF'"
    return (f"chr(((position(upper(substr({t}, 2, 1)) in {hexd}) - 1) * 16 "
            f"+ position(upper(substr({t}, 3, 1)) in {hexd}) - 1)::INTEGER)")


def percent_encode_sql(s: str, safe: str) -> str:
    tokens = f"regexp_extract_all({s}, {lit(f'[{safe}]+|%[0-9A-Fa-f]{{2}}|%|[^{safe}%]+')}, 0)"
    stray = (f"(length({s}) - length(replace({s}, '%', '')) <> "
             f"len(regexp_extract_all({s}, '%[0-9A-Fa-f]{{2}}', 0)))")
    escape = rx("t", "^%[0-9A-Fa-f]{2}$")
    ch = _escape_char_sql("t")
    enc = (f"CASE WHEN {escape} AND {stray} THEN '%25' || substr(t, 2, 2) "
           f"WHEN {escape} AND {rx(ch, U.UNRESERVED)} THEN {ch} "
           f"WHEN {escape} THEN upper(t) WHEN t = '%' THEN '%25' "
           f"WHEN {rx('t', f'^[{safe}]')} THEN t ELSE url_encode(t) END")
    return f"array_to_string(list_transform({tokens}, lambda t: {enc}), '')"


def normalise_sql(url: str) -> str:
    """Normalise an already resolved URL expression (stage resolve first)."""
    u = rx_replace(rx_replace(url, U.STRIP_ANYWHERE, ""), "^" + WS_CLASS + "+", "")
    p = url_parts_sql(u)
    scheme, h = f"lower({p['scheme']})", f"lower({p['host']})"
    pn = f"TRY_CAST({p['port']} AS INTEGER)"
    default = f"(({scheme} = 'http' AND {pn} = 80) OR ({scheme} = 'https' AND {pn} = 443))"
    port = f"(CASE WHEN {p['port']} = '' OR {default} THEN '' ELSE ':' || CAST({pn} AS VARCHAR) END)"
    userinfo = f"(CASE WHEN {p['has_userinfo']} THEN {p['userinfo']} || '@' ELSE '' END)"
    path = percent_encode_sql(dots_sql(p["path"]), U.PATH_SAFE)
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {_lead_slash_sql(path)} END)"
    query = percent_encode_sql(p["query"], U.QUERY_SAFE)
    out = (f"{scheme} || '://' || {userinfo} || {h} || {port} || {path} || "
           f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)")
    ok = (f"{u} IS NOT NULL AND {p['has_authority']} AND {h} <> '' AND {port_ok_sql(p['port'])} "
          f"AND NOT {rx(h, WS_CLASS)} AND {scheme} <> ''")
    return f"(CASE WHEN {ok} THEN {out} END)"


def robots_url_sql(u: str) -> str:
    p = url_parts_sql(u)
    return (f"(CASE WHEN lower({p['host']}) <> '' THEN lower({p['scheme']}) || '://' || lower({p['host']}) "
            f"|| '/robots.txt' END)")


def path_and_query_sql(u: str) -> str:
    p = url_parts_sql(u)
    return f"({p['path']} || CASE WHEN {p['query']} <> '' THEN '?' || {p['query']} ELSE '' END)"


def is_external_sql(u: str, root: str) -> str:
    d = domain_sql(u)
    return f"(({d}) <> '' AND ({d}) <> {root})"


def is_crawlable_sql(u: str) -> str:
    p = url_parts_sql(u)
    return f"(lower({p['scheme']}) IN ('http', 'https') AND {p['has_authority']} AND {p['host']} <> '')"


# ---------------------------------------------------------------------------
# HTML extraction in DuckDB SQL.

H = U


def decode_sql(s: str) -> str:
    for ent, ch in H.ENTITIES:
        s = f"replace({s}, {lit(ent)}, {lit(ch)})"
    return s


def strip_comments_sql(h: str) -> str:
    parts = f"string_split({h}, '<!--')"
    kept = (f"list_transform(({parts})[2:], lambda p: CASE WHEN strpos(p, '-->') > 0 "
            f"THEN substr(p, strpos(p, '-->') + 3) ELSE '' END)")
    return f"(({parts})[1] || array_to_string({kept}, ''))"


def clean_html_sql(h: str) -> str:
    h = strip_comments_sql(h)
    h = rx_replace(h, H.RE_SCRIPT_BODY, r"\1</script>")
    return rx_replace(h, H.RE_STYLE_BODY, r"\1</style>")


def head_sql(c: str) -> str:
    return f"(CASE WHEN {rx(c, H.RE_HEAD)} THEN {rx_extract(c, H.RE_HEAD, 1)} ELSE {c} END)"


def tags_sql(seg: str, name: str) -> str:
    return f"regexp_extract_all({seg}, {lit(H.tag_re(name))}, 0)"


def attr_sql(t: str, name: str) -> str:
    r = H.attr_re(name)
    return decode_sql(f"({rx_extract(t, r, 1)} || {rx_extract(t, r, 2)} || {rx_extract(t, r, 3)})")


def has_attr_sql(t: str, name: str) -> str:
    return rx(t, H.has_attr_re(name))


def attr_values_sql(tag_array: str, name: str, where=None) -> str:
    cond = has_attr_sql("t", name)
    if where is not None:
        cond = f"({cond} AND {where('t')})"
    return f"list_transform(list_filter({tag_array}, lambda t: {cond}), lambda t: {attr_sql('t', name)})"


def rel_is_sql(value: str):
    return lambda t: f"({has_attr_sql(t, 'rel')} AND {attr_sql(t, 'rel')} = {lit(value)})"


def element_contents_sql(seg: str, name: str) -> str:
    parts = f"string_split_regex({seg}, {lit(H.start_split_re(name))})"
    closed = f"list_filter(({parts})[2:], lambda p: {rx('p', H.piece_re(name))})"
    return f"list_transform({closed}, lambda p: {rx_extract('p', H.piece_re(name), 1)})"


def direct_texts_sql(seg: str, name: str) -> str:
    inner = element_contents_sql(seg, name)
    x = rx_replace("x", H.RE_CHILD, H.MARK)
    x = rx_replace(x, H.RE_CHILD, H.MARK)
    x = rx_replace(x, H.RE_ANY_TAG, H.MARK)
    return f"flatten(list_transform({inner}, lambda x: string_split({decode_sql(x)}, {lit(H.MARK)})))"


def joined_sql(arr: str, sep: str) -> str:
    return f"array_to_string({clean_list_sql(arr)}, {lit(sep)})"


def link_kind_sql(kind: str, cleaned: str, head: str) -> str:
    """Raw href/src values of one link kind."""
    if kind == "href_all":
        return attr_values_sql(tags_sql(cleaned, "a"), "href")
    if kind == "href_follow":
        return attr_values_sql(tags_sql(cleaned, "a"), "href",
                               lambda t: f"NOT ({has_attr_sql(t, 'rel')} AND contains({attr_sql(t, 'rel')}, 'nofollow'))")
    if kind == "canonical":
        return attr_values_sql(tags_sql(head, "link"), "href", rel_is_sql("canonical"))
    if kind == "hreflang":
        return attr_values_sql(tags_sql(head, "link"), "href",
                               lambda t: f"({rel_is_sql('alternate')(t)} AND {has_attr_sql(t, 'hreflang')})")
    if kind == "pagination":
        return attr_values_sql(tags_sql(head, "link"), "href",
                               lambda t: f"({rel_is_sql('next')(t)} OR {rel_is_sql('prev')(t)})")
    if kind == "images":
        return attr_values_sql(tags_sql(cleaned, "img"), "src")
    if kind == "stylesheets":
        return attr_values_sql(tags_sql(cleaned, "link"), "href", rel_is_sql("stylesheet"))
    if kind == "javascript":
        return attr_values_sql(tags_sql(cleaned, "script"), "src")
    if kind == "base":
        return attr_values_sql(tags_sql(head, "base"), "href")
    raise KeyError(kind)


def meta_contents_sql(seg: str, name_value: str) -> str:
    return attr_values_sql(tags_sql(seg, "meta"), "content",
                           lambda t: f"({has_attr_sql(t, 'name')} AND {attr_sql(t, 'name')} = {lit(name_value)})")


def meta_robots_sql(cleaned: str, agent: str) -> str:
    metas = tags_sql(cleaned, "meta")
    names = attr_values_sql(metas, "name")
    ua = f"(list_filter({names}, lambda n: contains({lit(agent.lower())}, lower(n))))[1]"
    ua_rules = (f"list_transform(list_filter({metas}, lambda t: {has_attr_sql('t', 'name')} AND "
                f"{attr_sql('t', 'name')} = {ua} AND {has_attr_sql('t', 'content')}), "
                f"lambda t: {attr_sql('t', 'content')})")
    return f"array_to_string(list_concat({ua_rules}, {meta_contents_sql(cleaned, 'robots')}), ', ')"


def canonical_header_sql(h: str) -> str:
    h = f"coalesce({h}, '')"
    return f"(CASE WHEN contains({h}, 'rel=') THEN translate(split_part({h}, ';', 1), '<>', '') ELSE '' END)"
