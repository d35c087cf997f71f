"""robots.txt evaluation as DataFrame plans.

Pipeline (one robots text per host, fetched with a status code):

1. ``parse_rules``: only 200 responses; lines -> ``posexplode``; comments
   and blanks stripped; each ``user-agent`` / ``allow`` / ``disallow`` line
   classified; a new group starts at an agent line that follows a rule line
   (window ``lag`` + running ``sum`` per host).  Other lines (sitemap, junk)
   neither break nor start a group.  Empty paths are dropped after grouping.
2. ``choose_agent``: per host the longest agent token contained in the
   crawler's short name (case-insensitive), else ``*``, else no rules.
3. ``agent_rules``: every group naming the chosen token is merged.
4. ``rule_patterns``: ``*`` -> any run, trailing ``$`` -> end, anchored at the
   path start; rules without wildcards are plain prefix tests.
5. ``with_robots_status``: each URL's path+query against its host's rules:
   longest matching allow vs longest matching disallow, allow on a tie,
   allowed when nothing matches or the host has no rules.

Scale: rules are collected per host (one row per host, bounded by the
size of a robots file), URLs join them many-to-one on host.  The rules side is
small enough for AQE to broadcast in practice; if there are too many hosts
it stays a shuffle join, and a host holding a large share of the URLs is
split by AQE skew handling on the URL side.  No URL x rule pairs are ever
materialised: matching runs inside the row with ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.functions.idna import ascii_host

RE_AGENT = r"(?i)^user-agent\s*:"
RE_ALLOW = r"(?i)^allow\s*:"
RE_DISALLOW = r"(?i)^disallow\s*:"


#: Paths that are looked through faster than bisected.
FEW = 64


def parse_rules(robots: DataFrame, host: str = "host", text: str = "robots_text",
                status: str = "status_code") -> DataFrame:
    """(host, line, grp, kind, value): agent and rule lines with their group."""
    # one response per host: an answered one if there is any, the first by text among several
    answers = robots.groupBy(ascii_host(F.lower(F.col(host))).alias("host")).agg(
        F.min(F.struct(F.coalesce(F.col(status) != 200, F.lit(True)).alias("failed"), F.col(text).alias("text"))).alias("r"))
    lines = (answers.filter(~F.col("r.failed"))
             .select("host", F.posexplode(F.split(F.col("r.text"), r"\r?\n", -1)).alias("line", "raw")))
    s = F.trim(F.regexp_replace(F.regexp_replace("raw", r"#.*$", ""), r"\s+$", ""))
    kind = (F.when(s.rlike(RE_AGENT), F.lit("agent"))
            .when(s.rlike(RE_DISALLOW), F.lit("disallow"))
            .when(s.rlike(RE_ALLOW), F.lit("allow")))
    value = F.regexp_replace(F.regexp_extract(s, r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
    classified = lines.select("host", "line", kind.alias("kind"), value.alias("value")) \
        .filter(F.col("kind").isNotNull())
    w = Window.partitionBy("host").orderBy("line")
    prev = F.lag("kind").over(w)
    start = ((F.col("kind") == "agent") & (prev.isNull() | (prev != "agent"))).cast("int")
    grouped = classified.withColumn("_start", start).withColumn(
        "grp", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    token = F.regexp_extract(F.col("value"), r"^(\S*)", 1)
    return grouped.select(
        "host", "line", "grp", "kind",
        F.when(F.col("kind") == "agent", token).otherwise(F.col("value")).alias("value"))


def _with_chosen_agent(rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``agent`` (the token that applies on this host, NULL when none)
    to every line, with window aggregates over the host partition the
    parser already produced (no further exchange)."""
    a = F.lit(agent.lower())
    is_agent = (F.col("kind") == "agent") & (F.col("value") != "")
    tok = F.lower(F.col("value"))
    spec = F.when(is_agent & (tok != "*") & a.contains(tok), F.length("value"))
    host = Window.partitionBy("host")
    best = F.max_by(F.when(spec.isNotNull(), tok), F.struct(spec, tok)).over(host)
    star = F.max((is_agent & (tok == "*")).cast("int")).over(host)
    chosen = F.when(F.max(spec).over(host).isNotNull(), best).when(star == 1, F.lit("*"))
    return rules.withColumn("agent", chosen)


def choose_agent(rules: DataFrame, agent: str) -> DataFrame:
    """(host, agent): the robots token that applies to the crawler per host."""
    return (_with_chosen_agent(rules, agent).filter(F.col("agent").isNotNull())
            .groupBy("host").agg(F.first("agent").alias("agent")))


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(host, kind, path): allow/disallow rules of every group naming the
    chosen agent (all groups merged); empty paths dropped."""
    r = _with_chosen_agent(rules, agent)
    names_it = ((F.col("kind") == "agent") & (F.lower("value") == F.col("agent"))).cast("int")
    r = r.withColumn("_grp_hit", F.max(names_it).over(Window.partitionBy("host", "grp")))
    return (r.filter(F.col("kind").isin("allow", "disallow") & (F.col("value") != "") & (F.col("_grp_hit") == 1))
            .select("host", "kind", F.col("value").alias("path")))


def rule_pattern(path) -> Column:
    """Rule -> anchored regex: escape, ``*`` -> ``.*``, trailing ``$`` -> end."""
    p = F.col(path) if isinstance(path, str) else path
    ends = p.endswith("$")
    body = F.when(ends, F.regexp_replace(p, r"\$$", "")).otherwise(p)
    esc = F.regexp_replace(body, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    esc = F.replace(esc, F.lit("\\*"), F.lit(".*"))
    return F.concat(F.lit("^"), esc, F.when(ends, F.lit("$")).otherwise(F.lit("")))


def rule_patterns(rules: DataFrame) -> DataFrame:
    """Adds ``pattern`` (regex) and ``is_prefix`` (no wildcard, no end anchor)."""
    return (rules.withColumn("pattern", rule_pattern("path"))
                 .withColumn("is_prefix", ~F.col("path").contains("*") & ~F.col("path").endswith("$")))


def rules_by_host(robots: DataFrame, agent: str, **kw) -> DataFrame:
    """(host, rules STRUCT<wild, allow, allow_lens, deny, deny_lens>), one row per host with rules.

    * ``wild``: the rules with a wildcard or an end anchor, cut at their wildcards, which
      every URL is matched against;
    * the other rules are prefixes: the sorted paths that allow and that deny, and the lengths
      there are.  A URL looks its own prefixes of those lengths up by bisection, so its cost
      grows with the number of lengths, hardly with the number of rules."""
    r = agent_rules(parse_rules(robots, **kw), agent)
    ends, allow = F.col("path").endswith("$"), F.col("kind") == "allow"
    plain = ~ends & ~F.col("path").contains("*")
    body = F.when(ends, F.expr("substr(path, 1, length(path) - 1)")).otherwise(F.col("path"))
    pieces = F.split(body, r"\*", -1)
    cut = F.struct(allow.alias("allow"), F.length("path").alias("len"), F.get(pieces, 0).alias("first"),
                   F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))).alias("rest"), ends.alias("ends"))
    held = r.groupBy("host").agg(F.collect_list(F.when(~plain, cut)).alias("wild"),
                                 F.sort_array(F.collect_set(F.when(plain & allow, F.col("path")))).alias("allow"),
                                 F.sort_array(F.collect_set(F.when(plain & ~allow, F.col("path")))).alias("deny"))
    lens = lambda paths: F.sort_array(F.array_distinct(F.transform(paths, F.length)))
    return held.select("host", F.struct("wild", "allow", lens("allow").alias("allow_lens"), "deny",
                                        lens("deny").alias("deny_lens")).alias("rules"))


def _holds(paths: Column, path: Column) -> Column:
    """Is ``path`` in a sorted array: bisection, or a plain look through a short one (the same answer)."""
    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = F.get(paths, middle) < path
        return F.struct(F.when(low, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(paths).alias("hi"))
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(paths))))
    found = F.aggregate(rounds, start, halve, lambda acc: F.coalesce(F.get(paths, acc["lo"]) == path, F.lit(False)))
    return F.when(F.size(paths) <= FEW, F.array_contains(paths, path)).otherwise(found)


def longest_prefix(paths: Column, lens: Column, target: Column) -> Column:
    """Length of the longest of the sorted ``paths`` that ``target`` starts with, -1 if none does."""
    return F.aggregate(F.filter(lens, lambda n: n <= F.length(target)), F.lit(-1), lambda best, n: F.when(
        _holds(paths, F.substr(target, F.lit(1), n)), n).otherwise(best))


def rule_matches(rule: Column, target: Column) -> Column:
    """Does a cut rule match: the first piece at the start, each further piece at its
    leftmost place after the one before, and an anchored rule's last piece at the end.
    Leftmost places leave the most room, so there is nothing to go back for."""
    after = F.aggregate(
        rule["rest"], F.length(rule["first"]) + 1,
        lambda at, p: F.when((at == 0) | (p == ""), at).otherwise(
            F.coalesce(F.nullif(F.call_function("locate", p, target, at), F.lit(0)) + F.length(p), F.lit(0))))
    last = F.element_at(rule["rest"], -1)
    before = F.aggregate(
        F.slice(rule["rest"], 1, F.greatest(F.size(rule["rest"]) - 1, F.lit(0))), F.length(rule["first"]) + 1,
        lambda at, p: F.when((at == 0) | (p == ""), at).otherwise(
            F.coalesce(F.nullif(F.call_function("locate", p, target, at), F.lit(0)) + F.length(p), F.lit(0))))
    anchored = F.when(F.size(rule["rest"]) == 0, target == rule["first"]).otherwise(
        (before > 0) & F.endswith(target, last) & (before <= F.length(target) - F.length(last) + 1))
    return F.startswith(target, rule["first"]) & F.when(rule["ends"], anchored).otherwise(after > 0)


def allowed_by(rules: Column, target: Column) -> Column:
    """Longest-match decision for one path+query against a host's rules."""
    start = F.struct(longest_prefix(rules["allow"], rules["allow_lens"], target).alias("a"),
                     longest_prefix(rules["deny"], rules["deny_lens"], target).alias("d"))
    longest = F.aggregate(
        F.filter(rules["wild"], lambda r: rule_matches(r, target)), start,
        lambda acc, r: F.struct(F.when(r["allow"], F.greatest(acc["a"], r["len"])).otherwise(acc["a"]).alias("a"),
                                F.when(r["allow"], acc["d"]).otherwise(F.greatest(acc["d"], r["len"])).alias("d")),
        lambda acc: (acc["d"] < 0) | (acc["a"] >= acc["d"]))
    return F.when(rules.isNull(), F.lit(True)).otherwise(longest)


def with_robots_status(df: DataFrame, url: str, robots: DataFrame, agent: str,
                       host_col: str = "host") -> DataFrame:
    """Adds ``robots_txt`` = 'allowed' / 'blocked' for the URL column.

    ``robots`` is either raw texts (host, robots_text, status_code) or the
    output of :func:`rules_by_host`."""
    table = robots if "rules" in robots.columns else rules_by_host(robots, agent, host=host_col)
    keyed = df.withColumn("_rhost", U.host(F.col(url)))
    joined = keyed.join(table.withColumnRenamed("host", "_rhost"), "_rhost", "left")
    ok = allowed_by(F.col("rules"), U.path_and_query(F.col(url)))
    return joined.withColumn("robots_txt", F.when(ok, F.lit("allowed")).otherwise(F.lit("blocked"))) \
        .drop("_rhost", "rules")
