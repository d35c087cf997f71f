"""robots evaluation on hand-made robots files (the reference's eleven
situations re-created with our own texts, plus edge cases)."""

import pytest
from pyspark.sql import functions as F

from sitegraph.operators.robots import parse_rules, with_robots_status


def allowed(spark, text, agent, paths, status=200):
    robots = spark.createDataFrame([("example.com", text, status)], "host string, robots_text string, status_code int")
    urls = spark.createDataFrame([(i, "https://example.com" + p) for i, p in enumerate(paths)], "i int, url string")
    out = with_robots_status(urls, "url", robots, agent).orderBy("i").collect()
    return [r["robots_txt"] == "allowed" for r in out]


CASES = [
    # 1 catch-all folder rule
    ("User-agent: *\nDisallow: /private/\n", "Googlebot", ["/public/a", "/private/a"], [True, False]),
    # 2 token contained in the crawler name wins over *
    ("User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /tmp/\n", "Googlebot-Image",
     ["/page", "/tmp/x"], [True, False]),
    # 3 wildcard disallow and allow of the same length: allow wins the tie
    ("User-agent: *\nDisallow: /x*.php\nAllow: /*y.php\n", "Googlebot", ["/xy.php"], [True]),
    # 4 two disallows, no allow
    ("User-agent: *\nDisallow: /a\nDisallow: /a/b/c\n", "Googlebot", ["/a/b/c/d"], [False]),
    # 5 folder allowed, longer disallow below it
    ("User-agent: *\nAllow: /shop/\nDisallow: /shop/cart/\n", "Googlebot", ["/shop/cart/1", "/shop/x"],
     [False, True]),
    # 6 own group blocks everything although * allows
    ("User-agent: *\nAllow: /\nUser-agent: Googlebot\nDisallow: /\n", "Googlebot", ["/x"], [False]),
    # 7 two agent lines share the final group
    ("User-agent: *\nDisallow: /\nUser-agent: Bingbot\nUser-agent: Googlebot\nDisallow: /x\n", "Googlebot",
     ["/a", "/x1"], [True, False]),
    # 8 three agent lines share a group, another group follows
    ("User-agent: Bingbot\nUser-agent: Googlebot\nUser-agent: Slurp\nDisallow: /priv\n"
     "User-agent: *\nDisallow: /\n", "Googlebot", ["/open", "/priv/1"], [True, False]),
    # 10 agent and rule on one line, orphan rule before any agent
    ("Disallow: /\nUser-agent: * Disallow: /secret\n", "Googlebot", ["/secret", "/"], [True, True]),
    # 11 sitemap line inside a group; wildcard disallow against an explicit allow
    ("User-agent: *\nDisallow: /*?\nSitemap: https://example.com/s.xml\nAllow: /search?q=ok\n", "Googlebot",
     ["/search?q=ok", "/list?page=2", "/list"], [True, False, True]),
    # end anchor
    ("User-agent: *\nDisallow: /*.pdf$\n", "Googlebot", ["/a.pdf", "/a.pdf?x=1"], [False, True]),
    # empty disallow allows everything
    ("User-agent: *\nDisallow:\n", "Googlebot", ["/anything"], [True]),
    # query string is part of the matched path
    ("User-agent: *\nDisallow: /p?sort=\n", "Googlebot", ["/p?sort=asc", "/p"], [False, True]),
    # two groups of one agent are merged
    ("User-agent: Googlebot\nDisallow: /a\nUser-agent: *\nDisallow: /\nUser-agent: Googlebot\nDisallow: /b\n",
     "Googlebot", ["/a1", "/b1", "/c"], [False, False, True]),
    # the longest rule is not the first one
    ("User-agent: *\nDisallow: /\nAllow: /deep/path/\n", "Googlebot", ["/deep/path/x", "/deep"], [True, False]),
    # keywords are case-insensitive, comments and trailing blanks stripped
    ("USER-AGENT: *   # all\ndisallow: /x   # no x\n", "Googlebot", ["/x", "/y"], [False, True]),
    # no group for the agent and no * group: no rules
    ("User-agent: Bingbot\nDisallow: /\n", "Googlebot", ["/x"], [True]),
]


@pytest.mark.parametrize("text,agent,paths,expected", CASES)
def test_robots_cases(spark, text, agent, paths, expected):
    assert allowed(spark, text, agent, paths) == expected


def test_shared_group_with_blank_lines_tabs_and_comments(spark):
    text = ("User-agent: Googlebot\n\n# the crawlers below share one group\nUser-agent:\tBingbot\n"
            "User-agent: DuckDuckBot\n\nUser-agent: YandexBot\nDisallow: /\n")
    for agent in ["Googlebot", "Bingbot", "DuckDuckBot", "YandexBot"]:
        assert allowed(spark, text, agent, ["/page"]) == [False], agent
    assert allowed(spark, text, "Chrome", ["/page"]) == [True]


def test_non_200_robots_means_no_rules(spark):
    assert allowed(spark, "User-agent: *\nDisallow: /\n", "Googlebot", ["/x"], status=404) == [True]


def test_parse_groups(spark):
    robots = spark.createDataFrame([("h", "User-agent: a\nUser-agent: b\nDisallow: /x\nSitemap: s\nAllow: /y\n"
                                          "User-agent: c\nDisallow: /z", 200)],
                                   "host string, robots_text string, status_code int")
    rows = [(r["grp"], r["kind"], r["value"]) for r in parse_rules(robots).orderBy("line").collect()]
    assert rows == [(1, "agent", "a"), (1, "agent", "b"), (1, "disallow", "/x"), (1, "allow", "/y"),
                    (2, "agent", "c"), (2, "disallow", "/z")]


def _match(spark, rules, targets):
    from sitegraph.operators import robots as R

    text = "User-agent: *\n" + "\n".join(rules)
    table = spark.createDataFrame([("e.com", text, 200)], "host string, robots_text string, status_code int")
    urls = spark.createDataFrame([(f"http://e.com{t}",) for t in targets], "url string")
    out = R.with_robots_status(urls, "url", table, "Bot").collect()
    return [r["robots_txt"] == "allowed" for r in out]


def test_wildcard_rules_piece_by_piece(spark):
    cases = [("/a*b$", "/axxb", True), ("/a*b$", "/axxbx", False), ("/a*b$", "/ab", True), ("/a*a$", "/a", False),
             ("/x", "/xyz", True), ("/x$", "/x", True), ("/x$", "/xy", False), ("*x", "/yyx1", True), ("/*.html$", "/a.html", True),
             ("/*.html$", "/a.html?q", False), ("/a**c", "/abc", True), ("/*", "/", True), ("/a*", "/b", False),
             ("/ab*bc$", "/abc", False), ("/ab*bc$", "/abbc", True), ("/*$", "/any", True), ("/a.b", "/axb", False)]
    for rule, target, hit in cases:
        assert _match(spark, [f"Disallow: {rule}"], [target]) == [not hit], (rule, target)


def test_hostile_wildcards_take_no_time(spark):
    import time

    t = time.time()
    assert _match(spark, ["Disallow: /" + "*a" * 40 + "*b"], ["/" + "a" * 20_000]) == [True]
    assert time.time() - t < 30


def test_two_responses_of_a_host_are_not_interleaved(spark):
    from sitegraph.operators import robots as R

    table = spark.createDataFrame(
        [("e.com", "User-agent: a\nDisallow: /a", 200), ("E.com", "User-agent: b\nDisallow: /b", 200), ("e.com", None, 500)],
        "host string, robots_text string, status_code int")
    rules = R.parse_rules(table).collect()
    assert {(r["kind"], r["value"]) for r in rules} == {("agent", "a"), ("disallow", "/a")}


def test_an_unanswered_response_does_not_hide_an_answered_one(spark):
    from sitegraph.operators import robots as R

    table = spark.createDataFrame([("e.com", "User-agent: a\nDisallow: /a", 200), ("e.com", None, None), ("e.com", "x", None)],
                                  "host string, robots_text string, status_code int")
    assert {(r["kind"], r["value"]) for r in R.parse_rules(table).collect()} == {("agent", "a"), ("disallow", "/a")}


def test_prefix_rules_against_a_plain_scan(spark):
    import random

    r = random.Random(6)
    word = lambda: "/" + "/".join(r.choice(["a", "b", "ab", "é", "x%20y", ""]) for _ in range(r.randrange(1, 4)))
    rules = [(r.choice(["Allow", "Disallow"]), word() + r.choice(["", "", "", "*", "$", "*b"])) for _ in range(60)]
    targets = [word() + r.choice(["", "/a", "?q=1"]) for _ in range(80)]

    def says(target):
        import re

        best = {"Allow": -1, "Disallow": -1}
        for kind, path in rules:
            body = path[:-1] if path.endswith("$") else path
            pattern = ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if path.endswith("$") else "")
            if re.match(pattern, target):
                best[kind] = max(best[kind], len(path))
        return best["Disallow"] < 0 or best["Allow"] >= best["Disallow"]

    table = spark.createDataFrame([("e.com", "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules), 200)],
                                  "host string, robots_text string, status_code int")
    from sitegraph.operators import robots as R

    urls = spark.createDataFrame([(k, "e.com", t) for k, t in enumerate(targets)], "k int, host string, target string")
    got = urls.join(R.rules_by_host(table, "Bot"), "host").select("k", R.allowed_by(F.col("rules"), F.col("target")).alias("ok"))
    assert [r["ok"] for r in got.orderBy("k").collect()] == [says(t) for t in targets]


def test_many_prefix_rules_cost_what_few_do(spark):
    import time

    from sitegraph.operators import robots as R

    def seconds(n):
        text = "User-agent: *\n" + "\n".join(f"Disallow: /dir{k:05d}/" for k in range(n))
        table = R.rules_by_host(spark.createDataFrame([("e.com", text, 200)], "host string, robots_text string, status_code int"),
                                "Bot").checkpoint()
        urls = spark.range(20_000).select(F.concat(F.lit("http://e.com/dir"), F.lpad("id", 5, "0"), F.lit("/x")).alias("url"))
        out = R.with_robots_status(urls, "url", table, "Bot").groupBy("robots_txt").count()
        out.collect()
        t = time.time()
        assert {r["robots_txt"]: r["count"] for r in out.collect()} == {"blocked": n, "allowed": 20_000 - n}
        return time.time() - t

    assert seconds(10_000) < 5 + 3 * seconds(100)
