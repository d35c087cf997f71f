"""URL resolution / normalisation and HTML extraction on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import urls as U
from sitegraph.functions.status import crawl_status
from sitegraph.operators.extract import base_url, extract_links, page_items, with_markup
from sitegraph.settings import CrawlSettings

URL_CASES = [
    ("http://a.com/b/c", "  d", "http://a.com/b/d"),
    ("http://a.com/b/c/d", "../../e", "http://a.com/e"),
    ("http://a.com/b/c", "./x/./y/../z", "http://a.com/b/x/z"),
    ("http://a.com/b?x=1", "?q=2", "http://a.com/b?q=2"),
    ("http://a.com/b?x=1#f", "#g", "http://a.com/b?x=1"),
    ("https://a.com/b", "//c.com/d", "https://c.com/d"),
    ("http://a.com/", "http://A.COM:80/x", "http://a.com/x"),
    ("http://a.com/", "https://a.com:443/x", "https://a.com/x"),
    ("http://a.com/", "http://a.com:8080/x", "http://a.com:8080/x"),
    ("http://a.com/", "http://u:p@a.com/x", "http://u:p@a.com/x"),
    ("http://a.com/", "/ü", "http://a.com/%C3%BC"),
    ("http://a.com/", "/a%20b", "http://a.com/a%20b"),
    ("http://a.com/", "/a%zz", "http://a.com/a%25zz"),
    ("http://a.com/", "/a%zz%41", "http://a.com/a%25zz%2541"),
    ("http://a.com/", "/%7euser/%2f%41?q=%3d%7E", "http://a.com/~user/%2FA?q=%3D~"),
    ("http://a.com/", "/a b", "http://a.com/a%20b"),
    ("http://a.com/", "http://a.com", "http://a.com/"),
    ("http://a.com/", "http://a.com:abc/", None),
    ("http://a.com/", "mailto:x@a.com", None),
    ("http://a.com/x/", "", "http://a.com/x/"),
    ("http://a.com/p/q", "/../r", "http://a.com/r"),
    ("http://a.com/p/q", "/a\n\tb", "http://a.com/ab"),
    ("http://a.com/p/q", "HTTP://[::1]:80/x", "http://[::1]/x"),
]


@pytest.mark.parametrize("base,href,expected", URL_CASES)
def test_normalise_cases(spark, base, href, expected):
    df = spark.createDataFrame([(base, href)], "base string, href string")
    got = df.select(U.normalise("href", base=F.col("base")).alias("u")).first()["u"]
    assert got == expected


def test_domain_and_robots_url(spark):
    df = spark.createDataFrame([("http://www.A.com/x?q",), ("http://www.www.a.com/",), ("",),
                                ("page.html",), ("https://h.org:8443/p",)], "u string")
    rows = df.select(U.domain("u").alias("d"), U.robots_url("u").alias("r")).collect()
    assert [r["d"] for r in rows] == ["a.com", "www.a.com", "", "page.html", "h.org"]
    assert rows[0]["r"] == "http://www.a.com/robots.txt"
    assert rows[4]["r"] == "https://h.org/robots.txt"


def test_start_url_repair(spark):
    df = spark.createDataFrame([(" example.com/a ",), ("https://X.org",), ("bad host.com/",), ("",)], "t string")
    got = [r[0] for r in df.select(U.start_url("t")).collect()]
    assert got == ["http://example.com/a", "https://x.org/", None, None]


PAGE = ("<html><head><title>T &amp; U</title><meta content=\"D  d\" name=\"description\">"
        "<meta name='googlebot' content='noindex'><meta name=robots content=nofollow>"
        "<link href='/c' rel=canonical><base href=\"/base/\"></head><body>"
        "<!-- <h1>fake</h1> <a href=\"/fake\">f</a> --><script>var x='<h1>no</h1><a href=\"/s\">';</script>"
        "<h1>Real <span>child</span> tail</h1><h2> </h2><h2>Two</h2>"
        "<a href=/x>x</a><a rel='nofollow' href='/nf'>n</a><a HREF=\"y\" rel=\"next nofollow\">y</a>"
        "<a href=\"https://other.org/o\">o</a><img src=\"i.png\"></body></html>")


def _page(spark):
    return spark.createDataFrame([("http://site.com/dir/page", PAGE)], "url string, html string")


def test_onpage_items(spark):
    s = CrawlSettings(crawl_items=("h1", "h2", "page_title", "meta_description", "canonical_tag", "meta_robots"))
    r = page_items(_page(spark), s).first()
    assert r["h1"] == "Real | tail"
    assert r["h2"] == "Two"
    assert r["page_title"] == "T & U"
    assert r["meta_description"] == "D d"
    assert r["canonical_tag"] == "http://site.com/c"
    assert r["meta_robots"] == "noindex, nofollow"


def test_link_kinds_and_base(spark):
    df = with_markup(_page(spark))
    r = df.select(H.anchor_hrefs("_tags").alias("all"), H.anchor_hrefs_follow("_tags").alias("follow"),
                  base_url("url").alias("base")).first()
    assert r["all"] == ["/x", "/nf", "y", "https://other.org/o"]
    assert r["follow"] == ["/x", "https://other.org/o"]
    assert r["base"] == "http://site.com/base/"


def test_extract_links_respects_settings(spark):
    s = CrawlSettings()
    links = sorted(r["url_to"] for r in extract_links(_page(spark), s).collect())
    # nofollow dropped, relative 'y' resolved against the base, external dropped, canonical followed
    assert links == ["http://site.com/c", "http://site.com/x"]
    s2 = s.with_items("external_links", "images", drop=("respect_nofollow",))
    links2 = sorted(r["url_to"] for r in extract_links(_page(spark), s2).collect())
    assert links2 == ["http://site.com/base/i.png", "http://site.com/base/y", "http://site.com/c",
                      "http://site.com/nf", "http://site.com/x", "https://other.org/o"]


def test_missing_head_and_empty_body(spark):
    df = spark.createDataFrame([("http://a.com/", "<title>T</title><link rel=\"canonical\" href=\"/c\"><h1>H</h1>"),
                                ("http://a.com/e", "")], "url string, html string")
    rows = {r["url"]: r for r in page_items(df, CrawlSettings()).collect()}
    assert rows["http://a.com/"]["page_title"] == "T"
    assert rows["http://a.com/"]["canonical_tag"] == "http://a.com/c"
    assert rows["http://a.com/e"]["h1"] == ""


def test_status_case_trailing_slash_is_canonicalised(spark):
    df = spark.createDataFrame([("https://example.com/page", 200, "https://example.com/page/")],
                               "url string, status_code int, canonical_tag string")
    got = df.select(crawl_status("url", "status_code", None, None, None, "canonical_tag", None)).first()[0]
    assert got == "canonicalised"


def test_crawl_status_order(spark):
    df = spark.createDataFrame([("u", 301, "noindex", "blocked", "noindex", "v", "w"),
                                ("u", 200, "", "allowed", "", "", ""), ("u", 999, "", "allowed", "", "", "")],
                               "url string, status_code int, x string, r string, m string, c string, h string")
    got = [r[0] for r in df.select(crawl_status("url", "status_code", "x", "r", "m", "c", "h")).collect()]
    assert got == ["moved permanently, blocked by x-robots-tag, blocked by robots.txt, noindex, canonicalised, "
                   "header canonicalised", "ok", "non-standard response"]


def test_short_ways_agree_with_the_long_ones(spark):
    """What a plain URL skips gives what the whole rule gives."""
    from sitegraph.functions.urls import _percent_encode, _remove_dots

    paths = ["", "/", "/a", "/a/", "/a/b.c", "/a/./b", "/a/../b", "/..", "/.", "//", "/a//b", "/a/b/..", "a/b", ".", "..", "./x",
             "/.a/b", "/a.b/c..d", "/a%20b", "/é", "/a b", "/%zz", "/a;b=c,d!$&'()*+:@~_-", "/a\nb", "/a?"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for drop in (False, True):
        rows = df.select("p", U.remove_dot_segments(F.col("p"), drop).alias("x"), _remove_dots(F.col("p"), drop).alias("y")).collect()
        assert [(r["p"], r["x"]) for r in rows] == [(r["p"], r["y"]) for r in rows]
    rows = df.select("p", U.percent_encode(F.col("p"), U.PATH_SAFE).alias("x"), _percent_encode(F.col("p"), U.PATH_SAFE).alias("y")).collect()
    assert [(r["p"], r["x"]) for r in rows] == [(r["p"], r["y"]) for r in rows]
    urls = ["http://www.a.com/", "https://www.www.b.com:8080/x?y=http://c.d/", "http://u:p@www.e.com/", "http://[::1]:80/x", "ftp://f.g/",
            "http://h.com?x#@z", "mailto:x@y.z", "HTTP://Upper.COM/%7ea/../b"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalise("u").alias("n")).where("n is not null")
    rows = df.select("n", U.domain("n").alias("d"), U.normal_domain("n").alias("e"), U.is_crawlable("n").alias("c"),
                     U.is_normal_crawlable("n").alias("f")).collect()
    assert len(rows) >= 6
    for r in rows:
        assert (r["d"], r["c"]) == (r["e"], r["f"]), r
