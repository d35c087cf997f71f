"""Page reading on markup that the given pages do not hold: expected values by hand."""

import time

import pytest
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.operators.selectors import SelectorError, extract, parse_css


def read(spark, html, *columns):
    df = spark.createDataFrame([(html,)], "html string").withColumn("c", H.clean("html")).withColumn("h", H.head("c")) \
        .withColumn("t", H.start_tags("c", H.PAGE_TAGS)).withColumn("ht", H.start_tags("h", H.HEAD_TAGS))
    return df.select(*[c.alias(f"x{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize("html, want", [
    ('<a-button href="/no"></a-button><a href="/yes">', ["/yes"]),
    ('<a title="set href=/bad now" href="/good">', ["/good"]),
    ('<a title="a > b" href="/good">', ["/good"]),
    ("<a title='\"' href=/x?a=b&amp;c=d>", ["/x?a=b&c=d"]),
    ('<A\nHREF = "/up" >', ["/up"]),
    ('<a href="/first" href="/second">', ["/first"]),
    ('<a data-href="/no">', []),
    ("<a href>", [""]),
    ('<a href="/a&#x2F;b&#38;c">', ["/a/b&c"]),
    ('<a title="<!--" href="/1"><a href="/2">', ["/1", "/2"]),
    ('<script>var a="<!--";</script><a href="/after">', ["/after"]),
    ("<!-- <script> --><a href='/seen'>", ["/seen"]),
    ("<script>'<a href=/no>'</script ><a href=/yes>", ["/yes"]),
    ("<style>a{}<a href=/no></style><a href=/yes>", ["/yes"]),
    ("<a href=/1><!-- never closed <a href=/2>", ["/1"]),
    ("<a href=/1><script>never closed <a href=/2>", ["/1"]),
    ('<a title="never closed href=/x><a href=/y>', ["/x", "/y"]),
    ('<a href="/1"><a href="/2"', ["/1"]),
])
def test_anchors(spark, html, want):
    got = read(spark, html, H.anchor_hrefs("t"))[0]
    assert got == want


@pytest.mark.parametrize("html, want", [
    ("<h1><span>Line1<br>Line2</span>tail</h1>", "tail"),
    ("<h1>a<b>b<i>c<u>d</u></i></b>e</h1>", "a | e"),
    ("<h1>a <b>b</i> c</b> d</h1>", "a | d"),
    ("<h1>a<br>b</h1><h1 class='>'>c</h1>", "a | b | c"),
    ("<h1>It&#8217;s caf&eacute; &amp;lt; &unknown; &#x1F600;</h1>", "It’s café &lt; &unknown; 😀"),
    ("<h1>5 < 6</h1>", "5 < 6"),
    ("<h1></h1><h1>never closed", ""),
    ("<h1x>no</h1x><h1>yes</h1>", "yes"),
    ("<script>'<h1>no</h1>'</script><h1>yes<!-- no --></h1>", "yes"),
])
def test_headings(spark, html, want):
    got = read(spark, html, H.joined(H.direct_texts("c", "h1"), " | "))[0]
    assert got == want


def test_hostile_pages_take_linear_time(spark):
    for html in ("<script>" * 20_000, "<!--" * 50_000, "<h1>" * 20_000, '<a href="' * 20_000, "<a " + "x=1 " * 50_000,
                 "<" * 100_000, "<h1>" + "<b>x</b>" * 5_000 + "</h1>"):
        t = time.time()
        read(spark, html, H.anchor_hrefs("t"), H.joined(H.direct_texts("c", "h1"), "|"))
        assert time.time() - t < 30, html[:20]


def test_selectors_refuse_what_they_do_not_know(spark):
    for css in ('a[href^="/two"]', "a:first-child", "div >", "a + b"):
        with pytest.raises(SelectorError):
            parse_css(css)
    pages = spark.createDataFrame([("u", "<p><img class=hero>after</p>")], "url string, html string")
    assert extract(pages, "x", "CSS Selector", "img.hero", " | ").first()["x"] == ""


def test_no_job_runs_while_a_query_is_built(spark):
    from sitegraph.operators.extract import extract_links
    from sitegraph.settings import CrawlSettings

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    pages = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count() \
        .select(F.concat(F.lit("http://e.com/"), "k").alias("url"), F.lit("<a href=/x>").alias("html"))
    extract_links(pages, CrawlSettings())
    assert len(tracker.getJobIdsForGroup(None)) == before


OPEN_LIST = "<ul><li class=a>one<li>two<li>three</ul>end"


def pick(spark, html, kind, selector):
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    return extract(pages, "x", kind, selector, " | ").first()["x"]


@pytest.mark.parametrize("html, selector, want", [
    (OPEN_LIST, "//li", "one | two | three"),
    ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", "//li", "abcd | b | c | e"),
    ("<p>a<p>b<div>c</div>d", "//p", "a | b"),
    ("<p>a<span>b<table><tr><td><p>c<p>d</table>e", "//p", "ab | c | d"),
    ("<table><tr><td>1<td>2<tr><th>3<td>4</table>", "//tr", "12 | 34"),
    ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "//td", "abc | b | d"),
    ("<table><thead><tr><td>h<tbody><tr><td>b</table>", "/table/tbody/tr/td", "b"),
    ("<dl><dt>t<dd>d<dt>u</dl>x", "//dt", "t | u"),
    ("<select><optgroup><option>1<option>2<optgroup><option>3</select>", "//optgroup", "12 | 3"),
    ("<div><b>x</div>y</b>z", "//b", "x"),
    ("<b>x<div>y</b>z</div>w", "//div", "yz"),
    ("</p>a<p>b</p></p>c", "//p", "b"),
    ("<div>never closed <i>x", "//div", "never closed x"),
    ("<a><img src=/1/>t</a>", "//img/@src", "/1/"),
    ("<a href='/x'title=t>q</a>", "//a/@title", "t"),
])
def test_implied_ends(spark, html, selector, want):
    assert pick(spark, html, "XPath", selector) == want


def test_first_open_item(spark):
    assert pick(spark, OPEN_LIST, "CSS Selector", "li.a") == "one"


def test_visits_of_one_url_stay_apart(spark):
    from sitegraph.operators.selectors import extraction_table
    from sitegraph.settings import CrawlSettings

    pages = spark.createDataFrame([("u", "<b>A</b>1<b>x</b>"), ("u", "<b>B</b>1"), ("u", None), ("u", "")], "url string, html string")
    settings = CrawlSettings(extractions=(("c", "CSS Selector", "b"), ("x", "XPath", "//b")), extraction_separator="|")
    assert sorted((r["c"], r["x"]) for r in extraction_table(pages, settings).collect()) == [
        ("", ""), ("", ""), ("A", "A|x"), ("B", "B")]


def test_more_selectors_than_one_walk_takes(spark):
    from sitegraph.operators.selectors import extraction_table
    from sitegraph.settings import CrawlSettings

    html = "".join(f"<div><i class=k{k}>v{k}</i></div>" for k in range(50))
    chosen = tuple((f"x{k}", "CSS Selector", f"div i.k{k}") for k in range(50))
    row = extraction_table(spark.createDataFrame([("u", html)], "url string, html string"), CrawlSettings(extractions=chosen)).first()
    assert [row[f"x{k}"] for k in range(50)] == [f"v{k}" for k in range(50)]


def test_depth_and_selector_count_cost_little(spark):
    def seconds(html, n):
        from sitegraph.operators.selectors import extraction_table
        from sitegraph.settings import CrawlSettings

        chosen = tuple((f"x{k}", "XPath", "//div/div") for k in range(n))
        pages = spark.createDataFrame([("u", html)] * 20, "url string, html string")
        t = time.time()
        extraction_table(pages, CrawlSettings(extractions=chosen)).collect()
        return time.time() - t

    seconds("<div>x</div>", 1)
    nested = "<div>" * 40 + "x" + "</div>" * 40
    assert seconds(nested, 1) < 10 + 3 * seconds("<div>" * 10 + "x" + "</div>" * 10, 1)
    assert seconds("<li>" * 20_000 + "<div>" * 500, 1) < 60


def test_selectors_need_no_exchange_and_read_pages_once(spark):
    from sitegraph.operators.selectors import extraction_table
    from sitegraph.settings import CrawlSettings

    pages = spark.createDataFrame([("u", "<b>x</b>")], "url string, html string")
    chosen = tuple((f"x{k}", "XPath", "//b") for k in range(4))
    plan = extraction_table(pages, CrawlSettings(extractions=chosen))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_trees_of_a_batch_are_held_as_numbers():
    import tracemalloc

    import pyarrow as pa

    from sitegraph.operators import dom

    page = [*["ul", "li", "b", "/b", "", "br/", "li", "/ul"] * 40, "p", ""]
    steps = dom.Steps(anywhere=1)
    pages = [page[k % 7:] for k in range(2000)] + [None, []]
    bits = [[1] * len(p or []) for p in pages]
    names, matches = pa.array(pages, pa.list_(pa.string())), pa.array(bits, pa.list_(pa.int64()))
    tracemalloc.start()
    got = dom.trees(names.slice(1), matches.slice(1), steps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [None if p is None else dict(zip(("level", "parent", "end", "hits"), dom.walk(p, b, steps), strict=True))
            for p, b in zip(pages[1:], bits[1:], strict=True)]
    assert got.to_pylist() == want
    numbers = sum(len(p or []) for p in pages) * 20     # three ints and a long per token
    assert peak < 2.5 * numbers                         # as Python objects: over ten times that
    assert dom.trees(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.int64())), steps).to_pylist() == []
