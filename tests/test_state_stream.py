"""Filters, upsert, crawl state, settings round trip, closure, failure rows,
selectors and streaming idempotency on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitegraph.functions.filters import apply_filters
from sitegraph.operators import state as ST
from sitegraph.operators.closure import spider_closure
from sitegraph.operators.selectors import SelectorError, extract, parse_css, parse_xpath
from sitegraph.session import scratch_path
from sitegraph.settings import CrawlSettings
from sitegraph.sources import io
from sitegraph.streaming.ingest import CrawlStore

CRAWL = [("http://a.com/a_b", 200, "text/html", "ok", None), ("http://a.com/a%b", 404, "TEXT/CSS", "not found", ""),
         ("http://a.com/A\\B", 301, "image/png", "moved permanently", "x"), ("http://a.com/new", None, None, None, None)]
SCHEMA = "url string, status_code int, content_type string, crawl_status string, canonical_tag string"


def urls(df):
    return sorted(r["url"] for r in df.collect())


@pytest.mark.parametrize("filters,expected", [
    ([("url", "Contains", "_")], ["http://a.com/a_b"]),
    ([("url", "Contains", "%")], ["http://a.com/a%b"]),
    ([("url", "Contains", "a\\b")], ["http://a.com/A\\B"]),
    ([("url", "Equals", "http://a.com/A\\B")], ["http://a.com/A\\B"]),
    ([("url", "Equals", "http://a.com/a\\b")], []),
    ([("content_type", "Begins With", "text")], ["http://a.com/a%b", "http://a.com/a_b"]),
    ([("status_code", "Greater Than", "250")], ["http://a.com/A\\B", "http://a.com/a%b"]),
    ([("status_code", "Less Than", "abc")], ["http://a.com/A\\B", "http://a.com/a%b", "http://a.com/a_b"]),
    ([("status_code", "Equals", "abc")], []),
    ([("status_code", "Contains", "0")], ["http://a.com/A\\B", "http://a.com/a%b", "http://a.com/a_b"]),
    ([("canonical_tag", "Does Not Contain", "x")], ["http://a.com/a%b"]),
    ([("url", "Contains", "")], ["http://a.com/A\\B", "http://a.com/a%b", "http://a.com/a_b"]),
])
def test_filter_cases(spark, filters, expected):
    df = spark.createDataFrame(CRAWL, SCHEMA)
    assert urls(apply_filters(df, filters)) == expected


def test_sort_and_projection(spark):
    df = spark.createDataFrame(CRAWL, SCHEMA)
    out = apply_filters(df, [("Status Code", "Sort Largest To Smallest", "")], ["URL", "Status Code"])
    assert out.columns == ["url", "status_code"]
    assert [r["status_code"] for r in out.collect()] == [404, 301, 200]


def test_upsert_cases(spark):
    before = spark.createDataFrame([("a", 200, "old"), ("b", None, None)], "url string, status_code int, t string")
    batch = spark.createDataFrame([("a", 500, "x", 1), ("b", 200, "first", 2), ("c", 301, "c1", 3),
                                   ("c", 404, "c2", 4), ("b", 404, "late", 5)],
                                  "url string, status_code int, t string, seq int")
    after = {r["url"]: r for r in ST.upsert(before, batch).collect()}
    assert (after["a"]["status_code"], after["a"]["t"], after["a"]["change"]) == (200, "old", None)
    assert (after["b"]["status_code"], after["b"]["t"], after["b"]["change"]) == (200, "first", "updated")
    assert (after["c"]["status_code"], after["c"]["t"], after["c"]["change"]) == (301, "c1", "new")
    # replaying the same batch changes nothing
    again = ST.upsert(ST.upsert(before, batch).drop("change"), batch)
    assert again.filter("change IS NOT NULL").count() == 0
    # empty batch
    empty = ST.upsert(before, batch.limit(0))
    assert empty.filter("change IS NOT NULL").count() == 0 and empty.count() == 2


def test_progress_and_pending(spark):
    df = spark.createDataFrame(CRAWL, SCHEMA)
    r = ST.progress(df).first()
    assert (r["total"], r["crawled"], r["pending"], r["percent"]) == (4, 3, 1, 75)
    assert urls(ST.pending(df)) == ["http://a.com/new"]
    assert ST.progress(df.limit(0)).first()["percent"] == 0


def test_failed_urls_threshold(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), "u1", "Connection Refused") for i in range(6)]
    rows += [(10 + i, t0 + dt.timedelta(minutes=10 + i), "u2", "Read timed out") for i in range(5)]
    rows += [(20, t0 + dt.timedelta(minutes=20), "u3", "ok")]
    rows += [(21 + i, t0 + dt.timedelta(minutes=21 + i), "u3", "Connection Refused") for i in range(7)]
    att = spark.createDataFrame(rows, "event_id long, ts timestamp, url string, outcome string")
    out = {r["url"]: r for r in ST.failed_urls(att, 5).collect()}
    assert set(out) == {"u1"}
    assert (out["u1"]["status_code"], out["u1"]["crawl_status"]) == (0, "connection refused")


def test_settings_round_trip_never_stores_passwords(spark):
    s = CrawlSettings(extra={"PROXY_PASSWORD": "secret", "PROXY_HOST": "p:1"},
                      exclusions=(("Contain", "/x"),), extractions=(("Title", "XPath", "//title/text()"),))
    folder = scratch_path(spark, "settings-test")
    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    io.save_crawl(spark, folder, crawl, s)
    loaded = io.load_crawl(spark, folder)
    cfg = dict((r["setting"], r["value"]) for r in loaded["config"].collect())
    assert "PROXY_PASSWORD" not in cfg and cfg["PROXY_HOST"] == "p:1"
    s2 = io.settings_from_config(cfg.items(), [tuple(r) for r in loaded["extractions"].collect()],
                                 [tuple(r) for r in loaded["exclusions"].collect()])
    assert s2.crawl_items == s.crawl_items and s2.exclusions == s.exclusions and s2.extractions == s.extractions
    assert loaded["crawl"].count() == 4


def test_extraction_column_names():
    s = CrawlSettings(extractions=(("My Title", "XPath", "//title"), ("url", "XPath", "//a/@href")))
    assert s.output_columns()[-2:] == ["my_title", "url_custom"]


def test_closure_on_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")],
                                  "url_from string, url_to string")
    start = spark.createDataFrame([("a",)], "url string")
    got = {r["url"]: r["depth"] for r in spider_closure(edges, start).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_selector_parsing_errors():
    with pytest.raises(SelectorError):
        parse_css("a:hover")
    with pytest.raises(SelectorError):
        parse_xpath("//a[position()=1]")
    assert parse_xpath("//div[@class='x']/@href").attr == "href"


def test_selectors_on_fragment(spark):
    html = ("<html><head><title>T</title></head><body><div class='a b' id=m><p>one <b>two</b></p>"
            "<p>three</p></div><ul><li><a href='/1'>1</a></li><li><a href='/2'>2</a></li></ul></body></html>")
    pages = spark.createDataFrame([("u", html)], "url string, html string")

    def one(kind, sel):
        return extract(pages, "x", kind, sel, " | ").first()["x"]

    assert one("CSS Selector", "div.b p") == "one two"
    assert one("CSS Selector", "#m > p b") == "two"
    assert one("CSS Selector", "ul > a") == ""
    assert one("XPath", "//p/text()") == "one | three"
    assert one("XPath", "//ul/li/a/@href") == "/1 | /2"
    assert one("XPath", "//li") == "1 | 2"
    assert one("XPath", "/html/head/title/text()") == "T"


def test_crawl_store_replay_is_noop(spark):
    base = spark.createDataFrame([("a", 200), ("b", None)], "url string, status_code int")
    store = CrawlStore(spark, scratch_path(spark, "store-test")).create(base)
    batch = spark.createDataFrame([("b", 200, 1), ("c", 301, 2)], "url string, status_code int, seq int")
    assert store.apply(batch, 0) == 1
    assert store.apply(batch, 0) == 0  # replayed batch id
    later = spark.createDataFrame([("c", 500, 1), ("a", 404, 2)], "url string, status_code int, seq int")
    store.apply(later, 1)
    cur = {r["url"]: (r["status_code"], r["change"]) for r in store.current().collect()}
    assert cur == {"a": (200, None), "b": (200, "updated"), "c": (301, "new")}


def test_new_sort_replaces_old_and_keeps_filters():
    from sitegraph.functions.filters import with_sort

    f = [("url", "Contains", "x"), ("url", "Sort A-Z", "")]
    assert with_sort(f, "status_code", "Sort Largest To Smallest") == [
        ("url", "Contains", "x"), ("status_code", "Sort Largest To Smallest", "")]


def test_register_views_after_load(spark):
    from sitegraph.operators.views import register_views

    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    edges = spark.createDataFrame([("http://a.com/a_b", "http://a.com/a%b")], "url_from string, url_to string")
    names = register_views(crawl, edges, prefix="t_")
    assert "t_broken_inlinks_4xx" in names
    assert spark.sql("SELECT * FROM t_broken_inlinks_4xx").count() == 1
    assert spark.sql("SELECT * FROM t_content_type_css").count() == 1


def test_stream_restart_after_failure_is_exactly_once(spark):
    from sitegraph.streaming.ingest import run_ingest, write_chunks

    src = scratch_path(spark, "restart-src")
    chunks = [spark.createDataFrame([(f"u{k}-{i}", 200, i) for i in range(3)], "url string, status_code int, seq int")
              for k in range(3)]
    write_chunks(chunks, src)
    base = spark.createDataFrame([("u0-0", None)], "url string, status_code int")
    store = CrawlStore(spark, scratch_path(spark, "restart-store")).create(base)
    ckpt = scratch_path(spark, "restart-ckpt")

    def crash(bid):
        if bid == 1:
            raise RuntimeError("executor lost after the batch was written")

    with pytest.raises(Exception):
        run_ingest(spark, src, store, max_files=1, checkpoint=ckpt, on_batch=crash)
    run_ingest(spark, src, store, max_files=1, checkpoint=ckpt)  # resume
    cur = store.current()
    assert cur.count() == 9
    assert store.log().groupBy("url").count().filter("count > 1").count() == 0
    assert {r["url"]: r["change"] for r in cur.collect()}["u0-0"] == "updated"


def test_two_sources_into_one_store(spark):
    from sitegraph.streaming.ingest import run_ingest, write_chunks

    base = spark.createDataFrame([("b-1", None)], "url string, status_code int")
    store = CrawlStore(spark, scratch_path(spark, "two-store")).create(base)
    for name in ("a", "b"):
        src = scratch_path(spark, f"two-src-{name}")
        for k in range(2):  # a second run of a source takes only what is new there
            write_chunks([spark.createDataFrame([(f"{name}-{k}", 200, k), ("both", 200 + k, k)],
                                                "url string, status_code int, seq int")], src)
            run_ingest(spark, src, store, max_files=1)
    cur = {r["url"]: (r["status_code"], r["change"]) for r in store.current().collect()}
    assert cur == {"a-0": (200, "new"), "a-1": (200, "new"), "b-0": (200, "new"), "b-1": (200, "updated"), "both": (200, "new")}


def test_session_keeps_the_submitted_master_and_needs_a_shared_folder(spark):
    import types

    from sitegraph.session import checkpoint_root, get_session

    assert get_session().sparkContext.master == spark.sparkContext.master
    cluster = types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda *a: None),
        sparkContext=types.SimpleNamespace(master="spark://m:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        checkpoint_root(cluster)


def test_closure_over_a_long_chain_and_a_hub(spark):
    from sitegraph.operators.closure import spider_closure

    edges = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("c3", f"h{k}") for k in range(500)] + [("x", "y")]
    df = spark.createDataFrame(edges, "url_from string, url_to string")
    got = {r["url"]: r["depth"] for r in spider_closure(df, spark.createDataFrame([("c0",)], "url string")).collect()}
    assert got == {f"c{k}": k for k in range(31)} | {f"h{k}": 4 for k in range(500)}


def test_links_are_filtered_before_they_are_made_distinct(spark):
    from sitegraph.operators.views import broken_inlinks

    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    edges = spark.createDataFrame([("http://a.com/a_b", "http://a.com/a%b")] * 2, "url_from string, url_to string")
    out = broken_inlinks(crawl, edges, (400, 499))
    assert out.count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("Join")  # printed top down: the distinct stands over the target join


def test_pointer_is_swapped_in_one_step(spark):
    folder = scratch_path(spark, "pointer-test")
    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    for mode in ("List", "Spider"):
        io.save_crawl(spark, folder, crawl, CrawlSettings(mode=mode))
    assert io.resume_crawl(spark, folder)["settings"].mode == "Spider"
    # a crash between writing the new pointer and the rename leaves the old version
    fs, p = io._fs(spark, f"{folder}/_CURRENT.crashed")
    fs.create(p, True).close()
    assert io.resume_crawl(spark, folder)["settings"].mode == "Spider"


def test_menu_entries_map_to_views(spark):
    from sitegraph.operators.views import ALL_VIEWS, MENU_VIEWS, menu_view

    assert set(MENU_VIEWS.values()) == set(ALL_VIEWS)
    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    assert urls(menu_view("Status Codes", "Client Error (4xx)", crawl)) == ["http://a.com/a%b"]


def test_resume_crawl(spark):
    folder = scratch_path(spark, "resume-test")
    crawl = spark.createDataFrame(CRAWL, SCHEMA)
    edges = spark.createDataFrame([("http://a.com/a_b", "http://a.com/a%b")], "url_from string, url_to string")
    io.save_crawl(spark, folder, crawl, CrawlSettings(mode="List"), inlinks=edges)
    r = io.resume_crawl(spark, folder)
    assert r["settings"].mode == "List"
    assert urls(r["pending"]) == ["http://a.com/new"]
    assert r["progress"].first()["crawled"] == 3
    assert spark.sql("SELECT * FROM broken_inlinks_non_ok").count() == 1


def test_selectors_nested_matches_and_parents(spark):
    from sitegraph.operators.dom import node_table

    html = "<div id=o>a<div id=i>b<span>c</span></div>d</div><div>e</div><p>f<br>g</p>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    n = {r["pos"]: r for r in node_table(pages).collect()}
    spans = [r for r in n.values() if r["tag"] == "span" and r["kind"] == "open"][0]
    assert n[spans["parent"]]["attrs"] == "<div id=i>"
    # every div's whole text, nested ones included in the outer one
    assert extract(pages, "x", "XPath", "//div", " | ").first()["x"] == "abcd | bc | e"
    assert extract(pages, "x", "XPath", "//div/div", " | ").first()["x"] == "bc"
    assert extract(pages, "x", "XPath", "//p/text()", " | ").first()["x"] == "f | g"
    assert extract(pages, "x", "CSS Selector", "div div span", " | ").first()["x"] == "c"
    assert extract(pages, "x", "CSS Selector", "div > span", " | ").first()["x"] == "c"


def test_selectors_on_deeply_unclosed_page(spark):
    html = "<html><body>" + "<p>para " * 3000 + "<b class=x>end</b></body></html>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    assert extract(pages, "x", "CSS Selector", "body p b.x", " | ").first()["x"] == "end"


def _fetch(spark, rows):
    """Fetches (n, url, status, html) as a crawl gets them."""
    kind = "n int, url string, status_code int, html string"
    return spark.createDataFrame(rows, kind).select("*", F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
                                                    F.array().cast("array<struct<url:string,status_code:int,headers:map<string,string>>>").alias("history"))


@pytest.mark.parametrize("swap", [False, True])
def test_the_first_fetch_to_arrive_counts(spark, swap):
    from sitegraph.operators.crawl import build_crawl

    a, b = "<a href=/one>", "<h1>late</h1><a href=/two>"
    rows = [(1, "http://a.com/", 200, a), (2, "http://a.com/", 404, b)]
    fetches = _fetch(spark, rows[::-1] if swap else rows).coalesce(1)
    crawl, links = build_crawl(fetches, CrawlSettings(), order="n")
    got = {r["url"]: r["status_code"] for r in crawl.collect()}
    assert got == {"http://a.com/": 200, "http://a.com/one": None, "http://a.com/two": None}
    assert links.count() == 2
    with pytest.raises(TypeError):
        build_crawl(fetches, CrawlSettings())


def test_bodies_are_read_once(spark):
    from sitegraph.operators.extract import read_pages

    plan = read_pages(_fetch(spark, [(1, "http://a.com/", 200, "<a href=/x>")]), CrawlSettings())._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert plan.count("regexp_replace(html") <= 1 and plan.count("never closed") == 0
    assert plan.count("<script") == 1  # the pattern that cleans a page


def test_no_body_meets_an_exchange_in_a_spider_crawl(spark):
    from sitegraph.operators.crawl import crawl_links

    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /p", 200)], "host string, robots_text string, status_code int")
    fetches = _fetch(spark, [(1, "http://a.com/", 200, "<a href=/x>")])
    plan = crawl_links(fetches, CrawlSettings(), robots).distinct()._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):  # what joins and aggregates see
        if "Join" in line or "Aggregate" in line:
            assert "html" not in line, line
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("ExternalRDD") <= 2  # fetches and robots, once each


def _chunk(spark, rows, kind):
    return spark.createDataFrame(rows, kind).coalesce(1)


def test_first_row_of_a_key_in_either_order(spark):
    from sitegraph.streaming.ingest import run_dedupe, write_chunks

    kind, src = "url string, status_code int, seq int", scratch_path(spark, "dd-src")
    write_chunks([_chunk(spark, [("a", 404, 7), ("a", 200, 3), ("b", 301, 9)], kind)], src)
    folder = scratch_path(spark, "dd")
    run_dedupe(spark, src, order="seq", max_files=1, folder=folder)
    write_chunks([_chunk(spark, [("a", 500, 1), ("c", 200, 2)], kind)], src)  # later to arrive, whatever its number
    got = {r["url"]: r["status_code"] for r in run_dedupe(spark, src, order="seq", max_files=1, folder=folder).collect()}
    assert got == {"a": 200, "b": 301, "c": 200}


def test_dedupe_state_is_bounded_by_the_delay(spark):
    from sitegraph.streaming import ingest as T

    src, kind = scratch_path(spark, "ddb-src"), "url string, ts timestamp, seq int"
    day = dt.datetime(2024, 1, 1)
    for k in range(6):  # new keys every 3 hours, and one that comes again after each
        rows = [(f"u{k}-{i}", day + dt.timedelta(hours=3 * k), i) for i in range(10)] + [("again", day + dt.timedelta(hours=3 * k), 99)]
        T.write_chunks([_chunk(spark, rows, kind)], src)
    folder, held = scratch_path(spark, "ddb"), []
    from pyspark.sql.streaming import StreamingQueryListener

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            held.extend(s.numRowsTotal for s in event.progress.stateOperators)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        out = T.run_dedupe(spark, src, order="seq", ts="ts", delay="1 hour", max_files=1, folder=folder)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(watch)
    assert out.where("url <> 'again'").count() == 60
    assert out.where("url = 'again'").count() == 6  # a first one each time, three delays later
    assert held and max(held) <= 3 * 11  # the keys of a few files, not of all six


def test_attempts_of_a_second_run_go_on(spark):
    from sitegraph.streaming.ingest import run_attempt_counter, write_chunks

    kind, src, folder = "url string, outcome string, ts int, event_id int", scratch_path(spark, "at-src"), scratch_path(spark, "at")
    rows = [("a", "x", k, k) for k in range(4)] + [("b", "x", k, k) for k in range(3)] + [("b", "ok", 1, 9)]
    write_chunks([_chunk(spark, rows, kind)], src)
    run_attempt_counter(spark, src, folder=folder)
    more = [("a", "x", 5, 5), ("a", "x", 6, 6), ("a", "ok", 7, 7), ("a", "x", 8, 8), *[("b", "x", 9, k) for k in range(9)], ("c", "ok", 1, 1)]
    write_chunks([_chunk(spark, more, kind)], src)
    got = run_attempt_counter(spark, src, folder=folder)
    assert {tuple(r) for r in got.collect()} == {("a", 7, 1, True), ("b", 12, 1, False), ("c", 0, 1, False)}
    rows += more
    failed = ST.failed_urls(spark.createDataFrame(rows, kind))
    assert {r["url"] for r in failed.collect()} == {"a"}


def test_compaction_keeps_table_feed_and_replays(spark, monkeypatch):
    from sitegraph.streaming import ingest as T

    kind = "url string, status_code int, seq int"
    base = spark.createDataFrame([("a", 200), ("b", None)], "url string, status_code int")
    batches = [[("b", 301, 1), ("n0", 200, 2)], [("n0", 500, 1), ("n1", 404, 2)], [("n2", 200, 1)], [("a", 500, 1), ("n3", 200, 2)]]

    def run(every):
        monkeypatch.setattr(T, "COMPACT", every)
        store = CrawlStore(spark, scratch_path(spark, f"compact-{every}")).create(base)
        for k, rows in enumerate(batches):
            assert store.apply(spark.createDataFrame(rows, kind), k) == 1
        for k, rows in enumerate(batches):  # replays, merged or not
            assert store.apply(spark.createDataFrame(rows, kind), k) == 0
        return store

    plain, compacted = run(100), run(2)
    table = lambda s: {tuple(r) for r in s.current().select("url", "status_code", "change").collect()}
    feed = lambda s: {tuple(r) for r in s.log().select("url", "status_code", "change").collect()}
    assert table(plain) == table(compacted) == {
        ("a", 200, None), ("b", 301, "updated"), ("n0", 200, "new"), ("n1", 404, "new"), ("n2", 200, "new"), ("n3", 200, "new")}
    assert feed(plain) == feed(compacted)
    assert compacted.log(merged=False) is None and len(compacted._batches(compacted.merged_path)) == 4
    # a batch reads its own buckets of the base only
    plan = compacted.current(only=spark.createDataFrame([("a",)], "url string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_crash_while_compacting_loses_nothing(spark, monkeypatch):
    base = spark.createDataFrame([("a", None)], "url string, status_code int")
    store = CrawlStore(spark, scratch_path(spark, "compact-crash")).create(base)
    store.apply(spark.createDataFrame([("a", 200, 1), ("b", 404, 2)], "url string, status_code int, seq int"), 0)
    want = {tuple(r) for r in store.current().collect()}
    store._write_base(store.current())  # the new base stands, the batch is still in the log
    assert {tuple(r) for r in store.current().collect()} == want


def test_attempts_of_many_urls_count_like_the_rows_in_order(spark):
    import random
    from sitegraph.streaming.ingest import run_attempt_counter, write_chunks

    r, kind = random.Random(8), "url string, outcome string, ts int, event_id int"
    src, folder = scratch_path(spark, "at-many"), scratch_path(spark, "at-many-out")
    state, got = {}, None
    for _ in range(3):
        rows = [(r.choice([None, *"abcdefghijkl"]), r.choice(["ok", "x", "x", "x", None]), r.choice([None, *range(30)]),
                 k) for k in range(150)]
        for url, outcome, *_ in sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[3])):  # no time: last, as in the SQL
            failures, successes, before = state.get(url, (0, 0, 0))
            ok = outcome == "ok"
            state[url] = (failures + (not ok), successes + ok, before + (not ok and not successes))
        write_chunks([spark.createDataFrame(rows, kind).repartition(3)], src)
        got = run_attempt_counter(spark, src, folder=folder, max_files=100, max_retries=3)
    assert {tuple(x) for x in got.collect()} == {(u, f, s, b > 3) for u, (f, s, b) in state.items()}
    # no Python per URL: the counts are aggregates
    assert "Pandas" not in got._jdf.queryExecution().toString()


def test_attempts_with_a_missing_time_come_last(spark):
    from sitegraph.streaming.ingest import run_attempt_counter, write_chunks

    src = scratch_path(spark, "at-null")
    rows = [("a", "x", k, k) for k in range(6)] + [("a", "ok", None, 1)]
    write_chunks([_chunk(spark, rows, "url string, outcome string, ts int, event_id int")], src)
    assert {tuple(x) for x in run_attempt_counter(spark, src).collect()} == {("a", 6, 1, True)}
