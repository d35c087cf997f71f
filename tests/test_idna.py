"""Punycode host labels against Python's own codec."""

import random

from pyspark.sql import functions as F

from sitegraph.functions import urls
from sitegraph.functions.idna import ascii_host

HOSTS = ["example.com", "bücher.de", "münchen.example.org", "例え.テスト", "пример.испытание", "ü", "üü", "aüaüa.b",
         "😀.com", "x😀y😀z.net", "日本語日本語日本語", "3年b組金八先生", "ドremi", "他们为什么不说中文", "", ".", "ü.", "-ü-", "é" * 63,
         "a" * 62 + "é", "\U0010ffff" * 20 + "é"]


def expected(host):
    return ".".join(x if x.isascii() or len(x) > 63 else "xn--" + x.encode("punycode").decode() for x in host.split("."))


def test_hosts_as_the_codec_writes_them(spark):
    rng = random.Random(5)
    letters = "abz09-" + "éüßñ" + "жщя" + "日本語学" + "́" + "😀\U00020000"
    hosts = HOSTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["é" * 64 + ".de"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", ascii_host(F.col("h")).alias("a")).collect()
    assert [(r.h, r.a) for r in got] == [(h, expected(h)) for h in hosts]


def test_normalised_urls_have_ascii_hosts(spark):
    rows = [("http://BÜCHER.de/straße?q=ü", "http://xn--bcher-kva.de/stra%C3%9Fe?q=%C3%BC"),
            ("https://user@例え.テスト:8443/", "https://user@xn--r8jz45g.xn--zckzah:8443/"),
            ("http://plain.example/a", "http://plain.example/a"), ("http://[::1]/x", "http://[::1]/x")]
    got = spark.createDataFrame([(u,) for u, _ in rows], "u string").select("u", urls.normalise("u").alias("n")).collect()
    assert {(r.u, r.n) for r in got} == set(rows)
