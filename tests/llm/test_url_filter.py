import pytest
from pyspark.sql import functions as F

from tablesmith.llm.common import hash_sample
from tablesmith.llm.url_filter import RULES, filter_urls

UPPER = {c: c + 32 for c in range(65, 91)}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(UPPER), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(url):
    host, path = split(url)
    fits = [(len(t), t, v) for v, t in RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def check(rows, urls):
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == split(urls[r.page_id]), urls[r.page_id]
        rule, verdict = rule_of(urls[r.page_id])
        assert r.rule == rule and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = filter_urls(pages).collect()
    check(rows, {r.page_id: r.url for r in pages.select("page_id", "url").collect()})
    ruled = [r for r in rows if r.rule]
    assert sum((r.block_chance >= 0.5) == (r.verdict == "block") for r in ruled) > 0.95 * len(ruled)
    assert {r.verdict for r in rows if not r.rule} == {"allow", "block"}


def test_odd_urls(spark):
    urls = dict(enumerate([
        None, "", "example.org/es/1", "http://", "http://example.org", "http://EXAMPLE.org/es/x?y=/z", "ftp://a.b.example.org/en/1#://x", "x://y://z/es/",
        "http://notexample.org/es/1", "http://org/x", "http://com/de", "http://a.com/de/", "http://a.com/fr/?a=1&b=2", "http://a.com\n/de/\n", "http://a.com?/de/",
        "http://é.com/de/" + "x" * 20000, "http://a.net/1", "http://a.net/1",
    ]))
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in urls.items()], "page_id long, url string, host string, label double")
    check(filter_urls(df).collect(), urls)


@pytest.mark.parametrize("verdict", ["allow", "block"])
def test_one_verdict_or_none(spark, verdict):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in filter_urls(df, [(verdict, "org/")]).collect()} == {verdict}
    assert {r.verdict for r in filter_urls(df, []).collect()} == {"allow"}
    assert filter_urls(df.where("page_id < 0")).collect() == []


@pytest.mark.parametrize("copies", [1, 1000])
def test_repeated_labelled_urls_do_not_shrink_the_sample(spark, copies):
    urls = [f"http://a{i}.org/x" if i % 2 else f"http://b{i}.com/de/{i}" for i in range(400)]
    once = spark.createDataFrame([(u,) for u in urls], "url string")
    df = once.crossJoin(spark.range(copies).select(F.col("id").alias("page_id")))
    order = [r.url for r in once.orderBy(F.xxhash64("url")).collect()]
    for n in (50, 400, 1000):
        assert [r.url for r in hash_sample(df, n, "url").orderBy(F.xxhash64("url")).collect()] == order[:n]
    rest = spark.createDataFrame([(-1, "http://c.net/1"), (-2, "http://c.com/de")], "page_id long, url string")
    rows = filter_urls(df.unionByName(rest)).select("rule", "page_id", F.col("block_chance").between(0.0001, 0.9999).alias("learned")).distinct().collect()
    assert all(r.learned for r in rows)
