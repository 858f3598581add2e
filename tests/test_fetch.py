"""Fetching feeds with a transport of the test's own: one partition a source, errors as rows."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import items
from broadsheet.sources import feeds, fetch

SOURCES = "id string, outlet string, url string, source_ord int"


def _transport():
    def transport(url, timeout):
        if "slow" in url:
            raise TimeoutError(f"no answer within {timeout} seconds")
        if "broken" in url:
            return b"\xff\xfe not xml"
        if "empty" in url:
            return b"  "
        if "latin" in url:
            return '<?xml version="1.0" encoding="iso-8859-1"?><rss><item><title>Café opens on the main street</title><link>https://l.example/1</link></item></rss>'.encode("latin-1")
        if "atom" in url:
            return (
                b'\xef\xbb\xbf<?xml version="1.0"?><feed><entry><title type="html">Council votes on the harbor plan</title><link rel="self" href="https://a.example/self"/>'
                b'<link rel="alternate" href="https://a.example/1"/><updated>2024-03-05T10:00:00Z</updated><summary>It voted.</summary></entry></feed>'
            )
        return f"<rss><item><title>News from number {url[-2:]} of the day</title><link>{url}/1</link></item></rss>".encode()

    return transport


transport = _transport()  # a function inside another one travels with what it holds


def registry(spark, urls):
    return spark.createDataFrame([(f"s{k}", f"Outlet {k}", u, k) for k, u in enumerate(urls)], SOURCES)


def test_fifty_nine_sources_of_which_one_times_out(spark):
    urls = [f"https://f.example/{k:02d}" for k in range(59)]
    urls[7] = "https://slow.example/07"
    sources = registry(spark, urls)
    landed = fetch.fetched(spark, sources, transport)
    assert landed.rdd.getNumPartitions() == 59
    rows = {r.source_id: r for r in landed.collect()}
    assert len(rows) == 59 and {i for i, r in rows.items() if r.error} == {"s7"}
    assert rows["s7"].error == "TimeoutError: no answer within 15 seconds" and rows["s7"].xml is None
    read = feeds.parse_feed(landed.where("error is null").select("source_id", "xml"))
    assert read.count() == 58
    told = items.newsrooms(sources.withColumn("lean", F.lit("x")), feeds.feed_status(landed, read)).where("why is not null").collect()
    assert [(r.source_id, r.n_items) for r in told] == [("s7", 0)] and "TimeoutError" in told[0].why


def test_odd_feeds(spark):
    sources = registry(spark, [f"https://{k}.example/x1" for k in ("latin", "atom", "broken", "empty")] + [None])
    landed = fetch.fetched(spark, sources, transport)
    rows = {r.source_id: r for r in landed.collect()}
    assert "Café opens" in rows["s0"].xml and rows["s1"].xml.startswith("<?xml")
    assert (rows["s2"].error, rows["s3"].error, rows["s4"].error) == (None, "empty", "ValueError: no address")
    got = {r.source_id: r for r in feeds.parse_feed(landed.where("error is null").select("source_id", "xml")).collect()}
    assert got["s1"].link == "https://a.example/1" and got["s0"].title.startswith("Café")
    assert set(got) == {"s0", "s1"}
    assert fetch.fetched(spark, sources.limit(0), transport).count() == 0


def test_feeds_without_end_are_refused(monkeypatch):
    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self, n):
            return b"x" * n

    monkeypatch.setattr("urllib.request.urlopen", lambda *_, **__: Reply())
    with pytest.raises(ValueError, match="too long"):
        fetch.over_http("https://x.example", 1)
