import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.operators.filters import is_reporting
from broadsheet.sources.feeds import parse_feed


def value(spark, f, given):
    return spark.createDataFrame([(given,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,facts",
    [
        ("5% now", []),
        ("15% now", ["15"]),
        ("15 percent", ["15 percent"]),
        ("$5 more", ["$5 m"]),
        ("$5 million", ["$5 million"]),
        ("$3.", ["$3."]),
    ],
)
def test_hard_facts(spark, given, facts):
    assert value(spark, text.hard_facts, given) == facts


def test_sentences_keep_decimals_initials_and_titles(spark):
    given = "Astra 6.1 flew over the U.S. coast again today. Dr. Smith said it was a very long day. Too short."
    assert value(spark, text.sentences, given) == [
        "Astra 6.1 flew over the U.S. coast again today.",
        "Dr. Smith said it was a very long day.",
    ]


def test_shingles_and_overlap(spark):
    assert value(spark, text.shingles, "a b c d e f g h") == ["a b c d e f g", "b c d e f g h"]
    assert value(spark, text.shingles, "a b") == []
    one = lambda t: text.overlap(F.array(F.lit("a"), F.lit("b")), F.split(t, ","))
    assert value(spark, one, "a,c,d") == 0.5


def test_double_escaped_html(spark):
    assert value(spark, text.strip_html, "&amp;lt;b&amp;gt;bold&amp;lt;/b&amp;gt;&amp;nbsp;x<script>no</script>") == "bold x"


RSS = """<rss><item><title><![CDATA[One & two]]></title><link><![CDATA[https://a.example/1?x=1]]></link>
<pubDate>Mon, 03 Jun 2024 10:00:00 GMT</pubDate><description>short</description></item>
<item><title>No link</title></item><item><title>Broken date</title><link>https://a.example/2</link><pubDate>soon</pubDate></item>
<entry><title>Atom</title><link rel="alternate" type="text/html" href="https://a.example/3"/><updated>2024-06-03T10:00:00Z</updated></entry><oops>"""


def test_parse_feed(spark):
    rows = parse_feed(spark.createDataFrame([("s", RSS)], "source_id string, xml string")).orderBy("item_ord").collect()
    assert [(r.title, r.link, r.ms) for r in rows] == [
        ("One & two", "https://a.example/1?x=1", 1717408800000),
        ("Broken date", "https://a.example/2", None),
        ("Atom", "https://a.example/3", 1717408800000),
    ]
    assert rows[0].summary == "short"


def test_reporting(spark):
    cases = [
        ("Senate passes a budget bill", "https://a.example/news/1", True),
        ("Senate passes a budget bill", "https://a.example/sport/1", False),
        ("Is this the end of it all?", "https://a.example/1", False),
        ("Watch: the storm arrives now", "https://a.example/1", False),
        ("Two words only", "https://a.example/1", False),
        ("The daily list of things", "https://a.example/1", False),
    ]
    df = spark.createDataFrame([(t, u) for t, u, _ in cases], "title string, link string").coalesce(1)
    assert [r.k for r in df.select(is_reporting(F.col("title"), F.col("link")).alias("k")).collect()] == [k for *_, k in cases]
