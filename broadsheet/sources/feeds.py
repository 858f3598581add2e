"""Feeds: parsing RSS and Atom text, and the view of the test tables as feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip_html

#: Items as the test tables give them. Documents without an event have no time. What follows from doc_id stands in for
#: what news would bring: sections of opinion, headlines that argue or shout, local stories, partners' texts. Documents
#: that begin with the same word make a story, so that copies meet in one.
FEED_ITEMS = r"""
select doc_id as ord, source as outlet, case n % 5 when 0 then 'left' when 1 then 'center' when 2 then 'right'
         when 3 then 'state' else 'independent' end as camp,
       case when n % 5 = 3 then case when n % 2 = 0 then 'Aland' else 'Beland' end end as state,
       case when n in (5, 12) then 'local' when n = 13 then 'good' end as section,
       case when n % 4 = 0 then 'world' else 'nation' end as source_beat,
       case when doc_id % 11 = 0 then 'state' else 'national' end as scope,
       text as summary_text,
       case doc_id % 23 when 1 then 'BREAKING: Is ' || t || '?' when 2 then 'Here''s why ' || t when 3 then 'Senate SLAMS ' || t || '!!'
         when 4 then 'A shocking and gut-wrenching ' || t when 5 then 'City column | Mayor vows to fight back against ' || t
         when 6 then 'Officials warn of an historic backlash over ' || t when 7 then 'Opinion: ' || t
         when 8 then 'Here is a FBI memo. And, ' || t when 9 then 'Record-breaking rain HITS Evergreen. ' || t
         else t end as title,
       'https://' || source || '.example/' || case when doc_id % 17 = 0 then 'opinion/' else 'news/' end || cast(doc_id as varchar(20))
         || case when doc_id % 3 = 0 then '?from=feed' else '' end as link,
       ts, cast(doc_id % 4 as int) as heat, doc_id % 7 = 0 as republished,
       coalesce(nullif(regexp_extract(lower(text), '([a-z0-9]+)', 1), ''), '-') as story_id
from (select d.doc_id, d.source, d.text, cast(substr(d.source, 4) as int) as n, e.ts,
        coalesce(nullif(regexp_extract(d.text, '^[.!?]*([^.!?]+[.!?])', 1), ''), substr(d.text, 1, 160)) as t
      from {documents} d left join {events} e on e.event_id = d.doc_id) x"""

#: The registry of sources that goes with them.
SOURCES = r"""
select distinct source as id, 'Outlet ' || source as outlet, 'none' as lean,
       case n % 5 when 0 then 'left' when 1 then 'center' when 2 then 'right' when 3 then 'state' else 'independent' end as camp,
       'owner' as owner, case when n % 4 = 0 then 'world' else 'nation' end as beat,
       case when n % 6 = 5 then 'state' else 'national' end as scope, 'https://' || source || '.example/feed' as url,
       case when n in (5, 12) then 'local' when n = 13 then 'good' end as section,
       case when n % 5 = 3 then case when n % 2 = 0 then 'Aland' else 'Beland' end end as state, n = 12 as place_filter, n as source_ord
from (select source, cast(substr(source, 4) as int) as n from {documents}) x"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "events")}


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FEED_ITEMS, **_tables(spark, sf_dir))


def sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SOURCES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as feeds would hold them, each in the edition of its own day, as built on the evening of that day."""
    items = feed_items(spark, sf_dir)
    day = F.coalesce(F.to_date("ts"), F.lit("2024-01-31").cast("date"))
    return items.select(
        day.alias("edition_date"),
        (day.cast("timestamp") + F.expr("interval 1 day")).alias("now"),
        F.col("outlet").alias("source_id"),
        F.col("ord").alias("item_ord"),
        "title",
        F.col("summary_text").alias("summary"),
        F.lit(None).cast("string").alias("body"),
        "link",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def listed_items(spark: SparkSession, sf_dir: str, days: int = 3) -> DataFrame:
    """The same items as feeds keep listing them: in the edition of their own day and in those of the days after it."""
    items = raw_items(spark, sf_dir).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    later = {"edition_date": F.date_add("edition_date", F.col("_k")), "now": F.col("now") + F.make_dt_interval("_k")}
    return items.withColumns(later).drop("_k")


def read_feeds(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """What a fetcher left in a landing folder, one file `<source id>.xml` a feed: source_id, source_ord, xml, error.

    Sources without a file, or with an empty one, give an error and no text, and never fail the others. Fetching itself
    stays outside: executors need not reach the network, and a rerun reads the same bytes.
    """
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        files = spark.createDataFrame([], "path string, content binary")
    name = F.regexp_extract("path", r"([^/]+)\.xml\z", 1)
    landed = files.select(name.alias("source_id"), F.decode("content", "UTF-8").alias("xml"))
    known = sources.select(F.col("id").alias("source_id"), "source_ord")
    error = F.when(F.col("xml").isNull(), "not fetched").when(F.trim("xml") == "", "empty")
    return known.join(landed, "source_id", "left").withColumn("error", error)


def feed_status(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, n_items, error of each feed."""
    counts = items.groupBy("source_id").agg(F.count("*").alias("n_items"))
    return feeds.select("source_id", "error").join(counts, "source_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def _tag(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)


def _unwrapped(s: Column) -> Column:
    wrapped = r"(?s)<!\[CDATA\[(.*?)\]\]>"
    return F.when(s.rlike(wrapped), F.regexp_extract(s, wrapped, 1)).otherwise(s)


def _first(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _link(block: Column) -> Column:
    text = F.trim(_unwrapped(_tag(block, "link")))
    href = lambda rel: F.regexp_extract(block, rf"""(?i)<link[^>]*{rel}href=["']([^"']+)["']""", 1)
    return _first(F.when(~text.startswith("<"), text), href("""rel=["']alternate["'][^>]*"""), href(""))


def _date(s: Column) -> Column:
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,9},\s*", "")  # Spark does not read names of days
    stamp = F.coalesce(
        *[F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")],
        bare.try_cast("timestamp"),
    )
    return F.nullif(F.unix_millis(stamp), F.lit(0))


def parse_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each item of each feed that has a title and a link: item_ord, title, summary, body, link, ms.

    Malformed feeds give what can be read; a date that cannot be read is null.
    """
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1>"), F.lit(0))
    own = [c for c in feeds.columns if c != xml]
    b = F.col("_block")
    return (
        feeds.select(*own, F.posexplode(blocks).alias("item_ord", "_block"))
        .select(
            *own,
            "item_ord",
            strip_html(_unwrapped(_tag(b, "title"))).alias("title"),
            _unwrapped(_first(_tag(b, "description"), _tag(b, "summary"))).alias("summary"),
            _unwrapped(_first(_tag(b, "content:encoded"), _tag(b, "content"))).alias("body"),
            _link(b).alias("link"),
            _date(_unwrapped(_first(*[_tag(b, t) for t in ("pubDate", "published", "updated", "dc:date")]))).alias("ms"),
        )
        .where("title <> '' and link <> ''")
    )
