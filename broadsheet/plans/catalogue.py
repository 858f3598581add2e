"""Queries over the test tables, each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, text
from ..operators import edition, filters, stories, weights
from ..streaming import notes
from . import news
from .sql import any_word, sentences_of, tokens_of

NOW = "2024-01-31 00:00:00"
QUERIES: dict = dict(news.QUERIES)
ORACLES: dict[str, str] = dict(news.ORACLES)


def _query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- parts of the oracles

TOKENS = f"tok as (select doc_id, unnest({tokens_of('text')}) as term from documents)"
IDF = (
    "idf as (select term, count(distinct doc_id) as df, ln((select count(*) + 1 from documents) / (count(distinct doc_id) + 0.5)) as idf"
    " from tok group by term)"
)
TFIDF = f"""{TOKENS}, {IDF}, raw as (select doc_id, term, count(*) * any_value(idf) as w from tok join idf using (term) group by doc_id, term),
vec as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"""

# ---- documents


@_query(f"select doc_id, len({tokens_of('text')}) as n_tokens, len(list_distinct({tokens_of('text')})) as n_distinct from documents")
def tokenize_counts(spark, sf_dir):
    found = _read(spark, sf_dir, "documents").withColumn("t", text.tokens(F.col("text")))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query(f"with {TOKENS}, {IDF} select term, df, round(idf, 6) as idf from idf")
def idf_table(spark, sf_dir):
    return stories.idf(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


@_query(f"""with {TFIDF}, r as (select doc_id, term, round(weight, 6) as weight,
row_number() over (partition by doc_id order by round(weight, 6) desc, term) as k from vec) select doc_id, term, weight, k from r where k <= 5""")
def tfidf_top_terms(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # a row is a block of documents
    return weights.heaviest(_read(spark, sf_dir, "documents"), "doc_id", "text", 5)


@_query(rf"""select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text,
'(?i)\$[\d,.]+\s?(?:billion|million|trillion|bn|m)?|\b\d[\d,.]*\s?(?:{lexicons.COUNTED}|%)\b|\b\d{{2,}}\b'),
lambda m: trim(regexp_replace(lower(m), '\s+', ' ', 'g'))))) as facts from documents""")
def hard_facts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.hard_facts(F.col("text"))).alias("facts"))


@_query(rf"""select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]{{2,}}){{0,2}}\b'),
lambda m: not regexp_matches(m, '^(?:{lexicons.NOT_NAMES})\b')))) as names from documents""")
def proper_names(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.proper_names(F.col("text"))).alias("names"))


@_query(f"select doc_id, i - 1 as place, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {sentences_of('text')} as s from documents))")
def sentences(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@_query(rf"""select source, count(*) as docs, round(avg(regexp_matches(text, '{any_word(lexicons.DOCUMENTED + "|license|copyright")}')::int), 6) as share
from documents group by source""")
def share_matching(spark, sf_dir):
    hit = F.col("text").rlike(text.whole(lexicons.DOCUMENTED + "|license|copyright"))
    return _read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg(hit.cast("double")), 6).alias("share"))


# ---- pages

#: The named entities, written out for the oracle; the pages hold no numeric ones.
_ROUND = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&rsquo;", "''"), ("&lsquo;", "''"), ("&apos;", "''"),
    ("&ldquo;", '"'), ("&rdquo;", '"'), ("&hellip;", "..."), ("&mdash;", ", "), ("&ndash;", ", "), ("&amp;", "&"),
]


def _stripped(column: str) -> str:
    """Three rounds of decoding and stripping, then the spaces; as steps over one row, since each names its text twice."""
    steps = []
    for _ in range(3):
        steps += [f"replace(t, '{a}', '{b}')" for a, b in _ROUND]
        steps += [f"regexp_replace(t, '(?is){p}', ' ', 'g')" for p in ("<script.*?</script>", "<style.*?</style>", "<[^>]*>")]
    steps += [
        "regexp_replace(t, '(?i)&[a-z]+;', ' ', 'g')", "replace(replace(t, chr(8216), chr(39)), chr(8217), chr(39))",
        "replace(replace(t, chr(8220), chr(34)), chr(8221), chr(34))", r"regexp_replace(t, '\(\s+', '(', 'g')", r"regexp_replace(t, '\s+\)', ')', 'g')",
        r"regexp_replace(t, '\s+([,.;:!?])', '\1', 'g')", r"regexp_replace(t, '[\s\x{0b}\x{a0}]+', ' ', 'g')", "trim(t)",
    ]
    for step in steps:
        column = step.replace("(t,", f"({column},", 1).replace("(t)", f"({column})", 1)
    return column


@_query(f"select page_id, md5({_stripped('html')}) as digest, length({_stripped('html')}) as n_chars from pages")
def strip_html_pages(spark, sf_dir):
    clean = _read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return clean.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


_KEY = "regexp_replace(split_part(url, '?', 1), '/$', '')"


@_query(f"select {_KEY} as link_key, min(page_id) as page_id from (select * from pages union all select * from pages) group by 1")
def link_key_dedupe(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    twice = pages.unionByName(pages).withColumn("link_key", text.link_key(F.col("url")))
    return edition.first_of(twice, ["link_key"], F.col("page_id")).select("link_key", "page_id")


@_query(f"select page_id from pages where {_KEY} not in (select {_KEY} from pages where contains(url, '?'))")
def seen_links_anti(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").withColumn("link_key", text.link_key(F.col("url")))
    seen = pages.where(F.col("url").contains("?")).select("link_key")
    return pages.join(seen, "link_key", "left_anti").select("page_id")


# ---- embeddings and events


@_query("""with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label, i, avg(x::double) as x from e group by 1, 2)
select v.vec_id, round(sum(u.x * c.x) / (sqrt(sum(u.x * u.x)) * sqrt(sum(c.x * c.x))), 5) as cosine
from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) u
join c on c.label = u.label and c.i = u.i join embeddings v on v.vec_id = u.vec_id group by 1""")
def embedding_cosine(spark, sf_dir):
    """Cosine to the centre of the label. Centres are arrays, so a vector is neither exploded nor shuffled to meet its own."""
    vectors = _read(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    parts = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "c") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("c", "c")))
    return vectors.join(centre, "label").select("vec_id", F.round(cosine, 5).alias("cosine"))


@_query(f"select event_id from events where ts is null or ts between timestamp '{NOW}' - interval 3 day and timestamp '{NOW}' + interval 2 hour")
def age_window(spark, sf_dir):
    inside = filters.in_time(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))
    return _read(spark, sf_dir, "events").where(inside).select("event_id")


@_query("select user_id, time_bucket(interval 60 second, ts) as minute, count(*) as n, greatest(count(*) - 5, 0) as refused from events group by 1, 2")
def rate_limit_windows(spark, sf_dir):
    return notes.windows(_read(spark, sf_dir, "events"), "user_id").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@_query("""with n as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2)
select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, first) as k from n) where k = 1""")
def modal_value_first_tie(spark, sf_dir):
    n = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "first")).alias("event_type"))
