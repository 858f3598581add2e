"""Queries over items and stories of the feed view, each with the DuckDB SQL that must return the same rows if SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, rewrite, text
from ..operators import accounts, clusters, edition, filters, stories, weights
from ..operators import items as items_
from ..operators.lineage import shared_folder
from ..sources import feeds
from ..sources.feeds import FEED_ITEMS, SOURCES, feed_items, parse_feed, raw_items, sample_sources
from . import backfill, build
from .sql import SPACE, any_word, facts_of, headed_of, listed, quoted, replaced_each, sentences_of, terms_of, tokens_of, words_of

NOW = "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


ITEMS = "items as (" + FEED_ITEMS.format(documents="documents", events="events") + ")"
SAID = f"said as (select *, {sentences_of('summary_text')} as sents from items)"
HEADED = f"{ITEMS}, {SAID}, head as (select *, {headed_of(2)} as t2, {headed_of(1)} as t1 from said)"


def at_noon(items: DataFrame) -> DataFrame:
    return items.withColumn("now", F.lit(NOW).cast("timestamp"))


# ---- headlines

_LABEL = r"(?i)^(?:breaking|exclusive|just in|developing|watch|video|opinion|analysis|live updates?|update|alert|urgent|new)\s*[:\-–—]\s*"
_BAIT = (
    r"(?i)[,.]?\s*(?:and\s+)?(?:here'?s\s+|here\s+is\s+|this\s+is\s+)?(?:what|why|how)\s+[\w'’ ]{0,24}"
    r"\b(?:know|means?|matters?|happens? next)\b\.?\s*$"
)
_SWAP = r"(?i)\b(?:" + "|".join(sorted(lexicons.SWAPS, key=lambda k: (-len(k), k))) + r")\b"
#: What stripping does to titles of the view: they hold no markup, so only spaces before signs and runs of spaces go.
_PLAIN = rf"trim(regexp_replace(regexp_replace(replace(replace(title, chr(8216), ''''), chr(8217), ''''), '[{SPACE}]+([,.;:!?])', '\1', 'g'), '[{SPACE}]+', ' ', 'g'))"
_PLAIN = rf"regexp_replace(regexp_replace(replace(replace({_PLAIN}, chr(8220), '\"'), chr(8221), '\"'), '\([{SPACE}]+', '(', 'g'), '[{SPACE}]+\)', ')', 'g')"
_CORE = rf"trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '^[^|]{{3,42}}\s\|\s+', ''), '(?i)^(?:stat\+|wsj|subscriber only|members only)\s*:\s*', ''), {quoted(_LABEL)}, ''))"
TITLES = f"{ITEMS}, titles as (select ord, title, {_PLAIN} as plain, {_CORE} as core from items)"


def _titles(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return feed_items(spark, sf_dir).select("ord", *[c.alias(name) for name, c in columns.items()])


@_query(f"with {TITLES} select ord, core from titles")
def headline_core(spark, sf_dir):
    return _titles(spark, sf_dir, core=rewrite.headline_core(F.col("title")))


_HEAT = " + ".join(f"2 * regexp_matches(plain, {quoted(any_word(w.replace('-', '[- ]')))})::int" for w in lexicons.HEAT_WORDS)


@_query(rf"""with {TITLES} select ord, 2 * regexp_matches(plain, {quoted(_LABEL)})::int + 3 * regexp_matches(plain, {quoted(_BAIT)})::int
+ 2 * len(regexp_extract_all(plain, '!')) + 2 * contains(plain, '?')::int + len(regexp_extract_all(plain, '\b[A-Z]{{4,}}\b'))
+ len(regexp_extract_all(plain, {quoted(_SWAP)})) + {_HEAT} as heat from titles""")
def heat_score(spark, sf_dir):
    return _titles(spark, sf_dir, heat=rewrite.heat_score(F.col("title")).cast("long"))


_TO = "(map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in lexicons.SWAPS.items()) + "})"
_CAPITAL = r"len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]')))"
_UP = lambda x: f"upper({x}[1]) || {x}[2:]"


@_query(rf"""with {ITEMS}, ws as (select ord, title, list_filter(regexp_split_to_array(title, '\s+'), lambda w: regexp_matches(w, '^[A-Za-z]')) as ws from items),
t as (select ord, title, len(ws) >= 4 and {_CAPITAL} >= 0.6 * len(ws) as titled from ws),
m as (select ord, title, titled, {_TO} as plain from t)
select ord, {replaced_each('title', _SWAP, lambda m: f"case when (i = 1 and g = '') or (titled and regexp_matches({m}, '^[A-Z]')) then {_UP(f'plain[lower({m})]')} else plain[lower({m})] end")} as title from m""")
def tone_swaps(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.apply_swaps(F.col("title")))


def _without_heat(column: str) -> str:
    for w in lexicons.HEAT_WORDS:
        column = f"regexp_replace({column}, {quoted(any_word(w.replace('-', '[- ]')) + '\\s*')}, '', 'g')"
    return column


@_query(f"with {ITEMS} select ord, {_without_heat('title')} as title from items")
def heat_removed(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.remove_heat(F.col("title")))


_WH = r"(?i)^(?:what|why|how|who|whom|when|where)\s+(?:is|are|was|were|do|does|did|can|could|should|will|would|has|have|had|may|might)\b"


@_query(rf"""with {ITEMS}, q as (select ord, title, trim(split_part(title, '?', 1)) as head, trim(regexp_replace(title, '(?s)^[^?]*\?[\s,.:;\-]*', '')) as tail from items)
select ord, case when not contains(title, '?') then title when len(regexp_split_to_array(tail, '\s+')) >= 5 then upper(tail[1]) || tail[2:]
when head = '' then replace(title, '?', '') when regexp_matches(head, {quoted(_WH)}) then head
when length(regexp_extract(head, '(?s)^(.*)\. ', 1)) > 20 then regexp_extract(head, '(?s)^(.*)\. ', 1) else head end as title from q""")
def questions(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.de_question(F.col("title")))


_AN = r"\b[Aa]n?\s+[A-Za-z](?:[A-Z]\.|[\w'’-])*\.?"
_NEXT = lambda m: rf"regexp_extract({m}, '^[Aa]n?\s+(.*)$', 1)"


def _article(m: str) -> str:
    word = _NEXT(m)
    spelled = rf"(not list_contains({listed(lexicons.READ_AS_WORDS)}, replace({word}, '.', '')) and regexp_matches({word}, '^[A-Z](?:\.|[A-Z]{{1,5}}$)'))"
    vowel = f"((regexp_matches({word}, '(?i)^[aeiou]') and not regexp_matches({word}, '{lexicons.TAKES_A}')) or regexp_matches({word}, '{lexicons.TAKES_AN}'))"
    an = f"case when {spelled} then regexp_matches({word}, '^[AEFHILMNORSX]') else {vowel} end"
    return f"{m}[1] || case when {an} then 'n ' else ' ' end || {word}"


@_query(f"with {ITEMS} select ord, {replaced_each('title', _AN, _article)} as title from items")
def articles(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.fix_articles(F.col("title")))


_LEXICON = rf"""lex as (select distinct w as word from (select unnest(list_concat(regexp_split_to_array(title, '[{SPACE}]+')[2:],
regexp_split_to_array(summary_text, '[{SPACE}]+')[2:120])) as x from items), lateral (select regexp_extract(x, '^([a-z][a-z''’-]+)[,.:;)]?$', 1) as w) where w <> '')"""


@_query(rf"""with {ITEMS}, {_LEXICON}, loud as (select distinct ord, lower(unnest(regexp_extract_all(title, '\b[A-Z]{{4,}}\b'))) as word from items)
select ord, word from loud join lex using (word)""")
def shouted_words(spark, sf_dir):
    """Words that a headline shouts and the lexicon of the day has in lower case (one edition for all)."""
    items = feed_items(spark, sf_dir).withColumn("edition_date", F.lit("2024-01-31").cast("date"))
    lexicon = items_.lexicon(items.withColumn("summary", F.col("summary_text")))
    found = rewrite.ordinary_words(items, ["title"], lexicon, ["edition_date", "ord"], ["edition_date"])
    return found.select("ord", F.explode("ordinary").alias("word"))


@_query(rf"""with {ITEMS} select ord, {replaced_each('title', r'\b[A-Z]{4,}\b', lambda m: f"case when list_contains({listed(lexicons.ACRONYMS)}, {m}) then {m} else {m}[1] || lower({m}[2:]) end")} as title from items""")
def shouting(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.de_caps(F.col("title")))


@_query(rf"""with {ITEMS}, c as (select ord, title, regexp_extract(title, '(?is)^(.*?[.!?])[{SPACE}]+(?:And|Also|Plus|Meanwhile|Elsewhere),[{SPACE}]+', 1) as one from items)
select ord, case when length(one) > 21 then one else title end as title from c""")
def first_story(spark, sf_dir):
    return _titles(spark, sf_dir, title=text.first_story(F.col("title")))


@_query()
def neutral_title(spark, sf_dir):
    return _titles(spark, sf_dir, title=rewrite.neutral_title(F.col("title")))


@_query()
def neutral_prose(spark, sf_dir):
    items = feed_items(spark, sf_dir).select("ord", F.col("summary_text").alias("raw"), F.lit(None).cast("string").alias("body"))
    return rewrite.with_neutral_prose(items, "raw", "body").select("ord", "summary_text", "long_text")


@_query(rf"""with {ITEMS} select ord, regexp_replace(split_part(link, '?', 1), '/$', '') as link_key,
right(regexp_replace(split_part(link, '?', 1), '[^A-Za-z0-9]', '', 'g'), 24) as id,
replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped,
strftime(ts::date, '%A, %B %-d, %Y') as day, cast(timezone('America/Denver', timezone('UTC', ts)) as date) as edition_date from items""")
def display_texts(spark, sf_dir):
    return _titles(
        spark,
        sf_dir,
        link_key=text.link_key(F.col("link")),
        id=text.story_id(F.col("link")),
        escaped=text.escape_html(F.col("title")),
        day=text.long_date(F.to_date("ts")),
        edition_date=text.edition_date(F.col("ts").cast("timestamp")),
    )


# ---- filters, beats, lexicon, newsrooms

_NOT = rf"""regexp_matches(link, '(?i)/(?:{filters.PATHS})/') or regexp_matches(title, '(?i)^(?:{filters.OPENINGS})\b|\b(?:podcast|newsletter|crossword|briefing)\b')
or regexp_matches(core, '(?is)^(?:is|are|was|were|do|does|did|can|could|should|will|would|has|have|had|may|might|am)\b.*\?\s*$')
or regexp_matches(core, {quoted("(?i)^(?:we (?:have to|need to|should) talk about|here'?s why|here'?s what|why i" + chr(92) + "b|what i learned|the case (?:for|against)|in defen[cs]e of|it'?s time to|let'?s" + chr(92) + "b|a love letter|an ode to|confessions of|i tried|i spent)")})
or regexp_matches(title, '(?i)^(?:your|the) (?:weekly|daily|morning|evening)\b') or len(regexp_split_to_array(title, '[{SPACE}]+')) < 4"""


@_query(f"with {ITEMS}, c as (select *, {_CORE} as core from items) select ord from c where not ({_NOT})")
def reporting_filter(spark, sf_dir):
    return feed_items(spark, sf_dir).where(filters.is_reporting(F.col("title"), F.col("link"))).select("ord")


@_query(rf"""with {ITEMS} select ord, section is null or not regexp_matches(title, '(?i)\b(?:{filters.NOT_SECTION_WORDS})\b') as section_ok,
regexp_matches(title || ' ' || summary_text[1:600], '\b(?:{lexicons.PLACES})\b') as in_place,
ts is null or ts between timestamp '{NOW}' - (case when section is null then interval 3 day else interval 7 day end) and timestamp '{NOW}' + interval 2 hour as in_time,
regexp_matches(title || ' ' || summary_text, '(?i)\b(?:originally (?:reported|published)|republished (?:from|with permission)|this story was produced by)\b') as republished_text
from items""")
def item_filters(spark, sf_dir):
    own, now = F.col("section").isNotNull(), F.lit(NOW).cast("timestamp_ntz")
    return _titles(
        spark,
        sf_dir,
        section_ok=~own | ~F.col("title").rlike(filters.NOT_SECTION),
        in_place=filters.in_place(F.col("title"), F.col("summary_text")),
        in_time=F.when(own, filters.in_time(F.col("ts"), now, 7)).otherwise(filters.in_time(F.col("ts"), now, 3)),
        republished_text=F.concat_ws(" ", "title", "summary_text").rlike(text.whole(lexicons.REPUBLISHED)),
    )


_LOW = "lower(title || ' ' || summary_text[1:300])"
_COUNTS = ", ".join(" + ".join(f"contains(t, '{w}')::int" for w in ws) + f" as n{i}" for i, ws in enumerate(lexicons.BEATS.values()))
_MOST = "greatest(" + ", ".join(f"n{i}" for i in range(len(lexicons.BEATS))) + ")"
_FIRST = "case " + " ".join(f"when n{i} = {_MOST} then '{b}'" for i, b in enumerate(lexicons.BEATS)) + " end"


@_query(f"""with {ITEMS}, low as (select ord, source_beat, {_LOW} as t from items), n as (select ord, source_beat, {_COUNTS} from low),
b as (select ord, source_beat, {_MOST} as most, {_FIRST} as best from n)
select ord, case when source_beat = 'world' then case when most >= 3 and best in ('science', 'health', 'climate', 'technology') then best else 'world' end
when most >= 2 then best else source_beat end as beat from b""")
def classify_argmax(spark, sf_dir):
    return _titles(spark, sf_dir, beat=stories.classify(F.col("title"), F.col("summary_text"), F.col("source_beat")))


@_query(f"with {ITEMS}, {_LEXICON} select word from lex")
def lexicon_words(spark, sf_dir):
    """Lower-case words of titles and summaries, without the first of each, of a summary's first 120 (one edition for all)."""
    items = feed_items(spark, sf_dir).select(F.lit("2024-01-31").cast("date").alias("edition_date"), "title", F.col("summary_text").alias("summary"))
    return items_.lexicon(items).select("word")


_SOURCES = "src as (" + SOURCES.format(documents="documents") + ")"


@_query(f"""with {ITEMS}, {_SOURCES}, status as (select outlet as source_id, count(*) as n from items where outlet <> 'src3' group by 1)
select source_ord::bigint as source_ord, id as source_id, s.outlet, coalesce(n, 0) as n_items,
case when n is null then case when id = 'src3' then 'timed out' else 'nothing in the last three days' end end as why from src s left join status on source_id = id""")
def newsrooms(spark, sf_dir):
    counts = feed_items(spark, sf_dir).where("outlet <> 'src3'").groupBy(F.col("outlet").alias("source_id")).agg(F.count("*").alias("n_items"))
    error = F.when(F.col("source_id") == "src3", "timed out")
    sources = sample_sources(spark, sf_dir)
    status = sources.select(F.col("id").alias("source_id")).join(counts, "source_id", "left").withColumn("error", error)
    return items_.newsrooms(sources, status).withColumn("source_ord", F.col("source_ord").cast("long"))


_ARCHIVE = r"select distinct cast(ts as date) as edition_date, regexp_replace(split_part(link, '?', 1), '/$', '') as link_key from items where ts is not null and ord % 3 = 0"


@_query(f"""with {ITEMS}, arch as ({_ARCHIVE}), days as (select distinct cast(ts as date) as edition_date from items where ts is not null)
select distinct d.edition_date, a.link_key from days d join arch a on a.edition_date < d.edition_date and a.edition_date >= d.edition_date - 7""")
def seen_links(spark, sf_dir):
    """Links that the week before each day showed; every third item stands for what was published."""
    items = feed_items(spark, sf_dir).where("ts is not null").withColumn("edition_date", F.to_date("ts"))
    archive = items.where("ord % 3 = 0").select("edition_date", text.link_key(F.col("link")).alias("link_key"))
    return build.seen_links(archive, items.select("edition_date"))


@_query(rf"""with {ITEMS} select ord, {_PLAIN} as title, link, epoch_ms(ts) as ms from items where ts is not null and {_PLAIN} <> ''""")
def parse_feed_items(spark, sf_dir):
    """Feeds of one item each, written from the view and read back."""
    item = (
        F.lit("<rss><channel><item><title><![CDATA["), F.col("title"), F.lit("]]></title><link>"), F.col("link"),
        F.lit("</link><pubDate>"), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"),
    )
    feeds = feed_items(spark, sf_dir).where("ts is not null").withColumn("ts", F.date_trunc("second", "ts"))
    read = parse_feed(feeds.select("ord", "ts", F.concat(*item).alias("xml")))
    return read.select("ord", "title", "link", "ms")


ORACLES["parse_feed_items"] = ORACLES["parse_feed_items"].replace("epoch_ms(ts)", "epoch_ms(date_trunc('second', ts))")

# ---- vectors, wording, bursts

WORDING = f"""sets as (select story_id, ord, outlet, {words_of('summary_text')} as w from items),
sh as (select distinct story_id, ord, outlet, list_aggregate(w[i:i + 6], 'string_agg', ' ') as s
  from (select story_id, ord, outlet, w, unnest(range(1, len(w) - 5)) as i from sets)),
num as (select ord, count(*) as n from sh group by ord),
wording as (select a.story_id, a.ord as a, b.ord as b, any_value(a.outlet) as oa, any_value(b.outlet) as ob, count(*) / least(any_value(x.n), any_value(y.n)) as overlap
  from sh a join sh b on a.story_id = b.story_id and a.s = b.s and a.ord < b.ord and a.outlet <> b.outlet
  join num x on x.ord = a.ord join num y on y.ord = b.ord group by 1, 2, 3)"""
BURST = """timed as (select story_id, outlet, epoch_ms(ts) as ms from items where ts is not null),
burst as (select a.story_id, max(k) as burst from (select a.story_id, a.ms, count(distinct b.outlet) as k from timed a
  join timed b on a.story_id = b.story_id and b.ms between a.ms and a.ms + 10800000 group by 1, 2) a group by 1)"""


@_query(f"with {ITEMS} select * from items")
def feed_view(spark, sf_dir):
    return feed_items(spark, sf_dir)


@_query(f"with {ITEMS}, {WORDING} select story_id, a, b, round(overlap, 6) as overlap from wording where overlap >= 0.25")
def shingle_overlap_pairs(spark, sf_dir):
    return stories.same_wording(feed_items(spark, sf_dir)).select("story_id", "a", "b", F.round("overlap", 6).alias("overlap"))


@_query(f"""with {ITEMS}, tok as (select ord, unnest({tokens_of('title')}) as term from items),
idf as (select term, ln((select count(*) + 1 from items) / (count(distinct ord) + 0.5)) as idf from tok group by term),
raw as (select ord, term, count(*) * any_value(idf) as w from tok join idf using (term) group by 1, 2),
vec as (select ord, term, w / sqrt(sum(w * w) over (partition by ord)) as weight, story_id from raw join items using (ord))
select a.story_id, a.ord as a, b.ord as b, round(sum(a.weight * b.weight), 6) as cosine from vec a join vec b
on a.story_id = b.story_id and a.term = b.term and a.ord < b.ord group by 1, 2, 3""")
def cosine_pairs(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # a row is two blocks of items
    items = feed_items(spark, sf_dir)
    vectors = weights.tfidf(items, "ord", "title").join(items.select("ord", "story_id"), "ord")
    return stories.cosines(vectors, "ord", "story_id").withColumn("cosine", F.round("cosine", 6))


@_query(f"with {ITEMS}, {BURST} select story_id, burst from burst")
def burst_3h(spark, sf_dir):
    return stories.bursts(feed_items(spark, sf_dir))


# ---- stories

_LEAD = """lead as (select * from (select *, row_number() over (partition by story_id order by republished::int, heat,
(camp = 'independent')::int desc, length(summary_text) desc, ord) as k from items) where k = 1)"""


@_query(f"with {ITEMS}, {_LEAD} select story_id, ord, outlet from lead")
def lead_per_group(spark, sf_dir):
    return stories.lead_items(feed_items(spark, sf_dir)).select("story_id", "ord", "outlet")


@_query(f"with {ITEMS} select story_id, outlet, min(ord) as ord from items group by 1, 2")
def first_per_outlet(spark, sf_dir):
    return accounts.coverage(feed_items(spark, sf_dir)).select("story_id", "outlet", "ord")


@_query(rf"""with {ITEMS}, {_LEAD}, g as (select story_id, count(distinct outlet) * 3 + count(distinct camp) * 7 + max(case when camp = 'independent' then 2 else 0 end) as w from items group by 1),
l as (select story_id, scope = 'state' and not regexp_matches(title || ' ' || summary_text, '{any_word(lexicons.NATIONAL)}') as is_local,
  coalesce(ts > timestamp '{NOW}' - interval 30 hour, false) as fresh from lead)
select story_id, w + case when fresh then 5 else 0 end - case when is_local then 9 else 0 end as weight, is_local from g join l using (story_id)""")
def story_weight(spark, sf_dir):
    return stories.weights(at_noon(feed_items(spark, sf_dir)))


@_query(f"with {ITEMS} select story_id, camp, list_sort(list(distinct outlet)) as outlets from items group by 1, 2")
def camp_outlets(spark, sf_dir):
    return feed_items(spark, sf_dir).groupBy("story_id", "camp").agg(F.array_sort(F.collect_set("outlet")).alias("outlets"))


TERMS = f"{HEADED}, tt as (select distinct story_id, camp, unnest({terms_of('t2')}) as term from head), ct as (select story_id, term, count(*) as camps from tt group by 1, 2)"


@_query(f"""with {TERMS}, mine as (select distinct story_id, camp, outlet, unnest({terms_of('t1')}) as term from head),
size as (select story_id, camp, count(*) as n from items group by 1, 2)
select m.story_id, m.camp, m.term, count(*) as outlets from mine m join ct on ct.story_id = m.story_id and ct.term = m.term and camps = 1
join size s on s.story_id = m.story_id and s.camp = m.camp group by 1, 2, 3, n having count(*) >= case when n > 2 then 2 else 1 end""")
def exclusive_terms(spark, sf_dir):
    return stories.exclusive_terms(feed_items(spark, sf_dir))


@_query(f"with {TERMS} select story_id, term, camps from ct where camps >= 2")
def crossed_terms(spark, sf_dir):
    return stories.crossed_terms(feed_items(spark, sf_dir))


_CORE_TERMS = f"""ht as (select distinct story_id, ord, unnest({terms_of('title')}) as term from items), hn as (select story_id, term, count(*) as n from ht group by 1, 2),
core as (select story_id, term from (select *, count(*) filter (n >= 2) over (partition by story_id) as twos from hn) where twos < 2 or n >= 2)"""


@_query(f"with {ITEMS}, {_CORE_TERMS} select story_id, term from core")
def core_terms(spark, sf_dir):
    return accounts.core_terms(feed_items(spark, sf_dir))


CANDIDATES = rf"""{TERMS}, {_CORE_TERMS},
sent as (select story_id, ord, outlet, camp, i - 1 as pos, sents[i] as text from (select *, unnest(range(1, least(len(sents), 3) + 1)) as i from head)),
st as (select story_id, ord, pos, unnest({terms_of('text')}) as term from sent),
sc as (select s.story_id, s.ord, s.pos, count(*) as n, count(c.term) as hits, count(distinct s.term) filter (ct.camps >= 2) as crossed from st s
  left join core c on c.story_id = s.story_id and c.term = s.term left join ct on ct.story_id = s.story_id and ct.term = s.term group by 1, 2, 3),
cand as (select story_id, ord, pos, text, outlet, camp, crossed / sqrt(n) + len({facts_of('text')}) * 0.4 as score from sent join sc using (story_id, ord, pos)
  where n >= 4 and hits >= 2 and not regexp_matches(text, '^[a-z0-9]') and not regexp_matches(text, '(?i)^(?:and|also|meanwhile|plus|elsewhere)\b[,:]?\s')
  and story_id in (select story_id from items group by 1 having count(distinct camp) >= 2))"""


@_query(f"with {CANDIDATES} select story_id, ord, pos, text, outlet, camp, round(score, 6) as score from cand")
def account_candidates(spark, sf_dir):
    return accounts.account_candidates(feed_items(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _five(column: str) -> str:
    w = words_of(column)
    return f"list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string(({w})[i:i + 4], ' ')))"


def _close(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(least(len({a}), len({b})) > 0 and {both} / least(len({a}), len({b})) > 0.3)"


_ONE = "select * from (select *, row_number() over (partition by story_id order by score desc, ord, pos) as k from {left}) where k = 1"


@_query(f"""with {CANDIDATES}, c as (select *, {_five('text')} as sh from cand where score >= 0.6),
p0 as ({_ONE.format(left='c')}),
l1 as (select c.* from c join p0 on p0.story_id = c.story_id where c.outlet <> p0.outlet and not {_close('c.sh', 'p0.sh')}),
p1 as ({_ONE.format(left='l1')}),
l2 as (select c.* from l1 c join p1 on p1.story_id = c.story_id where c.outlet <> p1.outlet and not {_close('c.sh', 'p1.sh')}),
p2 as ({_ONE.format(left='l2')}),
every as (select 0 as place, * from p0 union all select 1, * from p1 union all select 2, * from p2)
select story_id, place, text, outlet, camp, round(score, 6) as score from every""")
def shared_account(spark, sf_dir):
    return accounts.shared_account(feed_items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_query()
def only_from(spark, sf_dir):
    return accounts.only_from(feed_items(spark, sf_dir))


@_query()
def fuller_account(spark, sf_dir):
    items = feed_items(spark, sf_dir).withColumn("long_text", F.lit(None).cast("string"))
    lead = stories.lead_items(items).select("story_id", F.col("title").alias("headline"), text.opening(F.col("summary_text"), 1).alias("shown"))
    return accounts.fuller_account(lead, accounts.coverage(items))


# ---- signals, verdicts, framing

_SIDE = "camp not in ('state', 'independent')"


def _seen(column: str, when: str = "true") -> str:
    """The distinct values in the order of their first item."""
    every = f"coalesce(list({column} order by ord) filter ({when}), [])"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


SIGNALS = f"""{HEADED}, {WORDING}, {BURST},
base as (select story_id, count(distinct outlet) as outlets, {_seen("camp")} as camps,
  round(avg(regexp_matches(t2, '{any_word(lexicons.UNNAMED)}')::int), 2) as anonymous,
  round(avg(regexp_matches(t2, '{any_word(lexicons.STATED)}')::int), 2) as statement_led,
  bool_or(regexp_matches(t2, '{any_word(lexicons.DOCUMENTED)}')) as documented,
  round(avg((camp = 'state')::int), 2) as state_share,
  {_seen("outlet", "camp = 'state'")} as state_outlets,
  {_seen("state", "camp = 'state' and state is not null")} as states, bool_and(camp = 'state') as state_only,
  count(distinct outlet) filter (camp <> 'state') as non_state_outlets,
  count(distinct outlet) filter ({_SIDE}) as n_side, count(distinct camp) filter ({_SIDE}) as sides, min(camp) filter ({_SIDE}) as side,
  {_seen("outlet", _SIDE)} as side_names from head group by story_id),
best as (select story_id, round(max(overlap), 2) as clone_best from wording group by 1),
cl as (select story_id, list_sort(list(distinct outlet)) as cloned_outlets from (select story_id, oa as outlet from wording where overlap >= 0.25
  union select story_id, ob from wording where overlap >= 0.25) group by 1),
sig as (select b.story_id, outlets, camps, anonymous, statement_led, documented, state_share, state_outlets, states, state_only, non_state_outlets,
  coalesce(clone_best, 0) as clone_best, coalesce(cloned_outlets, []) as cloned_outlets, coalesce(len(cloned_outlets), 0) as cloned,
  coalesce(burst, 0) as burst, case when sides = 1 then side end as sole_camp, case when sides = 1 then side_names else [] end as side_outlets,
  sides = 1 and side <> 'center' and n_side >= 2 as one_sided, camps = ['independent'] and outlets >= 2 as only_independent
  from base b left join cl using (story_id) left join best using (story_id) left join burst using (story_id))"""


@_query(f"with {SIGNALS} select * from sig")
def signals(spark, sf_dir):
    return stories.signals(feed_items(spark, sf_dir))


_REASONS = """list_filter([case when cloned >= 3 then cloned || ' outlets used nearly the same wording, so this is likely one source repeated, not ' || cloned || ' separate reports'
    when cloned = 2 then 'two outlets used nearly the same wording' end,
  case when anonymous >= 0.5 and outlets >= 3 then 'most of the coverage relies on unnamed officials' end,
  case when not documented and outlets >= 4 then 'none of the coverage points to a document, court ruling, report or data' end,
  case when statement_led >= 0.5 and outlets >= 3 then 'most of the coverage repeats a press release or official statement' end,
  case when burst >= 6 then burst || ' outlets published it within the same three hours' end,
  case when one_sided then 'reported by ' || array_to_string(side_outlets, ', ') || ', and no outlet from the other side' end,
  case when only_independent then 'no left, center or right outlet has reported it yet' end], lambda x: x is not null)"""
_NAMES = "case sole_camp " + " ".join(f"when '{k}' then '{v}'" for k, v in lexicons.CAMP_NAMES.items()) + " end"


@_query(f"""with {SIGNALS}, h as (select *, (cloned >= 3)::int + (anonymous >= 0.5)::int + (burst >= 6)::int + (statement_led >= 0.5)::int
+ (not documented and outlets >= 4)::int as heavy, {_REASONS} as found from sig),
v as (select *, case when heavy >= 3 then 'manufactured' when cloned >= 3 or (statement_led >= 0.5 and outlets >= 3) then 'single-source'
when anonymous >= 0.6 and outlets >= 3 then 'anonymous' when one_sided then 'one-sided' when only_independent then 'under-covered' end as verdict from h)
select story_id, verdict, case verdict when 'manufactured' then 'This looks like a coordinated push' when 'single-source' then 'Many outlets, one source'
when 'anonymous' then 'Relies on unnamed sources' when 'one-sided' then 'Only ' || {_NAMES} || ' is running this'
when 'under-covered' then 'Only independent outlets have this' end as verdict_title,
case when verdict is not null then case when len(found) > 0 then found else ['based on how the story was covered'] end end as reasons from v""")
def verdict(spark, sf_dir):
    return stories.explained(stories.verdict(stories.signals(feed_items(spark, sf_dir)))).select("story_id", "verdict", "verdict_title", "reasons")


@_query(rf"""with {ITEMS}, s as (select story_id, count(distinct outlet) as outlets, count(distinct camp) filter (camp in ('left', 'center', 'right')) as sides,
bool_or(regexp_matches(title, {quoted("(?i)" + chr(92) + "b(?:" + lexicons.BIG_CLAIMS + ")" + chr(92) + "b")})) as big from items group by 1)
select story_id, case when outlets >= 3 and sides >= 2 then 'confirmed' when outlets = 1 and big then 'unconfirmed' when outlets = 1 then 'single'
when big and sides < 2 then 'thin' else 'some' end as level from s""")
def how_sure(spark, sf_dir):
    s = feed_items(spark, sf_dir).groupBy("story_id").agg(
        F.count_distinct("outlet").alias("o"), F.collect_set("camp").alias("c"), F.bool_or(stories.big_claim(F.col("title"))).alias("b")
    )
    return s.select("story_id", stories.confidence(F.col("o"), F.col("c"), F.col("b")).alias("level"))


#: Words that the test texts do hold, in families as the contested vocabulary has them; the default families come first.
FAMILIES = {**lexicons.FRAMING, "size": ("hether", "anand"), "kind": ("entre", "eaux"), "rank": ("heit", "ung"), "turn": ("ción", "mente")}
_FAMILIES = ", ".join(f"({i}, {quoted(f)}, {quoted(w)})" for i, (f, ws) in enumerate(FAMILIES.items()) for w in ws)


@_query(f"""with {HEADED}, f(i, family, word) as (values {_FAMILIES}),
used as (select distinct story_id, camp, i, family, word from head join f on contains(lower(t2), word)),
split as (select story_id, i, family from used group by 1, 2, 3 having count(distinct camp) >= 2 and count(distinct word) >= 2),
kept as (select story_id, family from (select *, row_number() over (partition by story_id order by i) as k from split) where k <= 3)
select story_id, family, camp, list_sort(list(distinct word)) as words from used join kept using (story_id, family) group by 1, 2, 3""")
def framing_splits(spark, sf_dir):
    return stories.framing(feed_items(spark, sf_dir), FAMILIES)


_CAMPS = "[" + ", ".join(quoted(c) for c in lexicons.CAMP_ORDER) + "]"


@_query(f"""with {ITEMS}, c as (select *, row_number() over (partition by story_id, outlet order by ord) as k from items)
select story_id, list_position({_CAMPS}, camp)::bigint as camp_no, camp, list(outlet order by ord) as outlets, list(link order by ord) as links
from c where k = 1 and list_contains({_CAMPS}, camp) group by story_id, camp""")
def coverage_by_camp(spark, sf_dir):
    found = accounts.by_camp(accounts.coverage(feed_items(spark, sf_dir)))
    return found.select("story_id", "camp_no", "camp", F.col("outlets.source").alias("outlets"), F.col("outlets.link").alias("links"))


@_query(f"""with {SOURCES.format(documents="documents").join(["s as (", ")"])}, p as (select *, list_position({_CAMPS}, camp)::bigint as camp_no from s),
r as (select *, row_number() over (partition by outlet order by camp_no, source_ord) as k from p where camp_no > 0)
select outlet, camp_no, camp, lean, owner from r where k = 1""")
def registry_by_camp(spark, sf_dir):
    return accounts.registry_by_camp(sample_sources(spark, sf_dir)).select("outlet", "camp_no", "camp", "lean", "owner")


# ---- editions


@_query(f"""with {ITEMS}, r as (select *, row_number() over (partition by outlet order by ts desc, ord) as k from items)
select ord, outlet from r where k <= 3 order by ts desc, ord limit 6""")
def per_outlet_cap(spark, sf_dir):
    return edition.capped(feed_items(spark, sf_dir), "outlet", 3, 6, F.desc("ts"), F.col("ord")).select("ord", "outlet")


@_query(rf"""with {ITEMS}, n as (select cast(ts as date) as edition_date, outlet as source, ord, epoch_ms(ts) as ms,
case when regexp_matches(title || ' ' || summary_text, '\b(?:{lexicons.NEAREST})\b') then 3 when regexp_matches(title || ' ' || summary_text, '\b(?:{lexicons.NEAR})\b') then 2 else 1 end as near
from items where ts is not null), k as (select *, row_number() over (partition by edition_date, source order by near desc, coalesce(ms, 0) desc, ord) as k from n)
select edition_date, source, ord, place from (select *, row_number() over (partition by edition_date order by near desc, coalesce(ms, 0) desc, ord) - 1 as place from k where k <= 3) where place < 6""")
def section_lists(spark, sf_dir):
    """The local section of each day, as if every item were a story of one outlet in it."""
    items = feed_items(spark, sf_dir).where("ts is not null")
    ready = items.select(
        F.to_date("ts").alias("edition_date"), F.lit("local").alias("pool"), "ord", F.col("title").alias("headline"), F.col("summary_text").alias("summary"),
        F.col("outlet").alias("source"), F.array("outlet").alias("outlets"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )
    return edition.section_stories(ready, "local", 6, 3, True).select("edition_date", "source", "ord", F.col("place").cast("long").alias("place"))


@_query()
def leader_cluster(spark, sf_dir):
    """The pools of each day: main, local and good, over all outlets."""
    pool = F.concat_ws("/", F.to_date("ts").cast("string"), F.coalesce("section", F.lit("main")))
    return clusters.cluster(feed_items(spark, sf_dir).withColumn("pool", pool))


@_query()
def select_edition(spark, sf_dir):
    """An edition for each day; every item is a story of its own here."""
    items = feed_items(spark, sf_dir)
    names = F.regexp_extract_all("title", F.lit(f"{text.BEHIND}[A-Z][a-zA-Z]{{3,}}{text.AHEAD}"), F.lit(0))
    ready = items.select(
        F.to_date("ts").alias("edition_date"),
        "ord",
        text.story_id(F.col("link")).alias("id"),
        F.col("outlet").alias("source"),
        stories.classify(F.col("title"), F.col("summary_text"), F.col("source_beat")).alias("beat"),
        stories.is_local(F.col("scope"), F.col("title"), F.col("summary_text")).alias("is_local"),
        F.length("title").cast("long").alias("weight"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.array_distinct(F.transform(names, F.lower)).alias("names"),
    )
    return edition.select_edition(ready)


@_query()
def edition_items(spark, sf_dir):
    """Raw items of all days to the items of their editions: filters, beats, plain wording, first of each link."""
    return items_.prepare(raw_items(spark, sf_dir), sample_sources(spark, sf_dir))


@_query()
def edition_days(spark, sf_dir):
    """Editions of days in a row, while feeds list an item for three days: what one day shows, the next seven leave out."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    backfill.backfill(feeds.listed_items(spark, sf_dir), sample_sources(spark, sf_dir), path)
    return backfill.pages(spark, path).select(
        "edition_date", "section", "section_no", "place", "story_id", "id", "headline", "source", "beat", "outlets", "camps", "verdict", "coverage"
    )


@_query()
def edition_pages(spark, sf_dir):
    """The whole chain: raw items to the pages of all days, with what is shown of each story."""
    made = build.build(raw_items(spark, sf_dir), sample_sources(spark, sf_dir))
    shown = build.nested(made)
    return shown.select(
        "edition_date", "section", "section_no", "place", "story_id", "id", "headline", "summary", "source", "beat", "is_local", "outlets", "camps",
        "sure", "verdict", "reasons", "gist", "coverage", "shared", "only", "framing", "account", "flag", "worth_saying",
    )
