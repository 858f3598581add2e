"""What the outlets of a story say: the account that camps share, what one camp alone reports, and a fuller account.

Picks depend on what was picked before. The shared account picks among the sentences of all items: each pick is one
aggregate over the candidates of all stories, so a story of any size is spread over many tasks. The fuller account picks
among ten sentences of each outlet, which the number of outlets bounds, and folds them in one row of their story.
items: story_id, ord, outlet, camp, title, summary_text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ACCOUNT_ORDER, CAMP_ORDER
from ..functions.text import (
    AHEAD, BEHIND, first_sentences, hard_facts, headed, overlap, proper_names, restates, same_idea, shingles, terms,
)
from .edition import first_of
from .lineage import settled
from .stories import camp_terms, crossed_terms, first_seen

MOVES_ON = "and|also|meanwhile|plus|elsewhere"


def core_terms(items: DataFrame, title: str = "title", held: Column | None = None) -> DataFrame:
    """story_id, term: the terms of two headlines or more, or of any where fewer than two are in two.

    held: the terms of the headline of an item, where they are known already.
    """
    each = items.select("story_id", F.explode(F.array_distinct(terms(F.col(title))) if held is None else held).alias("term"))
    counts = each.groupBy("story_id", "term").agg(F.count("*").alias("_n"))
    enough = counts.groupBy("story_id").agg((F.count_if(F.col("_n") >= 2) >= 2).alias("_two"))
    return counts.join(enough, "story_id").where(~F.col("_two") | (F.col("_n") >= 2)).select("story_id", "term")


def _sentences_of(items: DataFrame, n: int = 3) -> DataFrame:
    """story_id, camp, outlet, ord, pos, text: the first n sentences of each summary."""
    said = first_sentences(F.coalesce("summary_text", F.lit("")), n)
    return items.select("story_id", "camp", "outlet", "ord", F.posexplode(said).alias("pos", "text"))


def _read(items: DataFrame, n: int = 3) -> DataFrame:
    """story_id, camp, outlet, ord, said (the first n sentences of the summary), and the terms of the title and of title and
    opening. Texts are read for this once; n is two or more."""
    summary = F.coalesce("summary_text", F.lit(""))
    said = items.select("story_id", "camp", "outlet", "ord", "title", summary.alias("_summary"), first_sentences(summary, n).alias("said"))
    opened = F.when(F.size("said") > 0, F.array_join(F.slice("said", 1, 2), " ")).otherwise(F.col("_summary"))
    head = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), opened)
    listed = [F.array_distinct(terms(text)).alias(name) for name, text in (("title_terms", F.col("title")), ("head_terms", head))]
    return settled(said.select("story_id", "camp", "outlet", "ord", "said", *listed))


def account_candidates(items: DataFrame) -> DataFrame:
    """story_id, ord, pos, text, outlet, camp, score: sentences about the story, by how many of their terms cross camps."""
    read = _read(items)
    said = read.select("story_id", "camp", "outlet", "ord", F.posexplode("said").alias("pos", "text")).where(
        ~F.col("text").rlike(r"^[a-z0-9]") & ~F.col("text").rlike(rf"(?i)^(?:{MOVES_ON}){AHEAD}[,:]?\s")
    )
    each = said.select("story_id", "ord", "pos", F.explode(terms(F.col("text"))).alias("term"))
    crossed = crossed_terms(read, F.col("head_terms")).select("story_id", "term", F.lit(True).alias("_crossed"))
    core = core_terms(read, held=F.col("title_terms")).withColumn("_core", F.lit(True))
    flags = each.join(crossed, ["story_id", "term"], "left").join(core, ["story_id", "term"], "left")
    counts = flags.groupBy("story_id", "ord", "pos").agg(
        F.count("*").alias("_terms"), F.count("_core").alias("_hits"), F.count_distinct(F.when(F.col("_crossed"), F.col("term"))).alias("_k")
    )
    score = F.col("_k") / F.sqrt(F.col("_terms")) + F.size(hard_facts(F.col("text"))) * 0.4
    several = read.groupBy("story_id").agg(F.count_distinct("camp").alias("_c")).where("_c >= 2").select("story_id")
    scored = said.join(counts.where("_terms >= 4 and _hits >= 2"), ["story_id", "ord", "pos"]).join(several, "story_id", "left_semi")
    return scored.select("story_id", "ord", "pos", "text", "outlet", "camp", score.alias("score"))


def _picked_first(rows: DataFrame, best: Column, columns: list[str]) -> DataFrame:
    """Of each story the row with the least `best`."""
    return rows.groupBy("story_id").agg(F.min_by(F.struct(*columns), best).alias("_p")).select("story_id", "_p.*")


def shared_account(items: DataFrame, most: int = 3, least: float = 0.6, alike: float = 0.3) -> DataFrame:
    """story_id, place, text, outlet, camp, score: the best sentences, one of an outlet, none close to one before it."""
    columns = ["text", "outlet", "camp", "score", "ord", "pos", "_sh"]
    # what sentences are compared by is made once, and a pick is not made again for the next one
    hashed = F.transform(shingles(F.col("text"), 5), lambda x: F.xxhash64(x))
    left = settled(account_candidates(items).where(F.col("score") >= least).withColumn("_sh", hashed))
    picks = []
    for place in range(most):
        pick = settled(_picked_first(left, F.struct(-F.col("score"), "ord", "pos"), columns).withColumn("place", F.lit(place)))
        picks.append(pick)
        if place + 1 < most:
            last = pick.select("story_id", F.col("_sh").alias("_last"), F.col("outlet").alias("_outlet"))
            apart = (F.col("outlet") != F.col("_outlet")) & (overlap(F.col("_last"), F.col("_sh")) <= alike)
            left = left.join(last, "story_id").where(apart).drop("_last", "_outlet")
    return reduce(DataFrame.unionByName, picks).select("story_id", "place", "text", "outlet", "camp", "score")


def _named(text: Column) -> Column:
    """The words of names and the words in capitals of a text, in lower case."""
    parts = F.flatten(F.transform(proper_names(text), lambda n: F.split(F.lower(n), r"\s+")))
    capitals = F.transform(F.regexp_extract_all(text, F.lit(f"{BEHIND}[A-Z]{{3,}}{AHEAD}"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(parts, capitals))


def only_from(items: DataFrame, most_terms: int = 8, most_facts: int = 5) -> DataFrame:
    """story_id, camp, outlets, terms, facts, quote: what one camp of a story carries and the others do not mention.

    A term counts if it is part of a name in the camp's titles or first sentences, if enough of its outlets have it, and
    if no other camp has it in its openings; a fact likewise, from one outlet on. The quote is the sentence with most of
    both, two at least. State camps and stories of one camp have none, and a lone term says too little.
    """
    head = headed(F.col("title"), F.col("summary_text"), 1)
    several = items.groupBy("story_id").agg(F.count_distinct("camp").alias("_c")).where("_c >= 2").select("story_id")
    mine = items.join(several, "story_id", "left_semi").where("camp <> 'state'").select(
        "story_id", "camp", "outlet", "ord", head.alias("_head"), "summary_text"
    )
    by_camp = mine.groupBy("story_id", "camp").agg(F.count("*").alias("_items"), first_seen(F.col("outlet"), F.col("ord")).alias("outlets"))

    each = mine.select("story_id", "camp", "outlet", "ord", F.posexplode(terms(F.col("_head"))).alias("pos", "term"))
    support = each.groupBy("story_id", "camp", "term").agg(
        F.count_distinct("outlet").alias("_o"), F.min(F.struct("ord", "pos")).alias("first")
    )
    named = mine.select("story_id", "camp", F.explode(_named(F.col("_head"))).alias("term")).distinct()
    alone = camp_terms(items).where("camps = 1").select("story_id", "term")
    need = F.when(F.col("_items") > 2, 2).otherwise(1)
    own_terms = (
        support.join(named, ["story_id", "camp", "term"], "left_semi")
        .join(alone, ["story_id", "term"], "left_semi")
        .join(by_camp.select("story_id", "camp", "_items"), ["story_id", "camp"])
        .where(F.col("_o") >= need)
        .select("story_id", "camp", "term", "first")
    )
    all_facts = items.select("story_id", "camp", F.explode(hard_facts(headed(F.col("title"), F.col("summary_text")))).alias("fact")).distinct()
    fact_camps = all_facts.groupBy("story_id", "fact").agg(F.count("*").alias("_c"), F.min("camp").alias("_lo"))
    own_facts = (
        mine.select("story_id", "camp", "ord", F.posexplode(hard_facts(F.col("_head"))).alias("pos", "fact"))
        .join(fact_camps, ["story_id", "fact"], "left")
        .where("_c is null or (_c = 1 and _lo = camp)")
        .groupBy("story_id", "camp", "fact")
        .agg(F.min(F.struct("ord", "pos")).alias("first"))
    )
    said = _sentences_of(mine)
    in_terms = said.select("story_id", "camp", "ord", "pos", F.explode(terms(F.col("text"))).alias("term")).join(
        own_terms.select("story_id", "camp", "term"), ["story_id", "camp", "term"]
    )
    in_facts = said.select("story_id", "camp", "ord", "pos", F.explode(hard_facts(F.col("text"))).alias("fact")).join(
        own_facts.select("story_id", "camp", "fact"), ["story_id", "camp", "fact"]
    )
    place = ["story_id", "camp", "ord", "pos"]
    hits = in_terms.select(*place).unionAll(in_facts.select(*place)).groupBy(*place).agg(F.count("*").alias("_hits")).where("_hits >= 2")
    quotes = said.join(hits, place).groupBy("story_id", "camp").agg(
        F.min_by(F.struct("text", "outlet"), F.struct(-F.col("_hits"), "ord", "pos")).alias("quote")
    )
    first = lambda rows, c, n: rows.groupBy("story_id", "camp").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", c))), lambda x: x[c]), 1, n).alias(f"{c}s")
    )
    none = F.array().cast("array<string>")
    out = (
        by_camp.join(first(own_terms, "term", most_terms), ["story_id", "camp"], "left")
        .join(first(own_facts, "fact", most_facts), ["story_id", "camp"], "left")
        .join(quotes, ["story_id", "camp"], "left")
        .select("story_id", "camp", "outlets", F.coalesce("terms", none).alias("terms"), F.coalesce("facts", none).alias("facts"), "quote")
    )
    return out.where((F.size("terms") >= 2) | (F.size("facts") >= 1))


def coverage(items: DataFrame) -> DataFrame:
    """The first item of each outlet of a story."""
    return first_of(items, ["story_id", "outlet"], F.col("ord"))


def camp_place(camp: Column) -> Column:
    """The place of a camp in the order in which pages show camps; others come last."""
    at = F.array_position(F.array(*[F.lit(c) for c in CAMP_ORDER]), camp)
    return F.coalesce(F.nullif(at, F.lit(0)), F.lit(len(CAMP_ORDER) + 1)).cast("long")


def by_camp(covered: DataFrame) -> DataFrame:
    """story_id, camp_no, camp, outlets: who covers a story, camp after camp as a page lists them. covered: coverage."""
    grouped = covered.groupBy("story_id", "camp").agg(F.array_sort(F.collect_list(F.struct("ord", "outlet", "link", "title"))).alias("_o"))
    shown = F.transform("_o", lambda x: F.struct(x["outlet"].alias("source"), x["title"].alias("title"), x["link"].alias("link")))
    return grouped.where(F.col("camp").isin(*CAMP_ORDER)).select("story_id", camp_place(F.col("camp")).alias("camp_no"), "camp", shown.alias("outlets"))


def registry_by_camp(sources: DataFrame) -> DataFrame:
    """sources as the page's list of newsrooms has them: by camp, then in their order, the first of each outlet."""
    placed = sources.where(F.col("camp").isin(*CAMP_ORDER)).withColumn("camp_no", camp_place(F.col("camp")))
    return first_of(placed, ["outlet"], F.col("camp_no"), F.col("source_ord"))


def fuller_account(
    stories: DataFrame, covered: DataFrame, most: int = 6, most_chars: int = 1100, rounds: int = 10
) -> DataFrame:
    """story_id, place, paragraph, text, outlet: an account woven from the outlets' own sentences, taken in turns.

    stories: story_id, headline, shown (what is shown above it, or null). covered: coverage. In each round every outlet
    offers its next sentence, least slanted camps first. A sentence is passed over if it is a fragment, leaves the
    story, restates the headline or what is shown, repeats an idea, or exceeds `most_chars` once two are there.
    """
    core = core_terms(covered).groupBy("story_id").agg(F.array_sort(F.collect_set("term")).alias("core"))
    rank = F.array_position(F.array(*[F.lit(c) for c in ACCOUNT_ORDER]), F.col("camp"))  # 0 for other camps: they come first
    text = F.coalesce(F.nullif("long_text", F.lit("")), "summary_text", F.lit(""))
    offered = covered.select(
        "story_id", "outlet", F.struct(rank.alias("camp"), "ord").alias("pool"),
        F.posexplode(first_sentences(text, rounds)).alias("round", "text"),
    )
    none = F.array().cast("array<string>")
    above = F.filter(F.array("shown", "headline"), lambda x: F.coalesce(x, F.lit("")) != "")
    seen = F.filter(F.array("shown"), lambda x: F.coalesce(x, F.lit("")) != "")
    story = stories.select("story_id", above.alias("above"), seen.alias("seen")).join(core, "story_id", "left")
    left = offered.join(story.withColumn("core", F.coalesce("core", none)), "story_id").withColumn("at", F.struct("round", "pool"))
    fragment = F.col("text").rlike("^[a-z]") | F.col("text").rlike(rf"(?i)^(?:and|also|meanwhile|plus|but){AHEAD}")
    own = F.array_distinct(terms(F.col("text")))
    drifted = (F.col("round") > 1) & ~F.arrays_overlap(own, F.col("core"))
    again = F.exists("above", lambda x: restates(own, terms(x)))
    left = left.where(~fragment & ~drifted & ~again)
    order = F.array_sort(F.collect_list(F.struct("at", "outlet", "text")))
    per_story = left.groupBy("story_id").agg(order.alias("offers"), F.first("core").alias("core"), F.first("seen").alias("seen"))
    start = F.struct(
        F.array().cast("array<struct<text:string,outlet:string>>").alias("picks"), F.col("seen"), F.lit(0).cast("int").alias("chars")
    )

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["picks"])
        fits = (n < 2) | (acc["chars"] + F.length(x["text"]) <= most_chars)
        new = ~F.exists(acc["seen"], lambda y: same_idea(y, x["text"], F.col("core")))
        longer = F.struct(
            F.concat(acc["picks"], F.array(F.struct(x["text"].alias("text"), x["outlet"].alias("outlet")))).alias("picks"),
            F.concat(acc["seen"], F.array(x["text"])).alias("seen"),
            (acc["chars"] + F.length(x["text"])).alias("chars"),
        )
        return F.when((n < most) & fits & new, longer).otherwise(acc)

    folded = per_story.select("story_id", F.aggregate("offers", start, step, lambda acc: acc["picks"]).alias("picks"))
    taken = folded.select("story_id", F.posexplode("picks").alias("place", "p")).select("story_id", "place", "p.text", "p.outlet")
    size = taken.groupBy("story_id").agg(F.when(F.count("*") > 4, 3).otherwise(2).alias("_size"))
    paragraph = F.floor(F.col("place") / F.col("_size")).cast("int")
    return taken.join(size, "story_id").select("story_id", "place", paragraph.alias("paragraph"), "text", "outlet")


def gist(enriched: Column, first_shared: Column, summary: Column) -> Column:
    """What is said of a story at a glance."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (enriched, first_shared, summary)])


def spread(camps: Column) -> Column:
    """Whether each of the camps of the spread covered a story, as a struct of flags."""
    return F.struct(*[F.array_contains(camps, c).alias(c) for c in ("left", "center", "right", "state", "independent")])


def flag(verdict_title: Column, sure: Column) -> Column:
    """The line that warns of a story: its verdict, or else a fixed note where too few outlets stand behind it."""
    return F.coalesce(verdict_title, F.when(sure.isin("unconfirmed", "thin"), "Unconfirmed: one source, big claim"))
