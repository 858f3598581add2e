"""Mixing sources to target weights (operator 10).

Every source gets a share of the corpus: weights in the order of the source names, at most MOST times the source's
own words, what is above going to the others by weight. A target of several times a source's size takes whole copies
of every document and then a part of them. Which part is decided by a threshold on a hash of the document: words are
summed by source and hash bucket, the bucket where the budget runs out is found from running sums of the buckets,
and only that bucket is divided again. No documents are sorted and no rows move but those of boundary buckets.

Null text: size 0, nothing taken. Null source: a source of its own, last in order. Rows that repeat in all of
doc_id and text share a hash and are taken or left together. Ties at a threshold: documents of one key go together. Texts
of any length: only their word counts move. Empty table: no rows. `mix` keeps the columns of its input, whatever their
names. Sources are ordered in one window, one row a source; a corpus has thousands of them at most, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut

WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MOST = 3
#: Bits of the hash that each refinement looks at; the last one looks at all that are left of 60.
LEVELS = (12, 16, 32)


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (words) and key (60 bits of a hash of identifier and text)."""
    seed = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))
    )
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
            "key": F.conv(F.substring(F.md5(seed), 1, 15), 16, 10).cast("long"),
        }
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> the words each source should give.

    A level L exists with target = min(most * size, L * weight) and targets that add up to all words. Sources reach
    their limit in the order of limit / weight, so running sums in that order give L directly.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("_n") % F.lit(len(weights)) + 1).cast("int")
    )
    limited = (
        sizes.withColumn("_n", F.row_number().over(order) - 1)
        .withColumn("weight", pattern.cast("double"))
        .withColumn("_limit", F.col("source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_limit") / F.col("weight"))
    )
    rising = Window.orderBy("_ratio", "_n")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), zero)) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    )
    found = (
        limited.withColumn("_level", level)
        .withColumn("_stops", F.col("_ratio") <= F.col("_level"))
        .withColumn("_final", F.min(F.when(~F.col("_stops"), F.struct("_ratio", "_n", "_level"))).over(whole)["_level"])
    )
    target = F.when(F.col("_stops"), F.col("_limit")).otherwise(
        F.least(F.col("_limit"), F.coalesce(F.col("_final"), F.lit(0.0)) * F.col("weight"))
    )
    return found.select("source", "source_size", target.alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source: whole copies, and the hash key below which documents are taken once more.

    `rows` has source, size, key. Budgets are nested: the budget left inside a boundary bucket is what the next,
    finer histogram has to spend. The last histogram is by key; it stops at the key that comes closest.
    """
    copies = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    spend = plan.select(
        F.col("source").alias("_s"),
        copies.alias("copies"),
        (F.col("target") - copies * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("low"),
    )
    left, inside = 60, rows
    for level, bits in enumerate(LEVELS):
        left -= bits
        joined = inside.join(spend, _same_source("source", "_s"))
        if level:
            joined = joined.where(F.shiftright(F.col("key"), left + bits) == F.shiftright(F.col("low"), left + bits))
        counts = (
            joined.withColumn("_b", F.shiftleft(F.shiftright(F.col("key"), left), left))
            .groupBy("_s", "copies", "rest", "low", "_b")
            .agg(F.sum("size").alias("words"))
        )
        each = Window.partitionBy("_s").orderBy("_b")
        placed = counts.withColumn("_to", F.sum("words").over(each)).withColumn("_from", F.col("_to") - F.col("words"))
        if left:
            # the bucket in which the budget runs out; the words below it are spent
            hit = placed.where((F.col("_from") <= F.col("rest")) & (F.col("rest") < F.col("_to")))
            spend = hit.select(
                "_s", "copies", (F.col("rest") - F.col("_from")).alias("rest"), F.col("_b").alias("low")
            )
        else:
            # take a key while that comes closer to the budget than stopping before it
            over = F.col("_to") - F.col("rest")
            take = (over <= 0) | (over < F.col("rest") - F.col("_from"))
            spend = placed.groupBy("_s", "copies").agg(
                F.coalesce(F.max(F.when(take, F.col("_b") + 1)), F.min("_b")).alias("below")
            )
    whole = plan.select(F.col("source").alias("_p"), copies.alias("_copies"))
    return whole.join(spend.drop("copies"), _same_source("_p", "_s"), "left").select(
        F.col("_p").alias("_source"), F.col("_copies").alias("copies"), F.coalesce("below", F.lit(0)).alias("below")
    )


def budgets(rows: DataFrame) -> DataFrame:
    """One row for each source (_src): its words, target, whole copies and the key below which one more is taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(sizes), "mix-targets")
    limits = thresholds(rows.select("source", "size", "key"), plan)
    found = plan.join(limits, _same_source("source", "_source"), "left").select(
        F.col("source").alias("_src"), "source_size", "target", "copies", "below"
    )
    return cut(found, "mix-budgets")


def take(rows: DataFrame) -> DataFrame:
    """rows (source, size, key, ...) with source_size, target, times and taken, the words that the mix takes."""
    times = F.col("copies") + (F.col("key") < F.col("below")).cast("long")
    return (
        rows.join(budgets(rows), _same_source("source", "_src"), "left")
        .withColumn("times", times)
        .withColumn("taken", F.col("size") * F.col("times"))
        .drop("_src", "copies", "below")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken. Documents without words are left out.

    Sizes and keys are computed once for the budgets, without texts, and again where the texts are read to be
    written out, which is cheaper than moving the texts to a join by document.
    """
    rows = cut(sized(docs.select("doc_id", "text", "source")).select("source", "size", "key"), "mix-sizes")
    limits = budgets(rows)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = sized(docs.withColumn("_doc", doc)).select("_doc", "source", "size", "key").where("size > 0")
    times = F.col("copies") + (F.col("key") < F.col("below")).cast("long")
    joined = tagged.join(limits, _same_source("source", "_src"), "left")
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
    return joined.select("_doc", copies).select("_doc.*")
