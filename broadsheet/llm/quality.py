"""Quality rules with thresholds learned from the corpus (operator 5).

Each document gets integer measures. A fixed rule fails texts that are too short or mostly repeat themselves. The
other rules have no fixed cutoff: for each language and source, quantile sketches of the measures give a fence, the
value at a high rank plus a multiple of its distance from the value at a low rank, and a document beyond a fence is
rejected. The fence of a source is drawn towards that of its language, and that towards the corpus, as if the wider
group lent it PRIOR documents; so a small group goes by its language and a large one by itself, without a switch. A
fence is never above that of the language or of the corpus, so that a bad source cannot excuse itself.

Where most values are equal, as the many zeros of a measure that clean texts never show, the distance of two ranks is
zero; wider ranks would soon lie among the junk itself. What counts as no distance then is the grain of the measure: the
share that one symbol, line or word makes in a short document of the group, the one at the rank SHORT by size. So the
least distance comes from sketches as well, and is no fixed number.

A sketch is a histogram of whole numbers (shares in millionths, sizes) that keeps their first PRECISION binary digits:
at most 2^PRECISION counters and as many halves for each further digit, a relative error below 1/64, and two sketches
merge by adding counters, in any order. Ranks are exact between counters; the upper edge of a counter is what counts.

Null text: no words, base_failed. Null language or source: a group of its own. Ties at a rank: the value there counts
as within. Repeated rows: each is judged. Texts of any length. Empty table: no rows. Columns of the input stay, whatever
their names, but for those that this operator adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, aside, back, bind, cut, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRESS = "!?"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Measure -> two ranks of its sketch in thousandths, the reach beyond, and the size that the measure is a share of.
#: Ranks of 250 and 750 hold while under a quarter of a group is junk. Repeats are zero in most clean texts and spread
#: widely in the others, so their ranks lie in the tail.
MEASURES = {
    "symbols": (250, 750, 6, "word_chars"),
    "capitals": (250, 750, 6, "word_chars"),
    "stress": (250, 750, 6, "word_chars"),
    "same_lines": (500, 980, 3, "n_lines"),
    "repeated": (500, 980, 3, "n_words"),
}
SIZES = ("word_chars", "n_lines", "n_words")
WHOLE, PRECISION, SHORT = 1_000_000, 7, 250
#: How many documents a wider group lends to the fence of a narrower one.
PRIOR = 200
KEY = ["lang", "source"]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more; linear in sorts of positions, no explode."""
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(bind(ordered, twice), lambda x: x["i"]))
        total = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")
            ),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return bind(windows, covered)


#: What measure adds to its input.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "n_lines", *[f"m_{m}" for m in MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """docs with the counts of the fixed rules and the measures m_* in millionths."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, SPACE_CHARS) > 0)
    out = aside(docs, "text").withColumn("_w", words(F.col("text"))).withColumn("_lines", lines)
    chars = _without(text, SPACE_CHARS)
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": chars.cast("long"),
            "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_w")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "_capitals": F.length(text) - _without(text, CAPITALS),
            "_stress": F.length(text) - _without(text, STRESS),
        }
    )
    share = lambda part, whole: F.coalesce(
        F.try_divide(F.lit(WHOLE) * F.col(part).cast("long"), F.col(whole)), F.lit(0)
    ).cast("int")
    return back(
        out,
        docs,
        **{c: F.col(c) for c in COUNTS},
        base_failed=(F.col("n_words") < MIN_WORDS)
        | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words")),
        n_lines=F.col("n_lines"),
        m_symbols=share("n_symbols", "word_chars"),
        m_capitals=share("_capitals", "word_chars"),
        m_stress=share("_stress", "word_chars"),
        m_same_lines=share("n_dup_lines", "n_lines"),
        m_repeated=share("n_repeat_words", "n_words"),
    )


def _dropped_bits(value: Column) -> Column:
    """How many binary digits of a whole number a sketch does not keep."""
    return F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))


def bucket(value: Column) -> Column:
    """The lower edge of the counter of a value."""
    bits = _dropped_bits(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def _upper(edge: Column) -> Column:
    return edge + F.call_function("shiftleft", F.lit(1).cast("long"), _dropped_bits(edge)) - 1


def sketches(measured: DataFrame) -> DataFrame:
    """One row for each language, source, measure or size, and counter: the sketches."""
    kept = {m: f"m_{m}" for m in MEASURES} | {size: size for size in SIZES}
    values = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(c).cast("long")).alias("value")) for m, c in kept.items()])
    return (
        measured.where(~F.col("base_failed"))
        .select(*KEY, F.explode(values).alias("m"))
        .groupBy(*KEY, F.col("m.measure").alias("measure"), F.col("m.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def merge(counters: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return counters.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def _fences(counters: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each group a struct `name` with its number of documents and a fence for each measure."""
    each = Window.partitionBy(*by, "measure")
    placed = counters.withColumns(
        {"_to": F.sum("n").over(each.orderBy("value")), "_all": F.sum("n").over(each)}
    )
    rank = lambda q: F.min(F.when(F.col("_to") * 1000 >= F.col("_all") * q, F.col("value")))
    at = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(f"_q{q}")))
    ranks = sorted({SHORT, *[q for low, high, *_ in MEASURES.values() for q in (low, high)]})
    found = placed.groupBy(*by, "measure").agg(*[rank(q).alias(f"_q{q}") for q in ranks], F.max("_all").alias("docs"))

    def fence(m: str) -> Column:
        low, high, reach, size = MEASURES[m]
        grain = F.floor(F.lit(WHOLE) / F.greatest(at(size, SHORT), F.lit(1)))
        top = _upper(at(m, high))
        return (top + reach * F.greatest(top - at(m, low), grain)).alias(m)

    return found.groupBy(*by).agg(F.struct(F.max("docs").alias("docs"), *[fence(m) for m in MEASURES]).alias(name))


def fences(counters: DataFrame) -> DataFrame:
    """The fence of each measure for each language and source that has documents."""
    own = _fences(counters, KEY, "own")
    lang = _fences(merge(counters, ["lang"]), ["lang"], "wide").withColumnRenamed("lang", "_lang")
    everything = _fences(merge(counters.withColumn("_one", F.lit(1)), ["_one"]), ["_one"], "widest")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(everything))  # one row

    def drawn(group: str, m: str, wider: Column) -> Column:
        n = F.col(f"{group}.docs").cast("double")
        return (n * F.col(f"{group}.{m}") + PRIOR * wider) / (n + PRIOR)

    def limit(m: str) -> Column:
        corpus = F.col(f"widest.{m}").cast("double")
        language = drawn("wide", m, corpus)
        return F.least(corpus, language, drawn("own", m, language))

    limits = F.struct(*[limit(m).alias(m) for m in MEASURES])
    return joined.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), limits.alias("_fence"))


#: Bytes of fences up to which they go to every task; beyond, Spark shuffles both sides and splits skewed groups.
BROADCAST_BYTES = 8 << 20
_FENCE_BYTES = 200


def judge(measured: DataFrame, counters: DataFrame) -> DataFrame:
    """measured with kept: false if the fixed rules failed or a measure is beyond the fence of its group."""
    limit = cut(fences(counters), "quality-fences")
    if limit.count() * _FENCE_BYTES <= BROADCAST_BYTES:
        limit = F.broadcast(limit)
    rows = aside(measured, *KEY, "base_failed", *[f"m_{m}" for m in MEASURES])
    joined = rows.join(limit, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    within = reduce(
        lambda a, b: a & b,
        [F.col(f"m_{m}") <= F.coalesce(F.col(f"_fence.{m}"), F.lit(float(WHOLE))) for m in MEASURES],
    )
    return back(joined, measured, kept=~F.col("base_failed") & within)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject; the columns of docs, nothing more.

    The measures are written with their documents before anything filters on them: a filter that Spark moves below the
    measures would compute the words of a text again for every word.
    """
    tagged = measure(aside(docs, "text", *KEY))
    measured = cut(tagged.drop("text", *[c for c in COUNTS if c not in SIZES]), "quality-measured")
    return judge(measured, sketches(measured)).where("kept").select("_doc.*")
