"""The first sentences of a text, read from its head where that is enough, are those of the whole text."""

import random

from pyspark.sql import functions as F

from broadsheet.functions import text


def given(seed=4):
    rng = random.Random(seed)
    parts = ["Dr. Li met U.S. staff", "3.1.4 and 2.5 percent", "A.B.", "no", "one two three four five six seven", "Gov. Ann", 'he said "go."', "x" * 400, "Ça va à l'école 😀"]
    ends = [". ", "! ", "?) ", '." ', ".", "... ", ".\n", " "]
    out = ["", "one", "a b c d e f", "a b c d e f. g", None, "word " * 3000]
    out += ["".join(rng.choice(parts) + rng.choice([" ", *ends]) for _ in range(rng.choice([3, 30, 200]))) for _ in range(150)]
    # cuts of a head fall on every sign of a sentence
    return out + ["y" * k + " one two three 3.5 J. K. Low four five.') " * 60 for k in range(60)]


def test_first_sentences_are_those_of_the_whole_text(spark):
    rows = spark.createDataFrame([(t,) for t in given()], "t string")
    for n in (1, 2, 3, 10):
        both = rows.select(text.first_sentences(F.col("t"), n).alias("a"), F.slice(text.sentences(F.col("t")), 1, n).alias("b"))
        assert [r for r in both.collect() if r.a != r.b] == [] and both.where(F.size("a") == n).count() > 30
