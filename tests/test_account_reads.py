"""Candidates of the shared account: texts are read once, and picks are not made again for the next one."""

from broadsheet.operators import accounts, stories

ROWS = [
    ("s", 1, "a", "left", "Harbor project wins approval", "Short one. The harbor project won final approval on Monday night. Crews start work on the harbor project in May. It costs 12 million dollars for the harbor project alone. More follows here for sure."),
    ("s", 2, "b", "right", "Harbor project approval", "The harbor project approval cost 40 percent more than planned. Nobody said why."),
    ("s", 3, "c", "center", "Harbor vote", "no sentence"),
    ("s", 4, "d", "center", None, None),
]


def items(spark):
    return spark.createDataFrame(ROWS, "story_id string, ord long, outlet string, camp string, title string, summary_text string")


def test_texts_are_read_once(spark):
    found = accounts.account_candidates(items(spark))
    assert "summary_text" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 2


def test_what_is_read_is_what_the_text_functions_give(spark):
    from pyspark.sql import functions as F

    given = items(spark)
    want = given.select(
        "ord", accounts.first_sentences(F.coalesce("summary_text", F.lit("")), 3).alias("said"), F.array_distinct(accounts.terms(F.col("title"))).alias("title_terms"),
        F.array_distinct(accounts.terms(accounts.headed(F.col("title"), F.col("summary_text")))).alias("head_terms"),
    )
    read = accounts._read(given)
    assert sorted(read.select(want.columns).collect()) == sorted(want.collect())
    crossed = lambda df: {(r.term, r.camps) for r in df.collect()}
    assert crossed(stories.crossed_terms(read, F.col("head_terms"))) == crossed(stories.crossed_terms(given)) != set()


def test_a_pick_is_made_once(spark):
    found = accounts.shared_account(items(spark), least=0.0)
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.place for r in found.orderBy("place").collect()][:2] == [0, 1]
