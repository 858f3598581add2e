"""Weights by blocks of texts, held against the SQL of the query and against one row for each item and term."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from broadsheet.functions.text import tokens
from broadsheet.operators import weights
from broadsheet.plans import catalogue


def given(n, seed=5):
    rng = random.Random(seed)
    words = [f"word{int(rng.expovariate(0.02))}" for _ in range(400)] + ["Über", "naïve", "ISTANBUL", "Kelvin", "İzmir", "that", "with", "abc", "a_bcde", "x" * 300, "\U0001f600", "\x00null"]
    ends = [" ", "\n", ", ", "-", ".", " "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(n)]
    # terms in equal number and of equal weight, and texts without any
    return [*texts, None, "", "the of a", " ".join(f"once{k}" for k in range(300)), "end", "word1", "word1"]


def by_rows(items):
    """One row for each item and term; keys are different and not null."""
    counts = items.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(items.agg(F.count("*").alias("n")))
    w = counts.join(df, "term").withColumn("w", F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 0.5)))
    return w.select("id", "term", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


@pytest.mark.parametrize("block", [1, 3000, 1 << 24])
def test_weights_by_blocks_are_those_by_rows(spark, monkeypatch, block):
    monkeypatch.setattr(weights, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(given(100))], "id string, text string").repartition(3)
    want = {(i, t): w for i, t, w in by_rows(items).collect()}
    got = weights.tfidf(items, "id", "text").collect()
    assert len(got) == len(want) > 2000
    assert all(abs(want[r.id, r.term] - r.weight) < 1e-12 for r in got)


@pytest.mark.parametrize("block", [1, 1 << 24])
@pytest.mark.parametrize("keys", ["once", "null", "repeated"])
def test_top_terms_of_odd_keys_are_those_of_the_sql(spark, tmp_path, monkeypatch, block, keys):
    monkeypatch.setattr(weights, "BLOCK_BYTES", block)
    key = {"once": lambda i: i, "null": lambda i: i or None, "repeated": lambda i: None if i % 5 == 4 else i // 2}[keys]
    # the one letter that DuckDB lowers to another number of letters than Java and JavaScript
    rows = [(key(i), t and t.replace("İ", "I")) for i, t in enumerate(given(150))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["tfidf_top_terms"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["tfidf_top_terms"](spark, str(tmp_path)).select("doc_id", "term", "weight", "k").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 300


def test_what_rounds_to_equal_weights_is_ordered_by_name(spark):
    """df of 1,999 and 2,000 of 100,000 items: one weight is larger, but not after rounding to three digits."""
    items = spark.range(100_000).select("id", F.expr("concat_ws(' ', if(id < 2000, 'aaaa', ''), if(id > 0 and id < 2000, 'bbbb', ''))").alias("text"))
    first = weights.heaviest(items, "id", "text", 1, 3).where("id = 7").collect()
    assert [tuple(r) for r in first] == [(7, "aaaa", 0.707, 1)]
    assert [r.term for r in weights.tfidf(items, "id", "text").where("id = 7").orderBy(F.desc("weight")).collect()] == ["bbbb", "aaaa"]


def test_a_term_is_one_row_for_each_block(spark, tmp_path):
    """Not one for each document: none but the few heaviest is dealt out by documents, and none by document and term."""
    spark.createDataFrame([(i, "some common words here") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["tfidf_top_terms"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = [line.partition("hashpartitioning(")[2] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not [d for d in dealt if "doc_id" in d and "term" in d]
    assert sum(d.startswith("term") for d in dealt) == 1 and "Generate explode" not in plan
