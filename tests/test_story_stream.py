"""Clusters as streaming state: any division into micro-batches gives the groups of the batch fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import clusters
from broadsheet.streaming import stories

AT = dt.datetime(2024, 3, 5, 6)
SCHEMA = "pool string, ord long, title string, summary_text string, ts timestamp"


def given(n=90, pools=("main", "local")):
    rng = random.Random(6)
    vocabulary = [f"term{i}" for i in range(300)]
    names = ["Lopez", "Ortega", "Harbor", "Delgado"]
    title = lambda i: " ".join([*rng.sample(vocabulary[i * 17 % 280 : i * 17 % 280 + 16], 6), *rng.sample(names, rng.randrange(3))])
    return [(p, i, title(i), " ".join(rng.sample(vocabulary[i * 17 % 280 :], 5)) + ".", AT + dt.timedelta(minutes=i)) for p in pools for i in range(n)]


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stories.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, ready, bounds, folder, name):
    """The stream over files that hold the items up to each bound."""
    for k, (low, high) in enumerate(zip([-1, *bounds], [*bounds, 10**9], strict=True)):
        ready.where((F.col("ord") > low) & (F.col("ord") <= high)).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02d}")
    stream = spark.readStream.schema(ready.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = stories.clustered(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.pool, r.ord): r.cluster_id for r in spark.table(name).collect()}, q


def test_micro_batches_give_the_groups_of_the_fold(spark, store, tmp_path):
    items = spark.createDataFrame(given(), SCHEMA)
    want = {(r.pool, r.ord): r.cluster_id for r in clusters.cluster(items).collect()}
    ready = clusters.vectors(items).join(items.select("pool", "ord", "ts"), ["pool", "ord"])
    ready.write.parquet(f"{tmp_path}/ready")
    ready = spark.read.parquet(f"{tmp_path}/ready")
    for k, bounds in enumerate(([], [0, 1, 40], [29, 59])):
        got, q = streamed(spark, ready, bounds, f"{tmp_path}/in{k}", f"stories{k}")
        assert got == want
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == len(bounds) + 1
    assert 5 < len(set(want.values())) < 80


def test_the_state_of_a_pool_goes_with_the_watermark(spark, store, tmp_path):
    day = lambda d: AT + dt.timedelta(days=d)
    row = lambda pool, i, ts: (pool, i, ["alpha", "beta"], [0.8, 0.6], ["alpha", "beta"], [], ts)
    schema = "pool string, ord long, terms array<string>, weights array<double>, title_terms array<string>, names array<string>, ts timestamp"
    for k, rows in enumerate([[row("a", 0, day(0))], [row("a", 1, day(1))], [row("b", 2, day(9))], [row("b", 3, day(9))], [row("b", 4, day(9))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stories.clustered(stream).writeStream.format("memory").queryName("gone").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.pool, r.ord, r.cluster_id) for r in spark.table("gone").collect()) == [("a", 0, 0), ("a", 1, 0), ("b", 2, 0), ("b", 3, 0), ("b", 4, 0)]
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) > totals[-1] > 0  # the rows of pool a are no longer there
