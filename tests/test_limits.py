"""Limits in event time against a sorted replay, for several divisions into micro-batches with late events."""

import datetime as dt
import random

import pytest

from broadsheet.streaming import limits, notes, stories

AT = dt.datetime(2024, 3, 5, 12)
SCHEMA = "client string, ts timestamp"


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stories.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(events, most=5, seconds=60):
    out, let = [], {}
    for client, ts in sorted(events):
        times = [t for t in let.get(client, []) if t > ts - dt.timedelta(seconds=seconds)]
        allowed = len(times) < most
        out.append((client, ts, allowed))
        let[client] = times + [ts] * allowed
    return sorted(out)


def streamed(spark, batches, folder, name):
    for k, some in enumerate(batches):
        spark.createDataFrame(some, SCHEMA).repartition(2).write.parquet(f"{folder}/{k:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option("latestFirst", "false").parquet(f"{folder}/*")
    q = limits.in_order(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.client, r.ts, r.allowed) for r in spark.table(name).collect())


def test_any_division_gives_the_sorted_replay(spark, store, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice("abc"), AT + dt.timedelta(seconds=rng.randrange(200), milliseconds=rng.choice([0, 0, 500]))) for _ in range(120)]
    end = [("end", AT + dt.timedelta(hours=1))]  # moves the watermark past all of them
    want = replay(events)
    assert {x[2] for x in want} == {True, False}
    shuffled = rng.sample(events, len(events))  # late by 200 seconds at most, within the five minutes
    for k, parts in enumerate(([events], [shuffled[:30], shuffled[30:31], shuffled[31:]], [sorted(shuffled[60:]), sorted(shuffled[:60], reverse=True)])):
        assert streamed(spark, [*parts, end, end], f"{tmp_path}/{k}", f"in_order{k}") == want


def test_a_client_is_judged_in_order_across_arrow_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        times = [AT + dt.timedelta(seconds=s) for s in (9, 1, 8, 2, 7, 3, 6, 4, 5, 0)]
        spark.createDataFrame([("c", t) for t in times], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = notes.limited(stream).writeStream.format("memory").queryName("by_arrow").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.client, r.ts, r.allowed) for r in spark.table("by_arrow").collect())
        assert got == replay([("c", t) for t in times])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
