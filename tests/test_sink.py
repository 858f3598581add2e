"""The sink by edition: later batches add, replays change nothing, readers never see half an attempt."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet.streaming import sink

DAY = dt.date(2024, 1, 1)
SCHEMA = "link_key string, edition_date date"


def rows(spark, *pairs):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=d)) for k, d in pairs], SCHEMA)


def held(spark, path):
    return sorted((r.link_key, (r.edition_date - DAY).days) for r in sink.read(spark, path, SCHEMA).collect())


def test_two_runs_with_rows_of_one_day_keep_both(spark, tmp_path):
    feed, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for k, some in enumerate([[("k1", 0)], [("k2", 0), ("k3", 1)], []]):
        rows(spark, *some).write.mode("append").parquet(feed) if some else None
        sink.by_edition(spark.readStream.schema(SCHEMA).parquet(feed), out, state).awaitTermination()
        assert held(spark, out) == [("k1", 0), ("k2", 0), ("k3", 1)][: 1 if k == 0 else 3]
    other = f"{tmp_path}/other"  # a stream of its own begins with batch 0 as well
    sink.by_edition(spark.readStream.schema(SCHEMA).parquet(feed), out, other).awaitTermination()
    assert held(spark, out) == sorted([("k1", 0), ("k2", 0), ("k3", 1)] * 2)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    assert held(spark, out) == []
    with pytest.raises(ValueError, match="name the schema"):
        sink.read(spark, out)
    sink.add(rows(spark, ("a", 0), ("b", 1)), out, "s", 0)
    sink.add(rows(spark, ("c", 0)), out, "s", 1)
    for _ in range(2):
        sink.add(rows(spark, ("a", 0), ("b", 1)), out, "s", 0)
        assert held(spark, out) == [("a", 0), ("b", 1), ("c", 0)]
    sink.add(rows(spark, ("a", 2)), out, "s", 0)  # what a replay brings counts, also on other days
    assert held(spark, out) == [("a", 2), ("c", 0)]
    sink.add(rows(spark), out, "s", 1)
    assert held(spark, out) == [("a", 2)]
    assert sink.tidy(spark, out) == 4 and held(spark, out) == [("a", 2)] and len(list((tmp_path / "data").iterdir())) == 2


def test_an_attempt_counts_once_its_line_is_written(spark, tmp_path):
    out = str(tmp_path)
    sink.add(rows(spark, ("a", 0)), out, "s", 0)
    rows(spark, ("x", 0)).write.partitionBy("edition_date").parquet(f"{out}/data/run=s-1-1-broken")  # died before its line
    assert held(spark, out) == [("a", 0)]
    sink.add(rows(spark, ("x", 0)), out, "s", 1)
    assert held(spark, out) == [("a", 0), ("x", 0)]
    failing = rows(spark, ("y", 0)).withColumn("link_key", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        sink.add(failing, out, "s", 0)
    assert held(spark, out) == [("a", 0), ("x", 0)]


def test_days_are_read_alone(spark, tmp_path):
    out = str(tmp_path)
    sink.add(rows(spark, ("a", 0), ("b", 1)), out, "s", 0)
    sink.add(rows(spark, ("c", 1)), out, "s", 1)
    day = sink.read(spark, out).where(F.col("edition_date") == F.lit(DAY + dt.timedelta(days=1)))
    assert sorted(r.link_key for r in day.collect()) == ["b", "c"]
    assert "PartitionFilters: [isnotnull(edition_date" in day._jdf.queryExecution().executedPlan().toString()


def test_rows_can_be_made_on_the_way(spark, tmp_path):
    rows(spark, ("a", 0), ("a", 0), ("b", 0)).write.parquet(f"{tmp_path}/in")
    counted = lambda b: b.groupBy("edition_date", "link_key").agg(F.count("*").alias("n"))
    sink.by_edition(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", counted).awaitTermination()
    assert sorted((r.link_key, r.n) for r in sink.read(spark, f"{tmp_path}/out").collect()) == [("a", 2), ("b", 1)]
