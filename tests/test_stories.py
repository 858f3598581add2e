import datetime as dt
import json

from pyspark.sql import functions as F

from broadsheet.operators import clusters, edition, stories
from broadsheet.streaming import notes

AT = dt.datetime(2024, 1, 1)


def test_burst_frame_is_inclusive(spark):
    hour = 3_600_000
    rows = [("A", 0), ("B", hour), ("A", 2 * hour), ("C", 3 * hour), ("D", 3 * hour + 1), ("E", None)]
    items = spark.createDataFrame(
        [(1, o, None if ms is None else AT + dt.timedelta(milliseconds=ms)) for o, ms in rows], "story_id long, outlet string, ts timestamp"
    )
    assert stories.bursts(items).first()["burst"] == 4


def test_same_wording_between_outlets_only(spark):
    text = " ".join(f"word{i}" for i in range(20))
    rows = [(1, 1, "A", text), (1, 2, "A", text), (1, 3, "B", text + " more"), (1, 4, "C", "other words stand here")]
    items = spark.createDataFrame(rows, "story_id long, ord long, outlet string, summary_text string")
    assert sorted((r.a, r.b, r.overlap) for r in stories.same_wording(items).collect()) == [(1, 3, 1.0), (2, 3, 1.0)]


def test_verdict_levels(spark):
    base = {"outlets": 5, "cloned": 0, "anonymous": 0.0, "burst": 0, "statement_led": 0.0, "documented": True, "one_sided": False, "only_independent": False}
    cases = [
        ({"cloned": 3, "anonymous": 0.5, "burst": 6}, "manufactured"),
        ({"cloned": 3}, "single-source"),
        ({"statement_led": 0.5}, "single-source"),
        ({"anonymous": 0.6}, "anonymous"),
        ({"one_sided": True}, "one-sided"),
        ({"only_independent": True}, "under-covered"),
        ({}, None),
    ]
    rows = [tuple({**base, **c}.values()) for c, _ in cases]
    schema = "outlets long, cloned long, anonymous double, burst long, statement_led double, documented boolean, one_sided boolean, only_independent boolean"
    found = stories.verdict(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)).orderBy("i").collect()
    assert [r.verdict for r in found] == [v for _, v in cases]


def test_clusters_follow_order_and_names(spark):
    rows = [
        ("p", 1, "Federal Reserve raises interest rates again", "Federal Reserve raises interest rates again."),
        ("p", 2, "Bank Japan raises interest rates again", "Bank Japan raises interest rates again."),
        ("p", 3, "Federal Reserve raises rates", "Interest rates climb."),
        ("p", 4, "Storm hits coast", "Heavy rain."),
    ]
    got = clusters.cluster(spark.createDataFrame(rows, "pool string, ord long, title string, summary_text string"))
    assert [r.cluster_id for r in got.orderBy("ord").collect()] == [0, 1, 0, 2]


def test_edition_caps_and_echoes(spark):
    day = AT.date()
    story = lambda i, source, beat, names=(), weight=9, local=False, id_=None: (day, i, id_ or f"s{i}", source, beat, local, weight - i, 0, list(names))
    rows = [
        story(0, "A", "world", ["Ann", "Bob"]),
        story(1, "B", "world", ["Ann", "Bob"]),
        story(2, "A", "world"),
        story(3, "A", "world"),
        story(4, "A", "nation"),
        story(5, "A", "health"),
        story(6, "C", "nation", local=True),
        story(7, "D", "nation", id_="s0"),
    ]
    schema = "edition_date date, ord long, id string, source string, beat string, is_local boolean, weight long, ms long, names array<string>"
    got = edition.select_edition(spark.createDataFrame(rows, schema)).orderBy("place").collect()
    assert [(r.section, r.id) for r in got] == [("lead", "s0"), ("lead", "s4"), ("lead", "s5"), ("nation", "s6")]


def test_notes_stream(spark, tmp_path):
    notes_in = [{"note": " fine story "}, {"note": "no"}, {"note": "spam spam", "website": "x"}]
    spark.createDataFrame([(json.dumps(n), "c", AT) for n in notes_in], "body string, client string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("body string, client string, ts timestamp").parquet(f"{tmp_path}/in")
    notes.store(notes.accepted(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.note for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["fine story"]


def test_rate_limit(spark):
    rows = [("c", AT + dt.timedelta(seconds=i)) for i in range(7)] + [("d", AT)]
    got = notes.windows(spark.createDataFrame(rows, "client string, ts timestamp"), "client").where(F.col("refused") > 0).collect()
    assert [(r.client, r.n, r.refused) for r in got] == [("c", 7, 2)]
