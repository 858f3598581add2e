"""Reader notes as a stream: validation, a limit for each client, links once a week, and a table of what has arrived."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, SECONDS = 5, 60
LENGTHS = {"note": 2000, "story": 300, "section": 80, "edition": 20}
SCHEMA = "note string, story string, section string, edition string, website string"


def cleaned(value: Column, most: int) -> Column:
    """Without control characters and outer spaces, cut to `most`."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")), F.lit(most))


def judged(raw: DataFrame, origins: Sequence[str] = ()) -> DataFrame:
    """raw (body, client, ts; with method and origin if they are known) -> cleaned notes with status and reason.

    status is that of a reply: 204 for a preflight, 405 for another method than POST, 403 for a page that is not allowed,
    400 for a body that is no JSON or an empty note, 200 otherwise. A note that fills in the hidden field is told 200 too,
    but its reason says `hidden`; those with status 200 and no reason are accepted, the rest is the side output.
    """
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    parsed = raw.withColumn("_n", F.from_json("body", SCHEMA))
    origin = F.coalesce(has("origin"), F.lit(""))
    allowed = origin.isin(*origins) | origin.rlike(r"^http://localhost(?::\d+)?\z") if origins else F.lit(True)
    method = F.coalesce(has("method"), F.lit("POST"))
    clean = {c: cleaned(F.col(f"_n.{c}"), n) for c, n in LENGTHS.items()}
    told = lambda status, why: F.struct(F.lit(status).alias("status"), F.lit(why).cast("string").alias("reason"))
    reason = (
        F.when(method == "OPTIONS", told(204, "preflight"))
        .when(method != "POST", told(405, "method"))
        .when(~allowed, told(403, "origin"))
        .when(F.get_json_object("body", "$").isNull(), told(400, "body"))
        .when(cleaned(F.col("_n.website"), 200) != "", told(200, "hidden"))
        .when(F.length(clean["note"]) < 3, told(400, "empty"))
        .otherwise(told(200, None))
    )
    return parsed.select("client", "ts", *[v.alias(c) for c, v in clean.items()], reason.alias("_r")).select("*", "_r.*").drop("_r")


def accepted(raw: DataFrame, origins: Sequence[str] = ()) -> DataFrame:
    """The notes that pass."""
    return judged(raw, origins).where("status = 200 and reason is null").drop("status", "reason")


def rejected(raw: DataFrame, origins: Sequence[str] = ()) -> DataFrame:
    """The notes that do not pass, with status and reason."""
    return judged(raw, origins).where("status <> 200 or reason is not null")


STATE, OUT = "times array<long>", "client string, ts timestamp, allowed boolean"


def limited(events: DataFrame, most: int = LIMIT, seconds: int = SECONDS, late: str = "5 minutes") -> DataFrame:
    """client, ts, allowed of a stream of events (client, ts): false once `most` were allowed in the `seconds` before.

    Events are judged as they come, in order of time within a trigger; limits.in_order waits until all have come.
    The state of a client is the at most `most` times that still count; it goes once the watermark has left them behind.
    """

    def of_client(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        x = pd.concat(list(batches)).sort_values("ts")  # of one client in one trigger, in however many Arrow batches
        let, last = [], 0
        for at in (int(t.value) // 1_000_000 for t in x["ts"]):
            times = [t for t in times if t > at - seconds * 1000]
            let.append(len(times) < most)
            times += [at] * let[-1]
            last = max(last, at)
        yield pd.DataFrame({"client": key[0], "ts": x["ts"], "allowed": let})
        state.update((times,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = events.select("client", "ts").withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(of_client, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_links(items: DataFrame, days: int = 7) -> DataFrame:
    """A stream of items (link_key, ts) without links that came within `days` before; the state goes as time passes."""
    return items.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["link_key"])


def windows(events: DataFrame, who: str, ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    """Counts for each client and minute, with those over the limit; for batches and streams alike."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, f"{SECONDS} seconds").alias("_w"), who).agg(F.count("*").alias("n"))
    return counts.select(who, F.col("_w.start").alias("minute"), "n", F.greatest(F.col("n") - LIMIT, F.lit(0)).cast("long").alias("refused"))


def store(notes: DataFrame, path: str, checkpoint: str):
    """Append what has arrived to a table of notes, then stop; a rerun goes on where the last one ended."""
    return notes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
