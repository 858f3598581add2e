"""Optional enrichment of stories by a given function; off by default, and a failure touches one story alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_dashes

MEASURES = (
    "outlets", "camps", "cloned", "anonymous", "documented", "statement_led", "burst", "state_share", "one_sided",
)
SCHEMA = "story_id string, summary string, differences string, verdict_key string, verdict_title string, reasoning string, tokens_in long, tokens_cached long, tokens_out long, error string"
#: Units a million tokens: read, read from a cache, written.
RATES = (4.0, 0.2, 20.0)


def prompts(stories: DataFrame, covered: DataFrame) -> DataFrame:
    """story_id, prompt: what each outlet wrote and what was measured, as JSON. The texts are data, never instructions."""
    row = F.struct("outlet", "camp", "lean", F.col("owner").alias("funding"), "state", F.col("title").alias("headline"), F.col("summary_text").alias("summary"))
    rows = covered.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"]).alias("coverage"))
    measured = F.struct(*[c for c in MEASURES if c in stories.columns])
    return stories.join(rows, "story_id").select("story_id", F.to_json(F.struct("headline", "coverage", measured.alias("measured"))).alias("prompt"))


def enrich(prompted: DataFrame, client: Callable[[str], dict] | None = None, at_once: int = 4) -> DataFrame:
    """One row for each story with what client(prompt) returned, or with its error; no rows without a client.

    At most `at_once` calls run at a time. The verdict `none` means that there is none.
    """
    spark = prompted.sparkSession
    if client is None:
        return spark.createDataFrame([], SCHEMA)
    fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for story_id, prompt in zip(x["story_id"], x["prompt"], strict=True):
                try:
                    answer = {"error": None, **client(prompt)}
                except Exception as e:  # one story's failure stays its own
                    answer = {"error": f"{type(e).__name__}: {e}"}
                rows.append([story_id, *[answer.get(f) for f in fields[1:]]])
            out = pd.DataFrame(rows, columns=fields)
            yield out.astype({f: "Int64" if f.startswith("tokens") else object for f in fields})

    answered = prompted.select("story_id", "prompt").repartition(at_once).mapInPandas(call, SCHEMA)
    some = F.col("verdict_key") != "none"
    tidy = {c: F.when(F.col(c).isNotNull(), without_dashes(F.col(c))) for c in ("summary", "differences", "reasoning")}
    return answered.withColumns(tidy).withColumns({c: F.when(some, F.col(c)) for c in ("verdict_key", "verdict_title", "reasoning")})


def usage(enriched: DataFrame, rates: tuple[float, float, float] = RATES) -> DataFrame:
    """Tokens and cost of a run, over all stories."""
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens_in", "tokens_cached", "tokens_out")]
    cost = sum((s * r for s, r in zip(sums, rates, strict=True)), F.lit(0.0)) / 1e6
    return enriched.agg(*[s.alias(c) for s, c in zip(sums, ("tokens_in", "tokens_cached", "tokens_out"), strict=True)], cost.alias("cost"))
