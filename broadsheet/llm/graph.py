"""Connected components of links between documents, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the smallest id that each linked id reaches.

    Every round takes the least label of the neighbours and then the label of the label, so a chain of n links needs
    about log n rounds. Each round is written to the shared folder; the driver only learns whether labels changed.
    No links: no rows.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select(
        "id", F.least("id", "label").alias("label")), "labels")
    while True:
        nearby = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(nearby, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = lower.select(F.col("id").alias("label"), F.col("label").alias("head"))
        labels = cut(
            lower.join(heads, "label").select("id", F.col("head").alias("label"), (F.col("head") < F.col("old")).alias("moved")),
            "labels",
        )
        if labels.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.drop("moved")
