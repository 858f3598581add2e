"""What several corpus operators use: the word pattern, word arrays, and tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_BYTES = tuple(SPACE_CHARS.encode())

#: Rows and bytes of one Arrow batch; the bytes count for long texts.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once for a row, also where `use` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor never replays what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # what this write shuffles is in the table afterwards, so its shuffle files can go when it is done
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(df: DataFrame) -> None:
    """Give up the rows of a table that `cut` wrote, once nothing reads it any more."""
    path = df.inputFiles()
    if path:
        folder = path[0].rsplit("/", 1)[0]
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, as in tests, one for local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return (named or "/tmp/checkpoints").rstrip("/")


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The rows of docs as one struct `_doc`, beside the columns that an operator reads; so no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *needed)


def back(found: DataFrame, docs: DataFrame, /, **added: Column) -> DataFrame:
    """The columns of docs again, and those that an operator adds, which take the place of columns of the same names."""
    # in two steps, so that no name of docs is read as an alias by what is added
    made = found.select("_doc", F.struct(*[c.alias(name) for name, c in added.items()]).alias("_new"))
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in added]
    return made.select(*own, *[F.col(f"_new.{name}").alias(name) for name in added])


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts vary from one word to megabytes, and a batch ends at the first row beyond either."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
