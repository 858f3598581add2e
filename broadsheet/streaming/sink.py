"""A sink for micro-batches that a replay does not double and a later batch does not overwrite.

Rows of a batch are written to a staging folder of their own, by edition_date, and count only once a line of the
manifest names that folder. A batch is known by its stream and its number: when a batch runs again after a failure, its
new line takes the place of the old one, and so do its rows, also if they fall on other days now. A batch with another
number adds to what is there, however many rows of the same day earlier ones brought. A day can also be replaced as a
whole, by rows that are built from all that it holds so far.

    <path>/data/run=<stream>-<batch>-<attempt>/edition_date=<day>/...   rows
    <path>/manifest/...                                                  one line for each attempt that was written whole
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.lineage import delete

LINE = "stream string, batch long, attempt long, folder string, n_rows long"


def stream_name(checkpoint: str) -> str:
    """A stream is its checkpoint: the same one goes on counting its batches, another one begins anew."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the manifest; none where nothing was written yet."""
    try:
        return spark.read.schema(LINE).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], LINE)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The lines that count: the last attempt of each batch."""
    last = Window.partitionBy("stream", "batch").orderBy(F.desc("attempt"))
    return lines(spark, path).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def add(rows: DataFrame, path: str, stream: str, batch: int) -> None:
    """Write the rows (with edition_date) of a batch; they take the place of those of an earlier attempt at it."""
    spark = rows.sparkSession
    before = lines(spark, path).where((F.col("stream") == stream) & (F.col("batch") == batch))
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    folder = f"data/run={stream}-{batch}-{attempt}-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("edition_date").parquet(f"{path}/{folder}")
    written = spark.read.parquet(f"{path}/{folder}").count() if _has_rows(spark, f"{path}/{folder}") else 0
    # one file, renamed into place when it is whole: until then readers see the attempt before
    spark.createDataFrame([(stream, batch, attempt, folder, written)], LINE).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _has_rows(spark: SparkSession, folder: str) -> bool:
    """Whether a partitioned table was given any partition: without one it has no schema to read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return any(s.isDirectory() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """What all batches have brought so far, each once. A filter on edition_date reads the partitions of those days alone.

    schema: of the rows, with edition_date; needed only while there may be none.
    """
    folders = [f"{path}/{r.folder}" for r in current(spark, path).where("n_rows > 0").select("folder").collect()]  # one a batch
    if folders:
        return (spark.read.schema(schema) if schema else spark.read).option("basePath", f"{path}/data").parquet(*folders).drop("run")
    if schema is None:
        raise ValueError(f"nothing was written to {path} yet: name the schema")
    return spark.createDataFrame([], schema)


def tidy(spark: SparkSession, path: str) -> int:
    """Delete the rows of attempts that no longer count, once no reader uses them; how many folders went."""
    old = lines(spark, path).join(current(spark, path).select("folder"), "folder", "left_anti").select("folder").distinct().collect()
    for r in old:
        delete(spark, f"{path}/{r.folder}")
    return len(old)


def by_edition(rows: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda x: x):
    """Write what has arrived (with edition_date) to a table of editions, then stop. `read` gives the table."""
    stream = stream_name(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        add(make(batch), path, stream, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
