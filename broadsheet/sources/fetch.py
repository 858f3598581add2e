"""Feeds as a data source: one partition for each source of the registry, fetched by its own task.

A source that cannot be read gives a row with an error and never fails the others; a task that is lost fetches its
source again. How bytes come in is a function that is handed in, so that tests and closed networks bring their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds until a feed counts as silent, and how much of one is read at most before it counts as none.
TIMEOUT, MOST_BYTES = 15, 64 << 20
SCHEMA = "source_id string, source_ord int, xml string, error string"

Transport = Callable[[str, float], bytes]


def over_http(url: str, timeout: float) -> bytes:
    from urllib.request import Request, urlopen

    request = Request(url, headers={"User-Agent": "broadsheet", "Accept": "application/rss+xml, application/atom+xml, text/xml"})
    with urlopen(request, timeout=timeout) as reply:  # noqa: S310
        body = reply.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise ValueError("the feed is too long")
    return body


def decoded(body: bytes) -> str:
    """Text of a feed: as its XML declaration says, UTF-8 else; bytes that are none of it are replaced."""
    import re

    told = re.match(rb"""\s*<\?xml[^>]*?encoding=["']([A-Za-z0-9._-]+)["']""", body.removeprefix(b"\xef\xbb\xbf"))
    try:
        return body.removeprefix(b"\xef\xbb\xbf").decode(told[1].decode() if told else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


@dataclass
class OneSource(InputPartition):
    source_id: str
    source_ord: int
    url: str


def feed_source(registry: list[tuple[str, int, str]], transport: Transport, timeout: float, name: str = "feeds") -> type[DataSource]:
    """A data source over a registry of (id, order, url)."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [OneSource(*source) for source in registry]

        def read(self, partition: OneSource) -> Iterator[tuple]:
            try:
                if not partition.url:
                    raise ValueError("no address")
                text = decoded(transport(partition.url, timeout))
                found = (text, None) if text.strip() else (None, "empty")
            except Exception as error:  # whatever a server does is told, and the other sources go on
                found = (None, f"{type(error).__name__}: {error}"[:300])
            yield (partition.source_id, partition.source_ord, *found)

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Feeds


def fetched(spark: SparkSession, sources: DataFrame, transport: Transport = over_http, timeout: float = TIMEOUT) -> DataFrame:
    """source_id, source_ord, xml, error: what each source (id, source_ord, url) holds now; the shape of feeds.read_feeds.

    Each action fetches anew: write the result to the landing folder, or settle it, before more than one step reads it.
    """
    registry = [(r["id"], r["source_ord"], r["url"]) for r in sources.select("id", "source_ord", "url").collect()]  # a registry, not data
    if not registry:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(feed_source(sorted(registry, key=lambda r: r[1]), transport, timeout))
    return spark.read.format("feeds").load()
