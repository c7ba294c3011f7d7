"""Announcement lists page by page, as a data source for batch and streaming reads.

    register(spark)
    spark.read.format("announcement_pages").option("url", "https://host/{source}?page={page}").option("sources", "sse,szse").load()

A source is one partition, as whether a next page is asked for depends on the last: paging ends at an empty page; a page without a new
announcement, a page that fails and the cap ``max_pages`` end it too, and then the source is not complete. Rows are pages with their raw
``body``; a last row a source says whether it is ``complete``, and if not why. ``announcements`` turns bodies into the common schema,
``coverage`` keeps the last rows.

As a stream each page is a partition of its own and pages are taken as they appear: the offset is the number of pages taken from each
source, so that a query that starts again goes on where its checkpoint stands. Pages must not change once they can be read.
"""

from __future__ import annotations

import functools
import json
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brightledger.sources.announcements import COLUMNS, SHAPES, merge, rows_of

SCHEMA = "source string, page int, body string, rows int, complete boolean, error string"
#: Pages asked of a source at most, and seconds to wait for one.
MAX_PAGES, TIMEOUT = 8, 30


def fetch(url: str, source: str, page: int) -> str | None:
    """A page's body; None if there is no such page."""
    try:
        with urllib.request.urlopen(url.format(source=source, page=page), timeout=TIMEOUT) as r:
            return r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            return None
        raise


def ids(source: str, body: str) -> list[str]:
    """The ids of a page's announcements, in its source's shape."""
    _, rows, (key, *_) = SHAPES[source]
    return [str(r.get(key)) for r in json.loads(body).get(rows) or []]


class SourcePartition(InputPartition):
    def __init__(self, source: str, page: int | None = None):
        self.source, self.page = source, page


class _Options:
    def __init__(self, options):
        self.url, self.most = options["url"], int(options.get("max_pages", MAX_PAGES))
        self.sources = [s.strip() for s in options.get("sources", ",".join(SHAPES)).split(",")]
        if unknown := set(self.sources) - set(SHAPES):
            raise ValueError(f"unknown sources: {sorted(unknown)}")


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [SourcePartition(s) for s in self.options.sources]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        source, seen, complete, error = partition.source, set(), False, "page cap"
        for page in range(1, self.options.most + 1):
            try:
                body = fetch(self.options.url, source, page)
                found = ids(source, body) if body is not None else None
            except (OSError, ValueError):
                error = f"page {page} failed"
                break
            if found is None:
                error = f"page {page} failed"
                break
            if not found:
                complete, error = True, None
                break
            if seen.issuperset(found):
                error = "repeated page"
                break
            seen.update(found)
            yield source, page, body, len(found), None, None
        yield source, None, None, len(seen), complete, error


class PagesStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = _Options(options)
        self.ahead: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {s: 0 for s in self.options.sources}

    def latestOffset(self) -> dict:
        """How many pages of each source there are now: those known are not asked for again."""
        for s in self.options.sources:
            n = self.ahead.get(s, 0)
            while fetch(self.options.url, s, n + 1) is not None:
                n += 1
            self.ahead[s] = n
        return dict(self.ahead)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [SourcePartition(s, page) for s in end for page in range(start.get(s, 0) + 1, end[s] + 1)]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        body = fetch(self.options.url, partition.source, partition.page)
        if body is None:
            raise OSError(f"page {partition.page} of {partition.source} is gone")
        yield partition.source, partition.page, body, len(ids(partition.source, body)), None, None

    def commit(self, end: dict) -> None:
        self.ahead = {s: max(n, self.ahead.get(s, 0)) for s, n in end.items()}


class AnnouncementPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "announcement_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnnouncementPages)


def parsed(pages: DataFrame, sources: Sequence[str] = tuple(SHAPES)) -> DataFrame:
    """The announcements on pages in the common schema, page by page, batch or stream."""
    found = []
    for s in sources:
        schema, rows, _ = SHAPES[s]
        bodies = pages.filter((F.col("source") == s) & F.col("body").isNotNull()).select(F.from_json("body", schema).alias("b"))
        found.append(rows_of(bodies.select(F.explode(f"b.{rows}").alias("r")), s))
    return functools.reduce(DataFrame.unionByName, found)


def announcements(pages: DataFrame) -> DataFrame:
    """Each announcement of a batch of pages once by source and id."""
    return merge([parsed(pages).select(*COLUMNS)])


def coverage(pages: DataFrame) -> DataFrame:
    """``source, rows, complete, error``: how each source's paging ended."""
    return pages.filter("page IS NULL").select("source", "rows", "complete", "error")
