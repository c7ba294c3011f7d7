"""Announcement lists: saved pages of exchanges' JSON, read and merged by Spark.

Fetching is another program's work: it leaves each response as one JSON file. Readers here bring the exchanges' shapes into one
schema, merge them, and say how each source did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.operators.rank import first_rows
from brightledger.operators.relate import union_first_wins

COLUMNS = ("source", "source_id", "code", "company_name", "title", "published_at", "url")
#: Shapes of responses: the schema, the array of rows, and each column's field or expression.
SHAPES = {
    "cninfo": ("announcements array<struct<announcementId: string, secCode: string, secName: string, announcementTitle: string, announcementTime: bigint, adjunctUrl: string>>",
               "announcements", ("announcementId", "secCode", "secName", "announcementTitle", F.timestamp_millis, "announcementTime", "adjunctUrl")),
    "sse": ("result array<struct<bulletinId: string, securityCode: string, securityName: string, title: string, sseDate: string, url: string>>",
            "result", ("bulletinId", "securityCode", "securityName", "title", F.to_timestamp, "sseDate", "url")),
    "szse": ("data array<struct<id: string, secCode: array<string>, secName: array<string>, title: string, publishTime: string, attachPath: string>>",
             "data", ("id", "secCode", "secName", "title", F.to_timestamp, "publishTime", "attachPath")),
    "bse": ("list array<struct<disclosureId: string, companyCd: string, companyName: string, disclosureTitle: string, publishDate: string, destFilePath: string>>",
            "list", ("disclosureId", "companyCd", "companyName", "disclosureTitle", F.to_timestamp, "publishDate", "destFilePath")),
}


def rows_of(found: DataFrame, source: str) -> DataFrame:
    """Rows ``r`` in a source's shape in the common schema; highlighting tags in titles go."""
    _, _, (key, code, name, title, to_time, at, url) = SHAPES[source]
    kinds = dict(found.select("r.*").dtypes)
    one = lambda c: F.element_at(F.col(f"r.{c}"), 1) if kinds[c].startswith("array") else F.col(f"r.{c}")
    return found.select(
        F.lit(source).alias("source"), F.col(f"r.{key}").alias("source_id"), one(code).alias("code"), one(name).alias("company_name"),
        F.regexp_replace(F.col(f"r.{title}"), "</?em>", "").alias("title"), to_time(F.col(f"r.{at}")).alias("published_at"), F.col(f"r.{url}").alias("url"),
    )


def read_source(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Rows of one source's saved responses in the common schema. A file that does not parse has none."""
    schema, rows, _ = SHAPES[source]
    return rows_of(spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(rows).alias("r")), source)


def merge(sources: list[DataFrame]) -> DataFrame:
    """All sources, each announcement once by source and id."""
    return union_first_wins([s.select(*COLUMNS) for s in sources], ["source", "source_id"], ["title"]).drop("branch")


def health(sources: dict[str, DataFrame]) -> DataFrame:
    """How many rows each source brought and how new they are; none means that it failed."""
    out = None
    for name, rows in sources.items():
        one = rows.agg(F.lit(name).alias("source"), F.count("*").alias("rows"), F.max("published_at").alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.col("rows") > 0)


def exchange_first(exchange: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """A company's filings from both sources: the later source wins on equal keys."""
    return union_first_wins([other.select(*COLUMNS), exchange.select(*COLUMNS)], key, ["source_id"]).drop("branch")


def page_complete(pages: DataFrame, most: int) -> DataFrame:
    """Whether paging came to an end: an empty page was seen before the cap, and no page came twice (``page, fingerprint, rows``)."""
    return pages.agg(
        ((F.min("rows") == 0) & (F.max("page") < most) & (F.count_distinct(F.when(F.col("rows") > 0, F.col("fingerprint"))) == F.count_if(F.col("rows") > 0))).alias("complete"),
        F.sum("rows").alias("rows"),
    )


def better_name(old: Column, new: Column) -> Column:
    """Of two names for a company the better: not empty, without placeholder marks, then the longer."""
    bad = lambda c: c.isNull() | (F.trim(c) == "") | c.rlike(r"^\d+$|\?|�")
    return F.when(bad(new), old).when(bad(old), new).when(F.length(new) > F.length(old), new).otherwise(old)


def universe(inputs: list[DataFrame]) -> DataFrame:
    """Listed companies (``code, name, industry``) from several inputs in order: the best name, the first industry that is there."""
    rows = None
    for i, df in enumerate(inputs):
        one = df.select("code", "name", "industry", F.lit(i).alias("branch"))
        rows = one if rows is None else rows.unionByName(one)
    bad = F.col("name").isNull() | (F.trim("name") == "") | F.col("name").rlike(r"^\d+$|\?|�")
    name = F.min_by("name", F.struct(bad, -F.length("name"), "branch", "name"))
    return rows.groupBy("code").agg(name.alias("name"), F.min_by("industry", F.when(F.trim("industry") != "", F.struct("branch", "industry"))).alias("industry"))


def exchange_of(code: Column) -> Column:
    """The exchange of a security code."""
    return F.when(code.rlike("^(?:60|68|90)"), "SSE").when(code.rlike("^(?:00|20|30)"), "SZSE").when(code.rlike("^(?:4|8|92)"), "BSE")


def page_texts(spark: SparkSession, path: str, most_pages: int = 120, most_chars: int = 5000) -> DataFrame:
    """``report, page, content``: text extracts of reports, one file each, their pages parted by form feeds.

    Pages past the bound and texts past theirs are cut as the index asks; pages of under 40 characters hold nothing.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("report"), F.split("value", "\f").alias("pages"))
    rows = files.select("report", F.posexplode(F.slice("pages", 1, most_pages)).alias("at", "content"))
    return rows.select("report", (F.col("at") + 1).alias("page"), F.substring(F.trim("content"), 1, most_chars).alias("content")).filter(F.length("content") >= 40)


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of report files, without reading them; ``content`` is read only where it is asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A static JSON table, such as companies or third-party values, with its schema given."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def latest_page(rows: DataFrame) -> DataFrame:
    """The newest row of each source."""
    return first_rows(rows, ["source"], [F.desc("published_at"), "source_id"])
