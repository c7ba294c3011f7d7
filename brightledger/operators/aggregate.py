"""Aggregates over filings, events and reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.operators.rank import first_rows


def filtered_counts(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """A count for each condition, all in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def distinct_filtered(column: str, condition: Column) -> Column:
    """COUNT(DISTINCT column) FILTER (WHERE condition)."""
    return F.count_distinct(F.when(condition, F.col(column)))


def distinct_children(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parents with the number of distinct children of each kind: each side is counted before it is joined, so that kinds do
    not multiply each other. ``children``: name -> (rows with ``key``, child column)."""
    out = parents
    for name, (rows, child) in children.items():
        out = out.join(rows.groupBy(key).agg(F.count_distinct(child).alias(name)), key, "left").fillna({name: 0})
    return out


def groups_of_size(df: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """How many groups have exactly that many rows."""
    return df.groupBy(*key).count().filter(F.col("count") == size).agg(F.count("*").alias("groups"))


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """How often each value occurs, blanks aside; arrays count by element."""
    rows = df.select(value.alias(name))
    if dict(rows.dtypes)[name].startswith("array"):
        rows = rows.select(F.explode(name).alias(name))
    return rows.filter(F.trim(F.col(name).cast("string")) != "").groupBy(name).agg(F.count("*").alias("n"))


def top_options(counted: DataFrame, name: str = "value", n: int = 7) -> DataFrame:
    """The most frequent values, ties by label."""
    return counted.orderBy(F.desc("n"), name).limit(n)


def nested(df: DataFrame, key: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Rows of a key as one sorted array of structs; a group is one row of the result, as its reader asks."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def to_cells(df: DataFrame, key: Sequence[str], metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """Long to wide with the metrics named, so that no job looks for them; the first value that is not null fills a cell."""
    return df.groupBy(*key).pivot(metric, list(metrics)).agg(F.first(value, ignorenulls=True))


def sum_disclosed(*parts: Column) -> Column:
    """The sum of the parts there are; null, not 0, if there are none."""
    none = reduce(lambda a, b: a & b, [p.isNull() for p in parts])
    return F.when(~none, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]))


def winning_offset(df: DataFrame, by: Sequence[str], offset: str, page: str, least: int = 3, margin: float = 2) -> DataFrame:
    """The offset with the most pages, if it has ``least`` and more than ``margin`` times the next one's."""
    votes = df.groupBy(*by, offset).agg(F.count_distinct(page).alias("votes"))
    order = Window.partitionBy(*by).orderBy(F.desc("votes"), offset)
    ranked = votes.withColumn("next", F.coalesce(F.lead("votes").over(order), F.lit(0)))
    return first_rows(ranked, by, [F.desc("votes"), offset]).filter((F.col("votes") >= least) & (F.col("votes") > margin * F.col("next"))).drop("next")


def votes(df: DataFrame, by: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """Votes for correct and wrong, and whether they are disputed."""
    out = filtered_counts(df, {"correct": F.col(verdict) == "correct", "wrong": F.col(verdict) == "wrong"}, by)
    return out.withColumn("disputed", (F.col("correct") > 0) & (F.col("wrong") > 0))


def fingerprint(df: DataFrame, by: Sequence[str], parts: Sequence[str], size: int = 24) -> DataFrame:
    """A hash of a group's rows in order, as so many hexadecimal digits."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    joined = F.concat_ws("\x1e", F.array_sort(F.collect_list(line)))
    return df.groupBy(*by).agg(F.substring(F.sha2(joined, 256), 1, size).alias("fingerprint"))


def coverage_shares(df: DataFrame, group: str, main: str) -> DataFrame:
    """The share of one value of a column, rounded half up, and what is left to 100."""
    share = F.floor(100 * F.count_if(F.col(group) == main) / F.count("*") + 0.5).cast("long")
    return df.agg(F.count("*").alias("universe"), share.alias("main_pct")).withColumn("other_pct", 100 - F.col("main_pct"))


def theme_counts(df: DataFrame, theme: str, ids: str, valid: DataFrame, key: str) -> DataFrame:
    """How many distinct valid ids each theme names in its array of ids, most first."""
    named = df.select(theme, F.explode(ids).alias(key)).distinct().join(valid.select(key), key, "left_semi")
    return named.groupBy(theme).agg(F.count("*").alias("n")).orderBy(F.desc("n"), theme)
