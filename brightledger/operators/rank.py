"""Ranking within groups: the newest, the best, the first few, the place among peers.

Every order ends in a unique key, so ties have one outcome. All of these are one window over one shuffle; where only the
first rows are wanted Spark cuts each partition down before that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str | Column]


def first_rows(df: DataFrame, by: Keys, order: Keys, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def losers(df: DataFrame, by: Keys, order: Keys) -> DataFrame:
    """All but the first row of each group: what a deduplication retires."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") > 1).drop("__place")


def competition_rank(df: DataFrame, by: Keys, value: str, rank: str = "rank", peers: str = "peers") -> DataFrame:
    """1 + how many peers have more, among rows with a value; null where fewer than two have one."""
    group = Window.partitionBy(*by)
    n = F.count(value).over(group)
    place = F.rank().over(group.orderBy(F.col(value).desc_nulls_last()))
    return df.withColumn(peers, n).withColumn(rank, F.when(F.col(value).isNotNull() & (n >= 2), place))


def running_extreme(df: DataFrame, by: Keys, order: Keys, value: str, least: int = 3) -> DataFrame:
    """``extreme``: 'high' or 'low' where a row is the largest or smallest of at least ``least`` values up to it."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.count(value).over(upto) >= least
    kind = F.when(F.col(value) == F.max(value).over(upto), "high").when(F.col(value) == F.min(value).over(upto), "low")
    return df.withColumn("extreme", F.when(enough, kind))


def last_rows_ascending(df: DataFrame, by: Keys, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group; readers order them by ``order``."""
    return first_rows(df, by, [F.col(c).desc() for c in order], n)


def round_robin(df: DataFrame, bucket: str, order: Keys, name: str = "turn") -> DataFrame:
    """Each row's turn within its bucket; ordering by turn and bucket takes buckets in rotation."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def best_theme_cards(df: DataFrame, entity: str, theme: str, priority: Keys, n: int = 3) -> DataFrame:
    """One card for each theme, then the first ``n`` of an entity."""
    return first_rows(first_rows(df, [entity, theme], priority), [entity], priority, n)


def bounded_newest(df: DataFrame, by: Keys, newest: Keys, size: Column, most_rows: int, most_size: int) -> DataFrame:
    """The newest rows while their number and summed size stay in bounds; the first that does not fit ends it."""
    upto = Window.partitionBy(*by).orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).withColumn("__sum", F.sum(size).over(upto))
    return kept.filter((F.col("__n") <= most_rows) & (F.col("__sum") <= most_size)).drop("__n", "__sum")


def failure_rate(df: DataFrame, by: Keys, order: Keys, failed: Column, last: int = 20, least: int = 6, limit: float = 0.6) -> DataFrame:
    """``n, failures, is_open``: over the last rows, and whether the circuit opens."""
    recent = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)
    counted = df.withColumn("n", F.count("*").over(recent)).withColumn("failures", F.sum(failed.cast("long")).over(recent))
    return counted.withColumn("is_open", (F.col("n") >= least) & (F.col("failures") / F.col("n") >= limit))


def closest(df: DataFrame, by: Keys, rank: Column, wanted: Column, same_kind: Column, tie: Keys = ()) -> DataFrame:
    """Of each group the row of the wanted kind, not after what is wanted, nearest to it, newer first."""
    order = [F.when(same_kind, 0).otherwise(1), F.when(rank <= wanted, 0).otherwise(1), F.abs(rank - wanted), rank.desc(), *tie]
    return first_rows(df, by, order)


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator, so that what later reads them does not compute them again: filters and projections are otherwise
    pushed through, with all that they mention."""
    packed = rows.withColumn("held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return packed.select(*[c for c in rows.columns if c not in columns], "held.*")
