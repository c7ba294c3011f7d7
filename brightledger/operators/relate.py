"""Joins by which tables of filings meet, and set operations on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.operators.contains import contained
from brightledger.operators.rank import first_rows


def with_match(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that have a match: EXISTS."""
    return df.join(other.select(*on), list(on), "left_semi")


def without_match(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that have none: NOT EXISTS."""
    return df.join(other.select(*on), list(on), "left_anti")


def missing_or_unready(df: DataFrame, state: DataFrame, on: Sequence[str], ready: Column) -> DataFrame:
    """Rows without a state, or whose state isn't ready."""
    return df.join(state, list(on), "left").filter(F.coalesce(~ready, F.lit(True)))


def prior_period(df: DataFrame, keys: Sequence[str], period: str, prior: Column, value: str) -> DataFrame:
    """Each row with the value of the same keys in the prior period, joined by the derived period and not by position."""
    base = df.select(*keys, F.col(period).alias("__period"), F.col(value).alias(f"prior_{value}"))
    return df.withColumn("__period", prior).join(base, [*keys, "__period"], "left").drop("__period")


def canonical_lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Looks a value up by keys and period, where Q2 stands for H1; the period as written is preferred."""
    same = F.regexp_replace(F.col(period), "Q2$", "H1")
    asked = df.withColumn("__period", same)
    held = other.select(*keys, same.alias("__period"), F.col(period).alias("__written"), value)
    # one candidate for each way of writing, chosen before the join, so that rows need no number
    written = first_rows(held, [*keys, "__period", "__written"], [value])
    both = written.groupBy(*keys, "__period").agg(F.map_from_entries(F.collect_list(F.struct("__written", value))).alias("__by"), F.min_by(value, "__written").alias("__any"))
    found = asked.join(both, [*keys, "__period"], "left")
    return found.withColumn(value, F.coalesce(F.try_element_at("__by", F.col(period)), F.col("__any"))).drop("__period", "__by", "__any")


def longest_contained(df: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Each row with the longest name contained in its text, ties to the first in order; null if there is none. Names are found by the grams
    that they share with the text."""
    hits = contained(df, text, names, name)
    best = hits.groupBy(text).agg(F.min_by(name, F.struct(-F.length(name), name)).alias(name))
    return df.join(best, text, "left")


def expected_but_absent(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """What a calendar expects less what is there."""
    return expected.select(*on).distinct().join(present.select(*on), list(on), "left_anti")


def union_first_wins(branches: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of all branches, one for each key: of the earliest branch, then first in order."""
    numbered = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    return first_rows(reduce(DataFrame.unionByName, numbered), keys, ["branch", *order])


def any_contains(columns: Sequence[str], text: str) -> Column:
    """Whether some column, as text, contains a string in any case."""
    q = text.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns])


def haystack(columns: Sequence[str], text: str) -> Column:
    """Whether the visible cells, joined by spaces with nulls as nothing, contain a string in any case."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lower(joined).contains(text.lower())


def optional(column: str, value) -> Column:
    """An equality that a null parameter turns off."""
    return F.lit(True) if value is None else F.col(column) == value


def older_than(column: str, now, interval: str) -> Column:
    """Whether an instant lies longer before ``now`` than an interval, which Spark SQL spells like '5 MINUTES'."""
    return F.col(column) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {interval}")


def page_before(df: DataFrame, key: str, before, n: int) -> DataFrame:
    """Keyset pagination: the next ``n`` rows below a key, in descending order; a null key starts at the top."""
    rows = df if before is None else df.filter(F.col(key) < before)
    return rows.orderBy(F.col(key).desc()).limit(n)


def rotating(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """The ``n`` rows after a key in its order, going on from the start where the end is reached."""
    wrapped = F.lit(False) if last is None else F.col(key) <= last
    return df.orderBy(wrapped, key).limit(n)


def batches(df: DataFrame, key: str, force: str, size: int) -> DataFrame:
    """Distinct keys with their force flags or-ed, in numbered batches of a size; a null key comes last.

    Numbers come from counts per key range, so that only one number for each range meets in one task. The ranges' bounds are values of a
    sample by hash: where a key belongs does not depend on how Spark parts the rows, which may differ between the counts and the rows.
    """
    from pyspark.sql import Window

    merged = df.groupBy(key).agg(F.max(force).alias(force))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = merged.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(16 * ranges)  # a bounded sample
    bounds = [r[0] for r in some.orderBy(key).collect()][8::16]
    kind = dict(df.dtypes)[key]
    before_key = F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]).cast(f"array<{kind}>"), lambda b: b <= F.col(key))
    ranged = merged.withColumn("__part", F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(F.size(before_key)))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__count"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    within = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    place = F.col("__start") + F.col("__n") - 1
    return within.join(starts, "__part").select(key, force, F.floor(place / size).alias("batch"))
