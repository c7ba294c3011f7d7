"""Writes without row updates: each takes the target as it is and the change, and returns the target as it will be.

Snapshots are written anew by the caller; event logs are only appended to and folded when read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.operators.rank import first_rows


def insert_absent(target: DataFrame, new: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """Adds rows that no target row equals on any of several keys; of equal new rows the first by their keys stays."""
    for key in keys:
        new = first_rows(new, key, [c for c in new.columns if c not in key]).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(new)


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace those of their key."""
    return target.join(new.select(*key), list(key), "left_anti").unionByName(new)


def conditional_upsert(target: DataFrame, new: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """As ``upsert``, but where both sides have a key a rule may compute a column from ``old`` and ``new`` structs."""
    columns = target.columns
    pack = lambda df, name: df.select(*key, F.struct(*columns).alias(name))
    both = pack(target, "old").join(pack(new, "new"), list(key), "full_outer")
    met = F.col("old").isNotNull() & F.col("new").isNotNull()

    def of(c: str) -> Column:
        plain = F.coalesce(F.col("new"), F.col("old"))[c]
        return F.when(met, rules[c]).otherwise(plain) if c in rules else F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col("old")[c])

    return both.select(*[of(c).alias(c) for c in columns])


def keep_if_unchanged(flag: str, compared: Sequence[str]) -> Column:
    """A rule: the old flag stays only while all compared fields are the same, nulls included."""
    same = F.lit(True)
    for c in compared:
        same = same & F.col("old")[c].eqNullSafe(F.col("new")[c])
    return F.when(same, F.col("old")[flag]).otherwise(F.lit(False))


def keep_unless_blank(column: str, placeholder: str) -> Column:
    """A rule: a good old value stays, a blank or placeholder gives way."""
    old = F.col("old")[column]
    return F.when(old.isNull() | (F.trim(old) == "") | (old == placeholder), F.col("new")[column]).otherwise(old)


def prefer_new(column: str) -> Column:
    """A rule: the new value, if there is one."""
    return F.coalesce(F.col("new")[column], F.col("old")[column])


def replace_children(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that have new rows give way to these."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


PARTS = 256


def store_children(new: DataFrame, path: str, parent: str, parts: int = PARTS) -> None:
    """The same for a stored table: only the parts of the table that hold one of the parents are written anew.

    Rows are in partitions by a hash of the parent. What is left of the touched partitions and the new rows is written beside the table
    first, then takes their place; files of other partitions stay as they are. A run that was lost can be repeated.
    """
    spark = new.sparkSession
    rows = new.withColumn("part", F.pmod(F.xxhash64(parent), F.lit(parts)).cast("int"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        rows.write.partitionBy("part").parquet(path)
        return
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most as many as there are parts
    old = spark.read.parquet(path).filter(F.col("part").isin(touched)).join(new.select(parent).distinct(), parent, "left_anti")
    beside = f"{path.rstrip('/')}.new"
    old.unionByName(rows).write.mode("overwrite").partitionBy("part").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), True)


def discard(tables: Mapping[str, DataFrame], ids: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Child tables without the discarded parents, and how many rows each lost."""
    left = {k: t.join(ids.select(key), key, "left_anti") for k, t in tables.items()}
    counts = None
    for k, t in tables.items():
        n = t.join(ids.select(key), key, "left_semi").agg(F.lit(k).alias("table"), F.count("*").alias("removed"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def latest_event(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The state of each key: its last event."""
    return first_rows(events, key, [F.col(c).desc() for c in order])


def run_of_failures(events: DataFrame, key: str, order: Sequence[str], ok: Column) -> DataFrame:
    """Health after each event: failures since the last success, and when success and failure were last seen."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = events.withColumn("__run", F.sum(ok.cast("int")).over(upto))
    since = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("consecutive_failures", F.sum((~ok).cast("long")).over(since)).drop("__run")


def guarded_update(state: DataFrame, ids: DataFrame, key: str, allowed: Sequence[str], to: str) -> DataFrame:
    """Rows named by ``ids`` whose status is allowed, with the new status; how many there are is their count."""
    return state.join(ids.select(key).distinct(), key, "left_semi").filter(F.col("status").isin(*allowed)).withColumn("status", F.lit(to))


def release_claims(state: DataFrame, released: DataFrame, key: str, previous: str = "previous_status") -> DataFrame:
    """Claims given back: a row that had failed before gets that state again, another goes."""
    flagged = state.join(released.select(key, F.lit(True).alias("__gone")), key, "left")
    kept = flagged.filter(F.col("__gone").isNull() | (F.col(previous) == "failed"))
    return kept.withColumn("status", F.when(F.col("__gone"), F.col(previous)).otherwise(F.col("status"))).drop("__gone")


def newest_response(responses: DataFrame, new: DataFrame, owner: str, order: Sequence[str]) -> DataFrame:
    """One response for each owner: the owner's newest is replaced, or the new one is added."""
    return upsert(latest_event(responses, [owner], order), new, [owner])


def mutually_exclusive(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Acknowledged or flagged, never both: the last event of a key decides."""
    return latest_event(events, [key], order).filter(F.col("status").isin("acked", "flagged"))


def append_events(events: DataFrame, path: str, at: str = "ts") -> None:
    """Adds events to a log of files by day; what is there stays, and readers of some days read only these."""
    events.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)
