"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a hash; a source's share is a threshold on it. Sizes are summed by source and leading bits of the hash,
the running sum shows the bucket in which the budget ends, and only that bucket is refined by the next bits. Nothing is
sorted, thresholds of smaller budgets lie below those of larger ones, and reruns agree.

Null texts have size 0; null sources form one source, the last. Rows alike in ``doc_id`` and ``text`` share a hash and are
taken together. An empty table gives an empty result. Input columns other than ``doc_id``, ``text`` and ``source`` play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightledger.llm.common import materialize, stage as pipeline_stage, WORD

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash that each round of refinement looks at, 32 in all.
BITS = (11, 11, 10)


def document_hash() -> Column:
    """32 bits of a document's id and text."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """Of ``key, source, source_size``: adds ``target``, one row for each source.

    Sharing a budget by weight, with what exceeds a source's limit shared again, ends where every source has
    ``min(limit, weight * level)``; the level is found from running sums over sources in order of limit by weight.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("ratio", "key").rowsBetween(W.unboundedPreceding, -1)
    sized = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    sized = sized.withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = sized.withColumn("level", left / open_weight)
    found = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return level.withColumn("target", F.least("most", F.col("weight") * F.coalesce(found, F.lit(float("inf"))))).select(
        "key", "source", "source_size", "target"
    )


def boundary(hist: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """For each key the first bucket at whose end the running size exceeds ``budget``, and the budget left before it."""
    run = W.partitionBy(*keys).orderBy(bucket)
    summed = hist.withColumn("upto", F.sum("size").over(run))
    return (
        summed.filter(F.col("upto") > F.col("budget"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(F.col(bucket).alias("b"), "size", (F.col("budget") - F.col("upto") + F.col("size")).alias("left")), bucket).alias("at"))
    )


def source_key() -> Column:
    """The source as a string that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))


def thresholds(docs: DataFrame, weights: Sequence[float], share: float, most: int, size: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized and hashed documents, their first histogram, and a row for each source: ``key, source_size, target, whole, threshold``.

    Every document of a source is taken ``whole`` times, and those with a hash below the threshold once more. Joins are on
    source and bucket, so that a source with a third of all rows is spread over its buckets.
    """
    b1, b2, b3 = BITS
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    base = materialize(
        docs.select("doc_id", "source", size.alias("size"), document_hash().alias("hash"), source_key().alias("key"))
        .withColumn("one", F.shiftright("hash", b2 + b3))
        .withColumn("two", F.shiftright("hash", b3).bitwiseAND((1 << b2) - 1))
        .withColumn("three", F.col("hash").bitwiseAND((1 << b3) - 1)),
        "mix",
    )
    first = materialize(base.groupBy("key", "one").agg(F.sum("size").alias("size"), F.first("source").alias("source")), "mix-histogram")
    sizes = first.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    share_of = targets(sizes, weights, share, most)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    plan = materialize(
        share_of.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets"
    )
    at_one = boundary(first.drop("source").join(plan.select("key", "budget"), "key"), ["key"], "one")
    at_one = materialize(at_one.select("key", F.col("at.b").alias("one"), F.col("at.left").alias("budget")), "mix-boundary")
    second = base.join(at_one, ["key", "one"]).groupBy("key", "one", "two").agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
    at_two = boundary(second, ["key", "one"], "two")
    at_two = materialize(at_two.select("key", "one", F.col("at.b").alias("two"), F.col("at.left").alias("budget")), "mix-boundary")
    third = base.join(at_two, ["key", "one", "two"]).groupBy("key", "one", "two", "three")
    third = third.agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
    # the last bucket is taken if that brings the sum nearer to the target
    last = boundary(third, ["key", "one", "two"], "three").select(
        "key",
        (
            F.shiftleft("one", b2 + b3) + F.shiftleft("two", b3) + F.col("at.b") + F.when(F.col("at.left") * 2 > F.col("at.size"), 1).otherwise(0)
        ).alias("threshold"),
    )
    rules = plan.join(last, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return base, first, materialize(rules, "mix-thresholds")


def copies() -> Column:
    """How often the mix takes a document, from its hash and its source's row."""
    return F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, size: Column | None = None) -> DataFrame:
    """Each document with ``size, source_size, target, copies``: how often the mix takes it, ``most`` times at most.

    Weights go to the sources in code-point order, nulls last, and repeat; together the sources get ``share`` of all sizes.
    """
    base, first, rules = thresholds(docs, weights, share, most, size)
    by_bucket = first.select("key", "one").join(rules, "key")
    return base.join(by_bucket, ["key", "one"]).select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``mix`` with production parameters."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns; a row for each source decides. Rows alike in id, text and
    source go together; null ids, texts and sources are values like others."""
    _, _, rules = thresholds(docs, WEIGHTS, SHARE, MOST, None)
    own = F.struct(*[docs[c] for c in docs.columns]).alias("own")
    taken = docs.select(own, document_hash().alias("hash"), source_key().alias("key")).join(rules, "key").select("own", copies().alias("copies"))
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("own.*")


_CASES = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
_TAKEN = f"""d AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
      CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 8) AS BIGINT) AS hash,
      CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key FROM docs_in),
 s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % {len(WEIGHTS)} {_CASES} END AS weight FROM d GROUP BY key),
 r AS (SELECT *, CAST({MOST} * source_size AS DOUBLE) AS most, CAST({MOST} * source_size AS DOUBLE) / weight AS ratio FROM s),
 l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
       FROM r WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT key, source_size, least(most, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
 p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
 h AS (SELECT key, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY key ORDER BY hash) AS upto FROM d GROUP BY key, hash),
 a AS (SELECT key, hash, whole, source_size, target,
              upto <= target - whole * source_size OR (upto - size <= target - whole * source_size AND 2 * (target - whole * source_size - upto + size) > size) AS extra
       FROM h JOIN p USING (key)),
 mixed AS (SELECT d.*, source_size, target, CAST((whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM d JOIN a USING (key, hash))"""
ORACLE_SQL = f"""WITH docs_in AS (SELECT * FROM documents), {_TAKEN}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"""
