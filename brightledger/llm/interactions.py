"""Audit of how filters interact, by inclusion-exclusion.

For every set of filters one number is counted: the documents that fail all of them, the sum of the product of their flags. That
is one aggregation with partial sums, however many orders of the filters are asked about; the rest is arithmetic on one row a part:

* an alternating sum over subsets (a Moebius inversion) turns joint failures into survivors of each set of filters;
* what a filter removes after others is the difference of two survivors, what it would have removed but for those before it is
  redundant, and what no other filter would have removed fails it alone;
* the game "documents that a set of filters removes" has the joint failures as its Harsanyi dividends, with the sign of
  inclusion-exclusion, and a filter's Shapley value is its equal share of the dividends of all sets that hold it. It is given times
  the number of orders, which makes it the sum of what the filter removes over all orders, a whole number.

Null texts are empty; a null source is the part of the empty string. A document is a repeat if a row with a smaller ``doc_id`` has the
same text: rows of one id do not repeat each other, and null ids neither repeat nor are repeated. Of several labels of one id each
counts if any row has it. Repeated rows count one by one, very long texts as any other (a text is in memory with its words, some 60
bytes a word). An empty table gives an empty result. Columns other than ``doc_id``, ``text`` and ``source`` play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.common import join_salted, materialize, words

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"


def text_flags(text: Column) -> dict[str, Column]:
    """The failures of the four filters that look at one text, nulls as empty texts."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    return {
        "A": F.size(w) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > UPPER_PERCENT * F.length(text),
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, the flags ``A`` to ``E``, ``good`` and ``toxic`` of every row of documents, as 0 and 1.

    Texts are looked at once; repeats are found by their SHA-256, and only digests of several rows are joined back, their rows dealt
    to several tasks.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        *[f.cast("long").alias(k) for k, f in text_flags(F.col("text")).items()],
    )
    own = materialize(own, "flags")
    several = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    judged = join_salted(own, several, "digest", "doc_id", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("long"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return judged.join(known, "doc_id", "left").select("part", *LETTERS, *marks)


def _sets(n: int) -> list[tuple[int, ...]]:
    """All sets of n filters; a set's place is the sum of 2 ** filter."""
    return [tuple(i for i in range(n) if mask >> i & 1) for mask in range(1 << n)]


def joint_failures(rows: DataFrame, filters: str, marks: Mapping[str, Column]) -> DataFrame:
    """For each part and each of the marks an array: how many marked rows fail all filters of a set, at the set's place."""

    def product(mark: Column, chosen: tuple[int, ...]) -> Column:
        for i in chosen:
            mark = mark * F.col(filters[i])
        return mark

    sums = [F.sum(product(mark, s)).alias(f"{name}_{k}") for name, mark in marks.items() for k, s in enumerate(_sets(len(filters)))]
    counted = rows.groupBy("part").agg(*sums)
    return counted.select("part", *[F.array(*[F.col(f"{name}_{k}") for k in range(1 << len(filters))]).alias(name) for name in marks])


def survivors(joint: Column, n: int) -> Column:
    """How many rows pass all filters of a set, at the set's place, from joint failures."""
    place = {s: k for k, s in enumerate(_sets(n))}
    passed = []
    for s in _sets(n):
        subsets = [x for r in range(len(s) + 1) for x in itertools.combinations(s, r)]
        passed.append(sum(((-1) ** len(x) * F.get(joint, F.lit(place[x])) for x in subsets[1:]), F.get(joint, F.lit(0))))
    return F.array(*passed)


def alone(joint: Column, n: int) -> Column:
    """For each filter how many rows fail it and no other."""
    holding = lambda i: [(k, s) for k, s in enumerate(_sets(n)) if i in s]
    return F.array(*[sum((-1) ** (len(s) - 1) * F.get(joint, F.lit(k)) for k, s in holding(i)) for i in range(n)])


def shapley(joint: Column, n: int) -> Column:
    """For each filter its share of the dividends, times the number of orders."""
    dividend = lambda k, s: (-1) ** (len(s) + 1) * (factorial(n) // len(s)) * F.get(joint, F.lit(k))
    return F.array(*[sum(dividend(k, s) for k, s in enumerate(_sets(n)) if i in s) for i in range(n)])


def audit(rows: DataFrame, filters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``flagged`` rows: a part's rows are never expanded, only its sums."""
    n = len(filters)
    joint = joint_failures(rows, filters, {"every": F.lit(1).cast("long"), "good": F.col("good"), "toxic": F.col("toxic")})
    solved = joint.select(
        "part", "every", *[survivors(F.col(c), n).alias(f"{c}_left") for c in ("every", "good", "toxic")],
        alone(F.col("every"), n).alias("alone"), shapley(F.col("every"), n).alias("share"),
    )
    orders = ",".join("".join(p) for p in itertools.permutations(filters))
    steps = solved.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    turn = [F.instr("filter_order", letter) for letter in filters]
    before = sum((F.when(t < F.col("step"), 1 << i).otherwise(0) for i, t in enumerate(turn)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("at", F.instr(F.lit(filters), F.expr("substring(filter_order, step, 1)")) - 1)
    steps = steps.withColumn("own", F.pow(F.lit(2), F.col("at")).cast("int")).withColumn("after", F.col("before") + F.col("own"))
    gone = lambda left: F.get(left, F.col("before")) - F.get(left, F.col("after"))
    removed = gone("every_left")
    return steps.select(
        "part", "filter_order", "step", F.get("every_left", F.col("after")).alias("kept"), removed.alias("removed"),
        (F.get("every", F.col("own")) - removed).alias("redundant"), F.get("alone", F.col("at")).alias("unique_fails"),
        gone("good_left").alias("good_lost"), gone("toxic_left").alias("toxic_lost"), F.get("share", F.col("at")).alias("shapley"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(flagged(docs, labels))


#: Each order applied filter by filter to patterns of flags; nothing of inclusion and exclusion.
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT doc_id, part, len(w) < {MIN_WORDS} AS A, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) AS B,
   100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > {UPPER_PERCENT} * len(t) AS C, regexp_matches(t, '[{SYMBOLS}]') AS D,
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM w),
 l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
 g AS (SELECT part, [A, B, C, D, E] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2, 3, 4),
 i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
 o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM i a JOIN i b ON b.i <> a.i JOIN i c ON c.i NOT IN (a.i, b.i) JOIN i d ON d.i NOT IN (a.i, b.i, c.i)
   JOIN i e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
 p AS (SELECT [a, b, c, d, e] AS o, list_aggregate(list_transform([a, b, c, d, e], lambda x: substr('{LETTERS}', x, 1)), 'string_agg', '') AS filter_order FROM o),
 s AS (SELECT part, filter_order, i.i AS step, o[i.i] AS f, fails, good, toxic, n, fails[o[i.i]] AS hit, list_bool_or(list_transform(o[1:i.i - 1], lambda x: fails[x])) AS gone FROM g, p, i),
 r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT coalesce(gone, false)), 0) AS removed,
   coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
   coalesce(sum(n) FILTER (hit AND good AND NOT coalesce(gone, false)), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND toxic AND NOT coalesce(gone, false)), 0) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
