"""All queries of the core library, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightledger.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT c.o_custkey AS custkey, c.yr, c.total, p.total AS prior_total,
       CASE WHEN p.total IS NULL OR p.total = 0 THEN NULL ELSE (c.total - p.total) / abs(p.total) * 100 END AS yoy_pct
FROM y c LEFT JOIN y p ON c.o_custkey = p.o_custkey AND p.yr = c.yr - 1
""")
def prior_period_yoy(spark: SparkSession, sf: str) -> DataFrame:
    """Each period joined to the same period a year before; a missing year gives no base."""
    year = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("yr"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    prior = year.select("custkey", (F.col("yr") + 1).alias("yr"), F.col("total").alias("prior_total"))
    base = F.col("prior_total")
    pct = F.when(base.isNull() | (base == 0), None).otherwise((F.col("total") - base) / F.abs(base) * 100)
    return year.join(prior, ["custkey", "yr"], "left").withColumn("yoy_pct", pct)
