"""Joins on contained texts: equal to the cross join, without a nested loop in the plan."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightledger.functions import text
from brightledger.operators import relate
from brightledger.operators.contains import contained

WORDS = st.lists(st.one_of(st.none(), st.text(alphabet="ab平安", max_size=5)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(WORDS, WORDS)
def test_equals_cross_join(spark, wholes, parts):
    a, b = spark.createDataFrame([(w,) for w in wholes], "w string"), spark.createDataFrame([(p,) for p in parts], "p string")
    got = sorted(tuple(r) for r in contained(a, "w", b, "p").collect())
    assert got == sorted({(w, p) for w in wholes if w is not None for p in parts if p and p in w})


def test_no_nested_loop(spark):
    names = spark.range(3).select(F.col("id").cast("string").alias("name"))
    texts = spark.range(3).select(F.concat(F.lit("x"), "id").alias("t"))
    for df in (contained(texts, "t", names, "name"), relate.longest_contained(texts, "t", names, "name"), text.match_names(texts.select(F.col("t").alias("query")), names.select(F.col("name").alias("code"), "name"))):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spelled(spark):
    readings = spark.createDataFrame([("平", "Ping"), ("安", "an"), ("银", "yin"), ("行", "hang"), ("行", "xing")], "character string, reading string")
    companies = spark.createDataFrame([("1", "平安银行"), ("2", "平安A"), ("3", None)], "code string, name string")
    named = text.spelled_names(companies, readings)
    got = {r["code"]: (r["spelled"], r["initials"]) for r in named.collect()}
    assert got == {"1": ("pinganyinhang", "payh"), "2": ("pingana", "paa"), "3": (None, None)}
    asked = spark.createDataFrame([("payh",), ("yinhang",), ("zz",)], "query string")
    assert {(r["query"], r["code"], r["stage"]) for r in text.match_names(asked, named).collect()} == {("payh", "1", 6), ("yinhang", "1", 6)}


def test_parts_are_filed_under_few_texts(spark):
    """Numbered names share all their pairs of characters; what is compared must not be all with all."""
    from brightledger.operators.contains import grams

    names = spark.range(2000).select(F.format_string("Customer#%09d", "id").alias("n"))
    own = names.select("n", F.explode(grams(F.col("n"), False)).alias("g"))
    often = names.select(F.explode(grams(F.col("n"), True)).alias("g")).groupBy("g").count()
    assert own.join(often, "g").groupBy("n").agg(F.min("count").alias("least")).agg(F.sum("least")).first()[0] <= 4000
    assert contained(names.select(F.concat(F.lit("看看"), "n").alias("t")), "t", names, "n").count() == 2000


def test_parts_of_any_length(spark):
    """Of one character, up to those that are met as they are, and longer ones, in texts of several pieces."""
    long = "".join(chr(0x4E00 + i * 7 % 500) for i in range(300))
    texts = [long, long[:100], long[150:] + "x", "ab" * 90, "a", ""]
    parts = [long[i : i + n] for n in (1, 2, 31, 32, 33, 64, 65, 100, 299) for i in (0, 1, 63, 64, 100, 201)] + ["ab" * 16, "ab" * 17, "x", "y"]
    a, b = spark.createDataFrame([(t,) for t in texts], "w string"), spark.createDataFrame([(p,) for p in parts], "p string")
    assert sorted(tuple(r) for r in contained(a, "w", b, "p").collect()) == sorted({(t, p) for t in texts for p in parts if p and p in t})


def test_names_take_one_join(spark):
    """All that names are found by is one join over texts that are made once: the driver holds a plan for each step, which grew beyond its memory."""
    companies = spark.range(300).select(F.concat(F.lit("K"), "id", F.lit("Z")).alias("code"), F.format_string("Customer#%09d", "id").alias("name"))
    asked = companies.select(F.concat("code", F.lit("怎么样")).alias("query")).union(companies.select(F.concat(F.lit("看看"), "name"))).union(companies.select(F.lower("name")))
    found = text.match_names(asked, companies)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 90 and len(plan) < 150_000
    got = found.groupBy("stage").count().collect()
    assert {r["stage"]: r["count"] for r in got} == {1: 300, 2: 300, 4: 300}
