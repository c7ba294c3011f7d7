"""Marks in answers: placed by number and clause, each page once."""

from pyspark.sql import functions as F

from brightledger.functions import citations

TEXT = "净利润同比增加16.99亿元至147.56亿元（+13.02%），主因财务费用减少6.62亿元，发电量1327.44亿千瓦时支撑营收增长3.36%。"
CITED = [("E2", 6, "净利润147.56亿元，同比增加16.99亿元", "r1"), ("E5", 6, "净利润同比增长13.02%", "r1"), ("E49", 9, "财务费用减少6.62亿元", "r1"), ("E50", 8, "发电量1327.44亿千瓦时", "r1")]
# answer, citations, pool, what it becomes
CASES = [
    (TEXT + "【E2】【E5】【E49】【E50】", CITED, None, "净利润同比增加16.99亿元至147.56亿元[P6]（+13.02%），主因财务费用减少6.62亿元[P9]，发电量1327.44亿千瓦时[P8]支撑营收增长3.36%。"),
    (TEXT, CITED, None, "净利润同比增加16.99亿元至147.56亿元[P6]（+13.02%），主因财务费用减少6.62亿元[P9]，发电量1327.44亿千瓦时[P8]支撑营收增长3.36%。"),
    ("毛利率升至23.2%【E1】，存货下降【E99】", [("E1", 12, "毛利率23.2%", None)], None, "毛利率升至23.2%[P12]，存货下降"),
    ("甲【E1】【E2】乙", [("E1", 3, None, "r"), ("E2", 3, None, "r")], None, "甲[P3]乙"),
    ("甲 [ e 7 ] 乙", [("e7", 4, "", "r")], None, "甲 [P4] 乙"),
    ("甲【E7】乙", [], [("E7", 5, "", "r")], "甲[P5]乙"),
    ("见[PDF 20]，现金流[PDF20]", [("E1", 7, "现金流", "r")], None, "见[P20]，现金流[P20]"),
    ("收入增加，毛利率改善；研发投入上升。【E1】【E2】", [("E1", 3, "毛利率有所改善", "r"), ("E2", 4, "研发费用", "r")], None, "收入增加，毛利率改善[P3]；研发投入上升[P4]。"),
    ("没有可对应的句子。【E1】", [("E1", 3, "其他事项", "r")], None, "没有可对应的句子。"),
    ("增长12%。【E1】", [("E1", 0, "12%", "r"), ("E2", None, "12%", "r")], None, "增长12%。"),
    (None, CITED, None, ""),
    ("原样", None, None, "原样"),
]


def test_page_marks(spark):
    schema = f"n int, a string, c {citations.CITATIONS}, p {citations.CITATIONS}"
    rows = spark.createDataFrame([(n, a, c, p) for n, (a, c, p, _) in enumerate(CASES)], schema)
    got = rows.select("n", citations.with_page_marks(F.col("a"), F.col("c"), F.col("p")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == {n: c[3] for n, c in enumerate(CASES)}


def test_tokens(spark):
    rows = spark.createDataFrame([("+54.63%【E1】【E2】",), ("原文【第 6 页】与 [P6]",), ("利润改善[PDF 20]，现金流[PDF20]",), (None,)], "a string")
    one, two, three, none = [[tuple(t) for t in r["t"]] for r in rows.select(citations.answer_tokens(F.col("a")).alias("t")).collect()]
    assert one == [("text", "+54.63%", None, None), ("mark", "【E1】", "E1", None), ("text", " ", None, None), ("mark", "【E2】", "E2", None)]
    assert two == [("text", "原文", None, None), ("mark", "【第 6 页】", None, 6), ("text", "与 ", None, None), ("mark", "[P6]", None, 6)]
    assert [t[3] for t in three if t[0] == "mark"] == [20, 20] and three[1][1] == "[P20]" and none == []


def test_sources(spark):
    kind = "array<struct<id: string, report: string, company: string, period: string>>"
    rows = [("提升【E1】，改善【E2】【E1】，同比【E3】", [("E1", "r1", "a", "p"), ("E2", "r1", "a", "p"), ("E3", "r2", "a", "q")]), ("本期【E1】与【E2】和【E9】", [("E1", None, "a", "p"), ("E2", None, "a", "p")])]
    got = spark.createDataFrame(rows, f"a string, s {kind}").select(citations.answer_sources(F.col("a"), F.col("s")).alias("s")).collect()
    assert [[s["id"] for s in r["s"]] for r in got] == [["E1", "E3"], ["E1"]]


def test_marks_go(spark):
    rows = spark.createDataFrame([("利润增16.99亿元【E2】【E5】",), ("费用下降[E3]",), ("甲 【E1】 ，乙",)], "a string")
    assert [r["t"] for r in rows.select(citations.without_marks(F.col("a")).alias("t")).collect()] == ["利润增16.99亿元", "费用下降", "甲，乙"]


def test_each_step_is_computed_once(spark):
    """Mentions of one step inside lambdas are computed anew: the expression must not grow with the mentions of mentions."""
    df = spark.createDataFrame([("a【E1】",)], "answer string").select(citations.with_page_marks(F.col("answer"), F.array().cast(citations.CITATIONS)).alias("answer"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") <= 10 and plan.count("split(") <= 1
