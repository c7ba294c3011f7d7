"""Quotes on pages: the cases of filings, places in the page's own characters, and brute force over all runs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightledger.operators import quotes

CHANGE = "这里的应收账款的变动率是47.78%是什么影响的"
PAGE = "一、主要项目\n应收账款 \t 变动率  47.78%  ，主要系客户\n回款减少所致。 存货 12.00%"
SHEET = "非流动负债：长期借款 应付债券 租赁负债 长期应付款 长期应付职工薪酬 预计负债 递延收益"
COVER = "宁德时代新能源科技股份有限公司 2025年第三季度报告 重要内容提示 公司董事会保证报告内容真实准确完整。"
WAGES = "这一页的长期应付职工薪酬，为什么是空的"
# question, cited page, pages, page of the answer and what it holds
CASES = {
    "number": (CHANGE, 3, {3: PAGE}, 3, ("47.78%", "应收账款")),
    "unrelated": (CHANGE, 3, {3: "公司治理结构完善，独立董事出席率 100%。"}, None, ()),
    "cited first": (CHANGE, 3, {2: "应收账款无关说明，变动率 1.00%。", 3: PAGE, 4: "附注：应收账款坏账准备计提政策。"}, 3, ("47.78%",)),
    "neighbour": (CHANGE, 3, {2: "前言", 3: "本页无应收账款数字。", 4: PAGE}, 4, ("47.78%",)),
    "terms only": ("请看应收账款和坏账准备", 1, {1: "本节披露应收账款坏账准备的计提方法与比例。"}, 1, ("应收账款", "坏账准备")),
    "no cover": (WAGES, 1, {1: COVER, 2: "目录 第一节 重要提示 第二节 公司基本情况", 7: SHEET}, None, ()),
    "sheet": (WAGES, 7, {1: COVER, 7: SHEET}, 7, ("长期应付职工薪酬",)),
    "short terms": ("请看长期和职工", 1, {1: "本段讨论长期发展战略与职工培训计划，与薪酬表无关。"}, None, ()),
    "short name": ("营收是多少？", 2, {2: "一、营业总收入 其中：营业收入 90,703,260,964.48元 营业成本…"}, 2, ("营业收入", "90,703,260,964.48")),
    "null page": (CHANGE, 1, {1: None}, None, ()),
    "null question": (None, 1, {1: PAGE}, None, ()),
}


def test_cases(spark):
    asked = spark.createDataFrame([(k, k, c[1], c[0]) for k, c in CASES.items()], "question_id string, report string, page int, question string")
    pages = spark.createDataFrame([(k, p, t) for k, c in CASES.items() for p, t in c[2].items()], "report string, page int, content string")
    got = {r["question_id"]: r for r in quotes.page_quotes(asked, pages, "report").collect()}
    for name, (_, _, texts, page, holds) in CASES.items():
        assert (got[name]["page"] if name in got else None) == page, name
        if page:
            own = texts[page][got[name]["start"] : got[name]["end"]]
            assert " ".join(own.split()) == got[name]["quote"] and len(got[name]["quote"]) >= 8
            assert all(h in got[name]["quote"] for h in holds), got[name]


def test_tokens(spark):
    rows = spark.createDataFrame([(CHANGE,), ("营收是多少？",), ("12 和 345 与 6.5 及 1,234.5%",), (WAGES,)], "q string")
    a, b, c, d = rows.select(quotes.question_numbers(F.col("q")).alias("n"), quotes.question_terms(F.col("q")).alias("t")).collect()
    assert a["n"] == ["47.78%", "47.78"] and {"应收账款", "变动率"} <= set(a["t"]) and not {"这里", "什么"} & set(a["t"])
    assert "营业收入" in b["t"] and c["n"] == ["1,234.5%", "345", "6.5", "234.5"] and d["t"][0] == "长期应付职工薪酬" and {"长期应付", "长期应"} <= set(d["t"])


@pytest.mark.parametrize(("page", "quote", "want"), [("营业 收入\n增长", "收入增长", (3, 8)), ("abc", "d", None), ("a b", " ", None), (None, "a", None), ("a　b", "a b", (0, 3)), ("xx", "xx", (0, 2))])
def test_range(spark, page, quote, want):
    got = spark.createDataFrame([(page, quote)], "p string, q string").select(quotes.quote_range(F.col("p"), F.col("q")).alias("r")).first()["r"]
    assert (got and tuple(got)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="应收账款率 \n1", max_size=12), st.text(alphabet="应收账款率 \n1", min_size=1, max_size=4))
def test_one_line_keeps_places(content, part):
    text, at = quotes.on_one_line(content)
    assert text == " ".join(content.split()) and len(at) == len(text)
    # brute force over all runs: each run's own characters, put on one line, are the run
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i] != " " and text[j - 1] != " ":
                assert " ".join(content[at[i] : at[j - 1] + 1].split()) == text[i:j]


def test_a_page_is_cut_into_characters_once(spark):
    df = spark.createDataFrame([("a b\xa0c", "bc")], "page string, quote string").select(quotes.quote_range(F.col("page"), F.col("quote")).alias("r"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert tuple(df.first()["r"]) == (2, 5) and plan.count("split(") == 1 and "RLIKE" not in plan
