"""Outlines from contents pages and from what pages look like."""

import pytest

from brightledger.operators import outline

YEAR = {
    1: "贵州茅台酒股份有限公司 2024年年度报告", 3: "目录\n第一节 释义 …… P4\n第二节 公司简介和主要财务指标 …… 5\n第三节 管理层讨论与分析 ........ 12\n第四节 公司治理 .... 40\n第五节 环境和社会责任 …… 55\n第八节 财务报告 .... 81\n第九节 债券 …… 400",
    4: "4 贵州茅台酒股份有限公司\n第一节 释义\n在本报告书中，除非文义另有所指", 5: "5 贵州茅台酒股份有限公司\n第二节 公司简介和主要财务指标\n公司信息", 12: "12 第三节 管理层讨论与分析\n报告期内公司从事的主要业务",
    40: "40 公司治理 第四节 公司治理", 56: "55 第五节 环境和社会责任", 81: "81 合并资产负债表",
}
RULES = {
    2: "重要提示 本公司已在本报告中“管理层讨论与分析”章节阐述了风险。", 3: "目录 第三章 管理层讨论与分析 ........ 10 第八章 财务报表 .... 81",
    11: "10 招商银行股份有限公司 第三章 管理层讨论与分析 2026年半年度报告 管理层讨论与分析 3.1 总体经营情况分析", 15: "第五章 股份变动 股东", 16: "第五章 股份变动 股东", 20: None, 30: "财务报表附注 一、公司基本情况",
}
SAME = {3: "目录\n第一节 释义 …… 4\n第二节 公司简介 …… 4\n第三节 讨论与分析 …… 8", 4: "正文", 8: "正文"}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(r, p, t) for r, pages in (("year", YEAR), ("rules", RULES), ("same", SAME)) for p, t in pages.items()]
    labels = spark.createDataFrame([("year", 5, 6)], "report string, printed int, page int")
    got = {}
    for r in outline.outline(spark.createDataFrame(rows, "report string, page int, content string"), "report", labels).collect():
        got.setdefault(r["report"], []).append(r)
    return {k: sorted(v, key=lambda r: (r["page"], r["level"], r["id"])) for k, v in got.items()}


def test_contents(found):
    got = [(r["title"], r["page"], r["end_page"]) for r in found["year"]]
    assert got == [("第一节 释义", 4, 5), ("第二节 公司简介和主要财务指标", 6, 11), ("第三节 管理层讨论与分析", 12, 39), ("第四节 公司治理", 40, 55), ("第五节 环境和社会责任", 56, 80), ("第八节 财务报告", 81, 81)]
    assert {r["source"] for r in found["year"]} == {"toc"}


def test_rules(found):
    got = {(r["id"], r["page"]) for r in found["rules"]}
    assert ("mda", 11) in got and ("notes", 30) in got and ("financials", 30) in got and ("detected-15", 15) in got
    assert not {p for _, p in got} & {2, 3, 16} and "toc" not in {r["source"] for r in found["rules"]}


def test_neighbours_on_one_page(found):
    assert [(r["title"], r["page"], r["end_page"]) for r in found["same"]] == [("第一节 释义", 4, 4), ("第二节 公司简介", 4, 7), ("第三节 讨论与分析", 8, 8)]
