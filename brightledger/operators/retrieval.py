"""Passages that answer a question: relevance by keywords, excerpts, and the evidence put together.

A question is one small record; its terms are made once and become literals of the plan. Pages are scored where they lie, and
the best few of each report come from one window.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions.finance import amount_text, resolve_yoy
from brightledger.operators.rank import first_rows

#: Words of the field that weigh more.
DOMAIN = ("营业收入", "营收", "净利润", "利润", "每股收益", "EPS", "ROE", "净资产收益率", "现金流", "毛利率", "费用", "主营业务", "管理层", "经营情况", "同比", "资产负债")
#: Which words of a question name which metric.
METRIC_WORDS = {
    "revenue": "营业收入|营收|收入", "net_profit": "净利|利润", "eps": "(?i)每股|EPS", "roe": "(?i)收益率|ROE", "total_assets": "资产|负债率",
    "total_liabilities": "负债", "operating_cash_flow": "现金流", "operating_cost": "成本|毛利", "non_recurring_pnl": "非经常性损益",
    "profit_ex_non_recurring": "扣非", "cash_and_equivalents": "货币资金", "restricted_cash": "受限.*货币资金|货币资金.*受限",
    "short_term_borrowings": "短期借款", "long_term_borrowings": "长期借款", "bonds_payable": "应付债券", "current_portion_debt": "一年内到期",
    "goodwill": "商誉", "equity_parent": "归属于母公司.*权益|归母净资产|归母权益",
}


def terms(question: str) -> list[str]:
    """Words of letters and digits as they are, Chinese runs as pairs of characters."""
    out: list[str] = []
    for word in re.findall(r"[一-龥]+|[A-Za-z0-9]+", question):
        word = word.lower()
        out += [word] if re.fullmatch(r"[a-z0-9]+", word) else [word[i : i + 2] for i in range(len(word) - 1)]
    return list(dict.fromkeys(out))


def relevance(question: str, content: Column) -> Column:
    """How well a text fits a question: terms it has, whole phrases, words of the field, and places where reasons are given."""
    lower, q = F.lower(content), question.lower()
    points = [(lower.contains(t), 1) for t in terms(question)]
    points += [(lower.contains(p), 20) for p in re.findall(r"[一-龥]{3,12}", question)]
    points += [(lower.contains(d.lower()), 8) for d in DOMAIN if d.lower() in q]
    if "营收" in question:
        points.append((content.contains("营业收入"), 8))
    if re.search("原因|为什么|变化|概览", question):
        points.append((content.rlike("经营情况|管理层|主要原因|同比|变动原因"), 6))
    if re.search("原因|为什么|变化", question):
        points.append((content.rlike("管理层讨论|主营业务分析|经营情况讨论") & (F.length(content) > 600), 24))
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points], F.lit(0))


def rank_pages(pages: DataFrame, question: str, by: list[str], metric_pages: DataFrame | None = None, n: int = 12) -> DataFrame:
    """The best pages of each group with their ``score``; a page the question names is the only one."""
    named = re.search(r"第\s*(\d+)\s*页", question)
    if named:
        scored = pages.withColumn("score", F.when(F.col("page") == int(named[1]), 100).otherwise(0))
    elif metric_pages is None:
        scored = pages.withColumn("score", relevance(question, F.col("content")))
    else:
        flagged = metric_pages.select(*by, "page").distinct().withColumn("__metric", F.lit(35))
        scored = pages.join(flagged, [*by, "page"], "left").withColumn("score", relevance(question, F.col("content")) + F.coalesce("__metric", F.lit(0))).drop("__metric")
    return first_rows(scored.filter("score > 0"), by, [F.desc("score"), "page"], n)


def excerpt(question: str, content: Column, length: int = 1600) -> Column:
    """The best of windows that overlap by half, the earliest of equals; a short text as it is."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(content) - 1, F.lit(0)), F.lit(length // 2))
    spans = F.transform(starts, lambda s: F.struct((-relevance(question, F.substring(content, s + 1, F.lit(length)))).alias("off"), s.alias("s")))
    best = F.array_min(spans)["s"]
    return F.when(F.length(content) <= length, content).otherwise(F.substring(content, best + 1, F.lit(length)))


def unsupported_years(question: str, context: str) -> list[str]:
    """Years asked for that no data has."""
    return [y for y in dict.fromkeys(re.findall(r"20\d{2}", question)) if y not in context]


@dataclass(frozen=True)
class QueryPlan:
    """What a question needs."""

    question: str
    metrics: list[str] = field(default_factory=list)
    explicit_page: int | None = None
    needs_history: bool = False
    needs_peers: bool = False
    wants_value: bool = False
    wants_change: bool = False
    out_of_scope: str | None = None


def plan_question(question: str) -> QueryPlan:
    """Reads off a question which metrics, periods, peers and answers it asks for."""
    page = re.search(r"第\s*(\d+)\s*页", question)
    metrics = [m for m, p in METRIC_WORDS.items() if re.search(p, question)]
    reason = bool(re.search("原因|为什么|为何|如何|怎么|影响", question))
    advice = re.search("买入|卖出|加仓|减仓|目标价|荐股", question)
    return QueryPlan(
        question, metrics, int(page[1]) if page else None, bool(re.search("历史|趋势|近.{1,2}年|历年|变化|同比|环比|对比去年", question)),
        bool(re.search("同行|行业|对比|排名|相比", question)), bool(metrics) and not reason and not page, bool(re.search("同比|增长|变化|下降", question)),
        "advice" if advice else None,
    )


def direct_answer(plan: QueryPlan, periods: str, facts: list[str], calculations: list[str], has_passages: bool) -> tuple[str | None, str]:
    """An answer that needs no model, and the mode; None where evidence must be read."""
    if plan.out_of_scope:
        return "暂不提供投资建议。", "out-of-scope"
    if missing := unsupported_years(plan.question, periods):
        return f"暂无法回答：没有 {'、'.join(missing)} 年的同口径数据。", "out-of-scope"
    if plan.explicit_page and not has_passages:
        return "暂无法回答：所选页没有可检索的原文。", "insufficient-evidence"
    if plan.wants_value:
        lines = [*facts, *(calculations if plan.wants_change else [])]
        return ("\n".join(lines), "structured-query") if facts else ("暂无法回答：相关指标尚未解析。", "insufficient-evidence")
    if not facts and not has_passages:
        return "暂无法回答：没有足够的指标或原文证据。", "insufficient-evidence"
    return None, "evidence-retrieval"


def evidence(facts: DataFrame, passages: DataFrame, report: str, by: Sequence[str] = ()) -> DataFrame:
    """Facts before passages with ids E1, E2, ... by first appearance of report and page; both have ``ordinal`` and ``text``.

    Ids are counted within each group ``by``; without one all rows are a question's context, a few dozen.
    """
    columns = [*dict.fromkeys([*by, report])]
    rows = facts.select(F.lit(0).alias("kind"), "ordinal", *columns, "page", "text").unionByName(passages.select(F.lit(1).alias("kind"), "ordinal", *columns, "page", "text"))
    whole = Window.partitionBy(*by).orderBy("first_kind", "first_ordinal", report, "page")
    first = rows.groupBy(*columns, "page").agg(F.min(F.struct("kind", "ordinal")).alias("f")).select(*columns, "page", F.col("f.kind").alias("first_kind"), F.col("f.ordinal").alias("first_ordinal"))
    ids = first.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(whole).cast("string")))
    return rows.join(ids.select(*columns, "page", "evidence_id"), [*columns, "page"])


def context(metrics: DataFrame, pages: DataFrame, plan: QueryPlan, report: str, n: int = 12, length: int = 1600) -> DataFrame:
    """What a question may be answered from, for each report: facts and changes of the metrics asked for (all where none is named),
    then the best passages, with evidence ids.

    ``metrics`` are ``report, metric, value, page, prior_value, yoy_pct``; a change is told where the question wants one.
    """
    asked = metrics.filter(F.col("metric").isin(*plan.metrics)) if plan.metrics else metrics
    place = F.array_position(F.array(*[F.lit(m) for m in METRIC_WORDS]), F.col("metric"))
    known = resolve_yoy(asked, "y", F.col("value"), F.col("prior_value"), F.col("yoy_pct"), F.lit(None).cast("double"), F.col("metric"))
    said = F.concat_ws(" ", "metric", amount_text(F.col("value")), F.when(F.lit(plan.wants_change), F.col("y.label")))
    facts = known.select(report, F.col("page").cast("int").alias("page"), place.cast("int").alias("ordinal"), said.alias("text"))
    best = rank_pages(pages, plan.question, [report], n=n)
    order = F.row_number().over(Window.partitionBy(report).orderBy(F.desc("score"), "page"))
    passages = best.select(report, F.col("page").cast("int").alias("page"), order.alias("ordinal"), excerpt(plan.question, F.col("content"), length).alias("text"))
    return evidence(facts, passages, report, [report])
