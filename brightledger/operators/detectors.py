"""Detectors over wide reports: relationships between metrics, and dimensions to watch.

Input is one row a report with a column for each metric and ``prior_<metric>`` for the comparable report's (see ``wide``).
Each detector becomes a struct ``id, theme, title, tone, priority, status``, where status is card, none or insufficient. All of
them are evaluated in one pass and exploded; what is shown is chosen by two windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions.finance import finite, profit_bridge, yoy, yoy_pct
from brightledger.operators.rank import best_theme_cards, first_rows

#: The metrics of a report.
METRICS = (
    "revenue", "net_profit", "eps", "roe", "operating_cost", "operating_cash_flow", "total_assets", "total_liabilities",
    "non_recurring_pnl", "profit_ex_non_recurring", "cash_and_equivalents", "restricted_cash", "goodwill", "equity_parent",
    "short_term_borrowings", "current_portion_debt", "long_term_borrowings", "bonds_payable",
)
#: Where a signal begins.
NON_RECURRING, CASH_TO_PROFIT, CASH_TO_ASSETS, DEBT_TO_ASSETS, GOODWILL, RESTRICTED = 0.2, 0.5, 0.2, 0.2, 0.2, 0.3
SHORT_SHARE, SHORT_COVER, MARGIN_DROP = 0.6, 1.0, 3
SYNC_GROWTH, PRIOR_CASH_OK, CASH_DROP, DEBT_HIGH, DEBT_JUMP, OCF_DROP, ASSET_LEAD, BRIDGE_MOVE = 5, 0.8, 0.5, 0.7, 5, 3, 10, 0.05
SHORT_PARTS = ("short_term_borrowings", "current_portion_debt")
DEBT_PARTS = (*SHORT_PARTS, "long_term_borrowings", "bonds_payable")


def wide(metrics: DataFrame, key: list[str]) -> DataFrame:
    """Long metrics to one row a report; the names are given, so no job looks for them."""
    return metrics.groupBy(*key).pivot("metric", list(METRICS)).agg(F.first("value", ignorenulls=True))


def with_prior(current: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
    """Wide reports with the metrics of the comparable one."""
    return current.join(prior.select(*on, *[F.col(m).alias(f"prior_{m}") for m in METRICS]), on, "left")


def _m(name: str) -> Column:
    return F.col(name)


def _p(name: str) -> Column:
    return F.col(f"prior_{name}")


def _have(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in columns])


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Detector:
    """What a detector says: when it has enough to go by, and rules of condition, title, tone and priority; the first that holds counts."""

    id: str
    theme: str
    enough: Column
    rules: list[tuple[Column, str, str, Column | int]]

    def staged(self, i: int) -> dict[str, Column]:
        """Columns of detector ``i``: the number of the rule that holds (-1 for none, null without enough) and, where it is no plain
        number, its priority."""
        first = F.coalesce(*[F.when(_yes(c), i) for i, (c, *_) in enumerate(self.rules)], F.lit(-1))
        out = {f"__rule{i}": F.when(_yes(self.enough), first)}
        computed = next((p for *_, p in self.rules if isinstance(p, Column)), None)
        return out if computed is None else out | {f"__priority{i}": computed.cast("int")}

    def card(self, i: int) -> Column:
        """The struct made from the staged columns."""
        rule = F.col(f"__rule{i}")
        said = lambda k, kind: F.coalesce(*[F.when(rule == n, F.lit(r[k])) for n, r in enumerate(self.rules)], F.lit(None)).cast(kind)
        priority = F.coalesce(*[F.when(rule == n, F.col(f"__priority{i}") if isinstance(r[3], Column) else F.lit(r[3])) for n, r in enumerate(self.rules)], F.lit(None)).cast("int")
        status = F.when(rule.isNull(), "insufficient").when(rule < 0, "none").otherwise("card")
        return F.struct(F.lit(self.id).alias("id"), F.lit(self.theme).alias("theme"), said(1, "string").alias("title"), said(2, "string").alias("tone"), priority.alias("priority"), status.alias("status"))


def _card(id: str, theme: str, enough: Column, rules: list[tuple[Column, str, str, Column | int]]) -> Detector:
    return Detector(id, theme, enough, rules)


def _steps(share: Column, per: int, most: int) -> Column:
    return F.least(F.lit(most), F.floor(share * per))


def revenue_vs_profit() -> Detector:
    r, p = yoy_pct(_m("revenue"), _p("revenue")), yoy_pct(_m("net_profit"), _p("net_profit"))
    up = lambda m: _m(m) > _p(m)
    down = lambda m: _m(m) < _p(m)
    both = _yes(up("revenue") & up("net_profit") & (F.coalesce(r, F.lit(0.0)) >= SYNC_GROWTH) & (F.coalesce(p, F.lit(0.0)) >= SYNC_GROWTH))
    moved = (_m("revenue") != _p("revenue")) & (_m("net_profit") != _p("net_profit"))
    return _card("revenue_vs_profit", "growth", _have(_m("revenue"), _m("net_profit"), _p("revenue"), _p("net_profit")) & moved, [
        (up("revenue") & down("net_profit"), "收入增长没有转化为利润增长", "watch", 95),
        (down("revenue") & up("net_profit"), "收入下滑但利润上升", "watch", 90),
        (both, "收入与利润同步增长", "ok", 35),
    ])


def cash_vs_profit() -> Detector:
    profit, cash, profit0, cash0 = _m("net_profit"), _m("operating_cash_flow"), _p("net_profit"), _p("operating_cash_flow")
    ratio, ratio0 = F.try_divide(cash, profit), F.try_divide(cash0, profit0)
    cross = _have(profit0, cash0)
    negative = (profit > 0) & (cash < 0)
    collapse = _yes(((ratio0 >= PRIOR_CASH_OK) & (ratio < CASH_TO_PROFIT)) | (ratio0 - ratio >= CASH_DROP))
    return _card("cash_vs_profit", "cash", _have(profit, cash), [
        (negative, "账面盈利但经营现金流为负", "watch", 98),
        (cross & (profit > profit0) & (cash < cash0), "盈利与经营现金流走势分化", "watch", 92),
        (cross & (profit < profit0) & (cash > cash0), "利润下滑但经营现金流改善", "watch", 88),
        (cross & collapse, "经营现金流相对利润明显走弱", "watch", 88),
        (cross & (profit > profit0) & (cash > cash0), "利润增长伴随经营现金流改善", "ok", 40),
        (~cross & (ratio < CASH_TO_PROFIT), "经营现金流相对利润偏弱", "watch", 82),
    ])


def _non_recurring() -> tuple[Column, Column, Column]:
    parent, ex, part = _m("net_profit"), _m("profit_ex_non_recurring"), _m("non_recurring_pnl")
    # a part as large as the whole was read from the wrong line; the difference tells it
    wrong = _yes((parent > 0) & (F.abs(part - parent) / parent < 0.02))
    return parent, ex, F.when(wrong | part.isNull(), F.coalesce(parent - ex, F.when(~wrong, part))).otherwise(part)


def earnings_quality() -> Detector:
    parent, ex, part = _non_recurring()
    share = part / parent
    return _card("ex_non_recurring", "earnings_quality", _have(parent, part), [
        ((parent > 0) & (ex < 0), "扣非为负而归母为正", "watch", 94),
        ((parent > 0) & (share >= NON_RECURRING), "非经常性损益占比偏高", "watch", 80 + _steps(share, 20, 12)),
    ])


def cost_and_margin() -> Detector:
    r, c, r0, c0 = _m("revenue"), _m("operating_cost"), _p("revenue"), _p("operating_cost")
    drop = ((r0 - c0) / r0 - (r - c) / r) * 100
    faster = (c0 > 0) & (F.try_divide(c, c0) - 1 > F.try_divide(r, r0) - 1 + 0.03)
    priority = 78 + F.least(F.lit(12), F.greatest(F.lit(0), F.floor(drop - MARGIN_DROP)))
    return _card("revenue_cost_margin", "growth", _have(r, c, r0, c0) & (r > 0) & (r0 > 0), [
        (drop >= MARGIN_DROP, "毛利率明显收窄", "watch", priority), (faster, "营业成本增速快于营收", "watch", priority),
    ])


def bridge() -> Detector:
    r, p, r0, p0 = _m("revenue"), _m("net_profit"), _p("revenue"), _p("net_profit")
    parts = profit_bridge(r, r0, p, p0)
    scale, margin, change = parts["from_revenue"], parts["from_margin"], p - p0
    moved = (change != 0) & ((p0 == 0) | (F.try_divide(F.abs(change), F.abs(p0)) >= BRIDGE_MOVE))
    leads = (F.abs(margin) >= F.abs(scale) * 1.15) & (F.abs(margin) >= F.abs(change) * 0.4)
    against = (scale != 0) & (margin != 0) & (F.signum(scale) != F.signum(margin))
    return _card("profit_bridge", "growth", _have(r, p, r0, p0) & (r > 0) & (r0 > 0), [
        (moved & (change < 0) & (margin < 0) & (leads | against), "利润下滑中利润率拖累更明显", "watch", 86),
        (moved & (change > 0) & (margin < 0) & against, "规模扩大但利润率拖累利润", "watch", 84),
        (moved & leads, "利润变动更多来自利润率变化", "watch", 76),
        (moved & (against | ((change < 0) & (margin < 0))), "规模与利润率对利润的贡献方向相反", "watch", 74),
    ])


def debt_vs_assets() -> Detector:
    a, d, a0, d0 = _m("total_assets"), _m("total_liabilities"), _p("total_assets"), _p("total_liabilities")
    ratio, jump = d / a, F.when((a0 > 0) & finite(d0), (d / a - d0 / a0) * 100)
    high, jumped = ratio >= DEBT_HIGH, _yes(jump >= DEBT_JUMP)
    priority = F.when(high & jumped, 85).when(high, 82).otherwise(78)
    return _card("debt_vs_assets", "leverage", _have(a, d) & (a > 0), [
        (jumped & (~high | (jump >= 8)), "资产负债率明显上升", "watch", priority), (high | jumped, "资产负债率处于较高水平", "watch", priority),
    ])


def restricted_cash() -> Detector:
    share = F.try_divide(_m("restricted_cash"), _m("cash_and_equivalents"))
    return _card("restricted_cash", "liquidity", _have(_m("restricted_cash"), _m("cash_and_equivalents")) & (_m("cash_and_equivalents") > 0), [
        (share >= RESTRICTED, "受限资金占比偏高", "watch", 70 + _steps(share, 30, 15))])


def goodwill() -> Detector:
    share = F.try_divide(_m("goodwill"), _m("equity_parent"))
    return _card("goodwill_vs_equity", "goodwill", _have(_m("goodwill"), _m("equity_parent")) & (_m("equity_parent") > 0), [
        (share >= GOODWILL, "商誉占净资产比例偏高", "watch", 72 + _steps(share, 30, 15))])


def assets_vs_revenue() -> Detector:
    a, r = yoy_pct(_m("total_assets"), _p("total_assets")), yoy_pct(_m("revenue"), _p("revenue"))
    return _card("assets_vs_revenue_growth", "expansion", _have(_m("total_assets"), _m("revenue")) & (a != 0) & (r != 0), [
        ((a > 0) & (r < 0), "资产扩张但营收下滑", "watch", 88),
        ((a > 0) & (((r > 0) & (a - r >= ASSET_LEAD)) | ((r < 2) & (a >= ASSET_LEAD))), "资产扩张快于营收增长", "watch", 80),
    ])


def cash_rate() -> Detector:
    r, c, r0, c0 = _m("revenue"), _m("operating_cash_flow"), _p("revenue"), _p("operating_cash_flow")
    drop = (c0 / r0 - c / r) * 100
    rising = (r > r0) & (drop > 0)
    return _card("ocf_rate", "cash", _have(r, c, r0, c0) & (r > 0) & (r0 > 0), [
        ((drop >= OCF_DROP) | (rising & (drop >= 1.5)), "经营现金流率下降", "watch", F.when(rising, 84).otherwise(78))])


RELATIONSHIPS = (revenue_vs_profit, cash_vs_profit, earnings_quality, cost_and_margin, bridge, debt_vs_assets, restricted_cash, goodwill, assets_vs_revenue, cash_rate)


def evaluated(reports: DataFrame, key: list[str], detectors=RELATIONSHIPS) -> DataFrame:
    """A row for each report and detector, with ``ordinal``, the order of evaluation.

    Which rule holds is a column of its own on the way, so that the plan stays small.
    """
    found = [d() for d in detectors]
    staged = reports.select(*key, *[c.alias(n) for i, d in enumerate(found) for n, c in d.staged(i).items()])
    rows = staged.select(*key, F.posexplode(F.array(*[d.card(i) for i, d in enumerate(found)])).alias("ordinal", "card"))
    return rows.select(*key, "ordinal", "card.*")


def relationships(reports: DataFrame, key: list[str], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The cards that are shown (the best of each theme, then the first few), and each report's status."""
    rows = evaluated(reports, key)
    cards = rows.filter("status = 'card'").withColumn("report", F.struct(*key))
    shown = best_theme_cards(cards, "report", "theme", [F.desc("priority"), "ordinal"], most).drop("report")
    has = lambda s: F.max(F.col("status") == s)
    state = F.when(has("card"), "has_cards").when(has("none"), "checked_none").otherwise("insufficient")
    return shown, rows.groupBy(*key).agg(state.alias("status"))


def _known_sum(names: tuple[str, ...]) -> Column:
    from brightledger.operators.aggregate import sum_disclosed

    return sum_disclosed(*[_m(n) for n in names])


def watch_dimensions() -> list:
    """The numeric dimensions; priority is the severity."""

    def non_recurring() -> Detector:
        parent, ex, part = _non_recurring()
        negative = _yes(ex < 0)
        severity = 80 + F.when(negative, 10).otherwise(0) + F.least(F.lit(20), F.floor(part / F.greatest(parent, F.lit(1.0)) * 40))
        return _card("non_recurring", "watch", _have(parent, part), [((parent > 0) & ((part / parent >= NON_RECURRING) | negative), "非经常性损益", "watch", severity)])

    def cash() -> Detector:
        p, c = _m("net_profit"), _m("operating_cash_flow")
        negative = (p > 0) & (c < 0)
        return _card("cash_vs_profit", "watch", _have(p, c), [(negative | (F.try_divide(c, p) < CASH_TO_PROFIT), "利润与现金流", "watch", 85 + F.when(negative, 15).otherwise(0))])

    def both_high() -> Detector:
        c, a, d = _m("cash_and_equivalents"), _m("total_assets"), _known_sum(DEBT_PARTS)
        return _card("cash_and_debt", "watch", _have(c, a, d) & (a > 0), [((c / a >= CASH_TO_ASSETS) & (d / a >= DEBT_TO_ASSETS), "存贷双高", "watch", 70)])

    def goodwill_load() -> Detector:
        return _card("goodwill_load", "watch", _have(_m("goodwill"), _m("equity_parent")) & (_m("equity_parent") > 0), [(_m("goodwill") / _m("equity_parent") >= GOODWILL, "商誉占比", "watch", 65)])

    def restricted() -> Detector:
        c = _m("cash_and_equivalents")
        return _card("restricted_cash", "watch", _have(c, _m("restricted_cash")) & (c > 0), [(_m("restricted_cash") / c >= RESTRICTED, "资金受限", "watch", 60)])

    def short_debt() -> Detector:
        s, d, c = _known_sum(SHORT_PARTS), _known_sum(DEBT_PARTS), _m("cash_and_equivalents")
        return _card("short_debt_pressure", "watch", _have(s, d, c) & (d > 0), [((s / d >= SHORT_SHARE) & (s > 0) & (c < SHORT_COVER * s), "短债压力", "watch", 68)])

    def margin_collapse() -> Detector:
        r, r0, p, p0, c, c0 = _m("revenue"), _p("revenue"), _m("net_profit"), _p("net_profit"), _m("operating_cost"), _p("operating_cost")
        drop = F.when((r > 0), ((r0 - c0) / r0 - (r - c) / r) * 100)
        return _card("margin_collapse", "watch", _have(r, r0) & (r0 > 0), [((r > r0) & (_yes(p < p0) | _yes(drop >= MARGIN_DROP)), "增收不增利", "watch", 75)])

    def one_off() -> Detector:
        parent, ex, part = _m("net_profit"), _m("profit_ex_non_recurring"), _m("non_recurring_pnl")
        share = F.coalesce(part, parent - ex) / parent
        return _card("one_off_boost", "watch", _have(parent, ex), [((parent > 0) & ((ex < 0) | (share >= NON_RECURRING)), "一次性抬升", "watch", 78)])

    return [non_recurring, cash, both_high, goodwill_load, restricted, short_debt, margin_collapse, one_off]


#: What texts are searched for, by dimension: pattern, title, severity.
TEXT_DIMENSIONS = {
    "admin_penalty": ("行政处罚|罚款|警示函|责令改正|立案调查|监管措施", "行政处罚", 82),
    "major_shareholder": ("(?:控股股东|实际控制人|第一大股东)[^。]{0,24}(?:变更|转让|减持|控制权)|协议转让|被动减持", "大股东变动", 72),
    "dividend_change": ("不派发|不进行利润分配|不进行现金分红|取消派息", "分红异动", 62),
    "donation_outflow": ("对外捐赠|公益捐赠|慈善捐赠|捐赠支出", "大额捐款", 58),
    "soft_pedal_cues": ("(?:处罚|诉讼|非标意见|整改|关注函)[^。]{0,60}(?:有所波动|阶段性|影响较小|不构成重大)", "表述淡化", 55),
    "unit_anomaly": (r"(?:薪酬|外包|费用)[^。]{0,60}?\d{8,}(?:\.\d+)?\s*万元", "披露单位异常", 120),
}


def watch_texts(pages: DataFrame, report: str) -> DataFrame:
    """``id, title, severity, page, quote``: for each report and dimension the first page that names it."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", " ")
    hits = F.array(*[
        F.when(text.rlike(p), F.struct(F.lit(k).alias("id"), F.lit(t).alias("title"), F.lit(s).alias("severity"), F.regexp_extract(text, f"(.{{0,24}}(?:{p}).{{0,12}})", 1).alias("quote")))
        for k, (p, t, s) in TEXT_DIMENSIONS.items()
    ])
    found = pages.select(report, "page", F.explode(F.array_compact(hits)).alias("hit")).select(report, "page", "hit.*")
    return first_rows(found, [report, "id"], ["page", "quote"])


def watch_cards(reports: DataFrame, pages: DataFrame, report: str, most: int = 2) -> DataFrame:
    """The gravest signals of each report; two calm defaults where there are none."""
    numbers = evaluated(reports, [report], watch_dimensions()).filter("status = 'card'").select(report, "id", "title", F.col("priority").alias("severity"), F.lit(None).cast("int").alias("page"))
    texts = watch_texts(pages, report).select(report, "id", "title", "severity", F.col("page").cast("int").alias("page"))
    shown = first_rows(numbers.unionByName(texts), [report], [F.desc("severity"), "id"], most)
    calm = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("title")) for i, t in (("earnings_quality_scan", "盈利质量"), ("balance_sheet_scan", "资产负债"))])
    quiet = reports.select(report).join(shown.select(report), report, "left_anti").select(report, F.explode(calm).alias("c"))
    return shown.unionByName(quiet.select(report, "c.id", "c.title", F.lit(0).alias("severity"), F.lit(None).cast("int").alias("page")))


def key_findings(reports: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """What to say first of a report: changes of the four headline metrics, weak cash and high leverage; warnings first."""
    ratio, debt = F.try_divide(_m("operating_cash_flow"), _m("net_profit")), F.try_divide(_m("total_liabilities"), _m("total_assets"))
    finding = lambda k, text, watch: F.struct(F.lit(k).alias("id"), text.alias("text"), watch.alias("watch"))
    parts = []
    for m in ("revenue", "net_profit", "eps", "roe"):
        y = yoy(_m(m), _p(m))
        parts.append(F.when(y.isNotNull(), finding(m, y["label"], _yes(_m(m) < _p(m)))))
    parts.append(F.when((_m("net_profit") > 0) & (ratio < 0.8), finding("cash", F.format_string("净现比 %.1f%%", ratio * 100), F.lit(True))))
    parts.append(F.when((_m("total_assets") > 0) & (debt >= 0.7), finding("leverage", F.format_string("资产负债率 %.1f%%", debt * 100), F.lit(True))))
    rows = reports.select(*key, F.posexplode(F.array_compact(F.array(*parts))).alias("ordinal", "f")).select(*key, "ordinal", "f.*")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("watch"), "ordinal"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)
