"""Changes, ratios and reconciliation of financial metrics, as Columns.

Amounts are doubles. A null or non-finite input gives a null result unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of money in yuan.
SCALES = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}
HUNDRED_MILLION = 1e8
#: The least absolute difference that counts, by metric.
FLOORS = {"revenue": 0.05, "net_profit": 0.05, "eps": 0.02, "roe": 0.15}
ADDITIVE = ("revenue", "net_profit", "eps")


def finite(x: Column) -> Column:
    """Whether a number is there and finite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded to digits with halves going up, as web pages round."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def _result(kind, pct: Column, label: Column, delta: Column, na) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pct.cast("double").alias("pct"), label.alias("label"), delta.alias("absolute_delta"), F.lit(na).alias("na_percent"))


def _percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x)


def yoy(current: Column, prior: Column) -> Column:
    """A change against a base as ``kind, pct, label, absolute_delta, na_percent``.

    Without a meaningful percentage (base 0 or a change of sign) the kind is qualitative; between losses the change relates
    to the size of the base, and the label says whether the loss shrank.
    """
    delta, none = current - prior, F.lit(None)
    zero = F.when(current > 0, "实现首次盈利").when(current == 0, "无变化").otherwise("首次亏损")
    cross = F.when(prior < 0, "扭亏为盈").otherwise("由盈转亏")
    pct = F.try_divide(delta, F.abs(prior)) * 100
    loss = F.concat(F.when(F.abs(current) < F.abs(prior), "减亏 ").otherwise("增亏 "), _percent(F.abs(pct)))
    gain = F.concat(F.when(pct > 0, "同比增长 ").otherwise("同比下降 "), _percent(F.abs(pct)))
    losses = (current < 0) & (prior < 0)
    return F.when(
        finite(current) & finite(prior),
        F.when(prior == 0, _result("qualitative", none, zero, delta, True))
        .when(((current > 0) & (prior < 0)) | ((current < 0) & (prior > 0)), _result("qualitative", none, cross, delta, True))
        .when(pct == 0, _result("flat", F.lit(0.0), F.lit("持平"), delta, False))
        .otherwise(_result("pct", pct, F.when(losses, loss).otherwise(gain), delta, False)),
    )


def yoy_pct(current: Column, prior: Column) -> Column:
    """Only the percentage of ``yoy``, where there is one; a small expression, as detectors need many."""
    crossed = ((current > 0) & (prior < 0)) | ((current < 0) & (prior > 0))
    return F.when(finite(current) & finite(prior) & (prior != 0) & ~crossed, (current - prior) / F.abs(prior) * 100)


def yoy_badge(y: Column, digits: int = 1) -> Column:
    """The short text of a card for a struct of ``yoy``."""
    size = _percent(F.abs(y["pct"]), digits)
    lost = F.substring(y["label"], 1, 2)
    signed = F.concat(F.when(y["pct"] >= 0, "+").otherwise("-"), size)
    text = F.when(y["na_percent"] | (y["kind"] == "qualitative"), y["label"]).when(y["kind"] == "flat", "持平")
    sized = text.when(lost.isin("减亏", "增亏"), F.concat(lost, F.lit(" "), size)).otherwise(signed)
    return F.when(y.isNull(), "暂无同比").otherwise(sized)


def yoy_tone(y: Column) -> Column:
    """up, down or neutral for a struct of ``yoy``."""
    label, lost = y["label"], F.substring(y["label"], 1, 2)
    good, bad = label.isin("扭亏为盈", "实现首次盈利"), label.isin("由盈转亏", "首次亏损")
    quality = F.when(good, "up").when(bad, "down").otherwise("neutral")
    sized = F.when((y["kind"] == "flat") | F.coalesce(y["pct"] == 0, F.lit(True)), "neutral").when(lost == "减亏", "up").when(lost == "增亏", "down")
    return F.when(y.isNull(), "neutral").when(y["na_percent"], quality).otherwise(sized.when(y["pct"] > 0, "up").otherwise("down"))


def absurd_prior(current: Column, prior: Column, metric: Column) -> Column:
    """Whether a disclosed base is likely a percentage that was read as an amount. Rates below 100 never are."""
    big, base = F.abs(current), F.abs(prior)
    rate = F.when((big <= 100) & (base <= 100), False).otherwise((base > 1000) | (big > 1000))
    pct = yoy_pct(current, prior)
    ratio = F.when(big > 0, base / big).otherwise(1.0)
    as_percent = (big < 1000) & (base <= 1000) & (base > F.greatest(F.lit(100.0), big * 10)) & (pct > -100) & (pct <= -90)
    far = (F.abs(pct) >= 500) & ((ratio < 0.01) | (base < big * 1e-6) | ((big < 1000) & (base <= 100) & (ratio < 0.1)))
    return F.when(~(finite(current) & finite(prior)), False).when(F.coalesce(metric == "roe", F.lit(False)), rate).otherwise(F.coalesce(as_percent | far, F.lit(False)))


def points(current: Column, prior: Column) -> Column:
    """The change of a rate in percentage points, in the form of ``yoy``."""
    pp = current - prior
    text = F.concat(F.when(pp > 0, "上升 ").otherwise("下降 "), F.format_string("%.2f", F.abs(pp)), F.lit(" 个百分点"))
    return F.when(pp == 0, _result("flat", F.lit(0.0), F.lit("持平"), F.lit(0.0), False)).otherwise(_result("qualitative", pp, text, pp, False))


def disclosed_change(pct: Column, current: Column, prior: Column) -> Column:
    """A disclosed percentage in the form of ``yoy``; a known base that makes it meaningless or a loss has its say."""
    known = finite(current) & finite(prior)
    delta = F.when(known, current - prior).otherwise(0.0)
    by_amounts = yoy(current, prior)
    losses = known & (current < 0) & (prior < 0)
    loss = F.concat(F.when(F.abs(current) < F.abs(prior), "减亏 ").otherwise("增亏 "), _percent(F.abs(pct)))
    gain = F.concat(F.when(pct > 0, "同比增长 ").otherwise("同比下降 "), _percent(F.abs(pct)))
    return (
        F.when(known & by_amounts["na_percent"], by_amounts)
        .when(pct == 0, _result("flat", F.lit(0.0), F.lit("持平"), delta, False))
        .otherwise(_result("pct", pct, F.when(losses, loss).otherwise(gain), delta, False))
    )


def resolve_yoy(df: DataFrame, name: str, current: Column, disclosed_prior: Column, disclosed_pct: Column, cross_prior: Column, metric: Column) -> DataFrame:
    """Adds the change by the best evidence, with its ``source``: the filing's percentage, its base, or another filing's value.

    What several branches need is a column of its own on the way, so that the plan stays small.
    """
    roe = F.coalesce(metric == "roe", F.lit(False))
    named = {"__c": current, "__p": disclosed_prior, "__y": disclosed_pct, "__x": cross_prior, "__roe": roe}
    first = df.withColumns({k: v if k == "__roe" else v.cast("double") for k, v in named.items()})
    c, p, y, x = (F.col(k) for k in ("__c", "__p", "__y", "__x"))
    second = first.withColumn("__absurd", absurd_prior(c, p, F.when(F.col("__roe"), "roe")))
    absurd, roe = F.col("__absurd"), F.col("__roe")
    base = F.when(finite(p) & (p != 0) & ~absurd, p)
    as_pct = absurd & ~roe & (F.abs(p) < 1000) & (F.abs(p) >= 0.01)
    # which evidence speaks, and the two numbers it speaks of
    kind = (
        F.when(~finite(c), None).when(finite(y), F.when(roe & base.isNotNull(), "points").otherwise("percent"))
        .when(finite(p) & ~absurd, F.when(roe, "points").otherwise("amounts")).when(finite(p) & as_pct, "percent")
        .when(finite(x), F.when(roe, "points").otherwise("amounts"))
    )
    source = F.when(finite(y) | (finite(p) & (~absurd | as_pct)), "disclosed").otherwise("computed")
    against = F.when(finite(y), base).when(finite(p) & ~absurd, p).when(finite(p) & as_pct, None).otherwise(x)
    third = second.withColumns({"__kind": kind, "__source": source, "__base": against, "__pct": F.when(finite(y), y).otherwise(p)})
    b = F.col("__base")
    fourth = third.withColumn("__change", F.when(F.col("__kind") == "points", points(c, b)).when(F.col("__kind") == "percent", disclosed_change(F.col("__pct"), c, b)).when(F.col("__kind") == "amounts", yoy(c, b)))
    fields = ("kind", "pct", "label", "absolute_delta", "na_percent")
    made = F.struct(*[F.col(f"__change.{k}").alias(k) for k in fields], F.col("__source").alias("source"))
    return fourth.withColumn(name, F.when(F.col("__change").isNotNull(), made)).drop("__c", "__p", "__y", "__x", "__roe", "__absurd", "__kind", "__source", "__base", "__pct", "__change")


def implied_prior(current: Column, pct: Column) -> Column:
    """The base that a percentage implies."""
    return F.try_divide(current, 1 + pct / 100)


def ratio_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent; null unless the whole is positive."""
    return F.when(whole > 0, part / whole * 100)


def debt_ratio(liabilities: Column, assets: Column) -> Column:
    return ratio_pct(liabilities, assets)


def cash_conversion(cash: Column, profit: Column) -> Column:
    return ratio_pct(cash, profit)


def gross_margin(revenue: Column, cost: Column) -> Column:
    return ratio_pct(revenue - cost, revenue)


def profit_bridge(revenue: Column, prior_revenue: Column, profit: Column, prior_profit: Column) -> Column:
    """What the change of revenue at the old margin brings to profit, and the rest."""
    scale = (revenue - prior_revenue) * F.try_divide(prior_profit, prior_revenue)
    return F.struct(scale.alias("from_revenue"), (profit - prior_profit - scale).alias("from_margin"))


def to_yuan(value: Column, unit: Column) -> Column:
    """An amount in yuan, rounded to cents; unknown units count as yuan."""
    scale = F.lit(1.0)
    for name, by in SCALES.items():
        scale = F.when(F.regexp_replace(unit, r"(?U)\s+", "") == name, by).otherwise(scale)
    return half_up(value * scale, 2)


def printed(x: Column) -> Column:
    """A number as people read it: thousands apart, at most two decimals, rounded half up."""
    return F.call_function("format_number", F.round(x, 2), F.lit("#,##0.##"))


def amount_text(yuan: Column) -> Column:
    """An amount of yuan in the unit in which people read it."""
    size = F.abs(yuan)
    return F.when(size >= 1e8, F.concat(printed(yuan / 1e8), F.lit("亿元"))).when(size >= 1e6, F.concat(printed(yuan / 1e4), F.lit("万元"))).otherwise(F.concat(printed(yuan), F.lit("元")))


def amount_in(value: Column, unit: Column) -> Column:
    """An amount with its unit: per cents and amounts a share as they are, yuan in the unit in which people read them. A large amount said
    to be in tens of thousands, thousands or millions is yuan by mistake of the label. Null and other than finite values are a dash."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    own = F.concat(printed(value), u)
    known = (u == "") | (u == "元") | (u == "RMB") | u.contains("人民币")
    text = (
        F.when((u == "%") | u.contains("％"), F.concat(printed(value), F.lit("%"))).when(u.rlike("元/?股|每股"), F.concat(printed(value), F.lit("元/股")))
        .when(u.isin("百万元", "千元", "万元"), F.when(F.abs(value) >= 1e6, amount_text(value)).otherwise(own)).when(u.isin("亿元", "万亿元"), own).when(known, amount_text(value)).otherwise(own)
    )
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "—").otherwise(text)


def metric_amount(metric: Column, value: Column) -> Column:
    """A metric's value as cards show it: returns in per cent, earnings a share, and money; no money is none of the large unit."""
    unit = F.when(metric == "roe", "%").when(metric == "eps", "元/股").otherwise("元")
    return F.when((value == 0) & ~metric.isin("roe", "eps"), "0亿元").otherwise(amount_in(value, unit))


LONG_AMOUNT = r"((?:-?\d{1,3}(?:,\d{3})+|\d{7,})(?:\.\d+)?\s*元(?!/?股))"


def readable_amounts(text: Column) -> Column:
    """A text whose long amounts of yuan, from a million on, are in the unit in which people read them; others stay, and so do prices a share."""
    hits = F.regexp_extract_all(text, F.lit(LONG_AMOUNT), F.lit(1))
    said = F.transform(hits, lambda h: F.struct(h.alias("h"), F.regexp_replace(h, r"[,\s元]", "").try_cast("double").alias("n")))
    said = F.transform(said, lambda x: F.when(F.abs(x["n"]) >= 1e6, amount_text(x["n"])).otherwise(x["h"]))
    return F.array_join(F.zip_with(F.split(text, LONG_AMOUNT, -1), F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def floor_of(metric: Column) -> Column:
    out = F.lit(0.15)
    for k, v in FLOORS.items():
        out = F.when(metric == k, v).otherwise(out)
    return out


def within_tolerance(a: Column, b: Column, metric: Column) -> Column:
    """Whether two values agree to a hundredth, or to the metric's floor."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return F.coalesce(finite(a) & finite(b) & (F.abs(a - b) <= F.greatest(floor_of(metric), 0.01 * scale)), F.lit(False))


def candidates(value: Column) -> Column:
    """An amount in hundred millions under each unit it may have been written in."""
    return F.array(*[value * (s / HUNDRED_MILLION) for s in SCALES.values()])


def nearest_of(options: Column, wanted: Column) -> Column:
    """The option closest to a value, ties to the first."""
    place = F.transform(options, lambda x, i: F.struct(F.abs(x - wanted).alias("off"), i.alias("i"), x.alias("x")))
    return F.array_min(place)["x"]


def comparable(wanted: Column, value: Column, metric: Column) -> Column:
    """A stored value in the unit that brings it closest to a third party's; rates stay as they are."""
    return F.when(metric.isin("eps", "roe"), value).otherwise(nearest_of(candidates(value), wanted))


def folded(wanted: Column, q3: Column, h1: Column, metric: Column) -> Column:
    """The third quarter and the half year added, each in the unit that serves best."""
    sums = F.flatten(F.transform(candidates(q3), lambda a: F.transform(candidates(h1), lambda b: a + b)))
    return F.when(metric == "eps", q3 + h1).otherwise(nearest_of(sums, wanted))


def comparable_q3(wanted: Column, q3: Column, h1: Column, metric: Column) -> Column:
    """``converted, folded``: a third quarter as it is, or with the half year added where that fits and it alone does not."""
    alone, both = comparable(wanted, q3, metric), folded(wanted, q3, h1, metric)
    off, single = F.abs(alone - wanted), F.abs(alone - wanted) > F.greatest(F.abs(wanted) * 0.15, F.lit(0.5))
    may = ~within_tolerance(alone, wanted, metric) & metric.isin(*ADDITIVE) & finite(h1)
    fold = F.coalesce(may & (within_tolerance(both, wanted, metric) | ((F.abs(both - wanted) < off) & single)), F.lit(False))
    return F.struct(F.when(fold, both).otherwise(alone).alias("converted"), fold.alias("folded"))


def check_status(wanted: Column, value: Column, converted: Column, metric: Column) -> Column:
    """OK, BAD or MISS of a third party's value and ours."""
    return F.when(~finite(wanted) | ~finite(value), "MISS").when(within_tolerance(converted, wanted, metric), "OK").otherwise("BAD")


def sum_disclosed(parts: Sequence[Column]) -> Column:
    """The sum of the parts there are; null if there are none."""
    from brightledger.operators.aggregate import sum_disclosed as add

    return add(*parts)


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A setting within its bounds; the default where it is no number."""
    return F.when(finite(value), F.greatest(F.lit(low), F.least(F.lit(high), half_up(value, 0)))).otherwise(F.lit(default))
