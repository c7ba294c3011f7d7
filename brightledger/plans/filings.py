"""Queries of the filing functions: periods, changes, reconciliation, detectors, retrieval and event windows.

Filings are made of orders (their titles by turns of the order key), metrics of order and line totals by customer and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.functions import finance, periods, text
from brightledger.operators import aggregate, detectors, overview, retrieval
from brightledger.plans.registry import query
from brightledger.sources.tables import events_with_time, table
from brightledger.streaming import events as windows

TITLES = ("年度报告", "半年度报告", "第一季度报告", "第三季度报告", "年度报告摘要", "前三季度业绩预告", "季度报告", "年度报告问询函的回复公告", "年报信息披露制度")
_TITLE_SQL = "'公司：' || CAST(year(o_orderdate) AS VARCHAR) || '年' || [" + ", ".join(f"'{t}'" for t in TITLES) + f"][CAST(o_orderkey % {len(TITLES)} AS INTEGER) + 1]"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("o_orderkey") % len(TITLES) + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), F.concat(F.lit("公司："), F.year("o_orderdate").cast("string"), F.lit("年"), kind).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), "o_orderstatus", "o_orderpriority",
    )


@query(f"""WITH t AS (SELECT o_orderkey AS id, o_orderdate AS d, {_TITLE_SQL} AS t FROM orders),
 k AS (SELECT *, CASE WHEN regexp_matches(t, '问询函|业绩预') THEN 'other' WHEN regexp_matches(t, '半年度报告') THEN 'semiannual' WHEN regexp_matches(t, '季度报告') THEN 'quarterly'
   WHEN regexp_matches(t, '年度报告') THEN 'annual' ELSE 'other' END AS kind,
   CAST(year(d) AS VARCHAR) || CASE WHEN regexp_matches(t, '半年度') THEN 'H1' WHEN regexp_matches(t, '第一季度') THEN 'Q1' WHEN regexp_matches(t, '三季度') THEN 'Q3'
   WHEN regexp_matches(t, '季度报告') THEN CASE WHEN month(d) <= 5 THEN 'Q1' WHEN month(d) <= 9 THEN 'H1' ELSE 'Q3' END ELSE 'FY' END AS period FROM t)
SELECT id, kind, period, kind <> 'other' AND NOT regexp_matches(t, '摘要') AS is_full, CASE WHEN kind <> 'other' AND regexp_matches(period, '^20') THEN period END AS canonical,
 CASE WHEN regexp_matches(period, '^20') THEN CAST(substr(period, 1, 4) AS INTEGER) * 10 ELSE 0 END + CASE substr(period, 5) WHEN 'FY' THEN 4 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 1 END AS period_rank,
 CAST(CAST(substr(period, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(period, 5) AS prior FROM k""")
def period_tokens(spark, sf):
    """Kind, period and rank of each filing by its title."""
    return periods.described(_titled(spark, sf)).select("id", "kind", "period", "is_full", "canonical", "period_rank", "prior")


def _yearly(spark, sf) -> DataFrame:
    """Customer and year with metrics of both signs, and the year before's."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("gross"), F.sum("l_quantity").alias("units"))
    y = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("revenue"), F.sum("gross").alias("cost"), F.count("*").alias("n"), F.sum("units").alias("units"))
    y = y.withColumn("net_profit", F.col("revenue") - 300000)
    prior = y.select("code", (F.col("yr") + 1).alias("yr"), *[F.col(c).alias(f"prior_{c}") for c in ("revenue", "cost", "net_profit", "n", "units")])
    return y.join(prior, ["code", "yr"], "left")


_YEARS = """y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) - 300000 AS p FROM orders GROUP BY 1, 2),
 b AS (SELECT c.code, c.yr, c.p, q.p AS p0 FROM y c LEFT JOIN y q ON c.code = q.code AND q.yr = c.yr - 1)"""


@query(f"""WITH {_YEARS} SELECT code, yr, CASE WHEN p0 IS NULL THEN NULL WHEN p0 = 0 OR (p > 0 AND p0 < 0) OR (p < 0 AND p0 > 0) THEN 'qualitative' WHEN p = p0 THEN 'flat' ELSE 'pct' END AS kind,
 CASE WHEN p0 IS NULL OR p0 = 0 OR (p > 0 AND p0 < 0) OR (p < 0 AND p0 > 0) THEN NULL ELSE (p - p0) / abs(p0) * 100 END AS pct,
 CASE WHEN p0 IS NULL THEN 'neutral' WHEN p > 0 AND p0 < 0 THEN 'up' WHEN p < 0 AND p0 > 0 THEN 'down' WHEN p = p0 THEN 'neutral' WHEN p > p0 THEN 'up' ELSE 'down' END AS tone FROM b""")
def yoy_changes(spark, sf):
    """Changes between profits and losses, with what can be said of them."""
    rows = _yearly(spark, sf).select("code", "yr", finance.yoy(F.col("net_profit"), F.col("prior_net_profit")).alias("y"))
    return rows.select("code", "yr", F.col("y.kind").alias("kind"), F.col("y.pct").alias("pct"), finance.yoy_tone(F.col("y")).alias("tone"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey,
 CASE WHEN v IS NULL THEN 'MISS' WHEN abs(o_totalprice - v) <= greatest(0.05, 0.01 * greatest(abs(o_totalprice), abs(v), 1e-9)) THEN 'OK' ELSE 'BAD' END AS status FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def reconcile_tolerance(spark, sf):
    """Order totals against the sum of their lines."""
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left")
    return rows.select("o_orderkey", finance.check_status(F.col("o_totalprice"), F.col("v"), F.col("v"), F.lit("revenue")).alias("status"))


@query("""SELECT o_orderkey, list_sort(list_transform([1e-8, 1e-5, 1e-4, 1e-2, 1.0], lambda s: {'off': abs(o_totalprice * s - 1.5), 'v': o_totalprice * s}))[1].v AS converted FROM orders""")
def unit_candidates(spark, sf):
    """Amounts in the unit that brings them closest to a third party's 1.5 hundred million."""
    return table(spark, sf, "orders").select("o_orderkey", finance.comparable(F.lit(1.5), F.col("o_totalprice"), F.lit("revenue")).alias("converted"))


@query("""SELECT c_custkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS total FROM
 (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1.0 END AS b FROM customer)""")
def disclosed_sum(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", aggregate.sum_disclosed(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 == 0, 1.0)).alias("total"))


def _wide(spark, sf) -> DataFrame:
    y = _yearly(spark, sf)
    now = {"revenue": "revenue", "net_profit": "net_profit", "operating_cost": "cost", "operating_cash_flow": "cost * 0.1 - net_profit * 0.2", "total_assets": "revenue * 3", "total_liabilities": "cost * 2.4",
           "eps": "net_profit / n", "roe": "net_profit / revenue * 100", "profit_ex_non_recurring": "net_profit - units * 500", "cash_and_equivalents": "revenue * 0.7", "goodwill": "units * 300",
           "equity_parent": "revenue", "short_term_borrowings": "cost * 0.5", "restricted_cash": "units * 200"}
    prior = lambda e: " ".join("prior_" + w if w.isidentifier() else w for w in e.split(" "))
    columns = [F.expr(now[m]).cast("double").alias(m) if m in now else F.lit(None).cast("double").alias(m) for m in detectors.METRICS]
    columns += [F.expr(prior(now[m])).cast("double").alias(f"prior_{m}") if m in now else F.lit(None).cast("double").alias(f"prior_{m}") for m in detectors.METRICS]
    return y.select("code", "yr", *columns)


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS g FROM lineitem GROUP BY 1),
 y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS r, sum(g) AS c FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2),
 b AS (SELECT c.code, c.yr, c.r * 3 AS a, c.c * 2.4 AS d, q.r * 3 AS a0, q.c * 2.4 AS d0 FROM y c LEFT JOIN y q ON c.code = q.code AND q.yr = c.yr - 1),
 f AS (SELECT code, yr, d / a >= 0.7 AS high, coalesce((d / a - d0 / a0) * 100 >= 5, false) AS jumped, coalesce((d / a - d0 / a0) * 100 >= 8, false) AS far, a IS NOT NULL AND d IS NOT NULL AS enough FROM b)
SELECT code, yr, CASE WHEN NOT enough THEN 'insufficient' WHEN high OR jumped THEN 'card' ELSE 'none' END AS status,
 CASE WHEN NOT enough OR NOT (high OR jumped) THEN NULL WHEN jumped AND (NOT high OR far) THEN '资产负债率明显上升' ELSE '资产负债率处于较高水平' END AS title,
 CASE WHEN NOT enough OR NOT (high OR jumped) THEN NULL WHEN high AND jumped THEN 85 WHEN high THEN 82 ELSE 78 END AS priority FROM f""")
def debt_detector(spark, sf):
    return detectors.evaluated(_wide(spark, sf), ["code", "yr"], [detectors.debt_vs_assets]).select("code", "yr", "status", "title", "priority")


@query("""WITH y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS r FROM orders GROUP BY 1, 2),
 b AS (SELECT c.code, c.yr, c.r, q.r AS r0 FROM y c LEFT JOIN y q ON c.code = q.code AND q.yr = c.yr - 1),
 g AS (SELECT *, CASE WHEN r0 IS NULL OR r = r0 OR r = 300000 THEN 'insufficient' WHEN r > r0 AND (r - r0) / r0 >= 0.05 AND r0 <> 300000 AND sign(r - 300000) = sign(r0 - 300000) AND (r - r0) / abs(r0 - 300000) >= 0.05 THEN 'card' ELSE 'none' END AS status FROM b)
SELECT code, yr, status FROM g""")
def growth_detector(spark, sf):
    """Revenue against profit: here both move together, so a card says that both grow."""
    return detectors.evaluated(_wide(spark, sf), ["code", "yr"], [detectors.revenue_vs_profit]).select("code", "yr", "status")


#: Wide reports in SQL, with the year before's as r0, p0 and so on.
_B = """l AS (SELECT l_orderkey, sum(l_extendedprice) AS g, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
 y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS r, sum(g) AS c, count(*) AS n, sum(q) AS u, sum(o_totalprice) - 300000 AS p FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2),
 w AS (SELECT *, c * 0.1 - p * 0.2 AS cf, r * 3 AS a, c * 2.4 AS d, p / n AS eps, p / r * 100 AS roe, p - u * 500 AS ex, r * 0.7 AS cash, u * 300 AS gw, u * 200 AS rc, c * 0.5 AS sb FROM y),
 b AS (SELECT w.*, z.r AS r0, z.p AS p0, z.c AS c0, z.cf AS cf0, z.a AS a0, z.d AS d0, z.eps AS eps0, z.roe AS roe0 FROM w LEFT JOIN w z ON z.code = w.code AND z.yr = w.yr - 1)"""


def _pct_sql(x: str, x0: str) -> str:
    return f"CASE WHEN {x0} IS NULL OR {x0} = 0 OR ({x} > 0 AND {x0} < 0) OR ({x} < 0 AND {x0} > 0) THEN NULL ELSE ({x} - {x0}) / abs({x0}) * 100 END"


#: Each detector in SQL: id, theme, when there is enough to say, and rules of condition, title and priority.
_DROP = "((r0 - c0) / r0 - (r - c) / r) * 100"
_SCALE, _CHANGE = "(r - r0) * (p0 / r0)", "(p - p0)"
_MARGIN = f"({_CHANGE} - {_SCALE})"
_MOVED = f"({_CHANGE} <> 0 AND (p0 = 0 OR abs({_CHANGE}) / abs(p0) >= 0.05))"
_LEADS = f"(abs({_MARGIN}) >= abs({_SCALE}) * 1.15 AND abs({_MARGIN}) >= abs({_CHANGE}) * 0.4)"
_AGAINST = f"({_SCALE} <> 0 AND {_MARGIN} <> 0 AND sign({_SCALE}) <> sign({_MARGIN}))"
_JUMP, _OCF = "(d / a - d0 / a0) * 100", "(cf0 / r0 - cf / r) * 100"
_DETECTORS = (
    ("revenue_vs_profit", "growth", "r0 IS NOT NULL AND p0 IS NOT NULL AND r <> r0 AND p <> p0", (
        ("r > r0 AND p < p0", "收入增长没有转化为利润增长", "95"), ("r < r0 AND p > p0", "收入下滑但利润上升", "90"),
        (f"r > r0 AND p > p0 AND coalesce({_pct_sql('r', 'r0')}, 0) >= 5 AND coalesce({_pct_sql('p', 'p0')}, 0) >= 5", "收入与利润同步增长", "35"))),
    ("cash_vs_profit", "cash", "p IS NOT NULL AND cf IS NOT NULL", (
        ("p > 0 AND cf < 0", "账面盈利但经营现金流为负", "98"), ("cf0 IS NOT NULL AND p > p0 AND cf < cf0", "盈利与经营现金流走势分化", "92"), ("cf0 IS NOT NULL AND p < p0 AND cf > cf0", "利润下滑但经营现金流改善", "88"),
        ("cf0 IS NOT NULL AND coalesce((cf0 / p0 >= 0.8 AND cf / p < 0.5) OR cf0 / p0 - cf / p >= 0.5, false)", "经营现金流相对利润明显走弱", "88"), ("cf0 IS NOT NULL AND p > p0 AND cf > cf0", "利润增长伴随经营现金流改善", "40"),
        ("cf0 IS NULL AND cf / p < 0.5", "经营现金流相对利润偏弱", "82"))),
    ("ex_non_recurring", "earnings_quality", "p IS NOT NULL AND ex IS NOT NULL", (("p > 0 AND ex < 0", "扣非为负而归母为正", "94"), ("p > 0 AND (p - ex) / p >= 0.2", "非经常性损益占比偏高", "80 + least(12, floor((p - ex) / p * 20))"))),
    ("revenue_cost_margin", "growth", "c IS NOT NULL AND c0 IS NOT NULL AND r > 0 AND r0 > 0", (
        (f"{_DROP} >= 3", "毛利率明显收窄", f"78 + least(12, greatest(0, floor({_DROP} - 3)))"), ("c0 > 0 AND c / c0 - 1 > r / r0 - 1 + 0.03", "营业成本增速快于营收", f"78 + least(12, greatest(0, floor({_DROP} - 3)))"))),
    ("profit_bridge", "growth", "r0 IS NOT NULL AND p0 IS NOT NULL AND r > 0 AND r0 > 0", (
        (f"{_MOVED} AND {_CHANGE} < 0 AND {_MARGIN} < 0 AND ({_LEADS} OR {_AGAINST})", "利润下滑中利润率拖累更明显", "86"), (f"{_MOVED} AND {_CHANGE} > 0 AND {_MARGIN} < 0 AND {_AGAINST}", "规模扩大但利润率拖累利润", "84"),
        (f"{_MOVED} AND {_LEADS}", "利润变动更多来自利润率变化", "76"), (f"{_MOVED} AND ({_AGAINST} OR ({_CHANGE} < 0 AND {_MARGIN} < 0))", "规模与利润率对利润的贡献方向相反", "74"))),
    ("debt_vs_assets", "leverage", "a IS NOT NULL AND d IS NOT NULL AND a > 0", (
        (f"coalesce({_JUMP} >= 5, false) AND (d / a < 0.7 OR {_JUMP} >= 8)", "资产负债率明显上升", "CASE WHEN d / a >= 0.7 THEN 85 ELSE 78 END"),
        (f"d / a >= 0.7 OR coalesce({_JUMP} >= 5, false)", "资产负债率处于较高水平", f"CASE WHEN d / a >= 0.7 AND coalesce({_JUMP} >= 5, false) THEN 85 WHEN d / a >= 0.7 THEN 82 ELSE 78 END"))),
    ("restricted_cash", "liquidity", "rc IS NOT NULL AND cash > 0", (("rc / cash >= 0.3", "受限资金占比偏高", "70 + least(15, floor(rc / cash * 30))"),)),
    ("goodwill_vs_equity", "goodwill", "gw IS NOT NULL AND r > 0", (("gw / r >= 0.2", "商誉占净资产比例偏高", "72 + least(15, floor(gw / r * 30))"),)),
    ("assets_vs_revenue_growth", "expansion", "r0 IS NOT NULL AND r <> r0", ()),  # assets are three times revenue here, so both grow alike
    ("ocf_rate", "cash", "cf IS NOT NULL AND cf0 IS NOT NULL AND r > 0 AND r0 > 0", ((f"{_OCF} >= 3 OR (r > r0 AND {_OCF} > 0 AND {_OCF} >= 1.5)", "经营现金流率下降", f"CASE WHEN r > r0 AND {_OCF} > 0 THEN 84 ELSE 78 END"),)),
)


def _detectors_sql() -> str:
    out = []
    for i, (name, theme, enough, rules) in enumerate(_DETECTORS):
        pick = lambda k, rules=rules: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k] if k == 2 else repr(r[k])}" for r in rules) + " END" if rules else "NULL"
        out.append(f"SELECT code, yr, {i} AS ordinal, '{name}' AS id, '{theme}' AS theme, coalesce({enough}, false) AS enough, {pick(1)} AS title, CAST({pick(2)} AS INTEGER) AS priority FROM b")
    return f"WITH {_B}, e AS ({' UNION ALL '.join(out)})"


@query(f"""{_detectors_sql()}, t AS (SELECT * FROM e WHERE enough AND title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, yr, theme ORDER BY priority DESC, ordinal) = 1)
 SELECT code, yr, id, theme, title, priority FROM t QUALIFY row_number() OVER (PARTITION BY code, yr ORDER BY priority DESC, ordinal) <= 3""")
def relationship_cards(spark, sf):
    """The three cards shown of each report, by ten detectors."""
    return detectors.relationships(_wide(spark, sf), ["code", "yr"])[0].select("code", "yr", "id", "theme", "title", "priority")


@query(f"{_detectors_sql()} SELECT code, yr, CASE WHEN bool_or(enough AND title IS NOT NULL) THEN 'has_cards' WHEN bool_or(enough) THEN 'checked_none' ELSE 'insufficient' END AS status FROM e GROUP BY 1, 2")
def relationship_status(spark, sf):
    return detectors.relationships(_wide(spark, sf), ["code", "yr"])[1]


#: Texts of filings, in turns, and the dimension that each is met by.
_NOTICES = ("公司收到警示函。", "控股股东拟减持股份。", "本年度不派发现金红利。", "公司对外捐赠物资。", "有关诉讼影响较小。", "薪酬总额123456789万元。", "一切正常。")
_MET = (("admin_penalty", "行政处罚", 82), ("major_shareholder", "大股东变动", 72), ("dividend_change", "分红异动", 62), ("donation_outflow", "大额捐款", 58), ("soft_pedal_cues", "表述淡化", 55), ("unit_anomaly", "披露单位异常", 120))
_WATCHED = (
    ("non_recurring", "非经常性损益", "p > 0 AND ((p - ex) / p >= 0.2 OR ex < 0)", "80 + CASE WHEN ex < 0 THEN 10 ELSE 0 END + least(20, floor((p - ex) / greatest(p, 1) * 40))"),
    ("cash_vs_profit", "利润与现金流", "(p > 0 AND cf < 0) OR cf / p < 0.5", "CASE WHEN p > 0 AND cf < 0 THEN 100 ELSE 85 END"),
    ("cash_and_debt", "存贷双高", "cash / a >= 0.2 AND sb / a >= 0.2", "70"), ("goodwill_load", "商誉占比", "gw / r >= 0.2", "65"), ("restricted_cash", "资金受限", "rc / cash >= 0.3", "60"),
    ("short_debt_pressure", "短债压力", "sb > 0 AND cash < sb", "68"), ("margin_collapse", "增收不增利", f"r > r0 AND (p < p0 OR {_DROP} >= 3)", "75"), ("one_off_boost", "一次性抬升", "p > 0 AND (ex < 0 OR (p - ex) / p >= 0.2)", "78"),
)
_TEXT_SQL = " UNION ALL ".join(f"SELECT report, '{k}' AS id, '{t}' AS title, {s} AS severity, CAST(min(page) AS INTEGER) AS page FROM g WHERE m = {i} GROUP BY 1" for i, (k, t, s) in enumerate(_MET))
_NUMBER_SQL = " UNION ALL ".join(f"SELECT code || '-' || yr AS report, '{k}' AS id, '{t}' AS title, CAST({s} AS INTEGER) AS severity, CAST(NULL AS INTEGER) AS page FROM b WHERE coalesce({c}, false)" for k, t, c, s in _WATCHED)


@query(f"""WITH {_B}, g AS (SELECT o_custkey || '-' || CAST(year(o_orderdate) AS INTEGER) AS report, o_orderkey % 50 AS page, o_orderkey % {len(_NOTICES)} AS m FROM orders), h AS ({_NUMBER_SQL} UNION ALL {_TEXT_SQL}),
 s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY report ORDER BY severity DESC, id) <= 2)
 SELECT * FROM s UNION ALL SELECT code || '-' || yr, i, t, 0, NULL FROM b, (VALUES ('earnings_quality_scan', '盈利质量'), ('balance_sheet_scan', '资产负债')) v(i, t) WHERE code || '-' || yr NOT IN (SELECT report FROM s)""")
def watch_dimensions(spark, sf):
    """Numbers and all pages' texts: what to watch of each report."""
    reports = _wide(spark, sf).withColumn("report", F.concat_ws("-", "code", "yr"))
    notice = F.element_at(F.array(*[F.lit(n) for n in _NOTICES]), (F.col("id") % len(_NOTICES) + 1).cast("int"))
    pages = _titled(spark, sf).select(F.concat_ws("-", "code", F.year("published_at")).alias("report"), (F.col("id") % 50).cast("int").alias("page"), notice.alias("content"))
    return detectors.watch_cards(reports, pages, "report")


def _label_sql(x: str) -> str:
    """The words for a change, in SQL."""
    v, v0 = x, f"{x}0"
    size = f"printf('%.2f', abs(({v} - {v0}) / abs({v0}) * 100)) || '%'"
    return f"""CASE WHEN {v0} IS NULL THEN NULL WHEN {v0} = 0 THEN CASE WHEN {v} > 0 THEN '实现首次盈利' WHEN {v} = 0 THEN '无变化' ELSE '首次亏损' END WHEN {v} > 0 AND {v0} < 0 THEN '扭亏为盈' WHEN {v} < 0 AND {v0} > 0 THEN '由盈转亏'
      WHEN {v} = {v0} THEN '持平' WHEN {v} < 0 AND {v0} < 0 THEN CASE WHEN abs({v}) < abs({v0}) THEN '减亏 ' ELSE '增亏 ' END || {size} ELSE CASE WHEN {v} > {v0} THEN '同比增长 ' ELSE '同比下降 ' END || {size} END"""


_FINDINGS = " UNION ALL ".join([f"SELECT code, yr, {i} AS k, '{m}' AS id, {_label_sql(x)} AS text, coalesce({x} < {x}0, false) AS watch FROM b" for i, (m, x) in enumerate((("revenue", "r"), ("net_profit", "p"), ("eps", "eps"), ("roe", "roe")))] + [
    "SELECT code, yr, 4, 'cash', CASE WHEN p > 0 AND cf / p < 0.8 THEN printf('净现比 %.1f', cf / p * 100) || '%' END, true FROM b", "SELECT code, yr, 5, 'leverage', CASE WHEN a > 0 AND d / a >= 0.7 THEN printf('资产负债率 %.1f', d / a * 100) || '%' END, true FROM b"])


@query(f"""WITH {_B}, f AS ({_FINDINGS}), o AS (SELECT code, yr, row_number() OVER (PARTITION BY code, yr ORDER BY k) - 1 AS ordinal, id, text, watch FROM f WHERE text IS NOT NULL)
 SELECT *, row_number() OVER (PARTITION BY code, yr ORDER BY watch DESC, ordinal) AS place FROM o QUALIFY row_number() OVER (PARTITION BY code, yr ORDER BY watch DESC, ordinal) <= 3""")
def key_findings(spark, sf):
    found = detectors.key_findings(_wide(spark, sf), ["code", "yr"])
    return found.withColumns({c: F.col(c).cast("long") for c in ("ordinal", "place")})


@query(f"""WITH t AS (SELECT o_orderkey AS id, o_custkey AS code, o_orderdate AS d, {_TITLE_SQL} AS t FROM orders),
 k AS (SELECT *, CASE WHEN regexp_matches(t, '问询函|业绩预') THEN 'other' WHEN regexp_matches(t, '报告') THEN 'report' ELSE 'other' END AS kind, CAST(year(d) AS VARCHAR) || CASE WHEN regexp_matches(t, '半年度') THEN 'H1' WHEN regexp_matches(t, '第一季度') THEN 'Q1'
   WHEN regexp_matches(t, '三季度') THEN 'Q3' WHEN regexp_matches(t, '季度报告') THEN CASE WHEN month(d) <= 5 THEN 'Q1' WHEN month(d) <= 9 THEN 'H1' ELSE 'Q3' END ELSE 'FY' END AS period FROM t),
 s AS (SELECT *, CAST(CASE WHEN kind = 'report' AND NOT regexp_matches(t, '摘要') THEN 1000000 ELSE 0 END + id % 5 * 10000 + 6100 AS INTEGER) AS score FROM k)
 SELECT CAST(id AS VARCHAR) AS id, code, period, score FROM s QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY score DESC, d DESC, CAST(id AS VARCHAR)) > 1""")
def duplicate_filings(spark, sf):
    rows = _titled(spark, sf).select(F.col("id").cast("string").alias("id"), "code", "title", F.lit("online").alias("status"), "published_at", F.col("published_at").alias("parsed_at"), (F.col("id") % 5).cast("int").alias("core_count"))
    return overview.duplicates(rows).select("id", "code", "period", "score")


@query("""WITH y AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS r, sum(o_totalprice) - 300000 AS p FROM orders GROUP BY 1, 2),
 c AS (SELECT code, yr || 'FY' AS period, m AS metric, CASE m WHEN 'revenue' THEN CASE WHEN code % 5 <> 0 THEN r / 1e8 END WHEN 'eps' THEN p / 1e6 + 0.01 END AS third_party, CASE m WHEN 'revenue' THEN r / 1e8 WHEN 'eps' THEN p / 1e6 END AS v FROM y, (VALUES ('revenue'), ('net_profit'), ('eps'), ('roe')) t(m))
 SELECT code, period, metric, third_party, CASE WHEN third_party IS NOT NULL THEN v END AS converted, false AS folded, CASE WHEN third_party IS NULL OR v IS NULL THEN 'MISS' ELSE 'OK' END AS status FROM c""")
def third_party_check(spark, sf):
    """Totals against a third party that has some of them in other units and leaves some out."""
    y = _yearly(spark, sf).withColumn("period", F.concat(F.col("yr").cast("string"), F.lit("FY")))
    stored = y.select("code", "period", F.explode(F.array(F.struct(F.lit("revenue").alias("metric"), F.col("revenue").alias("value")), F.struct(F.lit("eps").alias("metric"), (F.col("net_profit") / 1e6).alias("value")))).alias("m")).select("code", "period", "m.*")
    third = y.select("code", "period", F.when(F.col("code") % 5 != 0, F.col("revenue") / 1e8).alias("revenue"), F.lit(None).alias("net_profit"), (F.col("net_profit") / 1e6 + 0.01).alias("eps"), F.lit(None).alias("roe"))
    return overview.reconcile(third, stored)


@query(f"""WITH {_B} SELECT code, yr || 'FY' AS period, r AS revenue, p AS net_profit, eps, concat_ws(',', CASE WHEN coalesce(abs({_pct_sql("r", "r0")}) >= 500, false) OR coalesce(abs({_pct_sql("p", "p0")}) >= 500, false) OR coalesce(abs({_pct_sql("eps", "eps0")}) >= 500, false) THEN 'absurd_yoy' END,
 'missing', CASE WHEN code % 9 = 0 THEN 'no_page' END) AS issues, NOT (code % 4 = 0 AND code % 8 <> 0) AS abnormal FROM b""")
def metric_overview(spark, sf):
    y = _yearly(spark, sf).withColumn("period", F.concat(F.col("yr").cast("string"), F.lit("FY"))).withColumn("announcement_id", F.concat_ws("-", "code", "period"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in (("revenue", "revenue"), ("net_profit", "net_profit"), ("eps", "net_profit / n"))])
    rows = y.select("code", "period", "announcement_id", F.concat(F.col("yr").cast("string"), F.lit("年年度报告")).alias("title"), F.to_timestamp(F.concat(F.col("yr").cast("string"), F.lit("-12-31"))).alias("published_at"), F.explode(cells).alias("m"),
                    F.when(F.col("code") % 9 != 0, 3).alias("source_page"), F.lit(None).cast("double").alias("prior_value"), F.lit(None).cast("double").alias("yoy_pct"), F.lit(0.9).alias("confidence"))
    rows = rows.select("code", "period", "announcement_id", "title", "published_at", "m.*", "source_page", "prior_value", "yoy_pct", "confidence")
    reviews = y.filter("code % 4 = 0").select("announcement_id", F.when(F.col("code") % 8 == 0, "flagged").otherwise("acked").alias("status"))
    return overview.overview(rows, reviews).select("code", "period", "revenue", "net_profit", "eps", F.array_join("issues", ",").alias("issues"), "abnormal")


_QUESTION = "the tion onnt 2026 eps"
_TERMS = "SELECT doc_id, lang, " + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in (("the", 1), ("tion", 1), ("onnt", 1), ("2026", 1), ("eps", 1), ("eps ", 0))) + " + CASE WHEN contains(lower(text), 'eps') THEN 8 ELSE 0 END AS score FROM documents"


@query(f"SELECT doc_id, lang, CAST(score AS INTEGER) AS score FROM ({_TERMS}) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 12")
def keyword_rank(spark, sf):
    pages = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("page"), F.col("text").alias("content"))
    return retrieval.rank_pages(pages, _QUESTION, ["lang"]).select(F.col("page").alias("doc_id"), "lang", "score")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 200)) AS st FROM documents WHERE length(text) > 400),
 r AS (SELECT doc_id, st, substr(text, CAST(st AS INTEGER) + 1, 400) AS w FROM s),
 q AS (SELECT *, CASE WHEN contains(lower(w), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(w), 'idiot') THEN 1 ELSE 0 END AS sc FROM r)
SELECT doc_id, sha256(w) AS h FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, st) = 1 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE length(text) <= 400""")
def best_excerpt(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(retrieval.excerpt("the idiot", F.col("text"), 400), 256).alias("h"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS clipped FROM documents""")
def clipped_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    return windows.tumbling_counts(events_with_time(spark, sf)).withColumn("start", _ntz("start"))


@query("""SELECT b - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type FROM events), range(0, 2) t(k) GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    return windows.tumbling_counts(events_with_time(spark, sf), "1 hour", slide="30 minutes").withColumn("start", _ntz("start"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    return windows.sessions(events_with_time(spark, sf)).withColumn("start", _ntz("start"))


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


@query("""SELECT source, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality = 0) AS wrong,
 count(*) FILTER (WHERE quality = 1) > 0 AND count(*) FILTER (WHERE quality = 0) > 0 AS disputed FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def vote_tally(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return aggregate.votes(rows.withColumn("verdict", F.when(F.col("quality") == 1, "correct").otherwise("wrong")), ["source"])


@query("""SELECT doc_id, sha256(doc_id || '|' || source || '|' || lower(regexp_replace(text, '[\\s\\x0B]+', '', 'g'))) AS id FROM documents""")
def logical_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source", text.normal_title(F.col("text"))), 256).alias("id"))
