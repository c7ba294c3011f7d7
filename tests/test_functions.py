"""Functions of periods, changes and texts on literal rows."""

import pytest
from pyspark.sql import functions as F

from brightledger.functions import finance, periods, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("title", "kind", "period", "full"),
    [
        ("某公司2026年年度报告", "annual", "2026FY", True), ("某公司2026 年半年度报告", "semiannual", "2026H1", True), ("某公司2026年第一季度报告", "quarterly", "2026Q1", True),
        ("2026年三季报", "quarterly", "2026Q3", True), ("2026年第二季度报告", "quarterly", "2026H1", True), ("2026年季度报告", "quarterly", "2026H1", True),
        ("2026年年度报告摘要", "annual", "2026FY", False), ("关于2026年年度报告问询函的回复", "other", "2026FY", False), ("2026年前三季度业绩预告", "other", "2026Q3", False),
        ("2026　年　半年报", "semiannual", "2026FY", True), ("年报信息披露管理制度", "other", "2026FY", False), ("", "other", "2026FY", False),
    ],
)
def test_titles(spark, title, kind, period, full):
    t, at = F.lit(title), F.lit("2026-08-20").cast("timestamp")
    r = one(spark, kind=periods.report_type(t), period=periods.period_of(t, at), full=periods.is_full_report(t), canonical=periods.canonical_period(t, at))
    assert (r.kind, r.period, r.full) == (kind, period, full)
    assert r.canonical == (None if kind == "other" else period)


def test_calendar(spark):
    found = [r.period for r in periods.expected_periods(spark, "2026-09-10").orderBy("period_rank").collect()]
    assert found == ["2025Q1", "2025H1", "2025Q3", "2025FY", "2026Q1", "2026H1"]
    r = one(spark, a=periods.rank_of(F.lit("2026Q2")), b=periods.rank_of(F.lit("2026H1")), c=periods.prior_year(F.lit("2026Q3")), d=periods.kind_of(F.lit("2026FY")))
    assert (r.a, r.b, r.c, r.d) == (20262, 20262, "2025Q3", "annual")


@pytest.mark.parametrize(
    ("question", "hint"),
    [("2025Q3的营收", "2025Q3"), ("去年年报", "2025FY"), ("今年半年报", "2026H1"), ("25年一季报", "2025Q1"), ("前年中报", "2024H1"), ("营收", None)],
)
def test_hints(spark, question, hint):
    assert one(spark, h=periods.period_hint(F.lit(question), F.lit("2026-05-01").cast("date"))).h == hint


def test_issuer(spark):
    t = F.lit("中国平安：平安银行股份有限公司2026年年度报告")
    r = one(spark, a=periods.names_own_issuer(F.lit("平安银行"), t), b=periods.names_own_issuer(F.lit("万科"), t), c=periods.names_own_issuer(F.lit("万科"), F.lit("年报")))
    assert (r.a, r.b, r.c) == (True, False, True)


@pytest.mark.parametrize(
    ("current", "prior", "kind", "pct", "label", "tone"),
    [
        (120.0, 100.0, "pct", 20.0, "同比增长 20.00%", "up"), (80.0, 100.0, "pct", -20.0, "同比下降 20.00%", "down"), (100.0, 100.0, "flat", 0.0, "持平", "neutral"),
        (5.0, 0.0, "qualitative", None, "实现首次盈利", "up"), (-5.0, 0.0, "qualitative", None, "首次亏损", "down"), (0.0, 0.0, "qualitative", None, "无变化", "neutral"),
        (5.0, -5.0, "qualitative", None, "扭亏为盈", "up"), (-5.0, 5.0, "qualitative", None, "由盈转亏", "down"),
        (-5.0, -10.0, "pct", 50.0, "减亏 50.00%", "up"), (-15.0, -10.0, "pct", -50.0, "增亏 50.00%", "down"), (0.0, 10.0, "pct", -100.0, "同比下降 100.00%", "down"),
    ],
)
def test_yoy(spark, current, prior, kind, pct, label, tone):
    y = finance.yoy(F.lit(current), F.lit(prior))
    r = spark.range(1).select(y.alias("y")).select("y.*", finance.yoy_tone(F.col("y")).alias("tone")).first()
    assert (r.kind, r.pct, r.label, r.tone) == (kind, pct, label, tone) and r.absolute_delta == current - prior


def test_yoy_of_nothing(spark):
    r = one(spark, a=finance.yoy(F.lit(None).cast("double"), F.lit(1.0)), b=finance.yoy(F.lit(float("nan")), F.lit(1.0)), c=finance.yoy(F.lit(1.0), F.lit(float("inf"))))
    assert r.a is None and r.b is None and r.c is None
    y = finance.yoy(F.lit(None).cast("double"), F.lit(1.0))
    assert one(spark, b=finance.yoy_badge(y)).b == "暂无同比"


def test_signs(spark):
    """Changing both signs changes a percentage's sign; a gain and the loss of the same size mirror each other."""
    rows = spark.createDataFrame([(float(a), float(b)) for a in (-9, -3, 2, 8) for b in (-4, 5, 7)], "a double, b double")
    rows = rows.select("a", "b", finance.yoy_pct(F.col("a"), F.col("b")).alias("x"), finance.yoy_pct(-F.col("a"), -F.col("b")).alias("y"))
    assert all((r.x is None) == (r.y is None) and (r.x is None or abs(r.x + r.y) < 1e-9) for r in rows.collect())


def resolved(spark, c, p, y, x, metric="revenue"):
    values = [None if v is None else float(v) for v in (c, p, y, x)]
    rows = spark.createDataFrame([(*values, metric)], "c double, p double, y double, x double, m string")
    return finance.resolve_yoy(rows, "r", *[F.col(k) for k in "cpyxm"]).first().r


def test_best_evidence(spark):
    r = resolved(spark, 120, 100, 19.5, 90)
    assert (r.pct, r.source) == (19.5, "disclosed")
    assert resolved(spark, 120, 100, None, 90).pct == pytest.approx(20) and resolved(spark, 120, None, None, 100).source == "computed"
    assert resolved(spark, 5e8, 3.78, None, None).pct == 3.78  # a percentage that was read as an amount
    assert resolved(spark, 13.79, 1.3, None, None, "roe").label == "上升 12.49 个百分点"
    assert resolved(spark, 5, -5, 200, None).label == "扭亏为盈" and resolved(spark, None, 1, 1, 1) is None and resolved(spark, 1, None, None, None) is None


def test_ratios(spark):
    d = lambda v: F.lit(v).cast("double")
    r = one(spark, a=finance.debt_ratio(d(60), d(100)), b=finance.debt_ratio(d(60), d(0)), c=finance.gross_margin(d(100), d(70)), d=finance.cash_conversion(d(5), d(-1)),
            e=finance.profit_bridge(d(200), d(100), d(30), d(10)), f=finance.implied_prior(d(120), d(20)), g=finance.to_yuan(d(1.005), F.lit("万元")), h=finance.half_up(d(-2.5), 0))
    assert (r.a, r.b, r.c, r.d, r.f, r.g, r.h) == (60, None, 30, None, 100, 10050, -2)
    assert (r.e.from_revenue, r.e.from_margin) == (10, 10)


def test_third_party(spark):
    d = lambda v: F.lit(v).cast("double")
    m = F.lit("revenue")
    r = one(spark, a=finance.comparable(d(12), d(1.2e9), m), b=finance.comparable(d(12), d(12), m), c=finance.comparable_q3(d(30), d(10e8), d(20e8), m),
            d=finance.comparable_q3(d(30), d(30e8), d(20e8), m), e=finance.within_tolerance(d(100), d(100.9), m), f=finance.within_tolerance(d(1), d(1.14), F.lit("roe")),
            g=finance.check_status(d(None), d(1), d(1), m), h=finance.comparable_q3(d(30), d(10), d(20), F.lit("roe")))
    assert (r.a, r.b, r.e, r.f, r.g) == (12, 12, True, True, "MISS")
    assert r.c.folded and r.c.converted == 30 and not r.d.folded and not r.h.folded


def test_texts(spark):
    s = F.lit
    r = one(spark, a=text.clip(s("一二三四五"), 4), b=text.industry_of(s("某某银行股份有限公司")), c=text.name_variants(s("贵州茅台酒股份有限公司")), d=text.chinese_number(s("一千零二十三")),
            e=text.chinese_number(s("十五")), f=text.unwrap_json(s('<think>x</think>```json\n{"a":1}\n```')), g=text.cited(s("甲【E2】乙【E1】丙【E2】")), h=text.attention(s("关于更正公告的补充")),
            i=text.page_citations(s("甲【E2】乙【E9】"), F.create_map(s("2"), s(7))), j=text.error_text(s("Error: PDF 503")), m=text.without_noise(s("请问茅台的财报怎么样？")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("一二三…", "银行", ["贵州茅台酒股份有限公司", "贵州茅台酒"], 1023, 15)
    assert (r.f, r.g, r.h, r.i, r.j, r.m) == ('{"a":1}', ["2", "1"], ["更正", "补充"], "甲[P7]乙", "PDF 请求失败（503）", "请问茅台的")
    v = one(spark, v=text.parse_verdict(s('{"summary": "好", "confidence": 7, "points": [{"title": "t", "text": "x", "page": 1}, {"title": "", "text": "y"}]}')), n=text.parse_verdict(s('{"summary": " "}')))
    assert v.v.summary == "好" and v.v.confidence == 1 and len(v.v.points) == 1 and v.n is None
    a = lambda *x: F.array(*map(s, x))
    assert one(spark, m=text.merge_texts(a("A b", "c"), a("a B!", "d", "e"), a("C"))).m == ["A b", "d", "e"]


def test_names(spark):
    companies = spark.createDataFrame([("600519", "贵州茅台"), ("000001", "平安银行"), ("601318", "中国平安")], "code string, name string")
    aliases = spark.createDataFrame([("国酒", "贵州茅台")], "alias string, name string")
    asked = spark.createDataFrame([("600519怎么样",), ("茅台",), ("平安银行",), ("平安",), ("看中国平安年报",), ("国酒",), ("无名",)], "query string")
    got = {r["query"]: (r.code, r.stage) for r in text.match_names(asked, companies, aliases).collect()}
    assert got == {"600519怎么样": ("600519", 1), "茅台": ("600519", 3), "平安银行": ("000001", 2), "平安": ("601318", 3), "看中国平安年报": ("601318", 2), "国酒": ("600519", 3)}


def test_waits(spark):
    wait = lambda i, pause, gate, ago, full=False, auto=True: periods.download_wait(F.lit(i), F.lit(pause), F.lit(gate), F.lit(ago).cast("double"), F.lit(full), F.lit(auto))
    r = one(spark, a=wait(0, 8.0, 10.0, 10.0), b=wait(2, 0.2, 0.0, None), c=wait(0, 8.0, -3.0, None), d=wait(0, 8.0, 0.0, None, True), e=wait(1, 8.0, 0.0, None, True), f=wait(0, 8.0, 0.0, 40.0, True), g=wait(0, 8.0, 5.0, None, False, False))
    assert [tuple(x) for x in r] == [
        (20.0, "上次失败，20s 后重试"), (2.0, "约 2s 后可下载"), (None, "即将领取"), (None, "等待下载槽空闲"), (None, "排队第 2 位"), (None, "上次失败，即将重试"), (None, "自动抓取已关：排队任务暂不开始下载"),
    ]


def test_freshness(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    now = t("2024-03-08 12:00:00")
    r = one(
        spark, a=periods.freshness(t("2024-03-08 11:58:31"), now), b=periods.freshness(t("2024-03-08 11:58:29"), now), c=periods.freshness(t("2024-03-08 13:00:00"), now), d=periods.freshness(t(None), now),
        e=periods.freshness(t("2024-03-08 11:00:30"), now), f=periods.updated_this_week(t("2024-03-01 12:00:00"), now), g=periods.updated_this_week(t("2024-03-01 11:59:59"), now), h=periods.updated_today(t(None), now),
    )
    assert tuple(r) == ("1 分钟前", "2 分钟前", "0 分钟前", "尚未抓取", "1 小时前", True, False, False)


def test_hints(spark):
    asked = {"2025年H1": "2025H1", "25年二季报": "2025Q2", "季报": None, "今年季报": None, "2024年半年报": "2024H1", "83年年报": "1983FY", "2024 年报": "2024FY", "x2026q1": "2026Q1", "去年FY": "2025FY", None: None}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", periods.period_hint(F.col("q"), F.lit("2026-05-01").cast("date")).alias("h")).collect()
    assert {r["q"]: r["h"] for r in rows} == asked


def test_amounts(spark):
    said = {(32483000000, "元"): "324.83亿元", (90703260964.48, "元"): "907.03亿元", (100, "元"): "100元", (12.5, "元/股"): "12.5元/股", (15.2, "%"): "15.2%", (-1234000000, "元"): "-12.34亿元",
            (1234567.0, "百万元"): "123.46万元", (12.0, "百万元"): "12百万元", (5.5, "亿元"): "5.5亿元", (1999.999, None): "2,000元", (3.0, "倍"): "3倍", (None, "元"): "—", (float("nan"), "元"): "—", (1.005, "每股"): "1.01元/股"}
    rows = spark.createDataFrame([(i, None if v is None else float(v), u) for i, (v, u) in enumerate(said)], "i int, v double, u string")
    assert [r["t"] for r in rows.orderBy("i").select(finance.amount_in(F.col("v"), F.col("u")).alias("t")).collect()] == list(said.values())
    m = lambda k, v: finance.metric_amount(F.lit(k), F.lit(v))
    assert tuple(one(spark, a=m("revenue", 32483000000.0), b=m("eps", 1.25), c=m("goodwill", 0.0), d=m("roe", 0.0))) == ("324.83亿元", "1.25元/股", "0亿元", "0%")
    t = lambda x: finance.readable_amounts(F.lit(x))
    got = one(spark, a=t("平安银行营业收入：32483000000元【E1】，132483000000元。"), b=t("营收约100元"), c=t("金额 32,483,000,000 元"), d=t("每股 12345678元/股，1,234 元"), e=t(None))
    assert tuple(got) == ("平安银行营业收入：324.83亿元【E1】，1,324.83亿元。", "营收约100元", "金额 324.83亿元", "每股 12345678元/股，1,234 元", None)


def test_questions(spark):
    asked = {"2024年贵州茅台营收增长多少？": ("贵州茅台", True), "平安银行": ("平安银行", False), "600519": ("600519", False), "三一重工（600031）怎么样": ("三一重工 600031", True), "看看这家公司过去几个阶段里": ("看看这家公司过去几个阶段里", True), "": ("", False)}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", text.without_noise(F.col("q")).alias("s"), text.asks(F.col("q")).alias("a")).collect()
    assert {r["q"]: (r["s"], r["a"]) for r in rows} == asked


def test_chinese_numbers(spark):
    said = {"八": 8, "十": 10, "十二": 12, "二十": 20, "一零五": 105, "二三": 23, "〇": 0, "一百一": 110, "一百零一": 101, "一千二": 1200, "一千零二十三": 1023, "九千九百九十九": 9999, "百": None, "零百": None, "２３": 23, "12": 12,
            "12345": None, "一二三四五": None, "甲": None, "": None, None: None, "两百五十": 250, "九千九百九十九十": None}
    rows = spark.createDataFrame([(k,) for k in said], "q string").select("q", text.chinese_number(F.col("q")).alias("n")).collect()
    assert {r["q"]: r["n"] for r in rows} == said
