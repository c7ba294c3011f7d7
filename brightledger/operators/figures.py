"""Metrics out of the table lines of page texts: a label, the period's figure, and what stands in the columns after it.

One expression finds all labels on a page in one pass, and everything after is arithmetic on the few cells behind each label:

* the text is mended where lines break inside amounts, and blanks between Chinese characters go;
* footnote marks and period stubs before the figure go, a unit in the label beats one on the figure, and that the page's;
* of the next three cells it is told whether they are a prior value and its change, a change alone (with or without a per cent sign)
  before the figure of the year to date, or a prior value before and after restatement.

Everything stays in Columns: pages are read once, and only lines with labels are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions.finance import to_yuan
from brightledger.operators.rank import held

# The labels under which metrics are disclosed in order of preference; unit and least and largest absolute value.
LABELS = {
    "revenue": (("营业总收入", "营业收入"), "元", 1e3, 1e15),
    "net_profit": (
        ("归属于上市公司普通股股东的净利润", "归属于上市公司股东的净利润", "归属于母公司所有者的净利润", "归属于母公司股东的净利润", "归属于本行股东的净利润", "归属于本公司股东的净利润"),
        "元", 1, 1e15,
    ),
    "eps": (("基本每股收益", "基本和稀释每股收益", "基本/稀释每股收益"), "元/股", 0, 1e3),
    "roe": (
        ("归属于本行普通股股东的加权平均净资产收益率", "归属于本公司普通股股东的加权平均净资产收益率", "加权平均净资产收益率", "加权平均净资产收益", "净资产收益率（加权平均）", "净资产收益率"),
        "%", 0, 1e3,
    ),
    "total_assets": (("资产总计", "资产总额", "总资产"), "元", 1e3, 1e16),
    "total_liabilities": (("负债合计", "负债总额"), "元", 1e3, 1e16),
    "operating_cash_flow": (("经营活动产生的现金流量净额", "经营活动现金流量净额"), "元", 0, 1e16),
    "operating_cost": (("营业成本",), "元", 1e3, 1e16),
    "non_recurring_pnl": (("非经常性损益合计", "非经常性损益净额", "非经常性损益"), "元", 0, 1e15),
    "profit_ex_non_recurring": (
        (
            "扣除非经常性损益后归属于母公司所有者的净利润", "扣除非经常性损益后归属于母公司股东的净利润", "扣除非经常性损益后归属于上市公司普通股股东的净利润",
            "扣除非经常性损益后归属于上市公司股东的净利润", "扣除非经常性损益后归属于本公司股东的净利润", "扣除非经常性损益后归属于本行股东的净利润", "扣除非经常性损益后的净利润",
            "归属于上市公司普通股股东的扣除非经常性损益的净利润", "归属于上市公司股东的扣除非经常性损益的净利润", "归属于母公司股东的扣除非经常性损益的净利润",
            "归属于本行股东的扣除非经常性损益的净利润", "扣非后归属于上市公司股东的净利润", "扣非后归属于母公司股东的净利润", "扣非后归属于本行股东的净利润",
        ),
        "元", 0, 1e15,
    ),
    "cash_and_equivalents": (("货币资金",), "元", 0, 1e16),
    "restricted_cash": (("受限货币资金", "使用受限的货币资金", "受限制的货币资金"), "元", 0, 1e16),
    "short_term_borrowings": (("短期借款",), "元", 0, 1e16),
    "long_term_borrowings": (("长期借款",), "元", 0, 1e16),
    "bonds_payable": (("应付债券",), "元", 0, 1e16),
    "current_portion_debt": (("一年内到期的非流动负债",), "元", 0, 1e16),
    "goodwill": (("商誉",), "元", 0, 1e16),
    "equity_parent": (("归属于母公司股东的权益", "归属于母公司所有者权益", "归属于上市公司股东的净资产", "归属于本公司股东权益合计"), "元", 0, 1e16),
}
# What may not stand before a metric's label, as there the words belong to another line, and how far back that is looked for.
NOT_BEFORE = {"non_recurring_pnl": "扣除$", "net_profit": "扣除非经常性损益后$|扣非后$", "roe": "扣除非经常性损益|扣非后$", "eps": "扣除非经常性损益|扣非后$"}
LOOK_BACK = 36
# Pages with tables of key figures, pages that explain changes, and the statements in which metrics stand.
SUMMARY = "主要会计数据|主要财务指标|主要财务比率|报告摘要|财务摘要"
EXPLAINS = r"发生变动的情况|变动的情况[、,，]?原因|项目名称[\s\S]{0,48}变动比例"
CONTINUED = "基本每股收益|稀释每股收益|加权平均净资产收益率|总资产|归属于上市公司股东的所有者权益"
STATEMENTS = {
    "资产负债表": ("total_assets", "total_liabilities", "cash_and_equivalents", "restricted_cash", "short_term_borrowings", "long_term_borrowings", "bonds_payable", "current_portion_debt", "goodwill", "equity_parent"),
    "现金流量表": ("operating_cash_flow",),
    f"非经常性损益|{SUMMARY}|利润表": ("non_recurring_pnl", "profit_ex_non_recurring"),
}
OTHER_STATEMENT = "利润表"
# Words before a per cent figure that make it a change and not a return on equity.
CHANGE_WORDS, CHANGE_NEAR = "同比|较上年|增减|变动|变化|百分点|说明|注释", "同比|较上年|增减|增加|减少|上升|下降|提高|降低"
UNIT = "亿元|百万元|万元|千元|元"
LARGE = UNIT.removesuffix("|元")
#: Characters behind a label that are looked at, and pages that count as the front of a report.
REACH, FRONT = 220, 30
SPACE = r"[\s\x{A0}\x{3000}]"
FIGURE = r"-?\d+(?:\.\d+)?"
#: A cell: a figure, perhaps in brackets, perhaps with a per cent sign.
CELL = rf"(?:\(?\s*{FIGURE}\s*(?:%\s*\)|\)\s*%|\)|%)?)"
TOLERANCE, SHARE = 0.15, 0.002


def mended(content: Column) -> Column:
    """A page's text on one line: amounts broken over lines are joined where their commas leave no doubt."""
    text = F.coalesce(content, F.lit(""))
    for pattern, by in ((r"(\d),?\r?\n\s*,(\d)", "$1,$2"), (r"(\d),\r?\n\s*(\d)", "$1,$2"), (r"(,\d{1,2})\r?\n\s*(\d)", "$1$2"), (r"(?m)(^|[\s（(])-\r?\n\s*(?=\d)", "$1-")):
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, rf"{SPACE}+", " ")
    return F.trim(F.regexp_replace(text, r"([一-龥]) (?=[一-龥])", "$1"))


def first_of(text: Column, *patterns: str) -> Column:
    """What the first of the patterns that matches captures; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def stated_unit(text: Column) -> Column:
    """The unit of money that a page states for its tables, if any; a note on yuan beside a figure is no such statement."""
    return first_of(text, rf"单位\s*[：:]\s*(?:人民币\s*)?({UNIT})", rf"[（(]\s*人民币\s*({LARGE})", rf"人民币\s*({LARGE})(?!\s*元)")


def page_unit(text: Column) -> Column:
    return F.coalesce(stated_unit(text), F.lit("元"))


def _label_table() -> dict[str, tuple[str, int]]:
    return {label: (metric, i) for metric, (labels, *_) in LABELS.items() for i, label in enumerate(labels)}


def _tree(words: list[str]) -> str:
    """An expression for any of the words, longer ones first, that looks at each character once."""
    branches: dict[str, list[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    some = "|".join(c + _tree(rest) for c, rest in branches.items())
    return f"(?:{some})?" if "" in words and some else f"(?:{some})" if some else ""


def _patterns() -> tuple[str, str]:
    """A label at any place, also inside another: one expression captures it with what follows, one what stands before it in texts that
    begin with as many blanks."""
    label = _tree(list(_label_table()))
    return rf"(?s)(?=({label}.{{0,{REACH}}}))", rf"(?s)(?={label})(?<=(.{{{LOOK_BACK}}}))"


def label_hits(pages: DataFrame, report: str) -> DataFrame:
    """A row for each label on a page with the text behind it and what the page is."""
    known = _label_table()
    rows = held(pages.select(report, "page", "content"), text=mended(F.col("content"))).drop("content")
    explains, summary = F.col("text").rlike(EXPLAINS), F.col("text").rlike(SUMMARY)
    statements = [F.when(F.col("text").rlike(p), F.lit(p)) for p in (*STATEMENTS, OTHER_STATEMENT)]
    rows = rows.select(
        report, "page", stated_unit(F.col("text")).alias("page_unit"), explains.alias("explains"), (summary & ~explains).alias("summary"),
        F.substring("text", 1, 600).rlike(CONTINUED).alias("continues"), F.array_compact(F.array(*statements)).alias("statements"),
        F.arrays_zip(*[F.regexp_extract_all(F.concat(F.lit(" " * LOOK_BACK), "text"), F.lit(p), F.lit(1)).alias(n) for p, n in zip(_patterns(), ("hit", "before"), strict=True)]).alias("hits"),
    )
    before = Window.partitionBy(report).orderBy("page")
    follows = (F.lag("page").over(before) == F.col("page") - 1) & F.lag("summary").over(before)
    rows = rows.withColumn("summary", F.col("summary") | (F.coalesce(follows, F.lit(False)) & ~F.col("explains") & F.col("continues")))
    hits = rows.select(report, "page", "page_unit", "explains", "summary", "statements", F.posexplode("hits").alias("place", "hits"))  # pages without hits go
    every = "|".join(sorted(known, key=len, reverse=True))
    hits = held(hits.select("*", "hits.*").drop("hits"), label=F.regexp_extract("hit", f"^({every})", 1))
    within = F.array("label")  # labels that begin with another label of their metric are hits of that one, too
    for a, (metric, _) in known.items():
        if shorter := [b for b, (m, _) in known.items() if m == metric and a != b and a.startswith(b)]:
            within = F.when(F.col("label") == a, F.array(F.col("label"), *[F.lit(b) for b in shorter])).otherwise(within)
    hits = hits.withColumn("label", F.explode(within))
    place_of = F.create_map(*[x for label, (metric, i) in known.items() for x in (F.lit(label), F.struct(F.lit(metric).alias("metric"), F.lit(i).alias("label_index")))])
    hits = hits.withColumn("of", place_of[F.col("label")]).withColumn("behind", F.substring(F.col("hit"), F.length("label") + 1, F.lit(REACH)))
    hits = hits.select(*[c for c in hits.columns if c not in ("of", "hit")], "of.metric", "of.label_index")
    metric, behind = F.col("metric"), F.col("behind")
    taken = F.lit(False)
    for m, p in NOT_BEFORE.items():
        taken = F.when(metric == m, F.col("before").rlike(p)).otherwise(taken)
    wrong = (
        F.when(taken, True).when(metric == "non_recurring_pnl", behind.startswith("后"))
        .when(metric == "net_profit", False)
        .when(metric == "roe", behind.rlike(r"^\s*[（(]?\s*全面摊薄|^\s*[（(]?\s*摊薄\s*[)）]") | ((F.col("label") == "加权平均净资产收益") & behind.startswith("率")))
        .otherwise(F.substring(behind, 1, 40).rlike(r"[_\-]\s*(?:本报告期|年初至报告期末)"))
    )
    return hits.filter(~wrong).drop("before")


def cell(raw: Column) -> Column:
    """``n, percent`` of a cell's text: brackets around a figure make it negative; null for none."""
    n = F.translate(raw, "()% ", "").try_cast("double")
    n = F.when(raw.contains("(") & raw.contains(")"), -F.abs(n)).otherwise(n)
    return F.struct(n.alias("n"), raw.contains("%").alias("percent"))


def ytd_follows(now: Column, bare: Column, then: Column) -> Column:
    """Whether a figure without a per cent sign is the change, as the year to date follows it: that is no smaller than about the
    period's figure, and the change is too small for a prior value, or for small figures does not resemble one."""
    a, b, c = F.abs(now), F.abs(bare), F.abs(then)
    money = (c >= 1000) & (c >= a * 0.5) & (b < a * 0.5)
    like_prior = (a > 0) & (F.abs(b - a) / a <= 0.08)
    short = (c < a * 0.85) & ~((b <= 100) & (c > b * 2))
    ratio = c / a
    small = ~like_prior & ~short & ((b > c) | (ratio.between(1.0, 5.0) & (b <= 100)) | (c > b * 2))
    return (b < 1000) & F.when(a >= 1000, money).otherwise(F.coalesce(small, F.lit(False)))


def told(now: Column, x: Column, y: Column, z: Column) -> Column:
    """``prior, change`` from the three cells behind a figure."""
    plain = lambda c: c["n"].isNotNull() & ~c["percent"]
    off = lambda base: F.abs((now - base["n"]) / F.abs(base["n"]) * 100 - z["n"]) <= TOLERANCE + F.abs(z["n"]) * SHARE
    fits = lambda base: F.when(base["n"] != 0, off(base)).otherwise(False)
    pair = lambda prior, change: F.struct(prior.cast("double").alias("prior"), change.cast("double").alias("change"))
    none = F.lit(None)
    return (
        F.when(x["percent"] & x["n"].isNotNull(), pair(none, x["n"]))
        .when(plain(x) & plain(y) & ytd_follows(now, x["n"], y["n"]), pair(none, x["n"]))
        .when(plain(x) & plain(y) & z["n"].isNotNull() & z["percent"], pair(F.when(fits(x), x["n"]).otherwise(y["n"]), z["n"]))
        .when(plain(x) & plain(y) & plain(z) & (F.abs(z["n"]) < 1000) & fits(y), pair(y["n"], z["n"]))
        .when(plain(x) & plain(y) & plain(z) & (F.abs(z["n"]) < 1000) & fits(x), pair(x["n"], z["n"]))
        .otherwise(pair(x["n"], F.when(y["percent"], y["n"])))
    )


def told_return(now: Column, x: Column, y: Column, z: Column, rest: Column) -> Column:
    """The same for a return on equity, whose prior is a level in per cent; rest: the text behind the first cell."""
    pair = lambda prior, change: F.struct(prior.cast("double").alias("prior"), change.cast("double").alias("change"))
    points, most = F.abs(now - y["n"]), LABELS["roe"][3]
    restated = (F.abs(points - F.abs(z["n"])) <= 0.05 + points * 0.001) & (F.abs(z["n"]) <= 80) & (F.abs(x["n"]) <= most) & (F.abs(y["n"]) <= most)
    ytd = (F.abs(y["n"]) >= F.abs(now) * 0.5) & (F.abs(x["n"]) < F.abs(now)) & (F.abs(x["n"]) <= 50)
    in_points = rest.rlike(r"^\s*个百分点") | (F.abs(x["n"]) > most)
    worded = F.substring(rest, 1, 24).rlike("百分点|同比|增减|较上年")
    return (
        F.when(restated, pair(y["n"], F.lit(None))).when(ytd | in_points, pair(F.lit(None), F.lit(None)))
        .otherwise(pair(x["n"], F.when(~worded & y["percent"], y["n"])))
    )


def parts(near: Column, lead: str) -> Column:
    """The figure behind ``lead``, the unit beside it, the next cell, what follows that, and two more cells; of one element without match."""
    cells = rf"\s*({CELL})?(?=(.{{0,40}}))\s*({CELL})?\s*({CELL})?.*$"
    return F.split(F.regexp_replace(near, f"(?s)^{lead}{cells}", "$1\t$2\t$3\t$4\t$5\t$6"), "\t", -1)


def candidates(pages: DataFrame, report: str) -> DataFrame:
    """``metric, value, unit, page, source_label, prior_value, yoy_pct, score`` for every label that figures follow."""
    rows = label_hits(pages, report)
    limits = F.create_map(*[x for m, (_, unit, least, most) in LABELS.items() for x in (F.lit(m), F.struct(F.lit(unit).alias("unit"), F.lit(float(least)).alias("least"), F.lit(float(most)).alias("most")))])
    near = F.translate("behind", "（）％．,，", "()%.")
    near = F.regexp_replace(near, r"^(?:\s*(?:20\d{2}|19\d{2})\s*年(?:\s*\d{1,2}\s*[-–—至到]\s*\d{1,2}\s*月)?)+", " ")
    rows = held(rows.withColumn("limits", limits[F.col("metric")]), near=near).drop("behind")
    money = F.col("limits.unit") == "元"
    own = first_of(F.substring("near", 1, 48), rf"^\s*\(\s*(?:人民币\s*)?({UNIT})\s*\)", rf"^\s*[：:]\s*(?:人民币\s*)?({UNIT})(?!\s*/)")
    marks = F.col("near")  # notes on the unit and marks of footnotes
    for pattern in (r"\(\s*(?:人民币\s*)?元(?:\s*/?\s*股)?\s*\)", r"\(\s*[1-9]\d{0,2}\s*\)", rf"(?:^|\s)([1-9]\d{{0,2}})(?=\s+{FIGURE})"):
        marks = F.regexp_replace(marks, pattern, " ")
    unit_off = F.regexp_replace("near", rf"^\s*\(\s*(?:人民币\s*)?(?:{UNIT})\s*\)", " ")
    rows = held(rows, own=F.when(money, own), near=F.when(money, unit_off).otherwise(marks))
    # three readings of where the figure is; the last is for all metrics, the others for returns on equity
    change = rf"(?<!(?:{CHANGE_WORDS})\s{{0,20}})(?<!(?:{CHANGE_NEAR})[^。；;\n]{{0,16}})"
    in_label = parts(F.col("near"), rf"\s*(?:\(%\)|%)(?!\d)\s*({CELL})()")
    a_percent = parts(F.col("near"), rf".*?{change}(?:(?=-)|(?<![\d.\-]))({FIGURE}\s*%)()")
    anywhere = parts(F.col("near"), rf".*?(\(?\s*{FIGURE}\s*\)?)\s*(%|亿元|百万元|万元|千元|元/股|元)?")
    rows = held(rows, parts=F.when(F.col("metric") != "roe", anywhere).otherwise(in_label), reading=F.when(F.col("metric") == "roe", 1).otherwise(3))
    for n, other in ((2, a_percent), (3, anywhere)):
        none = (F.col("reading") < 3) & (F.size("parts") == 1)
        rows = held(rows, parts=F.when(none, other).otherwise(F.col("parts")), reading=F.when(none, n).otherwise(F.col("reading")))
    part = lambda i: F.get("parts", F.lit(i))
    rows = rows.filter("size(parts) > 1")
    beside = F.when(F.col("reading") == 3, F.nullif(part(1), F.lit(""))).otherwise("%")
    rows = held(rows, now=cell(part(0))["n"], beside=beside, x=cell(part(2)), y=cell(part(4)), z=cell(part(5)), rest=part(3)).drop("parts")
    three = [F.col(c) for c in "xyz"]
    both = F.when(F.col("reading") == 3, told(F.col("now"), *three)).otherwise(told_return(F.col("now"), *three, F.col("rest")))
    money_unit = lambda c: F.when(F.col(c).isin(*UNIT.split("|")), F.col(c))
    scale = F.coalesce("own", money_unit("beside"), money_unit("page_unit"), F.lit("元"))
    rows = held(rows, told=both, scale=scale)
    sized = lambda c: F.when(F.col("limits.unit") == "元", to_yuan(c, F.col("scale"))).otherwise(c)
    within = lambda c, least: F.abs(c).between(least, F.col("limits.most"))
    rows = held(rows, value=sized(F.col("now")), prior=sized(F.col("told.prior")), change=F.col("told.change"))
    rows = rows.filter(within(F.col("value"), F.col("limits.least")))
    prior = F.when((F.col("reading") < 3) | within(F.col("prior"), F.col("limits.least")), F.col("prior"))
    own_statement = F.lit(OTHER_STATEMENT)
    for p, of in STATEMENTS.items():
        own_statement = F.when(F.col("metric").isin(*of), F.lit(p)).otherwise(own_statement)
    stated = F.array_contains("statements", own_statement) & ~F.col("explains") & (F.col("metric") != "roe")
    add = lambda when, points: F.when(when, points).otherwise(0.0)
    score = (
        F.lit(0.68) + add(F.col("summary"), 0.14) + add(F.col("summary") & F.col("metric").isin("eps", "roe"), 0.06) + add(stated, 0.08)
        + add(F.col("own").isNotNull() | F.col("beside").isNotNull() | F.col("page_unit").isNotNull(), 0.06) + add(F.col("page") <= FRONT, 0.03)
        + add(F.col("label_index") == 0, 0.03) - add(F.col("explains"), 0.25)
    )
    return rows.select(
        report, "page", "metric", "value", "limits.unit", F.col("label").alias("source_label"), prior.alias("prior_value"), F.col("change").alias("yoy_pct"),
        F.round(score, 6).alias("score"), "label_index", "place",
    )


def choose(found: DataFrame, report: str) -> DataFrame:
    """One value for each report and metric: the best score, then one with a prior value or a change, then the first place.

    Values that agree to a thousandth raise confidence and the first of them lend change and prior value; a change is never paired
    with another place's prior value. A rival of almost the same score lowers confidence.
    """
    keys, place = [report, "metric"], ["page", "label_index", "place"]
    silent = F.when(F.col("yoy_pct").isNotNull() | F.col("prior_value").isNotNull(), 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), silent, *place)
    best = F.first(F.struct("value", "unit", "page", "source_label", "yoy_pct", "prior_value", "score")).over(order)
    both, value = found.withColumn("best", best), F.col("best.value")
    agrees = F.abs(F.col("value") - value) <= F.greatest(F.lit(0.0001), F.abs(value) * 0.001)
    rival = (F.col("value") != value) & (F.col("score") >= F.round(F.col("best.score") - 0.16, 6))
    lent = lambda c: F.when(agrees & F.col(c).isNotNull(), F.struct(*place))
    told_of = both.groupBy(*keys).agg(
        F.first("best").alias("best"), F.sum(agrees.cast("int")).alias("agreeing"), F.max(rival).alias("conflict"),
        F.min_by(F.struct("yoy_pct", "prior_value"), lent("yoy_pct")).alias("with_yoy"), F.min_by("prior_value", lent("prior_value")).alias("with_prior"),
    )
    raw = F.col("best.score") + F.when(F.col("agreeing") > 1, 0.05).otherwise(0) - F.when(F.col("conflict"), 0.12).otherwise(0)
    return told_of.select(
        *keys, "best.value", "best.unit", F.col("best.page").alias("source_page"), "best.source_label",
        F.coalesce("with_yoy.yoy_pct", "best.yoy_pct").alias("yoy_pct"),
        F.when(F.col("with_yoy.yoy_pct").isNotNull(), F.col("with_yoy.prior_value")).otherwise(F.coalesce("with_prior", "best.prior_value")).alias("prior_value"),
        F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.96), raw)), 2).alias("confidence"),
    )


def metrics(pages: DataFrame, report: str) -> DataFrame:
    """Page texts (``page`` from 1, ``content``) to one row for each report and metric; null texts have no lines."""
    return choose(candidates(pages, report), report)
