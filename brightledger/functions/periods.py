"""Reporting periods: what a filing's title says of its kind and period, and the calendar of what is expected.

A period is a token such as 2026Q1, 2026H1, 2026Q3 or 2026FY; Q2 stands for H1. Functions take and return Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words by which titles are classified.
NOT_A_REPORT = "可转债|可转换公司债券|转换公司债券|公司债券|债券募集|募集说明书|配股说明书|增发|非公开发行"
MEETING = "业绩说明会|投资者说明会|主要经营数据|经营数据公告|H股公告|责任追究|管理办法|资本管理|第三支柱"
FORECAST = "业绩预[告增减盈亏]|业绩预$|业绩快报|盈利预告|亏损预告"
LETTER = "问询函|关注函|说明函|监管函|回函"
OPINION = "独立意见|专项说明|核查意见|自查报告"
REPLY, REPORT = "的回复|回复公告|回复函", "年度报告|(?<!半)年报|半年度报告|半年报|中期报告|季度报告|季报"
SEMIANNUAL = "半年度报告|半年报|中期报告"
QUARTERLY = "第[一二两三123]季度报告|[一二三]季度报告|[一二三]季报|Q[1-3]报告|季度报告"
ABSTRACT = "摘要|取消|英文版|业绩预|业绩快报"
YEAR_BEFORE = r"(20\d{2})\s*(?:半年度|半年报|中期报告|第[一二三两123]季度|[一二三]季度|[一二三]季报|Q[1-3]|年度报告|(?<!半)年报)"
CORPORATION = "股份有限公司"


def compact(title: Column) -> Column:
    """A title without white space of any alphabet; null is empty."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", "")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def year_of(title: Column, published: Column) -> Column:
    """The year a title names, else that of publication, as text."""
    text = F.coalesce(title, F.lit(""))
    named = F.coalesce(_found(text, r"(?U)(20\d{2})\s*年"), _found(text, "(?U)" + YEAR_BEFORE))
    return F.coalesce(named, F.date_format(published, "yyyy"))


def report_type(title: Column) -> Column:
    """annual, semiannual, quarterly or other; what only speaks of reports is other."""
    t = compact(title)
    other = t.rlike(NOT_A_REPORT) | t.rlike(MEETING) | t.rlike(FORECAST) | t.rlike(LETTER) | t.rlike(OPINION) | (t.rlike(REPLY) & t.rlike(REPORT))
    annual = t.rlike("年度报告") | (t.rlike("(?<!半)年报") & ~t.rlike("信息披露|制度"))
    return F.when(other, "other").when(t.rlike(SEMIANNUAL), "semiannual").when(t.rlike(QUARTERLY), "quarterly").when(annual, "annual").otherwise("other")


def is_full_report(title: Column) -> Column:
    """Whether a title names a whole report: no abstract, forecast, letter or the like."""
    t = compact(title)
    return ~t.rlike(ABSTRACT) & ~t.rlike(f"{LETTER}|独立意见|专项说明|核查意见") & (report_type(title) != "other")


def period_of(title: Column, published: Column) -> Column:
    """The period of a report by its title; a quarter without a number follows the month of publication."""
    t, month = compact(title), F.month(published)
    unnumbered = F.when(month <= 5, "Q1").when(month <= 9, "H1").otherwise("Q3")
    suffix = (
        F.when(t.rlike("半年度|中期报告|第[二两2]季度|二季度|二季报|Q2"), "H1")
        .when(t.rlike("第[一1]季度|一季度|一季报|Q1"), "Q1")
        .when(t.rlike("第[三3]季度|三季度|三季报|Q3"), "Q3")
        .when(t.rlike("季度报告|季报"), unnumbered)
        .otherwise("FY")
    )
    return F.concat(year_of(title, published), suffix)


def is_canonical(period: Column) -> Column:
    return F.coalesce(period.rlike(r"^20\d{2}(FY|H1|Q[1-3])$"), F.lit(False))


def canonical_period(title: Column, published: Column) -> Column:
    """The period of a real report, null for other titles."""
    period = period_of(title, published)
    return F.when((report_type(title) != "other") & is_canonical(period), period)


def effective_period(title: Column, published: Column, stored: Column) -> Column:
    """The title's period, which overrides the stored one."""
    return F.coalesce(canonical_period(title, published), stored)


def described(filings: DataFrame, title: str = "title", published: str = "published_at") -> DataFrame:
    """Adds ``kind, period, is_full, canonical, period_rank, prior`` of each filing; the title is classified once."""
    t, at, kind, period = F.col(title), F.col(published), F.col("kind"), F.col("period")
    once = filings.withColumns({"kind": report_type(t), "period": period_of(t, at)})
    whole = (kind != "other") & ~compact(t).rlike(ABSTRACT)  # what is_full_report leaves out besides is of another kind already
    return once.withColumns({"is_full": whole, "canonical": F.when((kind != "other") & is_canonical(period), period), "period_rank": rank_of(period), "prior": prior_year(period)})


def kind_of(period: Column) -> Column:
    """The report type of a period token."""
    return F.when(period.contains("FY"), "annual").when(period.rlike("H1|Q2"), "semiannual").when(period.rlike("Q[13]"), "quarterly")


def rank_of(period: Column) -> Column:
    """year * 10 + 1 to 4: the order of periods; 0 for the part that is missing."""
    year = F.coalesce(F.regexp_extract(period, r"(20\d{2})", 1).try_cast("int"), F.lit(0))
    quarter = F.when(period.contains("FY"), 4).when(period.rlike("H1|Q2"), 2).when(period.contains("Q3"), 3).when(period.contains("Q1"), 1).otherwise(0)
    return year * 10 + quarter


def prior_year(period: Column) -> Column:
    """The same period a year before."""
    year = F.substring(period, 1, 4).try_cast("int")
    return F.concat((year - 1).cast("string"), F.substring(period, 5, 10))


def names_own_issuer(company: Column, title: Column) -> Column:
    """False where a title names another corporation as issuer."""
    t, name = compact(title), compact(company)
    issuer = _found(t, f"：([^：]+?{CORPORATION})")
    core = F.regexp_replace(issuer, f"{CORPORATION}$", "")
    own = F.regexp_replace(name, f"{CORPORATION}|集团有限公司|有限公司|集团|控股$", "")
    near = issuer.contains(own) | name.contains(core) | core.contains(own) | own.contains(core)
    return issuer.isNull() | (own == "") | near


def latest_expected(today: Column) -> Column:
    """The newest period that should be filed on a day."""
    year, month = F.year(today), F.month(today)
    return (
        F.when(month >= 11, F.concat(year.cast("string"), F.lit("Q3")))
        .when(month >= 9, F.concat(year.cast("string"), F.lit("H1")))
        .when(month >= 5, F.concat(year.cast("string"), F.lit("Q1")))
        .otherwise(F.concat((year - 1).cast("string"), F.lit("FY")))
    )


def expected_periods(spark: SparkSession, today: str, since: str = "2025Q1") -> DataFrame:
    """``period, period_rank``: all periods from ``since`` to the newest expected one, in order."""
    day = F.lit(today).cast("date")
    years = spark.range(1).select(F.explode(F.sequence(F.lit(int(since[:4])), F.year(day))).alias("y"))
    every = years.select(F.explode(F.array(*[F.concat(F.col("y").cast("string"), F.lit(s)) for s in ("Q1", "H1", "Q3", "FY")])).alias("period"))
    ranked = every.withColumn("period_rank", rank_of(F.col("period")))
    return ranked.filter((F.col("period_rank") >= rank_of(F.lit(since))) & (F.col("period_rank") <= rank_of(latest_expected(day))))


def freshness(at: Column, now: Column) -> Column:
    """Minutes, hours or days since an instant, minutes rounded and none below 0; without one that nothing was fetched yet."""
    minutes = F.greatest(F.lit(0), F.floor(F.timestamp_diff("MICROSECOND", at, now) / 60e6 + 0.5))
    said = F.when(minutes < 60, F.format_string("%d 分钟前", minutes)).when(minutes < 1440, F.format_string("%d 小时前", F.floor(minutes / 60)))
    return F.when(at.isNull(), "尚未抓取").otherwise(said.otherwise(F.format_string("%d 天前", F.floor(minutes / 1440))))


def updated_today(at: Column, now: Column) -> Column:
    return F.coalesce(F.date_trunc("day", at) == F.date_trunc("day", now), F.lit(False))


def updated_this_week(at: Column, now: Column) -> Column:
    """Whether an instant is no more than seven days ago, the seventh included."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", at, now) <= 7 * 86400 * 1_000_000, F.lit(False))


def download_wait(index: Column, pause_s: Column, gate_s: Column, failed_s: Column, slots_full: Column, automatic: Column, backoff_s: int = 30) -> Column:
    """``seconds, reason`` of a queued download: the larger of what is left of a failure's pause and of the gate, and a pause for each
    before it. failed_s: seconds since it failed, null if it did not. Nothing waits a known time while downloads are off or, but for
    failed ones, all slots are taken; no seconds where it can begin at once."""
    failed, first = failed_s.isNotNull(), index == 0
    pause = F.greatest(F.lit(1), F.floor(pause_s + 0.5))
    left = F.greatest(F.lit(0), F.ceil(backoff_s - F.coalesce(failed_s, F.lit(float(backoff_s)))))
    wait = F.greatest(left, F.greatest(F.lit(0.0), gate_s)) + index * pause
    seconds, place = F.when(wait > 0, wait).cast("double"), F.format_string("排队第 %d 位", index + 1)
    shown = F.regexp_replace(wait.cast("string"), r"\.0$", "")
    reason = (
        F.when(~automatic, "自动抓取已关：排队任务暂不开始下载").when(slots_full & ~failed, F.when(first, "等待下载槽空闲").otherwise(place))
        .when(failed, F.when(wait > 0, F.concat(F.lit("上次失败，"), shown, F.lit("s 后重试"))).otherwise("上次失败，即将重试"))
        .otherwise(F.when(wait > 0, F.concat(F.lit("约 "), shown, F.lit("s 后可下载"))).when(first, "即将领取").otherwise(place))
    )
    return F.struct(F.when(automatic & (~slots_full | failed), seconds).alias("seconds"), reason.alias("reason"))


# How a kind of report is asked for, in the order in which it is looked for, and the period's ending.
KINDS = (
    (r"(?i)半年报|半年度|中报|(?<![A-Za-z0-9])H1(?![A-Za-z0-9])", "H1"), (r"(?i)三季报|第三季度|(?<![A-Za-z0-9])Q3(?![A-Za-z0-9])", "Q3"), (r"(?i)一季报|第一季度|(?<![A-Za-z0-9])Q1(?![A-Za-z0-9])", "Q1"),
    (r"(?i)二季报|第二季度|(?<![A-Za-z0-9])Q2(?![A-Za-z0-9])", "Q2"), ("季报|季度", ""), (r"(?i)年度报告|(?<![半中])年报|(?<![A-Za-z0-9])FY(?![A-Za-z0-9])", "FY"),
)
YEAR, SHORT_YEAR, BARE_YEAR = r"(20\d{2})\s*年", r"(?:^|[^\d])(\d{2})\s*年", r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"


def period_hint(question: Column, today: Column) -> Column:
    """The period a free text asks for: a token as such, or a year (four digits with 年, two digits, four alone, this, last, the one before)
    and a kind; a quarter without its number is no period."""
    token = F.upper(F.regexp_extract(question, r"(?i)(20\d{2}(?:FY|H1|Q[1-3]))", 1))
    this, short = F.year(today), F.regexp_extract(question, SHORT_YEAR, 1).try_cast("int")
    year = F.coalesce(
        F.regexp_extract(question, YEAR, 1).try_cast("int"), F.when(short >= 80, short + 1900).otherwise(short + 2000), F.regexp_extract(question, BARE_YEAR, 1).try_cast("int"),
        F.when(question.contains("今年"), this).when(question.contains("去年"), this - 1).when(question.contains("前年"), this - 2),
    )
    kind = F.lit(None).cast("string")
    for pattern, ending in reversed(KINDS):
        kind = F.when(question.rlike(pattern), F.lit(ending or None)).otherwise(kind)
    return F.coalesce(F.nullif(token, F.lit("")), F.concat(year.cast("string"), kind))


def matches_hint(period: Column, hint: Column) -> Column:
    """Whether a period is the one asked for; Q2 accepts H1."""
    half = lambda c: F.regexp_replace(c, "Q2$", "H1")
    return half(period) == half(hint)
