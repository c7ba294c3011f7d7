"""What analysts open: lists of reports, peers, reconciliation with third parties, overviews and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions import finance, periods
from brightledger.operators.aggregate import nested
from brightledger.operators.rank import first_rows, held
from brightledger.operators.relate import union_first_wins

HEADLINE = ("revenue", "net_profit", "eps", "roe")
#: Weights of a filing's state when duplicates compete.
STATUS_WEIGHT = {"online": 6, "review": 5, "parse_partial": 4, "downloaded": 3, "downloading": 2, "discovered": 1}
ABSURD_PCT = 500


def keep_score(title: Column, core: Column, status: Column, parsed_at: Column) -> Column:
    """How much a filing deserves to stay among duplicates for its period."""
    weight = F.lit(0)
    for s, w in STATUS_WEIGHT.items():
        weight = F.when(status == s, w).otherwise(weight)
    full = F.when(periods.is_full_report(title), 1_000_000).otherwise(0)
    return full + core * 10_000 + weight * 1_000 + F.when(parsed_at.isNotNull(), 100).otherwise(0) + F.when(title.rlike("更正|修订"), 50).otherwise(0)


def duplicates(filings: DataFrame) -> DataFrame:
    """Filings (``id, code, title, status, published_at, parsed_at, core_count``) that a better one for code and period retires."""
    rows = filings.withColumn("period", periods.period_of(F.col("title"), F.col("published_at"))).filter("code IS NOT NULL")
    rows = rows.withColumn("score", keep_score(F.col("title"), F.col("core_count"), F.col("status"), F.col("parsed_at")))
    place = F.row_number().over(Window.partitionBy("code", "period").orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "id"))
    return rows.withColumn("place", place).filter("place > 1").drop("place")


def reports_with_metrics(reports: DataFrame, metrics: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Reports, and comparable prior ones where wanted, each once, with their metrics as a sorted array."""
    rows = reports if priors is None else union_first_wins([reports, priors], ["id"]).drop("branch")
    rows = rows.withColumn("period", periods.effective_period(F.col("title"), F.col("published_at"), F.col("period")))
    grouped = nested(metrics, ["id"], [c for c in metrics.columns if c != "id"], "metrics")
    return rows.join(grouped, "id", "left")


def peers(reports: DataFrame, wide: DataFrame) -> DataFrame:
    """Reports (``id, code, industry, period, published_at``) with growth, margin and rank among the newest of their industry."""
    newest = first_rows(reports, ["code", "period"], [F.desc("published_at"), "id"]).join(wide, "id")
    prior = newest.select("code", F.col("period").alias("prior_period"), F.col("revenue").alias("prior_revenue"))
    both = newest.withColumn("prior_period", periods.prior_year(F.col("period"))).join(prior, ["code", "prior_period"], "left")
    group = Window.partitionBy("industry", "period")
    growth = finance.yoy_pct(F.col("revenue"), F.col("prior_revenue"))
    ranked = F.when(F.col("revenue").isNotNull() & (F.count("revenue").over(group) >= 2), F.rank().over(group.orderBy(F.desc_nulls_last("revenue"))))
    return both.withColumn("revenue_growth", growth).withColumn("rank", ranked).withColumn("n_peers", F.count("revenue").over(group))


def reconcile(third: DataFrame, stored: DataFrame) -> DataFrame:
    """``code, period, metric, third_party, converted, folded, status`` for each third-party row and metric.

    ``third``: code, period and a column for each headline metric. ``stored``: code, period, metric, value. Periods of which
    nothing is stored are left out; Q2 stands for H1; a third quarter may be met by itself or with the half year added.
    """
    half = lambda c: F.regexp_replace(c, "Q2$", "H1")
    have = stored.withColumn("same", half(F.col("period"))).withColumn("exact", F.col("period") == F.col("same"))
    have = first_rows(have, ["code", "same", "metric"], [F.desc("exact"), F.desc("value")]).select("code", "same", "metric", "value")
    cells = third.select("code", "period", half(F.col("period")).alias("same"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("third_party")) for m in HEADLINE])).alias("c"))
    cells = cells.select("code", "period", "same", "c.*").join(have.select("code", "same").distinct(), ["code", "same"], "left_semi")
    h1 = have.filter(F.col("same").endswith("H1")).select("code", F.concat(F.substring("same", 1, 4), F.lit("Q3")).alias("same"), "metric", F.col("value").alias("h1"))
    both = cells.join(have, ["code", "same", "metric"], "left").join(h1, ["code", "same", "metric"], "left")
    w, v, m = F.col("third_party"), F.col("value"), F.col("metric")
    q3 = finance.comparable_q3(w, v, F.when(F.col("same").endswith("Q3"), F.col("h1")), m)
    both = both.withColumn("q3", q3)
    return both.select("code", "period", "metric", "third_party", F.when(w.isNotNull() & v.isNotNull(), F.col("q3.converted")).alias("converted"),
                       F.coalesce("q3.folded", F.lit(False)).alias("folded"), finance.check_status(w, v, F.col("q3.converted"), m).alias("status"))


def overview(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row for each code and period with a cell for each headline metric, its issues and whether someone must look.

    ``rows``: code, period, title, published_at, announcement_id, metric, value, source_page, prior_value, yoy_pct,
    confidence. A row is abnormal if it is flagged, if the title names another period, or if it has issues nobody acknowledged.
    """
    best = first_rows(rows, ["code", "period", "metric"], [F.desc_nulls_last("confidence"), "announcement_id"])
    cross = best.select("code", F.col("period").alias("__prior"), "metric", F.col("value").alias("cross_prior"))
    both = best.withColumn("__prior", periods.prior_year(F.col("period"))).join(cross, ["code", "__prior", "metric"], "left").drop("__prior")
    cell = finance.resolve_yoy(both, "y", F.col("value"), F.col("prior_value"), F.col("yoy_pct"), F.col("cross_prior"), F.col("metric"))
    pct = F.when(~F.col("y.na_percent"), F.col("y.pct"))
    issues = F.array_compact(F.array(F.when(F.col("source_page").isNull(), "no_page"), F.when(F.abs(pct) >= ABSURD_PCT, "absurd_yoy")))
    titled = periods.canonical_period(F.col("title"), F.col("published_at"))
    grouped = cell.withColumn("issues", issues).withColumn("titled", titled).groupBy("code", "period").agg(
        F.min_by("announcement_id", F.struct("announcement_id")).alias("announcement_id"), F.max(F.coalesce(F.col("titled") != F.col("period"), F.lit(False))).alias("period_mismatch"),
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in HEADLINE],
        F.array_distinct(F.flatten(F.collect_list("issues"))).alias("found"),
    )
    missing = F.when(sum([F.col(m).isNull().cast("int") for m in HEADLINE], F.lit(0)) > 0, F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    mismatch = F.when(F.col("period_mismatch"), F.array(F.lit("period_mismatch"))).otherwise(F.array().cast("array<string>"))
    all_issues = grouped.withColumn("issues", F.array_sort(F.concat(missing, mismatch, "found"))).drop("found")
    judged = all_issues.join(reviews.select("announcement_id", "status"), "announcement_id", "left")
    abnormal = (F.col("status") == "flagged") | F.col("period_mismatch") | ((F.size("issues") > 0) & ~F.coalesce(F.col("status") == "acked", F.lit(False)))
    return judged.withColumn("abnormal", F.coalesce(abnormal, F.lit(False)))


# How far a period is collected; a failed filing ranks last.
COLLECTED = {"parsed": 6, "parsed_partial": 5, "downloaded": 4, "discovered": 3, "expected": 2, "failed": 1}
MOST_PERIODS = 1000


def collected(status: Column, has_metrics: Column, complete: Column, has_file: Column) -> Column:
    """A filing's state of collection by its status, its metrics and its stored file."""
    done = status.isin("review", "online")
    return (
        F.when(status.isin("parse_parked", "parse_failed"), "failed").when(status == "parse_partial", "parsed_partial").when(done & has_metrics & ~complete, "parsed_partial")
        .when(has_metrics | done, "parsed").when(has_file | status.isin("downloaded", "parsing"), "downloaded").when(status != "", "discovered").otherwise("expected")
    )


def period_states(filings: DataFrame, calendar: DataFrame, companies: DataFrame) -> DataFrame:
    """``code, period, period_rank, state, status, id, is_latest``: the farthest state of a company's filings of each period, and what the
    calendar expects where there is no filing at all; the newest expected period is marked.

    ``filings`` have ``code, period, status, published_at, id`` and may have the flags ``has_metrics, complete, has_file``. Of equal states
    the filing published last goes first. Periods that are no tokens are left out. The calendar has ``MOST_PERIODS`` periods at most.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in filings.columns else F.lit(False)
    due = [(r["period"], r["period_rank"]) for r in calendar.select("period", "period_rank").limit(MOST_PERIODS + 1).collect()]
    if len(due) > MOST_PERIODS:
        raise ValueError(f"a calendar of more than {MOST_PERIODS} periods")
    state = collected(F.coalesce("status", F.lit("")), flag("has_metrics"), flag("complete"), flag("has_file"))
    rows = filings.filter(F.col("period").rlike("^20[0-9]{2}(FY|H1|Q[1-3])$")).select("code", "period", periods.rank_of(F.col("period")).alias("period_rank"), state.alias("state"), "status", "published_at", "id")
    weight = F.create_map(*[F.lit(x) for pair in COLLECTED.items() for x in pair])[F.col("state")]
    best = first_rows(rows, ["code", "period"], [F.desc(weight), F.desc_nulls_last("published_at"), "id"]).drop("published_at")
    expected = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(r).alias("period_rank")) for p, r in due]) if due else F.array().cast("array<struct<period: string, period_rank: int>>")
    absent = companies.select("code", F.inline(expected)).join(best.select("code", "period"), ["code", "period"], "left_anti")
    kinds = dict(best.dtypes)
    absent = absent.select("code", "period", F.col("period_rank").cast(kinds["period_rank"]), F.lit("expected").alias("state"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("status", "id")])
    newest = max(due, key=lambda d: d[1])[0] if due else None
    return best.unionByName(absent).withColumn("is_latest", F.coalesce(F.col("period") == F.lit(newest), F.lit(False)))


def readiness(reports: DataFrame, metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """How many reports are there, have all headline metrics, are indexed, and are ready: both."""
    core = metrics.filter(F.col("metric").isin(*HEADLINE)).groupBy("id").agg(F.count_distinct("metric").alias("core"))
    indexed = pages.select("id").distinct().withColumn("indexed", F.lit(True))
    both = reports.join(core, "id", "left").join(indexed, "id", "left")
    full, has = F.coalesce(F.col("core") == 4, F.lit(False)), F.coalesce("indexed", F.lit(False))
    return both.agg(F.count("*").alias("reports"), F.count_if(full).alias("complete"), F.count_if(has).alias("indexed"), F.count_if(full & has).alias("ready"))


def discover(found: DataFrame, known: DataFrame, companies: DataFrame, since: str, priority: dict[str, int]) -> DataFrame:
    """New filings of enabled companies: from the best source, each once by content and not there by id or source key."""
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", ""))
    rows = found.join(companies.filter("enabled").select("code"), "code", "left_semi").filter(F.col("published_at") >= F.lit(since).cast("timestamp"))
    rows = rows.filter(periods.is_full_report(F.col("title"))).withColumn("id", F.sha2(F.concat_ws("|", "code", F.date_format("published_at", "yyyy-MM-dd"), title), 256))
    rank = F.lit(len(priority))
    for s, n in priority.items():
        rank = F.when(F.col("source") == s, n).otherwise(rank)
    once = first_rows(rows.withColumn("__rank", rank), ["id"], ["__rank", "source_id"]).drop("__rank")
    # a generator holds the known ids: Spark else folds one constant id of all known rows into the condition and compares every row with every one
    ids = held(known.select("id"), id=F.col("id")).distinct()
    return once.join(ids, "id", "left_anti").join(known.select("source", "source_id"), ["source", "source_id"], "left_anti")


def flatten_filings(companies: DataFrame, since: str) -> DataFrame:
    """Companies with nested periods to a row a filing, of canonical periods from ``since`` on, newest first."""
    rows = companies.select("code", F.explode("periods").alias("p")).select("code", "p.*").filter(periods.is_canonical(F.col("period")))
    return rows.withColumn("period_rank", periods.rank_of(F.col("period"))).filter(F.col("period_rank") >= periods.rank_of(F.lit(since))).orderBy(F.desc("period_rank"), "code")


def parse_queue(filings: DataFrame) -> DataFrame:
    """Filings in the order in which they are parsed: asked for by hand, without an error, newest."""
    return filings.orderBy(F.desc(F.coalesce("parse_priority", F.lit(0))), F.col("parse_error").isNotNull(), F.desc_nulls_last("published_at"), "id")


def download_queue(filings: DataFrame) -> DataFrame:
    """Filings in the order in which they are fetched: discovered ones before those that failed, newest first."""
    return filings.orderBy(F.when(F.col("status") == "discovered", 0).otherwise(1), F.desc_nulls_last("published_at"), "id")


def verdict_queue(reports: DataFrame, asked: DataFrame, bulk: DataFrame, due: DataFrame, busy: DataFrame, n: int) -> DataFrame:
    """The next reports to judge: asked for, then in bulk in order of arrival, then due; each once, none that is being judged."""
    tiers = [t.select("id", "ordinal") for t in (asked, bulk, due)]
    return union_first_wins(tiers, ["id"], ["ordinal"]).join(reports.select("id"), "id", "left_semi").join(busy.select("id"), "id", "left_anti").orderBy("branch", "ordinal", "id").limit(n)


def home_order(cards: DataFrame, column: str | None, starred: DataFrame) -> DataFrame:
    """Cards by a column, largest first and missing last, starred ones before the rest; ties by code."""
    flagged = cards.join(starred.select("code", F.lit(True).alias("__star")), "code", "left")
    keys = [F.desc_nulls_last("__star")] + ([F.desc_nulls_last(column)] if column else []) + [F.col("code")]
    return flagged.orderBy(*keys).drop("__star")


def moves(changes: DataFrame, limit: float = 30) -> DataFrame:
    """Changes by size, large ones marked."""
    return changes.withColumn("large", F.abs("yoy_pct") >= limit).orderBy(F.desc_nulls_last(F.abs("yoy_pct")), "metric")


def by_name(cards: DataFrame, name: str = "name", key: str = "code") -> DataFrame:
    """Cards in the order of their Chinese names, by readings and not by code points; unnamed ones last."""
    return cards.orderBy(F.asc_nulls_last(F.collate(F.col(name), "zh")), key)
