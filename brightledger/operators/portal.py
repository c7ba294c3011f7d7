"""Pages of the portal: filters of its lists, the period on display, timelines, claims, rosters and one-line conclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions import finance, periods, text
from brightledger.operators.overview import HEADLINE
from brightledger.operators.rank import first_rows
from brightledger.operators.relate import any_contains, older_than

#: Exchanges and the common portal, as sources of filings.
SOURCES = ("SSE", "SZSE", "BSE", "CNINFO")
PARSED = ("parsed", "parsed_partial")
#: How far a state goes when no period is parsed.
STATE_ORDER = {"downloaded": 40, "discovered": 30, "failed": 20, "expected": 10}


def company_history(reports: DataFrame, metrics: DataFrame, suffix: str, n: int) -> DataFrame:
    """Of each company the ``n`` reports that have metrics, those of a period with the suffix first, then newest.

    An empty suffix fits every period. Reports are ``id, code, status, published_at``, metrics ``id, period``.
    """
    fits = metrics.groupBy("id").agg(F.max(F.col("period").endswith(suffix)).alias("fits"))
    rows = reports.filter("status <> 'auto_skipped'").join(fits, "id")
    return first_rows(rows, ["code"], [F.desc("fits"), F.desc_nulls_last("published_at"), "id"], n)


def home_cards(cards: DataFrame, columns: Sequence[str], codes: Sequence[str] = (), keyword: str = "", is_question: bool = False, industry: str | None = None) -> DataFrame:
    """The cards of the companies a search names; else those that a keyword fits, unless it is a question; else all.

    An industry narrows them only where no company is named.
    """
    if codes:
        return cards.filter(F.col("code").isin(*codes))
    rows = cards.filter(any_contains(columns, keyword)) if keyword.strip() and not is_question else cards
    return rows if industry is None else rows.filter(F.col("industry") == industry)


def filter_filings(filings: DataFrame, source: str = "all", only_failed: bool = False, only_unparsed: bool = False, only_without_verdict: bool = False,
                   prefix: str = "", keyword: str = "", columns: Sequence[str] = ("code", "name")) -> DataFrame:
    """Filings by source, state, verdict, beginning of the period and company; each filter is off by default."""
    rows = filings
    if source != "all":
        rows = rows.filter(F.when(F.upper(F.trim("source")).isin(*SOURCES), F.upper(F.trim("source"))) == source)
    if only_failed:
        rows = rows.filter("state = 'failed'")
    if only_unparsed:
        rows = rows.filter(~F.coalesce(F.col("state").isin(*PARSED), F.lit(False)))
    if only_without_verdict:
        rows = rows.filter(~F.col("verdict_status").eqNullSafe(F.lit("ready")))
    if prefix.strip():
        rows = rows.filter(F.upper("period").startswith(prefix.strip().upper()))
    return rows.filter(any_contains(columns, keyword.strip())) if keyword.strip() else rows


def filter_overview(rows: DataFrame, card: str | None = None, only_abnormal: bool = False, period: str | None = None, only_attention: bool = False, search: str = "",
                    columns: Sequence[str] = ("code", "period")) -> DataFrame:
    """Rows of the metric overview by the card chosen, which goes before the box for abnormal ones, period, title and search."""
    if card == "audit_non_standard":
        rows = rows.filter("audit_kind = 'non_standard'")
    elif card in ("missing", "absurd_yoy"):
        rows = rows.filter(F.col("abnormal") & F.array_contains("issues", card))
    elif card == "abnormal" or only_abnormal:
        rows = rows.filter("abnormal")
    if period is not None:
        rows = rows.filter(F.col("period") == period)
    if only_attention:
        rows = rows.filter(F.size(text.attention(F.coalesce("title", F.lit("")))) > 0)
    return rows.filter(any_contains(columns, search.strip())) if search.strip() else rows


def demote_excess(filings: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    """All filings, with those being parsed beyond ``limit`` put back in the queue: live ones stay first, then the newest.

    Only the ``limit`` that stay are looked for in order, which each task does on its own rows first.
    """
    parsing = filings.filter("status = 'parsing'").join(live.select("id", F.lit(True).alias("live")), "id", "left")
    kept = parsing.orderBy(F.desc_nulls_last("live"), F.desc_nulls_last("updated_at"), "id").limit(limit).select("id", F.lit(True).alias("kept"))
    both = filings.join(kept, "id", "left")
    back = (F.col("status") == "parsing") & F.col("kept").isNull()
    return both.select(*[(F.when(back, F.lit("downloaded")).otherwise(F.col(c)) if c == "status" else F.col(c)).alias(c) for c in filings.columns], F.coalesce(back, F.lit(False)).alias("demoted"))


def comparable_history(reports: DataFrame) -> DataFrame:
    """``selected, id, period``: for each report the company's reports of the same part of the year up to it, one a period, the best.

    Reports are ``id, code, period, score``; those without metrics are left out by the caller.
    """
    part = F.substring("period", 5, 4)
    own = reports.select(F.col("id").alias("selected"), "code", part.alias("part"), periods.rank_of(F.col("period")).alias("upto"))
    held = reports.select("id", "code", "period", part.alias("part"), "score", periods.rank_of(F.col("period")).alias("period_rank"))
    both = own.join(held, ["code", "part"]).filter("period_rank <= upto")
    return first_rows(both, ["selected", "period"], [F.desc("score"), "id"]).select("selected", "id", "period")


def display_period(states: DataFrame) -> DataFrame:
    """Of each company the period on display: the newest parsed one, else the one whose state goes farthest, newest first."""
    far = F.lit(0)
    for s, n in STATE_ORDER.items():
        far = F.when(F.col("state") == s, n).otherwise(far)
    far = F.when(F.col("state").isin(*PARSED), 100).otherwise(far)
    return first_rows(states, ["code"], [far.desc(), periods.rank_of(F.col("period")).desc(), "period"])


def recent_periods(rows: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """The newest ``n`` canonical period tokens of each group, once each, with their place."""
    tokens = rows.select(*by, F.trim("period").alias("period")).filter(periods.is_canonical(F.col("period"))).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(periods.rank_of(F.col("period")).desc(), "period"))
    return tokens.withColumn("place", place.cast("long")).filter(F.col("place") <= n)


STAGES = ("published", "discovered", "downloaded", "parsed", "online")


def timeline(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide timestamps to a row for each of five stages in order; of a report without one the instant is null."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("stage"), F.col(f"{s}_at").alias("at")) for i, s in enumerate(STAGES)])
    return reports.select(*columns, F.inline(rows))


def beside(*counts: DataFrame) -> DataFrame:
    """Aggregates of several tables in one row; each has one row, so nothing multiplies."""
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out


def coverage_stats(companies: DataFrame) -> DataFrame:
    """Companies (``crawled, source, parse_status, n_metrics``) in numbers: covered, by source in per cent, and what is open."""
    here, status = F.col("crawled"), lambda s: F.count_if(F.col("parse_status") == s)
    counted = companies.agg(
        F.count("*").alias("universe"), F.count_if((F.col("parse_status") == "completed") | (F.col("n_metrics") > 0)).alias("covered"),
        F.count_if(here & (F.col("source") == "exchange")).alias("exchange_count"), F.count_if(here & (F.col("source") == "cninfo")).alias("cninfo_count"), F.count_if(here).alias("found"),
        status("pending").alias("pending"), status("parsing").alias("parsing"), status("failed").alias("failed"),
    )
    pct = F.coalesce(F.floor(F.try_divide(F.col("exchange_count") * 100, F.col("found")) + 0.5), F.lit(0)).cast("long")
    return counted.withColumn("exchange_pct", pct).withColumn("cninfo_pct", F.when(F.col("found") > 0, 100 - F.col("exchange_pct")).otherwise(0)).drop("found")


def conversation_title(company: Column, title: Column) -> Column:
    """What a new conversation on a report is called."""
    return F.substring(F.concat(company, F.lit(" · "), title), 1, 120)


def claim(verdicts: DataFrame, reports: DataFrame, ids: DataFrame, now: str, stale: str = "20 MINUTES") -> DataFrame:
    """``id, how``: the reports among ``ids`` that may be judged now: new ones, and pending ones that have been silent for long."""
    asked = ids.select("id").distinct().join(reports.select("id"), "id", "left_semi")
    new = asked.join(verdicts.select("id"), "id", "left_anti").withColumn("how", F.lit("inserted"))
    silent = verdicts.filter((F.col("status") == "pending") & older_than("updated_at", now, stale))
    return new.unionByName(silent.join(asked, "id", "left_semi").select("id", F.lit("reclaimed").alias("how")))


def heartbeat(verdicts: DataFrame, ids: DataFrame, now: str, stale: str = "10 MINUTES") -> DataFrame:
    """Pending verdicts after those named have shown life, without those silent for longer than ``stale``."""
    alive = verdicts.join(ids.select("id", F.lit(True).alias("alive")), "id", "left")
    at = F.when(F.col("alive") & (F.col("status") == "pending"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    beaten = alive.withColumn("updated_at", at).drop("alive")
    return beaten.filter(~((F.col("status") == "pending") & older_than("updated_at", now, stale)))


def physical_pages(question: Column, pages: Column) -> Column:
    """Page numbers as printed replaced by places in the file, by a map from number to place; unknown ones become 0.

    Numbers said to be of the PDF stay, and all stay where the map is empty or null.
    """
    pattern = r"(?i)(?:PDF\s*)?第\s*\d+\s*页"
    marks, rest = F.regexp_extract_all(question, F.lit(f"({pattern})"), 1), F.split(question, pattern, -1)

    def place(mark: Column) -> Column:
        number = F.regexp_extract(mark, r"(\d+)", 1).try_cast("int")
        return F.when(mark.rlike("(?i)^PDF"), mark).otherwise(F.concat(F.lit("第"), F.coalesce(F.try_element_at(pages, number), F.lit(0)).cast("string"), F.lit("页")))

    done = F.concat(F.transform(marks, place), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(rest, done, lambda a, b: F.concat(a, b)), "")
    return F.when(F.size(pages) > 0, joined).otherwise(question)


def roster_flags(starred: Column, readable: Column, downloaded: Column, status: Column, covered: Column, missing: Column) -> Column:
    """What the roster says of a company, in order."""
    held = F.when(status == "failed", "解析失败").when(status == "parsing", "解析中").when(status == "queued", "排队解析").otherwise("已下载待解析")
    state = F.when(readable, "已可读").when(downloaded, held).when(covered, "已发现待下载").otherwise("等待抓取")
    return F.array_compact(F.array(F.when(starred, "已收藏"), state, F.when(missing, "新期待更新")))


def history_conclusion(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """``conclusion`` of each group's reports (``period, revenue, net_profit``): from the first to the last period, in words.

    Null with fewer than two reports, or where neither amount is known at both ends.
    """
    order = periods.rank_of(F.col("period"))
    ends = reports.groupBy(*by).agg(F.count("*").alias("n"), *[f(c, order).alias(f"{k}_{c}") for c in ("revenue", "net_profit") for k, f in (("first", F.min_by), ("last", F.max_by))])

    def bit(name: str, c: str) -> Column:
        a, b = F.col(f"first_{c}"), F.col(f"last_{c}")
        pct = F.when(a != 0, (b - a) / F.abs(a) * 100)
        change = F.when(pct.isNotNull(), F.concat(F.lit("（"), F.format_string("%+.1f%%", pct), F.lit("）"))).otherwise("")
        return F.concat(F.lit(f"{name}由 "), finance.amount_text(a), F.lit(" 至 "), finance.amount_text(b), change)

    bits = F.concat_ws("，", bit("营收", "revenue"), bit("归母净利", "net_profit"))
    said = F.when((F.col("n") >= 2) & (bits != ""), F.concat(F.lit("近"), F.col("n").cast("string"), F.lit("期"), bits))
    return ends.select(*by, said.alias("conclusion"))


def summary_items(rows: DataFrame, key: str, labelled: Sequence[tuple[str, Column]], empty: str, most: int = 480, n: int = 200) -> DataFrame:
    """The newest ``n`` rows as texts of their labelled parts, without blank ones, clipped."""
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(label), F.trim(c))) for label, c in labelled]
    line = F.concat_ws("；", *parts)
    return rows.orderBy(F.desc(key)).limit(n).select(key, text.clip(F.when(line == "", empty).otherwise(line), most).alias("text"))


def latest_value(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """A scalar subquery with an order and a limit of one, as an aggregate: of each group the value of its last row."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def backlog(filings: DataFrame, companies: DataFrame, now: str, parse_slots: int, download_slots: int, retry: str = "30 SECONDS") -> DataFrame:
    """``id, action, place``: what the next step of the backlog does. Filings of others than their company are skipped; discovered
    ones and, after a pause, failed ones are fetched; fetched ones are parsed, those asked for first."""
    rows = filings.join(companies.filter("enabled").select("code", "name"), "code")
    own = periods.names_own_issuer(F.col("name"), F.col("title")) & periods.is_full_report(F.col("title"))
    judged = rows.withColumn("own", own)
    skipped = judged.filter(~F.col("own") & F.col("status").isin("discovered", "downloaded", "download_failed")).select("id", F.lit("skip").alias("action"), F.lit(None).cast("long").alias("place"))

    def queue(action: str, some: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
        first = some.orderBy(*order).limit(n)
        return first.select("id", F.lit(action).alias("action"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # of n rows

    due = judged.filter(F.col("own") & ((F.col("status") == "discovered") | ((F.col("status") == "download_failed") & older_than("updated_at", now, retry))))
    fetch = queue("download", due, [F.when(F.col("status") == "discovered", 0).otherwise(1), F.desc_nulls_last("published_at"), F.col("id")], download_slots)
    ready = judged.filter(F.col("own") & (F.col("status") == "downloaded"))
    parse = queue("parse", ready, [F.desc(F.coalesce("parse_priority", F.lit(0))), F.col("parse_error").isNotNull(), F.desc_nulls_last("published_at"), F.col("id")], parse_slots)
    return skipped.unionByName(fetch).unionByName(parse)


def acceptance(golden: DataFrame, stored: DataFrame) -> DataFrame:
    """``expected, found, matching``: golden values (``id, metric, value, page``) that are stored, and that are equal to a millionth
    on the same page."""
    held = stored.select("id", "metric", F.col("value").alias("have"), F.col("page").alias("on"))
    same = (F.abs(F.col("have") - F.col("value")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("value"))) & (F.col("on") == F.col("page"))
    return golden.join(held, ["id", "metric"], "left").agg(F.count("*").alias("expected"), F.count("have").alias("found"), F.count_if(same).alias("matching"))


def review(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reports in review that a decision (``id, decision``: approve or reject) moves: ``id, status, audit``, the audit's text.

    Approved ones with all headline metrics go online, others stay; rejected ones are parsed anew.
    """
    both = reports.filter("status IN ('review', 'parse_partial')").join(decisions, "id")
    to = F.when(F.col("decision") == "reject", "downloaded").when((F.col("decision") == "approve") & (F.col("core") == len(HEADLINE)), "online")
    return both.withColumn("to", to).filter("to IS NOT NULL").select("id", F.col("to").alias("status"), F.concat_ws(":", "decision", "status", "to").alias("audit"))


def numbered_cards(cards: DataFrame, order: Sequence[Column], starred: DataFrame) -> DataFrame:
    """Cards in an order of the portal, starred ones before the rest."""
    flagged = cards.join(starred.select("code", F.lit(True).alias("__star")), "code", "left")
    return flagged.orderBy(F.desc_nulls_last("__star"), *order).drop("__star")


def snapshot(states: DataFrame, metrics: DataFrame, companies: DataFrame, latest: str) -> DataFrame:
    """A row for each company: the period on display with its state and headline metrics, how many periods are parsed, and whether the
    newest expected period is still missing. ``states`` are ``code, period, state, id``, one a period; metrics ``id, metric, value``."""
    shown = display_period(states).select("code", "period", "state", "id")
    wide = metrics.groupBy("id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in HEADLINE])
    parsed = F.col("state").isin(*PARSED)
    counts = states.groupBy("code").agg(F.count_if(parsed).alias("n_parsed"), F.max(~F.col("state").isin("expected", "discovered") & (F.col("period") == latest)).alias("has_latest"))
    both = companies.select("code").join(shown, "code", "left").join(counts, "code", "left").join(wide, "id", "left")
    return both.select("code", "period", F.coalesce("state", F.lit("expected")).alias("state"), *HEADLINE, F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"), (~F.coalesce("has_latest", F.lit(False))).alias("latest_missing"))
