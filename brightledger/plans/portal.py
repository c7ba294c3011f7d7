"""Queries of the portal's lists, queues and states. Orders stand for filings, customers for companies, parts for themes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions import finance, periods
from brightledger.operators import aggregate, overview, portal, upsert
from brightledger.operators.overview import HEADLINE
from brightledger.plans.registry import query
from brightledger.sources.tables import table

STATES = ("parsed", "parsed_partial", "downloaded", "discovered", "failed", "expected")
SOURCES = ("SSE", "szse ", "BSE", "CNINFO", "other")
SUFFIXES = ("FY", "H1", "Q1", "Q3")
NOW = "1998-08-01 00:00:00"


def _turn(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))


def _filings(spark, sf) -> DataFrame:
    """Orders as filings of the years 2017 on."""
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    return o.select(
        "id", F.col("o_custkey").alias("code"), F.concat((F.year("o_orderdate") + 25).cast("string"), _turn(SUFFIXES)).alias("period"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        _turn(STATES).alias("state"), _turn(SOURCES).alias("source"), F.when(F.col("id") % 3 == 0, "ready").when(F.col("id") % 3 == 1, "pending").alias("verdict_status"), F.col("o_totalprice").alias("revenue"),
    )


def _cases(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(o_orderkey % {len(values)} AS INTEGER) + 1]"


_F = f"""f AS (SELECT o_orderkey AS id, o_custkey AS code, CAST(year(o_orderdate) + 25 AS VARCHAR) || {_cases(SUFFIXES)} AS period, CAST(o_orderdate AS TIMESTAMP) AS published_at,
 {_cases(STATES)} AS state, {_cases(SOURCES)} AS source, CASE o_orderkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' END AS verdict_status, o_totalprice AS revenue FROM orders)"""
_RANK = "(CAST(substr({p}, 1, 4) AS INTEGER) * 10 + CASE substr({p}, 5) WHEN 'FY' THEN 4 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 1 END)"
_PERIOD_RANK = _RANK.format(p="period")


def _amount(x: str) -> str:
    shown = lambda v: f"regexp_replace(regexp_replace(format('{{:,.2f}}', {v}), '0$', ''), '\\.0?$', '')"
    return f"CASE WHEN abs({x}) >= 1e8 THEN {shown(f'{x} / 1e8')} || '亿元' WHEN abs({x}) >= 1e6 THEN {shown(f'{x} / 1e4')} || '万元' ELSE {shown(x)} || '元' END"


@query(f"""WITH {_F} SELECT code, id, ends_with(period, 'H1') AS fits FROM f WHERE id % 5 <> 0 AND state <> 'discovered'
 QUALIFY row_number() OVER (PARTITION BY code ORDER BY ends_with(period, 'H1') DESC, published_at DESC, id) <= 3""")
def suffix_history(spark, sf):
    """Reports to compare with: those of half years first."""
    f = _filings(spark, sf)
    reports = f.withColumn("status", F.when(F.col("state") == "discovered", "auto_skipped").otherwise(F.col("state")))
    return portal.company_history(reports, f.filter("id % 5 <> 0").select("id", "period"), "H1", 3).select("code", "id", "fits")


@query("""SELECT 'named' AS mode, c_custkey AS code FROM customer WHERE c_custkey IN (5, 7) UNION ALL
 SELECT 'keyword', c_custkey FROM customer WHERE contains(lower(c_name), '12') AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'question', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def home_filter(spark, sf):
    cards = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))
    asked = {"named": {"codes": [5, 7], "keyword": "12"}, "keyword": {"keyword": "12"}, "question": {"keyword": "12", "is_question": True}}
    found = [portal.home_cards(cards, ["name"], industry="BUILDING", **how).select(F.lit(mode).alias("mode"), "code") for mode, how in asked.items()]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH {_F} SELECT 'open' AS how, id FROM f WHERE upper(trim(source)) = 'SZSE' AND state NOT IN ('parsed', 'parsed_partial') AND verdict_status IS DISTINCT FROM 'ready' AND starts_with(period, '2020')
 UNION ALL SELECT 'failed', id FROM f WHERE state = 'failed' AND contains(CAST(code AS VARCHAR), '1')""")
def filings_filter(spark, sf):
    f = _filings(spark, sf)
    one = portal.filter_filings(f, source="SZSE", only_unparsed=True, only_without_verdict=True, prefix=" 2020")
    two = portal.filter_filings(f, only_failed=True, keyword="1", columns=["code"])
    return one.select(F.lit("open").alias("how"), "id").unionByName(two.select(F.lit("failed").alias("how"), "id"))


_MARKED = f"""{_F}, m AS (SELECT *, id % 2 = 0 AS abnormal, CASE WHEN id % 4 = 0 THEN ['missing'] WHEN id % 4 = 1 THEN ['absurd_yoy', 'missing'] ELSE [] END AS issues,
 CASE WHEN id % 9 = 0 THEN 'non_standard' END AS audit_kind, CASE WHEN id % 6 = 0 THEN '年度报告（更正）' WHEN id % 6 <> 5 THEN '年度报告' END AS title FROM f)"""


@query(f"""WITH {_MARKED} SELECT 'missing' AS card, id FROM m WHERE abnormal AND list_contains(issues, 'missing') AND starts_with(period, '2019FY') UNION ALL
 SELECT 'audit', id FROM m WHERE audit_kind = 'non_standard' UNION ALL SELECT 'box', id FROM m WHERE abnormal AND contains(title, '更正') AND contains(CAST(code AS VARCHAR) , '2')""")
def overview_filter(spark, sf):
    f, n = _filings(spark, sf), F.col("id")
    issues = F.when(n % 4 == 0, F.array(F.lit("missing"))).when(n % 4 == 1, F.array(F.lit("absurd_yoy"), F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    title = F.when(n % 6 == 0, "年度报告（更正）").when(n % 6 != 5, "年度报告")
    rows = f.withColumns({"abnormal": n % 2 == 0, "issues": issues, "audit_kind": F.when(n % 9 == 0, "non_standard"), "title": title})
    asked = {"missing": {"card": "missing", "period": "2019FY", "only_abnormal": True}, "audit": {"card": "audit_non_standard", "only_abnormal": True}, "box": {"only_abnormal": True, "only_attention": True, "search": "2", "columns": ["code"]}}
    return reduce(DataFrame.unionByName, [portal.filter_overview(rows, **how).select(F.lit(k).alias("card"), "id") for k, how in asked.items()])


@query(f"""WITH {_F}, p AS (SELECT id, row_number() OVER (ORDER BY id % 90 = 0 DESC, published_at DESC, id) AS rn FROM f WHERE id % 3 = 0)
 SELECT f.id, CASE WHEN f.id % 3 <> 0 THEN 'online' WHEN rn > 25 THEN 'downloaded' ELSE 'parsing' END AS status, coalesce(rn > 25, false) AS demoted FROM f LEFT JOIN p USING (id)""")
def excess_demoted(spark, sf):
    """Filings being parsed beyond 25 go back to the queue."""
    f = _filings(spark, sf).select("id", F.when(F.col("id") % 3 == 0, "parsing").otherwise("online").alias("status"), F.col("published_at").alias("updated_at"))
    return portal.demote_excess(f, f.filter("id % 90 = 0"), 25).select("id", "status", "demoted")


@query(f"""WITH {_F}, r AS (SELECT *, {_PERIOD_RANK} AS pr, id % 11 AS score FROM f WHERE id % 5 <> 0) SELECT a.id AS selected, b.id, b.period FROM r a JOIN r b ON a.code = b.code AND substr(a.period, 5) = substr(b.period, 5) AND b.pr <= a.pr
 QUALIFY row_number() OVER (PARTITION BY a.id, b.period ORDER BY b.score DESC, b.id) = 1""")
def same_part_history(spark, sf):
    return portal.comparable_history(_filings(spark, sf).filter("id % 5 <> 0").withColumn("score", F.col("id") % 11))


@query(f"""WITH {_F} SELECT code, period, state, id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY id) = 1) QUALIFY row_number() OVER (PARTITION BY code ORDER BY
 CASE WHEN state IN ('parsed', 'parsed_partial') THEN 100 WHEN state = 'downloaded' THEN 40 WHEN state = 'discovered' THEN 30 WHEN state = 'failed' THEN 20 ELSE 10 END DESC, {_PERIOD_RANK} DESC, period) = 1""")
def display_periods(spark, sf):
    once = portal.first_rows(_filings(spark, sf), ["code", "period"], ["id"])
    return portal.display_period(once).select("code", "period", "state", "id")


@query(f"""WITH {_F}, t AS (SELECT DISTINCT code, trim(CASE WHEN id % 7 = 0 THEN 'old' ELSE period || ' ' END) AS period FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {_PERIOD_RANK} DESC, period) AS place FROM t WHERE period <> 'old')
 SELECT code, period, place FROM r WHERE place <= 3""")
def newest_tokens(spark, sf):
    rows = _filings(spark, sf).withColumn("period", F.when(F.col("id") % 7 == 0, "old").otherwise(F.concat("period", F.lit(" "))))
    return portal.recent_periods(rows, ["code"])


@query(f"""WITH {_F} SELECT id, k - 1 AS ordinal, ['published', 'discovered', 'downloaded', 'parsed', 'online'][k] AS stage, strftime(CASE k WHEN 1 THEN published_at WHEN 2 THEN published_at + INTERVAL 1 DAY WHEN 3 THEN CASE WHEN id % 2 = 0 THEN published_at + INTERVAL 2 DAY END
 WHEN 4 THEN CASE WHEN id % 4 = 0 THEN published_at + INTERVAL 3 DAY END END, '%Y-%m-%d') AS at FROM f, range(1, 6) t(k)""")
def report_timelines(spark, sf):
    f, n = _filings(spark, sf), F.col("id")
    later = lambda days: F.col("published_at") + F.expr(f"INTERVAL {days} DAY")
    wide = f.withColumns({"discovered_at": later(1), "downloaded_at": F.when(n % 2 == 0, later(2)), "parsed_at": F.when(n % 4 == 0, later(3)), "online_at": F.lit(None).cast("timestamp")})
    return portal.timeline(wide, ["id"]).select("id", F.col("ordinal").cast("long").alias("ordinal"), "stage", F.date_format("at", "yyyy-MM-dd").alias("at"))


@query(f"""WITH {_F} SELECT (SELECT count(*) FROM f) AS reports, (SELECT count(DISTINCT code) FROM f WHERE state = 'parsed') AS readable_companies, (SELECT count(*) FROM customer) AS target_companies""")
def system_counts(spark, sf):
    f = _filings(spark, sf)
    filings = f.agg(F.count("*").alias("reports"), aggregate.distinct_filtered("code", F.col("state") == "parsed").alias("readable_companies"))
    return portal.beside(filings, table(spark, sf, "customer").agg(F.count("*").alias("target_companies")))


@query("""WITH c AS (SELECT *, c_custkey % 4 > 0 AS crawled, CASE WHEN c_custkey % 3 = 0 THEN 'cninfo' ELSE 'exchange' END AS source, ['completed', 'pending', 'parsing', 'failed', 'queued'][CAST(c_custkey % 5 AS INTEGER) + 1] AS s FROM customer)
 SELECT count(*) AS universe, count(*) FILTER (WHERE s = 'completed' OR c_custkey % 2 > 0) AS covered, count(*) FILTER (WHERE crawled AND source = 'exchange') AS exchange_count, count(*) FILTER (WHERE crawled AND source = 'cninfo') AS cninfo_count,
 count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'parsing') AS parsing, count(*) FILTER (WHERE s = 'failed') AS failed,
 CAST(floor(count(*) FILTER (WHERE crawled AND source = 'exchange') * 100 / count(*) FILTER (WHERE crawled) + 0.5) AS BIGINT) AS exchange_pct,
 100 - CAST(floor(count(*) FILTER (WHERE crawled AND source = 'exchange') * 100 / count(*) FILTER (WHERE crawled) + 0.5) AS BIGINT) AS cninfo_pct FROM c""")
def coverage_numbers(spark, sf):
    c = table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))
    rows = c.select((F.col("id") % 4 > 0).alias("crawled"), F.when(F.col("id") % 3 == 0, "cninfo").otherwise("exchange").alias("source"), _turn(("completed", "pending", "parsing", "failed", "queued")).alias("parse_status"), (F.col("id") % 2).alias("n_metrics"))
    return portal.coverage_stats(rows)


@query("SELECT o_orderkey AS id, left(c_name || ' · ' || o_orderpriority || repeat('x', CAST(o_orderkey % 130 AS INTEGER)), 120) AS title FROM orders JOIN customer ON c_custkey = o_custkey")
def conversation_titles(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    title = F.concat("o_orderpriority", F.repeat(F.lit("x"), (F.col("o_orderkey") % 130).cast("int")))
    return both.select(F.col("o_orderkey").alias("id"), portal.conversation_title(F.col("c_name"), title).alias("title"))


_VERDICTS = f"""{_F}, v AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE ELSE TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE END AS updated_at FROM f WHERE id % 5 < 3)"""


def _verdicts(f: DataFrame) -> DataFrame:
    at = F.lit(NOW).cast("timestamp")
    return f.filter("id % 5 < 3").select("id", F.when(F.col("id") % 3 == 0, "pending").otherwise("ready").alias("status"), F.when(F.col("id") % 2 == 0, at - F.expr("INTERVAL 5 MINUTES")).otherwise(at - F.expr("INTERVAL 30 MINUTES")).alias("updated_at"))


@query(f"""WITH {_VERDICTS} SELECT id, 'inserted' AS how FROM f WHERE id % 4 = 1 AND id % 5 >= 3 UNION ALL SELECT id, 'reclaimed' FROM v WHERE id % 4 = 1 AND status = 'pending' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 20 MINUTE""")
def claimed_verdicts(spark, sf):
    f = _filings(spark, sf)
    asked = f.filter("id % 4 = 1").select("id").unionByName(f.filter("id % 8 = 1").select("id")).unionByName(spark.createDataFrame([(-1,)], "id long"))
    return portal.claim(_verdicts(f), f, asked, NOW)


@query(f"""WITH {_VERDICTS} SELECT id, status, CAST(date_diff('minute', CASE WHEN id % 7 = 0 AND status = 'pending' THEN TIMESTAMP '{NOW}' ELSE updated_at END, TIMESTAMP '{NOW}') AS BIGINT) AS silent FROM v
 WHERE NOT (status = 'pending' AND id % 7 <> 0 AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE)""")
def living_verdicts(spark, sf):
    f = _filings(spark, sf)
    rows = portal.heartbeat(_verdicts(f), f.filter("id % 7 = 0"), NOW)
    return rows.select("id", "status", F.timestamp_diff("MINUTE", F.col("updated_at"), F.lit(NOW).cast("timestamp")).alias("silent"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN '第 ' || (o_orderkey % 20) || ' 页与PDF 第 3 页和第2页' ELSE '第' || CASE o_orderkey % 20 WHEN 2 THEN 7 WHEN 5 THEN 1 ELSE 0 END || '页与PDF 第 3 页和第7页' END AS question FROM orders""")
def page_questions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    asked = F.concat(F.lit("第 "), (F.col("id") % 20).cast("string"), F.lit(" 页与PDF 第 3 页和第2页"))
    known = F.when(F.col("id") % 10 != 0, F.create_map(F.lit(2), F.lit(7), F.lit(5), F.lit(1))).otherwise(F.create_map().cast("map<int,int>"))
    return o.select("id", portal.physical_pages(asked, known).alias("question"))


@query("""WITH c AS (SELECT c_custkey AS code, c_custkey % 5 AS a, c_custkey % 7 AS b FROM customer) SELECT code, concat_ws(',', CASE WHEN a = 0 THEN '已收藏' END, CASE WHEN b = 0 THEN '已可读' WHEN b < 4 THEN CASE a WHEN 1 THEN '解析失败' WHEN 2 THEN '解析中' WHEN 3 THEN '排队解析' ELSE '已下载待解析' END
 WHEN b = 4 THEN '已发现待下载' ELSE '等待抓取' END, CASE WHEN code % 3 = 0 THEN '新期待更新' END) AS flags FROM c""")
def roster_rows(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), (F.col("c_custkey") % 5).alias("a"), (F.col("c_custkey") % 7).alias("b"))
    status = F.when(F.col("a") == 1, "failed").when(F.col("a") == 2, "parsing").when(F.col("a") == 3, "queued").otherwise("pending")
    flags = portal.roster_flags(F.col("a") == 0, F.col("b") == 0, F.col("b") < 4, status, F.col("b") == 4, F.col("code") % 3 == 0)
    return c.select("code", F.array_join(flags, ",").alias("flags"))


_PCT = "CASE WHEN {a} <> 0 THEN '（' || format('{{:+.1f}}', ({b} - {a}) / abs({a}) * 100) || '%）' ELSE '' END"


@query(f"""WITH y AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, sum(o_totalprice) / 7 AS r, sum(o_totalprice) / 7 - 40000 AS p FROM orders GROUP BY 1, 2), e AS (SELECT code, count(*) AS n, arg_min(r, yr) AS r0, arg_max(r, yr) AS r1, arg_min(p, yr) AS p0, arg_max(p, yr) AS p1 FROM y GROUP BY 1)
 SELECT code, CASE WHEN n >= 2 THEN '近' || n || '期营收由 ' || {_amount("r0")} || ' 至 ' || {_amount("r1")} || {_PCT.format(a="r0", b="r1")} || '，归母净利由 ' || {_amount("p0")} || ' 至 ' || {_amount("p1")} || {_PCT.format(a="p0", b="p1")} END AS conclusion FROM e""")
def history_conclusions(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code"), F.concat((F.year("o_orderdate") + 25).cast("string"), F.lit("FY")).alias("period")).agg((F.sum("o_totalprice") / 7).alias("revenue"))
    return portal.history_conclusion(y.withColumn("net_profit", F.col("revenue") - 40000), ["code"])


@query("""SELECT event_id, CASE WHEN length(t) <= 24 THEN t ELSE left(t, 23) || '…' END AS text FROM (SELECT event_id, '类型:' || event_type || CASE WHEN user_id % 2 = 0 THEN '；公司:' || user_id ELSE '' END || CASE WHEN user_id % 3 = 0 THEN '；备注:' || repeat('长', 20) ELSE '' END AS t FROM events) ORDER BY event_id DESC LIMIT 200""")
def summary_texts(spark, sf):
    e, user = table(spark, sf, "events"), F.col("user_id")
    parts = [("类型:", F.col("event_type")), ("公司:", F.when(user % 2 == 0, user.cast("string"))), ("备注:", F.when(user % 3 == 0, F.repeat(F.lit("长"), F.lit(20))).otherwise(" "))]
    return portal.summary_items(e, "event_id", parts, "(空记录)", most=24)


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type FROM events GROUP BY 1")
def latest_values(spark, sf):
    return portal.latest_value(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])


_BACKLOG = f"""b AS (SELECT o_orderkey AS id, o_orderdate AS d, ['discovered', 'downloaded', 'download_failed', 'online'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS status, o_orderkey % 7 <> 0 AS own, o_orderkey % 5 AS parse_priority, o_orderkey % 3 = 0 AS has_error,
 CASE WHEN o_orderkey % 8 = 2 THEN 10 ELSE 60 END AS waited FROM orders WHERE o_custkey % 2 = 0)"""


@query(f"""WITH {_BACKLOG} SELECT id, 'skip' AS action, NULL::BIGINT AS place FROM b WHERE NOT own AND status <> 'online' UNION ALL
 (SELECT id, 'download', row_number() OVER (ORDER BY status = 'discovered' DESC, d DESC, id) FROM b WHERE own AND (status = 'discovered' OR (status = 'download_failed' AND waited > 30)) QUALIFY row_number() OVER (ORDER BY status = 'discovered' DESC, d DESC, id) <= 20) UNION ALL
 (SELECT id, 'parse', row_number() OVER (ORDER BY parse_priority DESC, has_error, d DESC, id) FROM b WHERE own AND status = 'downloaded' QUALIFY row_number() OVER (ORDER BY parse_priority DESC, has_error, d DESC, id) <= 10)""")
def backlog_plan(spark, sf):
    """What the backlog does next: 20 downloads and 10 parses."""
    n = F.col("id")
    rows = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey")).select(
        "id", F.col("o_custkey").alias("code"), F.when(n % 7 == 0, "别家股份有限公司：别家股份有限公司2020年年度报告").otherwise("2020年年度报告").alias("title"), _turn(("discovered", "downloaded", "download_failed", "online")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), (n % 5).alias("parse_priority"), F.when(n % 3 == 0, "x").alias("parse_error"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval(secs=F.when(n % 8 == 2, 10).otherwise(60))).alias("updated_at"))
    rows = rows.withColumn("title", F.when(n % 7 == 0, "某某：别家股份有限公司2020年年度报告").otherwise(F.col("title")))
    companies = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.lit("本家").alias("name"), (F.col("c_custkey") % 2 == 0).alias("enabled"))
    return portal.backlog(rows, companies, NOW, 10, 20)


@query("""SELECT count(*) AS expected, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS found, count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0) AS matching FROM orders""")
def acceptance_audit(spark, sf):
    """Golden values against stored ones, some of them missing, off by a thousandth, or of another page."""
    n, o = F.col("id"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("revenue").alias("metric"), F.col("o_totalprice").alias("value"), F.lit(3).alias("page"))
    stored = o.filter("id % 5 <> 0").withColumn("value", F.when(n % 3 == 0, F.col("value") * 1.001 + 1).otherwise(F.col("value") * (1 + 1e-8))).withColumn("page", F.when(n % 4 == 0, 4).otherwise(3))
    return portal.acceptance(o, stored)


@query("""SELECT id, status, audit FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'reject' ELSE 'approve' END AS d, ['review', 'parse_partial', 'online'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'downloaded' WHEN o_orderkey % 5 = 4 THEN 'online' END AS status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'reject:' || s || ':downloaded' ELSE 'approve:' || s || ':online' END AS audit FROM orders WHERE o_orderkey % 4 < 2) WHERE s <> 'online' AND status IS NOT NULL""")
def reviewed(spark, sf):
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    reports = o.select("id", _turn(("review", "parse_partial", "online")).alias("status"), (F.col("id") % 5).alias("core"))
    return portal.review(reports, o.filter("id % 4 < 2").select("id", F.when(F.col("id") % 2 == 0, "reject").otherwise("approve").alias("decision")))


@query(f"""WITH {_F} SELECT id FROM f ORDER BY id % 4 DESC, id % 3 = 0, published_at DESC, id LIMIT 50""")
def next_to_parse(spark, sf):
    f = _filings(spark, sf).withColumn("parse_priority", F.when(F.col("id") % 4 > 0, F.col("id") % 4)).withColumn("parse_error", F.when(F.col("id") % 3 == 0, "x"))
    return overview.parse_queue(f).limit(50).select("id")


@query(f"""WITH {_F} SELECT id FROM f WHERE state IN ('discovered', 'failed') ORDER BY state = 'discovered' DESC, published_at DESC, id LIMIT 50""")
def next_to_download(spark, sf):
    return overview.download_queue(_filings(spark, sf).filter("state IN ('discovered', 'failed')").withColumn("status", F.col("state"))).limit(50).select("id")


@query("SELECT p_partkey AS metric, p_retailprice - 1400 AS yoy_pct, abs(p_retailprice - 1400) >= 30 AS large FROM part")
def large_moves(spark, sf):
    return overview.moves(table(spark, sf, "part").select(F.col("p_partkey").alias("metric"), (F.col("p_retailprice") - 1400).alias("yoy_pct")))


@query("SELECT c_custkey AS code FROM customer ORDER BY c_custkey % 50 = 0 DESC, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey LIMIT 60")
def home_sorted(spark, sf):
    cards = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("revenue"))
    return overview.home_order(cards, "revenue", cards.filter("code % 50 = 0").select("code")).limit(60).select("code")


@query("SELECT c_custkey AS code FROM customer ORDER BY c_custkey % 40 = 0 DESC, c_custkey % 7 = 0 DESC, c_custkey % 100, c_custkey LIMIT 60")
def home_by_popularity(spark, sf):
    """Readable cards first, then by rank; starred ones before all."""
    cards = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), (F.col("c_custkey") % 100).alias("rank"))
    return portal.numbered_cards(cards, [F.desc(F.col("code") % 7 == 0), F.col("rank"), F.col("code")], cards.filter("code % 40 = 0").select("code")).limit(60).select("code")


@query(f"""WITH {_F} SELECT code, period, id, {_PERIOD_RANK} AS period_rank FROM f WHERE {_PERIOD_RANK} >= 20202""")
def flattened_filings(spark, sf):
    companies = aggregate.nested(_filings(spark, sf), ["code"], ["period", "id"], "periods")
    return overview.flatten_filings(companies, "2020H1")


@query("""WITH t AS (SELECT o_orderkey AS id, 0 AS tier, o_orderkey % 13 AS ordinal FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 1, o_orderkey % 17 FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 2, o_orderkey FROM orders WHERE o_orderkey % 5 = 0),
 u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, ordinal) = 1) SELECT id, tier FROM u WHERE id % 3 <> 0 ORDER BY tier, ordinal, id LIMIT 40""")
def next_verdicts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    tier = lambda m, by: o.filter(f"id % {m} = 0").withColumn("ordinal", by)
    rows = overview.verdict_queue(o, tier(11, F.col("id") % 13), tier(7, F.col("id") % 17), tier(5, F.col("id")), o.filter("id % 3 = 0"), 40)
    return rows.select("id", F.col("branch").alias("tier"))


@query("""SELECT o_custkey AS code, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS rows FROM orders GROUP BY 1""")
def nested_rows(spark, sf):
    n = aggregate.nested(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], "rows")
    return n.select(F.col("o_custkey").alias("code"), F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"])), ",").alias("rows"))


@query("""SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ', ' ')) AS value FROM part) WHERE trim(value) <> '' GROUP BY 1""")
def choices_histogram(spark, sf):
    """Answers of several choices count each."""
    return aggregate.histogram(table(spark, sf, "part"), F.split(F.concat("p_name", F.lit(" ")), " "))


@query("SELECT p_brand AS theme, count(DISTINCT s) AS n FROM (SELECT p_brand, unnest([p_size, p_size + 1, p_size]) AS s FROM part) WHERE s <= 25 GROUP BY 1")
def theme_sizes(spark, sf):
    p = table(spark, sf, "part")
    themes = p.select(F.col("p_brand").alias("theme"), F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size")).alias("ids"))
    return aggregate.theme_counts(themes, "theme", "ids", p.filter("p_size <= 26").select((F.col("p_size")).alias("id")).unionByName(p.select((F.col("p_size") + 1).alias("id"))).filter("id <= 25").distinct(), "id")


_PEERS = """w AS (SELECT o_orderkey AS id, o_custkey AS code, CAST(year(o_orderdate) + 25 AS VARCHAR) || 'FY' AS period, o_orderdate AS d, c_mktsegment AS industry, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS revenue FROM orders JOIN customer ON c_custkey = o_custkey),
 n AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY d DESC, id) = 1)"""


@query(f"""WITH {_PEERS} SELECT n.id, n.industry, n.period, CASE WHEN q.revenue IS NOT NULL AND n.revenue IS NOT NULL THEN (n.revenue - q.revenue) / abs(q.revenue) * 100 END AS revenue_growth, count(n.revenue) OVER g AS n_peers,
 CASE WHEN n.revenue IS NOT NULL AND count(n.revenue) OVER g >= 2 THEN rank() OVER (PARTITION BY n.industry, n.period ORDER BY n.revenue DESC NULLS LAST) END AS rank
 FROM n LEFT JOIN n q ON q.code = n.code AND CAST(substr(q.period, 1, 4) AS INTEGER) = CAST(substr(n.period, 1, 4) AS INTEGER) - 1 WINDOW g AS (PARTITION BY n.industry, n.period)""")
def peer_growth(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    reports = both.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), F.concat((F.year("o_orderdate") + 25).cast("string"), F.lit("FY")).alias("period"), F.col("o_orderdate").alias("published_at"), F.col("c_mktsegment").alias("industry"))
    wide = both.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("revenue"))
    return overview.peers(reports, wide).select("id", "industry", "period", "revenue_growth", "n_peers", "rank")


_STATUSES = ("parse_failed", "parse_parked", "parsing", "downloaded", "online", "review", "parse_partial", "discovered", "")
_COLLECTED = ("failed", "failed", "downloaded", "downloaded", "parsed", "parsed", "parsed_partial", "discovered", "expected")


@query(f"""WITH {_F}, due AS (SELECT y || s AS period FROM range(2020, 2022) t(y), (VALUES ('Q1'), ('H1'), ('Q3'), ('FY')) u(s)),
 h AS (SELECT code, period, id, published_at, id % 11 = 0 AS partial, [{", ".join(f"'{x}'" for x in _COLLECTED)}][id % {len(_STATUSES)} + 1] AS plain FROM f),
 g AS (SELECT *, CASE WHEN partial AND plain IN ('parsed', 'parsed_partial') THEN 'parsed_partial' WHEN partial AND plain <> 'failed' THEN 'parsed' ELSE plain END AS state FROM h),
 b AS (SELECT code, period, state, id FROM g QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY list_position(['failed', 'expected', 'discovered', 'downloaded', 'parsed_partial', 'parsed'], state) DESC, published_at DESC, id) = 1)
 SELECT code, period, state, id, period = '2021FY' AS is_latest FROM b
 UNION ALL SELECT c_custkey, period, 'expected', NULL, period = '2021FY' FROM customer, due WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.code = c_custkey AND b.period = due.period)""")
def company_states(spark, sf):
    """The state of each company and period, with what the calendar expects of 2020 and 2021; every eleventh filing has some metrics only."""
    f = _filings(spark, sf).withColumn("status", _turn(_STATUSES)).withColumn("has_metrics", F.col("id") % 11 == 0).withColumn("complete", F.lit(False))
    calendar = periods.expected_periods(spark, "2022-01-15", since="2020Q1")
    return overview.period_states(f, calendar, table(spark, sf, "customer").select(F.col("c_custkey").alias("code"))).select("code", "period", "state", "id", "is_latest")


@query("""WITH n AS (SELECT o_orderkey AS k, o_custkey AS code, o_orderdate AS d, CASE o_orderkey % 3 WHEN 0 THEN 'SSE' WHEN 1 THEN 'CNINFO' ELSE 'BSE' END AS source FROM orders WHERE o_custkey % 3 <> 0 AND o_orderdate >= DATE '1995-01-01' AND o_orderkey % 5 <> 0),
 o AS (SELECT *, sha256(code || '|' || strftime(d, '%Y-%m-%d') || '|' || '2020年年度报告') AS id FROM n QUALIFY row_number() OVER (PARTITION BY code, d ORDER BY CASE source WHEN 'SSE' THEN 0 WHEN 'CNINFO' THEN 1 ELSE 2 END, k) = 1)
 SELECT id, source, k AS source_id FROM o WHERE k % 7 <> 0""")
def discovered(spark, sf):
    """New filings of enabled companies that are not known by source yet."""
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    found = o.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("timestamp").alias("published_at"), _turn(("SSE", "CNINFO", "BSE")).alias("source"),
                     F.when(F.col("id") % 5 == 0, "2020年年度报告摘要").otherwise("2020年 年度报告").alias("title"))
    companies = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), (F.col("c_custkey") % 3 != 0).alias("enabled"))
    known = found.filter("source_id % 7 = 0").select(F.lit("none").alias("id"), "source", "source_id")
    return overview.discover(found, known, companies, "1995-01-01", {"SSE": 0, "CNINFO": 1}).select("id", "source", "source_id")


@query("""SELECT count(*) AS reports, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS complete, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS indexed, count(*) FILTER (WHERE o_orderkey % 12 = 0) AS ready FROM orders""")
def readiness(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    metrics = o.select("id", F.explode(F.slice(F.array(*[F.lit(m) for m in HEADLINE]), F.lit(1), F.when(F.col("id") % 4 == 0, 4).otherwise(2))).alias("metric"))
    return overview.readiness(o, metrics, o.filter("id % 3 = 0"))


_EVENTS = "SELECT user_id, event_id, ['acked', 'flagged', 'cleared'][CAST(event_id % 3 AS INTEGER) + 1] AS status FROM events"


@query(f"SELECT * FROM ({_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE status <> 'cleared'")
def exclusive_marks(spark, sf):
    """Acknowledged or flagged: the last event decides."""
    e = table(spark, sf, "events").withColumn("id", F.col("event_id")).select("user_id", "event_id", _turn(("acked", "flagged", "cleared")).alias("status"))
    return upsert.mutually_exclusive(e, "user_id", ["event_id"])


@query(f"""WITH {_F} SELECT id, 'downloaded' AS status FROM f WHERE id % 4 = 0 AND state IN ('parsed_partial', 'failed')""")
def guarded_updates(spark, sf):
    f = _filings(spark, sf).select("id", F.col("state").alias("status"))
    return upsert.guarded_update(f, f.filter("id % 4 = 0").select("id").unionByName(f.filter("id % 8 = 0").select("id")), "id", ["parsed_partial", "failed"], "downloaded")


@query(f"""WITH {_F} SELECT id, CASE WHEN id % 5 = 0 THEN 'failed' ELSE state END AS status FROM f WHERE id % 5 <> 0 OR id % 2 = 0""")
def released_claims(spark, sf):
    f = _filings(spark, sf).select("id", F.col("state").alias("status"), F.when(F.col("id") % 2 == 0, "failed").alias("previous_status"))
    return upsert.release_claims(f, f.filter("id % 5 = 0"), "id").select("id", "status")


@query("""SELECT user_id, event_id FROM (SELECT * FROM events WHERE user_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) UNION ALL SELECT DISTINCT user_id, -1 FROM events WHERE user_id % 4 = 0""")
def one_response_each(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    new = e.filter("user_id % 4 = 0").select("user_id").distinct().withColumn("event_id", F.lit(-1).cast(e.schema["event_id"].dataType))
    return upsert.newest_response(e, new, "user_id", ["event_id"])


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' END ELSE c_mktsegment END AS industry, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 'note' ELSE c_name END AS note FROM customer""")
def watched_companies(spark, sf):
    """A good industry stays, a blank one gives way; the note is the new one if there is one."""
    c = table(spark, sf, "customer").withColumn("code", F.col("c_custkey"))
    industry = F.when(F.col("code") % 4 == 0, "待分类").when(F.col("code") % 3 != 0, F.col("c_mktsegment"))
    old = c.select("code", industry.alias("industry"), F.col("c_name").alias("note"))
    new = c.filter("code % 2 = 0").select("code", F.lit("new").alias("industry"), F.when(F.col("code") % 5 > 0, "note").alias("note"))
    return upsert.conditional_upsert(old, new, ["code"], {"industry": upsert.keep_unless_blank("industry", "待分类"), "note": upsert.prefer_new("note")})


@query("""SELECT c.o_orderkey AS id, coalesce(e.v, h.v) AS value FROM (SELECT *, o_orderkey % 5 AS m FROM orders) c LEFT JOIN (SELECT o_custkey, min(o_totalprice) FILTER (WHERE o_orderkey % 3 = 0) AS v FROM orders GROUP BY 1) e ON e.o_custkey = c.o_custkey AND c.m < 2
 LEFT JOIN (SELECT o_custkey, coalesce(min(o_totalprice) FILTER (WHERE o_orderkey % 3 = 1), min(o_totalprice) FILTER (WHERE o_orderkey % 3 = 0)) AS v FROM orders GROUP BY 1) h ON h.o_custkey = c.o_custkey""")
def half_year_lookup(spark, sf):
    """Values by company and half year, which Q2 stands for; the period as written is preferred."""
    o = table(spark, sf, "orders")
    held = o.filter("o_orderkey % 3 < 2").groupBy(F.col("o_custkey").alias("code"), F.when(F.col("o_orderkey") % 3 == 0, "2020Q2").otherwise("2020H1").alias("period")).agg(F.min("o_totalprice").alias("value"))
    asked = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), F.when(F.col("o_orderkey") % 5 < 2, "2020Q2").otherwise("2020H1").alias("period"))
    from brightledger.operators.relate import canonical_lookup

    return canonical_lookup(asked, held, ["code"], "period", "value").select("id", "value")


@query(f"""SELECT o_orderkey AS id, {_amount("v")} AS text FROM (SELECT *, (o_totalprice - 150000) * 0.91370023 * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS v FROM orders)""")
def amounts_in_words(spark, sf):
    n = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), finance.amount_text((F.col("o_totalprice") - 150000) * 0.91370023 * F.when(n == 0, 1).when(n == 1, 100).otherwise(10000)).alias("text"))


@query(f"""WITH {_F}, s AS (SELECT code, period, state, id FROM f QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY id) = 1),
 d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN state IN ('parsed', 'parsed_partial') THEN 100 WHEN state = 'downloaded' THEN 40 WHEN state = 'discovered' THEN 30 WHEN state = 'failed' THEN 20 ELSE 10 END DESC, {_PERIOD_RANK} DESC, period) = 1),
 n AS (SELECT code, count(*) FILTER (WHERE state IN ('parsed', 'parsed_partial')) AS n_parsed, bool_or(state NOT IN ('expected', 'discovered') AND period = '2022FY') AS l FROM s GROUP BY 1)
 SELECT c_custkey AS code, d.period, coalesce(d.state, 'expected') AS state, o_totalprice AS revenue, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 10 END AS net_profit, CAST(NULL AS DOUBLE) AS eps, CAST(NULL AS DOUBLE) AS roe, coalesce(n_parsed, 0) AS n_parsed, NOT coalesce(l, false) AS latest_missing
 FROM customer LEFT JOIN d ON d.code = c_custkey LEFT JOIN n ON n.code = c_custkey LEFT JOIN orders ON o_orderkey = d.id""")
def crawl_snapshot(spark, sf):
    """Every company with the period on display, its metrics, and whether the newest period is there."""
    f = _filings(spark, sf)
    both = F.array(F.struct(F.lit("revenue").alias("metric"), F.col("revenue").alias("value")), F.struct(F.lit("net_profit").alias("metric"), F.when(F.col("id") % 2 == 0, F.col("revenue") / 10).alias("value")))
    metrics = f.select("id", F.explode(both).alias("m")).select("id", "m.*")
    return portal.snapshot(portal.first_rows(f, ["code", "period"], ["id"]), metrics, table(spark, sf, "customer").select(F.col("c_custkey").alias("code")), "2022FY")


@query("""WITH r AS (SELECT o_orderkey AS report, 0 AS kind, CAST(1 AS INTEGER) AS ordinal, CAST(o_orderkey % 3 + 1 AS INTEGER) AS page FROM orders UNION ALL SELECT o_orderkey, 1, 1, 2 FROM orders UNION ALL SELECT o_orderkey, 1, 2, 3 FROM orders WHERE o_orderkey % 2 = 0),
 i AS (SELECT report, page, 'E' || row_number() OVER (PARTITION BY report ORDER BY min(kind * 10 + ordinal), page) AS evidence_id FROM r GROUP BY 1, 2) SELECT report, kind, ordinal, page, evidence_id FROM r JOIN i USING (report, page)""")
def question_contexts(spark, sf):
    """Of each report the fact that a question asks for and the passages that tell of it, with evidence ids."""
    from brightledger.operators import retrieval

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("report"), F.col("o_totalprice").alias("value"))
    n, null = F.col("report"), F.lit(None).cast("double")
    metrics = o.select("report", F.lit("revenue").alias("metric"), "value", (n % 3 + 1).alias("page"), (F.col("value") / 2).alias("prior_value"), null.alias("yoy_pct"))
    page = lambda k, content: o.select("report", F.lit(k).alias("page"), F.lit(content).alias("content"))
    pages = page(2, "营收原因：营业收入增长").unionByName(page(3, "营业收入").filter("report % 2 = 0")).unionByName(page(9, "其他"))
    found = retrieval.context(metrics, pages, retrieval.plan_question("营收变动的原因"), "report")
    return found.select("report", "kind", "ordinal", "page", "evidence_id")
