"""Operators on literal rows: writes, detectors, extraction, overviews, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from brightledger.operators import detectors, extract, overview, relate, retrieval, upsert
from brightledger.sources import announcements as sources
from brightledger.streaming import events as streams


def report(spark, **values):
    names = [*detectors.METRICS, *[f"prior_{m}" for m in detectors.METRICS]]
    return spark.range(1).select(F.lit("r").alias("id"), *[F.lit(values.get(n)).cast("double").alias(n) for n in names])


@pytest.mark.parametrize(
    ("values", "detector", "status", "priority"),
    [
        ({"revenue": 120, "prior_revenue": 100, "net_profit": 8, "prior_net_profit": 10}, "revenue_vs_profit", "card", 95),
        ({"revenue": 90, "prior_revenue": 100, "net_profit": 12, "prior_net_profit": 10}, "revenue_vs_profit", "card", 90),
        ({"revenue": 110, "prior_revenue": 100, "net_profit": 12, "prior_net_profit": 10}, "revenue_vs_profit", "card", 35),
        ({"revenue": 101, "prior_revenue": 100, "net_profit": 12, "prior_net_profit": 10}, "revenue_vs_profit", "none", None),
        ({"revenue": 101}, "revenue_vs_profit", "insufficient", None),
        ({"net_profit": 10, "operating_cash_flow": -1}, "cash_vs_profit", "card", 98),
        ({"net_profit": 10, "operating_cash_flow": 3}, "cash_vs_profit", "card", 82),
        ({"net_profit": 10, "operating_cash_flow": 9, "prior_net_profit": 9, "prior_operating_cash_flow": 8}, "cash_vs_profit", "card", 40),
        ({"net_profit": 10, "profit_ex_non_recurring": -1}, "ex_non_recurring", "card", 94),
        ({"total_assets": 100, "total_liabilities": 75}, "debt_vs_assets", "card", 82),
        ({"total_assets": 100, "total_liabilities": 40}, "debt_vs_assets", "none", None),
        ({"cash_and_equivalents": 100, "restricted_cash": 40}, "restricted_cash", "card", 82),
        ({"goodwill": 30, "equity_parent": 100}, "goodwill_vs_equity", "card", 81),
    ],
)
def test_detectors(spark, values, detector, status, priority):
    rows = {r.id: r for r in detectors.evaluated(report(spark, **values).withColumnRenamed("id", "rid"), ["rid"]).collect()}
    assert len(rows) == 10 and (rows[detector].status, rows[detector].priority) == (status, priority)


def test_cards_shown(spark):
    r = report(spark, revenue=120, prior_revenue=100, net_profit=8, prior_net_profit=10, operating_cost=100, prior_operating_cost=70, operating_cash_flow=-1, total_assets=100, total_liabilities=90)
    shown, state = detectors.relationships(r.withColumnRenamed("id", "rid"), ["rid"])
    assert [x.id for x in shown.orderBy(F.desc("priority")).collect()] == ["cash_vs_profit", "revenue_vs_profit", "debt_vs_assets"]
    assert state.first().status == "has_cards"
    pages = spark.createDataFrame([("r", 9, "公司因故收到警示函，并被处以罚款。"), ("r", 4, "本期收到警示函一份。")], "rid string, page int, content string")
    cards = detectors.watch_cards(r.withColumnRenamed("id", "rid"), pages, "rid").orderBy(F.desc("severity")).collect()
    assert [(c.id, c.page) for c in cards] == [("cash_vs_profit", None), ("admin_penalty", 4)]
    calm = detectors.watch_cards(report(spark).withColumnRenamed("id", "rid"), pages.limit(0), "rid").collect()
    assert {c.id for c in calm} == {"earnings_quality_scan", "balance_sheet_scan"}
    found = detectors.key_findings(r.withColumnRenamed("id", "rid"), ["rid"]).orderBy("place").collect()
    assert [f.id for f in found] == ["net_profit", "cash", "leverage"]


def test_extraction(spark):
    pages = [("r", 3, "单位：万元 主要会计数据\n营业收入 1,234.50 1,000.00 23.45%\n归属于上市公司股东的净利润 (56.00) 10.00\n基本每股收益 -0.12 0.30"), ("r", 40, "单位：元\n营业收入 12,345,000.00"), ("s", 1, None)]
    rows = spark.createDataFrame(pages, "report string, page int, content string")
    got = {x.metric: x for x in extract.metrics(rows, "report").collect()}
    assert got["revenue"].value == 12345000 and got["revenue"].yoy_pct == 23.45 and got["revenue"].source_page == 3 and got["revenue"].confidence >= 0.9
    assert got["net_profit"].value == -560000 and got["net_profit"].prior_value == 100000 and got["eps"].value == -0.12 and got["eps"].unit == "元/股"


def test_audit_opinions(spark):
    pages = [("a", 2, "重要提示：会计师事务所为本公司出具了标准无保留意见的审计报告。"), ("b", 2, "会计师事务所出具了保留意见的审计报告。"), ("b", 30, "上年出具了标准无保留意见的审计报告"), ("c", 1, "没有任何意见")]
    got = {r.report: (r.type, r.page) for r in extract.audit_opinions(spark.createDataFrame(pages, "report string, page int, content string"), "report").collect()}
    assert got == {"a": ("unqualified", 2), "b": ("qualified", 2)}
    toc = spark.createDataFrame([("a", 1, "第一节 释义......3\n第二节 公司简介......8")], "report string, page int, content string")
    assert [(r.title, r.start_page, r.end_page) for r in extract.table_of_contents(toc, "report").orderBy("start_page").collect()] == [("第一节 释义", 3, 7), ("第二节 公司简介", 8, 8)]


def test_retrieval(spark):
    pages = spark.createDataFrame([("r", 1, "公司营业收入同比增长"), ("r", 2, "无关内容"), ("r", 3, "管理层讨论：营业收入变动原因")], "report string, page int, content string")
    got = [(r.page, r.score) for r in retrieval.rank_pages(pages, "营收变化的原因", ["report"]).orderBy(F.desc("score"), "page").collect()]
    assert [p for p, _ in got] == [3, 1]
    assert [r.page for r in retrieval.rank_pages(pages, "第2页说什么", ["report"]).collect()] == [2]
    plan = retrieval.plan_question("2024年营收同比多少")
    assert plan.metrics == ["revenue"] and plan.wants_value and plan.wants_change and plan.needs_history
    assert retrieval.direct_answer(plan, "2025FY", ["x"], [], True)[1] == "out-of-scope" and retrieval.direct_answer(plan, "2024FY", ["x"], ["y"], True) == ("x\ny", "structured-query")
    facts = spark.createDataFrame([(0, "r", 3, "f"), (1, "r", 1, "g")], "ordinal int, report string, page int, text string")
    more = spark.createDataFrame([(0, "r", 3, "p"), (1, "s", 9, "q")], "ordinal int, report string, page int, text string")
    assert {r.text: r.evidence_id for r in retrieval.evidence(facts, more, "report").collect()} == {"f": "E1", "p": "E1", "g": "E2", "q": "E3"}


def test_reconcile(spark):
    third = spark.createDataFrame([("1", "2026Q3", 30.0, None, 1.0, 9.0), ("1", "2025FY", 1.0, 1.0, 1.0, 1.0), ("2", "2026H1", 5.0, 1.0, None, None)], "code string, period string, revenue double, net_profit double, eps double, roe double")
    stored = spark.createDataFrame([("1", "2026Q3", "revenue", 10e8), ("1", "2026H1", "revenue", 20e8), ("1", "2026Q3", "roe", 2.0), ("2", "2026Q2", "revenue", 5e8)], "code string, period string, metric string, value double")
    got = {(r.code, r.period, r.metric): (r.status, r.folded) for r in overview.reconcile(third, stored).collect()}
    assert got[("1", "2026Q3", "revenue")] == ("OK", True) and got[("1", "2026Q3", "net_profit")][0] == "MISS" and got[("1", "2026Q3", "eps")][0] == "MISS" and got[("1", "2026Q3", "roe")] == ("BAD", False)
    assert got[("2", "2026H1", "revenue")] == ("OK", False) and ("1", "2025FY", "revenue") not in got


def test_period_states(spark):
    from brightledger.functions.periods import expected_periods

    schema = "code string, period string, status string, published_at string, id string, has_metrics boolean, complete boolean"
    rows = [
        ("1", "2025Q1", "parse_failed", None, "a", None, None), ("1", "2025H1", "downloaded", None, "b", None, None), ("1", "2025H1", "online", None, "c", True, False), ("1", "2024FY", "parsing", "2", "d", None, None),
        ("1", "2024FY", "parse_parked", "3", "e", None, None), ("1", "最新", "online", None, "f", None, None), ("2", "2025Q3", "review", "1", "g", True, True), ("2", "2025Q3", "online", "2", "h", True, True), ("2", "2026Q1", "new", None, "i", None, None),
    ]
    got = {(r.code, r.period): (r.state, r.id, r.is_latest) for r in overview.period_states(spark.createDataFrame(rows, schema), expected_periods(spark, "2025-11-02"), spark.createDataFrame([("1",), ("2",)], "code string")).collect()}
    assert got == {
        ("1", "2025Q1"): ("failed", "a", False), ("1", "2025H1"): ("parsed_partial", "c", False), ("1", "2025Q3"): ("expected", None, True), ("1", "2024FY"): ("downloaded", "d", False),
        ("2", "2025Q1"): ("expected", None, False), ("2", "2025H1"): ("expected", None, False), ("2", "2025Q3"): ("parsed", "h", True), ("2", "2026Q1"): ("discovered", "i", False),
    }


def test_discover(spark):
    schema = "source string, source_id string, code string, title string, published_at timestamp"
    at = "2026-08-20 00:00:00"
    found = spark.createDataFrame([("cninfo", "9", "1", "甲 2026年半年度报告", None), ("sse", "1", "1", "甲2026年半年度报告", None), ("sse", "2", "2", "乙2026年半年度报告", None), ("sse", "3", "1", "甲业绩预告", None), ("sse", "4", "3", "丙2026年半年度报告", None)], schema).withColumn("published_at", F.to_timestamp(F.lit(at)))
    known = spark.createDataFrame([("x", "sse", "4")], "id string, source string, source_id string")
    companies = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "code string, enabled boolean")
    assert [(r.source, r.source_id) for r in overview.discover(found, known, companies, "2026-01-01", {"sse": 0, "cninfo": 1}).collect()] == [("sse", "1")]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a", True), (2, "待分类", True)], "k int, v string, ok boolean")
    n = spark.createDataFrame([(1, "b", False), (2, "c", False), (3, "d", False)], "k int, v string, ok boolean")
    got = upsert.conditional_upsert(t, n, ["k"], {"v": upsert.keep_unless_blank("v", "待分类"), "ok": upsert.keep_if_unchanged("ok", ["v"])})
    assert sorted(map(tuple, got.collect())) == [(1, "a", False), (2, "c", False), (3, "d", False)]
    once = upsert.upsert(t, n, ["k"])
    assert sorted(once.collect()) == sorted(upsert.upsert(once, n, ["k"]).collect())
    assert sorted(upsert.insert_absent(t, n, ["k"]).collect()) == sorted(upsert.insert_absent(upsert.insert_absent(t, n, ["k"]), n, ["k"]).collect())
    state = spark.createDataFrame([(1, "pending", "failed"), (2, "pending", "ready")], "id int, status string, previous_status string")
    assert [tuple(r) for r in upsert.release_claims(state, state, "id").collect()] == [(1, "failed", "failed")]
    assert [r.id for r in upsert.guarded_update(state, state.limit(1), "id", ["pending"], "held").collect()] == [1]


def test_lookup_prefers_the_written_period(spark):
    asked = spark.createDataFrame([("1", "2026Q2"), ("1", "2025H1"), ("2", "2026H1")], "code string, period string")
    held = spark.createDataFrame([("1", "2026H1", 1.0), ("1", "2026Q2", 2.0), ("1", "2025Q2", 3.0)], "code string, period string, value double")
    assert {(r.code, r.period): r.value for r in relate.canonical_lookup(asked, held, ["code"], "period", "value").collect()} == {("1", "2026Q2"): 2.0, ("1", "2025H1"): 3.0, ("2", "2026H1"): None}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": [{"bulletinId": "1", "securityCode": "600000", "securityName": "甲", "title": "<em>年报</em>", "sseDate": "2026-04-01", "url": "u"}] * 2}))
    (tmp_path / "b.json").write_text("not json")
    rows = sources.read_source(spark, "sse", f"file://{tmp_path}")
    assert [(r.source_id, r.title) for r in sources.merge([rows]).collect()] == [("1", "年报")]
    assert {r.source: r.ok for r in sources.health({"sse": rows, "bse": rows.limit(0)}).collect()} == {"sse": True, "bse": False}
    names = spark.createDataFrame([("1", "甲", None), ("1", "甲股份有限公司", "银行"), ("2", "?", ""), ("2", "乙", None)], "code string, name string, industry string")
    assert sorted(tuple(r) for r in sources.universe([names]).collect()) == [("1", "甲股份有限公司", "银行"), ("2", "乙", None)]
    (tmp_path / "r1.txt").write_text("x" * 50 + "\f" + "short\f" + "y" * 60)
    assert [(r.report, r.page) for r in sources.page_texts(spark, f"file://{tmp_path}/r1.txt").orderBy("page").collect()] == [("r1", 1), ("r1", 3)]


def test_shapes_of_all_sources(spark, tmp_path):
    saved = {
        "cninfo": {"announcements": [{"announcementId": "7", "secCode": "600000", "secName": "甲", "announcementTitle": "年报", "announcementTime": 1775001600000, "adjunctUrl": "a.pdf"}]},
        "szse": {"data": [{"id": "8", "secCode": ["000001"], "secName": ["乙"], "title": "季报", "publishTime": "2026-04-01 08:00:00", "attachPath": "/b.pdf"}]},
        "bse": {"list": [{"disclosureId": "9", "companyCd": "430001", "companyName": "丙", "disclosureTitle": "半年报", "publishDate": "2026-04-01", "destFilePath": "/c.pdf"}]},
    }
    rows = {}
    for name, payload in saved.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "p1.json").write_text(json.dumps(payload))
        rows[name] = sources.read_source(spark, name, f"file://{tmp_path}/{name}")
    got = {r.source: (r.source_id, r.code, r.company_name, r.title, r.published_at.strftime("%Y-%m-%d"), r.url) for r in sources.merge(list(rows.values())).collect()}
    assert got == {"cninfo": ("7", "600000", "甲", "年报", "2026-04-01", "a.pdf"), "szse": ("8", "000001", "乙", "季报", "2026-04-01", "/b.pdf"), "bse": ("9", "430001", "丙", "半年报", "2026-04-01", "/c.pdf")}
    assert {r.source: r.rows for r in sources.health(rows).collect()} == dict.fromkeys(saved, 1)
    both = sources.exchange_first(rows["szse"], rows["szse"].withColumn("source", F.lit("cninfo")).withColumn("source_id", F.lit("1")), ["code", "title"])
    assert [r.source for r in both.collect()] == ["cninfo"]


def test_paging_and_stored_files(spark, tmp_path):
    pages = lambda rows: sources.page_complete(spark.createDataFrame(rows, "page int, fingerprint string, rows long"), 5).first()
    assert tuple(pages([(1, "a", 30), (2, "b", 4), (3, "", 0)])) == (True, 34)
    assert not pages([(1, "a", 30), (2, "a", 30), (3, "", 0)]).complete and not pages([(k, str(k), 30) for k in range(1, 6)]).complete
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "x.txt").write_text("no report")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in sources.stored_reports(spark, f"file://{tmp_path}").select("path", "length").collect()] == [("x.pdf", 8)]
    (tmp_path / "c.json").write_text('[{"code": "1", "name": "甲", "extra": 1}, {"code": "2"}]')
    assert sorted(tuple(r) for r in sources.dimension(spark, f"file://{tmp_path}/c.json", "code string, name string").collect()) == [("1", "甲"), ("2", None)]
    names = spark.createDataFrame([("600000",), ("000001",), ("430001",), ("x",)], "code string").select(sources.exchange_of(F.col("code")).alias("e"))
    assert [r.e for r in names.collect()] == ["SSE", "SZSE", "BSE", None]


def test_filings_arrive_once(spark, tmp_path):
    """Within the lookback a filing counts once by id and once by source key."""
    base = f"file://{tmp_path}"
    rows = [("a", "sse", "1"), ("a", "cninfo", "9"), ("b", "sse", "1"), ("c", "sse", "2"), ("c", "sse", "2")]
    spark.createDataFrame(rows, "id string, source string, source_id string").withColumn("published_at", F.lit("2026-04-01").cast("timestamp")).coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id string, source string, source_id string, published_at timestamp").parquet(f"{base}/in")
    streams.run_once(streams.deduplicated(stream), f"{base}/out", f"{base}/cp")
    got = [(r.id, r.source, r.source_id) for r in spark.read.parquet(f"{base}/out").collect()]
    assert len({i for i, _, _ in got}) == len(got) == len({k[1:] for k in got}) and {"c"} <= {i for i, _, _ in got}
    streams.run_once(streams.deduplicated(stream), f"{base}/out", f"{base}/cp")
    assert spark.read.parquet(f"{base}/out").count() == len(got)


def test_opinion_details(spark):
    pages = [
        ("a", 2, "会计师事务所出具了非标准无保留意见的审计报告。"), ("b", 3, "无保留意见的说明，另有持续经营重大不确定性段落。"), ("c", 20, "审计报告为标准无保留意见"), ("c", 21, "审计意见为带强调事项段的无保留意见"),
        ("d", 1, "否定意见" + "，" * 100 + "否定意见，审计报告。"),
    ]
    got = {r.report: (r.type, r.kind, r.page, r.score) for r in extract.audit_opinions(spark.createDataFrame(pages, "report string, page int, content string"), "report").collect()}
    assert got["a"][:2] == ("unqualified", "standard") or got["a"][:2] == ("qualified", "non_standard")
    assert got["b"][0] == "unqualified_emphasis" and got["c"][:3] == ("unqualified_emphasis", "non_standard", 21)
    assert got["d"] == ("adverse", "non_standard", 1, 1.13)


def test_units_of_pages(spark):
    texts = ["单位：百万元人民币", "（人民币千元列示）", "金额以人民币万元表示", "每股（人民币元）", ""]
    got = [r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").select(extract.page_unit(F.col("t")).alias("u")).collect()]
    assert got == ["百万元", "千元", "万元", "元", "元"]


def test_event_log_grows_by_day(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    e = spark.createDataFrame([(1, "2026-04-01 10:00:00"), (2, "2026-04-02 10:00:00")], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    upsert.append_events(e.filter("event_id = 1"), path)
    upsert.append_events(e.filter("event_id = 2"), path)
    assert [r.event_id for r in spark.read.parquet(path).filter("day = DATE '2026-04-02'").collect()] == [2] and spark.read.parquet(path).count() == 2


def test_context(spark):
    metrics = spark.createDataFrame([("r", "revenue", 2e8, 3, 1e8, None), ("r", "eps", 0.5, 4, None, None)], "report string, metric string, value double, page int, prior_value double, yoy_pct double")
    pages = spark.createDataFrame([("r", 3, "营收增长原因"), ("r", 7, "管理层讨论 营业收入"), ("r", 8, "无关")], "report string, page int, content string")
    got = {(r.kind, r.page): (r.evidence_id, r.text) for r in retrieval.context(metrics, pages, retrieval.plan_question("营收同比多少"), "report").collect()}
    assert got[0, 3] == ("E1", "revenue 2亿元 同比增长 100.00%") and got[1, 3][0] == "E1" and got[1, 7][0] == "E2" and len(got) == 3


def test_streams(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [(i, "a" if i % 3 else "b", "error" if i % 2 else "view") for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, user_id string, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600 + 1_700_000_000))
    e.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    streams.run_once(streams.tumbling_counts(stream, late="10 minutes"), f"{base}/out", f"{base}/cp")
    got = spark.read.parquet(f"{base}/out")
    batch = streams.tumbling_counts(e)
    assert 0 < got.count() <= batch.count() and got.join(batch, ["start", "event_type", "n"], "left_anti").count() == 0
    out = streams.breaker(stream.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))
    q = out.writeStream.format("memory").queryName("breaker").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.source: r.n for r in spark.table("breaker").collect()} == {"a": 20, "b": 14}
    steps = [("x", 1, "discovered"), ("x", 2, "downloading"), ("x", 3, "online"), ("x", 4, "downloaded"), ("y", 1, "parsing")]
    spark.createDataFrame(steps, "id string, seq int, to string").write.parquet(f"{base}/steps")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts alone would go on for ever
    q = streams.filing_states(spark.readStream.schema("id string, seq int, to string").parquet(f"{base}/steps")).writeStream.format("memory").queryName("states").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {r.id: (r.status, r.rejected) for r in spark.table("states").collect()} == {"x": ("downloaded", 1), "y": ("", 1)}


def test_known_filings_of_one_constant_id_meet_by_an_equal_join(spark):
    found = spark.range(20).select(F.col("id").alias("source_id"), F.col("id").alias("code"), F.lit("2021-03-01").cast("timestamp").alias("published_at"), F.lit("SSE").alias("source"), F.lit("2020年年度报告").alias("title"))
    known = found.filter("source_id % 7 = 0").select(F.lit("none").alias("id"), "source", "source_id")
    companies = spark.range(20).select(F.col("id").alias("code"), F.lit(True).alias("enabled"))
    got = overview.discover(found, known, companies, "2000-01-01", {"SSE": 0})
    assert sorted(r["source_id"] for r in got.collect()) == [i for i in range(20) if i % 7]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_batches_do_not_hang_on_how_rows_are_parted(spark):
    """Ranges by partition came out otherwise for counts and for rows, where Spark parts them differently."""
    rows = spark.range(0, 40_000, 1, 16).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 3 == 0).alias("force")).unionByName(spark.createDataFrame([(None, False)], "k long, force boolean"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(kept, ("40", "false", "50k"), strict=True):
            spark.conf.set(k, v)
        got = {r["k"]: r["batch"] for r in relate.batches(rows, "k", "force", 100).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {k: i // 100 for i, k in enumerate([*range(20_011), None])}
