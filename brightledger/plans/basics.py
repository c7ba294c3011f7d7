"""Queries of the operator families over the star schema: customers stand for companies, orders for filings, line items for
metrics, documents for page texts, events for the audit log and conversations for chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightledger.operators import aggregate as agg
from brightledger.operators import rank, relate, upsert
from brightledger.plans.registry import query
from brightledger.sources.tables import table


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return rank.first_rows(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


_SCORE = """CASE WHEN o_orderpriority LIKE '1%' THEN 1000000 ELSE 0 END + CASE o_orderstatus WHEN 'F' THEN 3000 WHEN 'O' THEN 2000 ELSE 1000 END
 + CASE WHEN o_totalprice > 100000 THEN 100 ELSE 0 END"""


def _scored(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), F.expr(_SCORE).alias("score"), "o_orderdate", "o_orderkey")


@query(f"""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, {_SCORE} AS score, o_orderdate, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY {_SCORE} DESC, o_orderdate DESC, o_orderkey) = 1""")
def best_duplicate(spark, sf):
    """Of several filings for one period the best by a weighted score."""
    return rank.first_rows(_scored(spark, sf), ["o_custkey", "yr"], [F.desc("score"), F.desc("o_orderdate"), "o_orderkey"])


@query(f"""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, {_SCORE} AS score, o_orderdate, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY {_SCORE} DESC, o_orderdate DESC, o_orderkey) > 1""")
def retired_duplicates(spark, sf):
    """The filings that a better one for their period retires."""
    return rank.losers(_scored(spark, sf), ["o_custkey", "yr"], [F.desc("score"), F.desc("o_orderdate"), "o_orderkey"])


@query("""WITH b AS (SELECT c_custkey, o_orderkey, o_orderpriority, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) = 1)
SELECT * FROM b ORDER BY c_custkey LIMIT 6""")
def preferred_then_latest_peers(spark, sf):
    """One filing a peer, of the preferred kind if there is one, else the newest; the first six peers by key."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderdate")
    prefer = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return rank.first_rows(o.join(c, "c_custkey"), ["c_custkey"], [prefer, F.desc("o_orderdate"), "o_orderkey"]).orderBy("c_custkey").limit(6)


@query("""WITH f AS (SELECT o.* FROM orders o JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4) l ON o_orderkey = l_orderkey)
SELECT o_custkey, o_orderkey, o_orderdate FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def lateral_complete_latest(spark, sf):
    """The newest complete filing: one with exactly four metrics."""
    full = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).count().filter("count = 4")
    o = relate.with_match(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), full, ["o_orderkey"])
    return rank.first_rows(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT c_custkey, c_nationkey, c_acctbal, count(c_acctbal) OVER (PARTITION BY c_nationkey) AS peers,
 CASE WHEN count(c_acctbal) OVER (PARTITION BY c_nationkey) >= 2 THEN rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) END AS rank FROM customer""")
def industry_rank(spark, sf):
    return rank.competition_rank(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN n < 3 THEN NULL WHEN o_totalprice = hi THEN 'high' WHEN o_totalprice = lo THEN 'low' END AS extreme FROM
 (SELECT *, count(o_totalprice) OVER w AS n, max(o_totalprice) OVER w AS hi, min(o_totalprice) OVER w AS lo FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))""")
def running_extremes(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rank.running_extreme(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").drop("o_orderdate")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 8""")
def sequential_history(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rank.last_rows_ascending(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 8)


@query("""SELECT o_custkey, o_orderkey, yr FROM (SELECT o_custkey, o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN yr <= 1998 THEN 0 ELSE 1 END, abs(yr - 1998), yr DESC, o_orderkey) = 1""")
def closest_period(spark, sf):
    """The filing nearest to a requested period, not after it if one can be had."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("yr"))
    return rank.closest(o, ["o_custkey"], F.col("yr"), F.lit(1998), F.lit(True), ["o_orderkey"])


@query("""SELECT p_brand, p_partkey, turn FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS turn FROM part)
WHERE turn <= 3""")
def round_robin_turns(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.round_robin(p, "p_brand", [F.desc("p_retailprice"), "p_partkey"]).filter("turn <= 3").drop("p_retailprice")


@query("""WITH t AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_extendedprice FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) = 1)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 3""")
def theme_topk(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    return rank.best_theme_cards(li, "l_orderkey", "l_returnflag", [F.desc("l_extendedprice"), "l_linenumber"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
 count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS other, count(*) FILTER (WHERE o_totalprice > 200000) AS large,
 count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS customers_filled FROM orders""")
def status_counts(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(
        F.count("*").alias("n"), F.count_if(s == "F").alias("filled"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"), agg.distinct_filtered("o_custkey", s == "F").alias("customers_filled"),
    )


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts FROM customer LEFT JOIN orders ON c_custkey = o_custkey
LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def entity_counts_fanout(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    parts = o.join(li, "o_orderkey").select("c_custkey", "l_partkey")
    return agg.distinct_children(table(spark, sf, "customer").select("c_custkey"), "c_custkey", {"n_orders": (o, "o_orderkey"), "n_parts": (parts, "l_partkey")})


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')""")
def semi_exists(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.with_match(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')""")
def anti_not_exists(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.without_match(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("""SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality <> 1""")
def needs_work_left_null(spark, sf):
    d, state = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return relate.missing_or_unready(d, state, ["doc_id"], F.col("quality") == 1)


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def inner_dimensions(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 49 GROUP BY 1""")
def left_counts_keep_zero(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "part").select("p_partkey").join(li, "p_partkey", "left").fillna({"n": 0})


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS A, max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS N,
 max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS R FROM
 (SELECT l_orderkey, l_returnflag, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def pivot_long_metrics(spark, sf):
    long = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_extendedprice").alias("v"))
    return agg.to_cells(long, ["l_orderkey"], "l_returnflag", "v", ["A", "N", "R"])


@query("""WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS total, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY 1, 2)
SELECT c.o_custkey AS custkey, c.yr, p.total IS NULL AS missing_base, coalesce(abs((c.total - p.total) / p.total) >= 5, false) AS absurd_yoy, c.urgent = 1 AS page_missing,
 p.total IS NULL OR coalesce(abs((c.total - p.total) / p.total) >= 5, false) AS abnormal FROM y c LEFT JOIN y p ON c.o_custkey = p.o_custkey AND p.yr = c.yr - 1""")
def issue_flags(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("total"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    both = relate.prior_period(y, ["custkey"], "yr", F.col("yr") - 1, "total")
    change = F.abs(F.try_divide(F.col("total") - F.col("prior_total"), F.col("prior_total")))
    flags = both.withColumn("missing_base", F.col("prior_total").isNull()).withColumn("absurd_yoy", F.coalesce(change >= 5, F.lit(False)))
    return flags.select("custkey", "yr", "missing_base", "absurd_yoy", (F.col("urgent") == 1).alias("page_missing"), (F.col("missing_base") | F.col("absurd_yoy")).alias("abnormal"))


@query("""SELECT c_custkey, CAST(yr AS INTEGER) AS yr FROM customer, range(1995, 2002) t(yr) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = yr)""")
def gap_calendar(spark, sf):
    """Periods a company should have filed for and has not."""
    years = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("yr"))
    filed = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr"))
    return relate.expected_but_absent(years, filed, ["c_custkey", "yr"])


@query("""SELECT user_id, event_id, n, failures, n >= 6 AND failures / n >= 0.6 AS is_open FROM (SELECT user_id, event_id, count(*) OVER w AS n,
 CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING))""")
def running_window_fail_rate(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return rank.failure_rate(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").drop("ts", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 50")
def keyset_page(spark, sf):
    return relate.page_before(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 900, 50)


@query("""SELECT event_id FROM events WHERE CAST(event_id AS VARCHAR) ILIKE '%11%' OR event_type ILIKE '%11%' OR props ILIKE '%11%'""")
def any_column_search(spark, sf):
    return table(spark, sf, "events").filter(relate.any_contains(["event_id", "event_type", "props"], "11")).select("event_id")


@query("""SELECT c_custkey FROM customer WHERE contains(lower(coalesce(c_name, '') || ' ' || coalesce(c_mktsegment, '')), '5 bu')""")
def haystack_search(spark, sf):
    return table(spark, sf, "customer").filter(relate.haystack(["c_name", "c_mktsegment"], "5 BU")).select("c_custkey")


@query("""SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 MINUTES AND (user_id = 7)""")
def aged_events(spark, sf):
    from brightledger.sources.tables import events_with_time

    e = events_with_time(spark, sf).filter(relate.older_than("ts", "2024-01-20 00:00:00", "5 MINUTES") & relate.optional("user_id", 7) & relate.optional("event_type", None))
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def json_histogram(spark, sf):
    return agg.histogram(table(spark, sf, "events"), F.get_json_object("props", "$.k"))


@query("""SELECT value, n FROM (SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT 7""")
def top_options(spark, sf):
    return agg.top_options(json_histogram(spark, sf))


@query("""WITH n AS (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS size, p_brand AS brand, false AS verified, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS note FROM part WHERE p_partkey % 2 = 0),
 o AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand, true AS verified, p_type AS note FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.size ELSE n.size END AS size, CASE WHEN n.k IS NULL THEN o.brand ELSE n.brand END AS brand,
 CASE WHEN n.k IS NULL THEN o.verified WHEN o.k IS NULL THEN n.verified ELSE CASE WHEN n.size IS NOT DISTINCT FROM o.size AND n.brand IS NOT DISTINCT FROM o.brand THEN o.verified ELSE false END END AS verified,
 CASE WHEN n.k IS NULL THEN o.note WHEN o.k IS NULL THEN n.note ELSE coalesce(n.note, o.note) END AS note FROM n FULL JOIN o ON n.k = o.k""")
def upsert_conditional(spark, sf):
    """A verified flag survives only unchanged numbers; a note gives way only to another note."""
    p = table(spark, sf, "part")
    new = p.filter("p_partkey % 2 = 0").selectExpr("p_partkey AS k", "p_size + IF(p_partkey % 3 = 0, 1, 0) AS size", "p_brand AS brand", "false AS verified", "IF(p_partkey % 5 = 0, NULL, p_name) AS note")
    old = p.filter("p_partkey % 7 <> 0").selectExpr("p_partkey AS k", "p_size AS size", "p_brand AS brand", "true AS verified", "p_type AS note")
    return upsert.conditional_upsert(old, new, ["k"], {"verified": upsert.keep_if_unchanged("verified", ["size", "brand"]), "note": upsert.prefer_new("note")})


@query("""SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'new ' || s_name FROM supplier WHERE s_suppkey % 2 = 1""")
def insert_if_absent(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")
    return upsert.insert_absent(s.filter("k % 2 = 0"), s.withColumn("name", F.concat(F.lit("new "), "name")), ["k"], ["name"])


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name FROM supplier""")
def upsert_overwrite(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")
    return upsert.upsert(s, s.filter("k % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ["k"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 1, 0.0 FROM lineitem WHERE l_orderkey % 4 = 0""")
def replaced_children(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = li.filter("l_orderkey % 4 = 0").select("l_orderkey").distinct().selectExpr("l_orderkey", "1 AS l_linenumber", "0.0D AS l_quantity")
    return upsert.replace_children(li, new, "l_orderkey")


@query("""SELECT 'lineitem' AS "table", count(*) AS removed FROM lineitem WHERE l_orderkey % 10 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 10 = 0""")
def discard_cascade(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return upsert.discard({"lineitem": li, "orders": o}, o.filter("k % 10 = 0"), "k")[1]


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def state_fold(spark, sf):
    return upsert.latest_event(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures FROM g""")
def source_health(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return upsert.run_of_failures(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "consecutive_failures")


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, 0 AS branch FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT c_custkey, 'late', 2 FROM customer)
SELECT k, name, branch FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY branch, name) = 1""")
def union_priority_dedupe(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")
    return relate.union_first_wins([c.filter("k % 2 = 0"), s, c.withColumn("name", F.lit("late"))], ["k"], ["name"])


@query("""SELECT doc_id, sha256(text) AS fingerprint FROM documents""")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


@query("""SELECT conv_id, substr(sha256(array_to_string(list_sort(list(lpad(CAST(turn AS VARCHAR), 6, '0') || chr(31) || role || chr(31) || text)), chr(30))), 1, 24) AS fingerprint FROM conversations GROUP BY 1""")
def group_fingerprint(spark, sf):
    c = table(spark, sf, "conversations").withColumn("at", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return agg.fingerprint(c, ["conv_id"], ["at", "role", "text"])


@query("""SELECT u.conv_id, u.turn, length(u.text) AS asked, length(a.text) AS answered FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def message_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return u.join(a, ["conv_id", "turn"])


@query("""SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def last_n_resort(spark, sf):
    return rank.last_rows_ascending(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS s, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
WHERE s <= 1200 AND n <= 12""")
def bounded_memory(spark, sf):
    c = table(spark, sf, "conversations")
    return rank.bounded_newest(c, ["conv_id"], [F.desc("turn")], F.length("text"), 12, 1200).select("conv_id", "turn")


@query("""SELECT n_name, count(*) AS n FROM (SELECT n_name, CASE WHEN position(upper(r_name) IN upper('filing of ' || r_name)) > 0 THEN 1 END AS hit FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE hit = 1 GROUP BY 1""")
def longest_alias(spark, sf):
    """Looks up the longest region name contained in a label."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    labels = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", F.concat(F.lit("filing of "), "r_name").alias("label"))
    return relate.longest_contained(labels, "label", r, "r_name").filter("r_name IS NOT NULL").groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT k, force, (row_number() OVER (ORDER BY k) - 1) // 200 AS batch FROM (SELECT o_custkey AS k, max(o_orderstatus = 'F') AS force FROM orders GROUP BY 1)""")
def id_batches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("force"))
    return relate.batches(o, "k", "force", 200)


@query("""SELECT s_suppkey FROM supplier ORDER BY CASE WHEN s_suppkey <= 8 THEN 1 ELSE 0 END, s_suppkey LIMIT 5""")
def rotating_cursor(spark, sf):
    return relate.rotating(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 8, 5)


@query("""SELECT count(*) AS groups FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4)""")
def complete_groups(spark, sf):
    return agg.groups_of_size(table(spark, sf, "lineitem"), ["l_orderkey"], 4)


@query("""SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def two_level_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("""SELECT count(*) AS universe, CAST(floor(100.0 * count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) + 0.5) AS BIGINT) AS main_pct,
 100 - CAST(floor(100.0 * count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) + 0.5) AS BIGINT) AS other_pct FROM customer""")
def coverage_kpis(spark, sf):
    return agg.coverage_shares(table(spark, sf, "customer"), "c_mktsegment", "BUILDING")


@query("""WITH v AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) AS votes FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, coalesce(lead(votes) OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_linenumber), 0) AS nx, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_linenumber) AS rn FROM v)
SELECT l_suppkey, l_linenumber, votes FROM r WHERE rn = 1 AND votes >= 3 AND votes > 1.02 * nx""")
def vote_with_margin(spark, sf):
    """The printed-page offset most pages agree on, here the line number of most of a supplier's orders."""
    return agg.winning_offset(table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", "l_orderkey", margin=1.02)


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_custkey, yr)""")
def rollup_totals(spark, sf):
    """An extension: totals by customer and year, by customer, and in all."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), "o_totalprice")
    return o.rollup("o_custkey", "yr").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


@query("""SELECT event_type, user_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(spark, sf):
    """An extension: the events before and after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select("event_type", "user_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), "event_id")


@query("""SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def common_nations(spark, sf):
    """An extension: set operations."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))
