"""Queries of the text, period and finance functions. Texts are built from orders, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions import citations as marks
from brightledger.functions import finance, periods, text
from brightledger.operators import extract, homophones, outline, quotes
from brightledger.plans.registry import query
from brightledger.sources.tables import table

def _id() -> Column:
    return F.col("id")


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))


#: Reports in a task, whose pages are made from small rows; texts, where each takes a while.
REPORTS = 10_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by id in as many parts as keep a part within ``REPORTS`` rows on average, so that no task grows with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // REPORTS)), "id")


def _turn(values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_id() % len(values) + 1).cast("int"))


def _of(values: tuple, key: str = "o_orderkey") -> str:
    """The same in SQL."""
    said = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{said}][CAST({key} % {len(values)} AS INTEGER) + 1]"


def _fixed(name: str, asked: tuple, wanted: tuple) -> str:
    """SQL for texts taken in turns: what each must become."""
    assert len(asked) == len(wanted)
    return f"SELECT o_orderkey AS id, {_of(wanted)} AS {name} FROM orders"


_COMPANIES = ("平安银行股份有限公司", "中信证券股份有限公司", "恒瑞医药", "贵州茅台酒股份有限公司", "某某科技", "海光信息", "寒武纪-U")
_LABELS = ("", "证券Ⅱ", "化学制药", None, "计算机设备", "半导体", "电子")


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_of(_COMPANIES)} AS n, coalesce({_of(_LABELS)}, '') AS m FROM orders) SELECT id, CASE WHEN m = '半导体' OR n = '寒武纪-U' THEN '科技' WHEN regexp_matches(m || n, '银行|证券') THEN '金融' WHEN m = '化学制药' THEN '医药' WHEN regexp_matches(n, '茅台') THEN '消费'
 WHEN m = '计算机设备' THEN '科技' ELSE '其他' END AS sector, CASE WHEN regexp_matches(n, '海光|寒武') THEN 'AI芯片' WHEN regexp_matches(n, '银行') THEN '银行' WHEN m = '证券Ⅱ' THEN '券商' WHEN m = '化学制药' THEN '创新药' WHEN regexp_matches(n, '茅台') THEN '白酒' WHEN m = '计算机设备' THEN '计算机' ELSE '待分类' END AS industry FROM o""")
def industries(spark, sf):
    """Sector and industry by the market's label, and by the name."""
    c = text.classify(_turn(_LABELS), _turn(_COMPANIES))
    return _orders(spark, sf).select("id", c["sector"].alias("sector"), c["industry"].alias("industry"))


@query(_fixed("variants", _COMPANIES, ("平安银行股份有限公司,平安银行", "中信证券股份有限公司,中信证券", "恒瑞医药,恒瑞", "贵州茅台酒股份有限公司,贵州茅台酒", "某某科技,某某", "海光信息,海光", "寒武纪-U,寒武纪")))
def names_without_endings(spark, sf):
    return _orders(spark, sf).select("id", F.array_join(text.name_variants(_turn(_COMPANIES)), ",").alias("variants"))


@query("""WITH c AS (SELECT concat('K', c_custkey, 'Z') AS code, c_name AS name, lower(substr(c_name, 1, len(c_name) - 1)) AS stem FROM customer),
 o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS form, c.* FROM orders JOIN c ON code = concat('K', o_custkey, 'Z')),
 q AS (SELECT id, form, code, CASE form WHEN 0 THEN concat(code, '怎么样') WHEN 1 THEN concat('看看', name, '的财报') WHEN 2 THEN lower(name) WHEN 3 THEN stem ELSE concat('第', id, '家') END AS query, stem FROM o)
 SELECT DISTINCT query, CASE WHEN form = 3 THEN (SELECT min(code) FROM c WHERE c.stem = q.stem) ELSE code END AS code, CAST(CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END AS INTEGER) AS stage FROM q WHERE form < 4""")
def matched_names(spark, sf):
    """Free texts on each order's customer to customers, by the best stage: a code, a whole name in the text, the name, its beginning, none."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("K"), "c_custkey", F.lit("Z")).alias("code"), F.col("c_name").alias("name"), "c_custkey")
    o = _orders(spark, sf).select("id", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey")
    stem = F.lower(F.expr("substring(name, 1, length(name) - 1)"))
    form = lambda n: F.col("id") % 5 == n
    said = F.when(form(0), F.concat("code", F.lit("怎么样"))).when(form(1), F.concat(F.lit("看看"), "name", F.lit("的财报"))).when(form(2), F.lower("name")).when(form(3), stem)
    return text.match_names(o.select(said.otherwise(F.concat(F.lit("第"), "id", F.lit("家"))).alias("query")), c.select("code", "name"))


@query("""SELECT o_orderkey AS id, CASE WHEN k = 0 THEN concat('净利润', v, '亿元[P', a, ']，财务费用减少', w, '亿元[P', b, ']。') WHEN k = 1 THEN concat('净利润', v, '亿元[P', a, ']，财务费用减少', w, '亿元[P', b, ']。')
  ELSE concat('净利润有所增长[P', a, ']；财务费用下降[P', b, ']。') END AS answer FROM (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 300 + 1 AS a, o_orderkey % 200 + 301 AS b, printf('%.2f', (o_orderkey % 9000 + 1000) / 100.0) AS v, 1000000 + o_orderkey AS w FROM orders)""")
def placed_citations(spark, sf):
    """Marks of evidence as marks of pages: inside the text, dealt from a pile to numbers, and to clauses."""
    v, w = F.format_string("%.2f", (_id() % 9000 + 1000) / 100), (_id() + 1000000).cast("string")
    k = _id() % 3
    text_of = F.when(k < 2, F.concat(F.lit("净利润"), v, F.lit("亿元"), F.when(k == 0, "【E1】").otherwise(""), F.lit("，财务费用减少"), w, F.lit("亿元。"))).otherwise("净利润有所增长；财务费用下降。")
    answer = F.concat(text_of, F.when(k == 0, " [E 2]【E9】").otherwise("【E1】【E2】"))
    one = F.struct(F.lit("E1").alias("id"), (_id() % 300 + 1).cast("int").alias("page"), F.when(k < 2, F.concat(F.lit("净利润"), v)).otherwise("净利润上升").alias("quote"), F.lit("r").alias("report"))
    two = F.struct(F.lit("e2").alias("id"), (_id() % 200 + 301).cast("int").alias("page"), F.when(k < 2, F.concat(F.lit("财务费用"), w)).otherwise("财务费用").alias("quote"), F.lit("r").alias("report"))
    return _orders(spark, sf).select("id", marks.with_page_marks(answer, F.array(one, two)).alias("answer"))


@query("SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'a') AND contains(lower(p_name || ' ' || p_type), 'steel') AS has FROM part")
def all_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.all_terms("A Steel", F.concat_ws(" ", "p_name", "p_type")).alias("has"))


_QUESTIONS = ("%y年%c的营收增长多少？", "%c", "%c 去年年报 H1", "（600519）怎么样", "今年第二季度%c净利润 同比 变化")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, 'C' || o_custkey AS c FROM orders)
 SELECT id, CASE k WHEN 0 THEN c || '的' WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN '600519' ELSE c END AS subject, k IN (0, 3, 4) OR (k = 2 AND len(c) >= 4) AS is_question FROM o""")
def questions(spark, sf):
    """What questions on each order's customer are about, and whether they are questions."""
    q = F.replace(F.replace(_turn(_QUESTIONS), F.lit("%y"), F.year("o_orderdate").cast("string")), F.lit("%c"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    q = F.regexp_replace(q, "^19", "20")
    return _orders(spark, sf).select("id", text.without_noise(q).alias("subject"), text.asks(q).alias("is_question"))


_TITLES = ("问询函", "风险提示", "", "业绩快报", "关注函", "预告", "摘要")


@query(f"SELECT o_orderkey AS id, array_to_string(list_filter([{_of(_TITLES)}, CASE WHEN o_orderkey % 2 = 0 THEN '更正' END, {_of(('', '取消', '补充', '修订', ''))}], lambda x: x <> ''), ',') AS words FROM orders")
def attention_words(spark, sf):
    """Words of titles with each order's state and customer that call for attention."""
    title = F.concat(F.lit("关于收到"), _turn(_TITLES), F.lit("公告"), F.col("o_orderstatus"), F.when(_id() % 2 == 0, "的更正").otherwise(""), F.col("o_custkey").cast("string"), _turn(("", "取消", "补充", "修订", "")))
    return _orders(spark, sf).select("id", F.array_join(text.attention(title), ",").alias("words"))


_BLANK = r"[\s\x0B\x{A0}\x{3000}]"


@query(rf"""WITH d AS (SELECT doc_id, string_split(text, '') AS c, regexp_replace(text, '{_BLANK}', '', 'g') AS t, regexp_replace(substr(text, 21, 40), '{_BLANK}', '', 'g') AS q FROM documents),
 s AS (SELECT doc_id, q, strpos(t, q) AS k, list_filter(range(len(c)), lambda i: NOT regexp_matches(c[i + 1], '{_BLANK}')) AS spots FROM d)
 SELECT doc_id, CASE WHEN q <> '' THEN spots[k] END AS starts_at, CASE WHEN q <> '' THEN spots[k + len(q) - 1] + 1 END AS ends_at FROM s""")
def quote_places(spark, sf):
    """Where each text's own middle stands if white space does not count, in the text's own characters; null for null and short texts."""
    d = table(spark, sf, "documents").withColumn("r", quotes.quote_range(F.col("text"), F.substring("text", 21, 40)))
    return d.select("doc_id", F.col("r.start").cast("long").alias("starts_at"), F.col("r.end").cast("long").alias("ends_at"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(4 + (o_orderkey % 3 = 0)::INTEGER AS INTEGER) AS page, printf('%.2f', (o_orderkey % 9000 + 1000) / 100.0) AS p FROM orders WHERE o_orderkey % 7 > 0),
 t AS (SELECT *, concat('第', id, '号公告。', chr(10), ' 应收账款  变动率 ', chr(9), p, '%，主要系客户', chr(10), '回款所致。其他说明见附注。') AS content FROM o)
 SELECT id AS question_id, page, concat('应收账款 变动率 ', p, '%，主要系客户 回款所致') AS quote, CAST(strpos(content, '应收账款') - 1 AS INTEGER) AS starts_at, CAST(strpos(content, '所致') + 1 AS INTEGER) AS ends_at FROM t""")
def question_quotes(spark, sf):
    """What on a page answers a question on a changed figure: on the cited page, for some on the next, for some nowhere."""
    p = F.format_string("%.2f", (_id() % 9000 + 1000) / 100)
    o = _orders(spark, sf).select("id", p.alias("p"))
    said = F.concat(F.lit("第"), "id", F.lit("号公告。\n 应收账款  变动率 \t"), F.when(_id() % 7 > 0, F.concat("p", F.lit("%，主要系客户\n回款所致。其他说明见附注。"))).otherwise("不适用"))
    pages = o.select("id", F.explode(F.array(F.lit(4), F.lit(5))).alias("page"), said.alias("said")).select(
        "id", "page", F.when(F.col("page") == F.when(_id() % 3 == 0, 5).otherwise(4), F.col("said")).otherwise("本页无此数字。").alias("content"))
    asked = o.select(_id().alias("question_id"), "id", F.lit(4).alias("page"), F.concat(F.lit("应收账款的变动率是"), "p", F.lit("%是什么影响的")).alias("question"))
    return quotes.page_quotes(asked, pages, "id").select("question_id", "page", "quote", F.col("start").alias("starts_at"), F.col("end").alias("ends_at"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d[0-9,]*(?:\.[0-9]+)?%?'), ' ') AS numbers FROM documents")
def numbers_in_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.number_tokens(F.col("text")), " ").alias("numbers"))


@query(_fixed("grams", (0, 1, 2), ("净利润,利润增,润增长,净利润增,利润增长", "", "营业收,业收入,营业收入")))
def chinese_grams(spark, sf):
    return _orders(spark, sf).select("id", F.array_join(text.ngrams(_turn(("净利润增长 ok", "profit", "营业收入 报告期"))), ",").alias("grams"))


@query("SELECT o_orderkey AS quote_id, 4 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS page, 1 AS hits FROM orders WHERE o_orderkey % 3 > 0")
def quoted_pages(spark, sf):
    """Numbers of a quote are on its page or, for even keys, on the next one; of every third report on neither."""
    o = _orders(spark, sf)
    number = F.concat((_id() + 100000).cast("string"), F.lit("%"))
    quotes = o.select(_id().alias("quote_id"), _id().alias("report"), F.lit(4).alias("page"), F.concat(F.lit("up "), number).alias("quote"))
    page = F.when(_id() % 3 == 0, 9).when(_id() % 2 == 0, 5).otherwise(4)
    pages = o.select(_id().alias("report"), page.alias("page"), F.concat(F.lit("by "), number).alias("content")).unionByName(o.select(_id().alias("report"), F.lit(3).alias("page"), F.lit("nothing").alias("content")))
    return text.best_page(pages, quotes, "report")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '1,2' ELSE '2' END AS cited, CASE WHEN o_orderkey % 2 = 0 THEN '收入增长[P7]，利润下降' ELSE '利润下降' END AS pages, CASE WHEN o_orderkey % 2 = 0 THEN '收入增长，利润下降' ELSE '利润下降' END AS plain FROM orders")
def citations(spark, sf):
    """Marks of evidence: which, as pages, and without."""
    answer = F.when(_id() % 2 == 0, "收入增长【E1】，利润下降【E2】").otherwise("利润下降【E2】")
    return _orders(spark, sf).select("id", F.array_join(text.cited(answer), ",").alias("cited"), text.page_citations(answer, F.create_map(F.lit("1"), F.lit(7))).alias("pages"), text.without_citations(answer).alias("plain"))


@query("""SELECT k AS id, n AS number FROM (SELECT o_orderkey AS k, o_orderkey % 10000 AS n FROM orders) WHERE n > 0""")
def chinese_numbers(spark, sf):
    """Every number below ten thousand that occurs, spelled out and read again."""
    n, digit = _id() % 10000, lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    parts = [F.floor(n / 1000).cast("int"), F.floor(n / 100).cast("int") % 10, F.floor(n / 10).cast("int") % 10, (n % 10).cast("int")]
    spelled = F.concat(*[F.when(p > 0, F.concat(digit(p), F.lit(u))).otherwise("零") for p, u in zip(parts, "千百十 ", strict=True)])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(spelled, F.lit(" "), F.lit("")), "零+", "零"), "^零|零$", ""), "^$", "零")
    return _orders(spark, sf).select("id", n.alias("n"), plain.alias("t")).filter("n > 0").select("id", text.chinese_number(F.col("t")).cast("long").alias("number"))


@query("SELECT o_orderkey AS report, ['第一节 概述', '第二节 公司简介', '第三节 财务'][k] AS title, [3, 5 + o_orderkey % 7, 30][k] AS start_page, [4 + o_orderkey % 7, 29, NULL][k] AS end_page FROM orders, range(1, 4) t(k)")
def contents_pages(spark, sf):
    line = lambda title, page: F.concat(F.lit(title + " ........ "), page.cast("string"), F.lit("\n"))
    content = F.concat(F.lit("目录\n"), line("第一节 概述", F.lit(3)), line("第二节 公司简介", _id() % 7 + 5), line("第三节 财务", F.lit(30)))
    rows = extract.table_of_contents(_orders(spark, sf).select(_id().alias("report"), F.lit(2).alias("page"), content.alias("content")), "report")
    end = F.when(F.col("start_page") < 30, F.col("end_page"))  # the last section has no next one
    return rows.select("report", "title", F.col("start_page").cast("long").alias("start_page"), end.cast("long").alias("end_page"))


_ANSWERS = ('<think>maybe {"a": 1}</think>```json\n{"summary": "s", "confidence": 1.7, "points": [{"title": "t", "text": "x", "page": 3}, {"title": " ", "text": "y"}]}\n```', "no json here", '{"summary": " "}')


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 's' END AS summary, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 't:x:3' END AS points, o_orderkey % 3 <> 1 AS has_json FROM orders")
def parsed_verdicts(spark, sf):
    """Verdicts out of a model's texts, with thoughts, fences and blank points."""
    rows = _orders(spark, sf).select("id", _turn(_ANSWERS).alias("answer")).select("id", text.parse_verdict(F.col("answer")).alias("v"), text.unwrap_json(F.col("answer")).isNotNull().alias("has_json"))
    points = F.array_join(F.transform("v.points", lambda p: F.concat_ws(":", p["title"], p["text"], p["page"].cast("string"))), ",")
    return rows.select("id", F.col("v.summary").alias("summary"), F.col("v.confidence").alias("confidence"), points.alias("points"), "has_json")


_ERRORS = (None, "Error: ", "error: Downloaded object is not a pdf today", "交易所拦截了 PDF，请稍后", "PDF ", "Error:PDF ", "failed ")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 2 THEN '下载内容不是 PDF' WHEN 3 THEN '交易所拦截了 PDF 下载' WHEN 4 THEN 'PDF 请求失败（' || o_custkey || '）' WHEN 5 THEN 'PDF 请求失败（' || o_custkey || '）' WHEN 6 THEN 'failed ' || o_custkey END AS said FROM orders""")
def errors_in_words(spark, sf):
    raw = F.concat(_turn(_ERRORS), F.when(_id() % 7 >= 4, F.col("o_custkey").cast("string")).otherwise(""))
    return _orders(spark, sf).select("id", text.error_text(raw).alias("said"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Revenue?|Margin|Debt' ELSE 'Margin|Debt|Cash' END AS texts FROM orders")
def merged_texts(spark, sf):
    """Generated texts, then others: each once by normal form, none that was excluded, three at most."""
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    excluded = F.when(_id() % 2 == 0, F.array().cast("array<string>")).otherwise(strings("revenue"))
    return _orders(spark, sf).select("id", F.array_join(text.merge_texts(strings("Revenue?", "Margin", "margin!"), strings("REVENUE", "Debt", "Cash", "Tax"), excluded), "|").alias("texts"))


@query("SELECT o_orderkey AS id, CASE WHEN length(t) <= 60 THEN t ELSE left(t, 59) || '…' END AS text FROM (SELECT o_orderkey, 'customer ' || o_custkey || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN repeat('a', 50) || chr(10) ELSE '' END || o_orderstatus AS t FROM orders)")
def snapshots(spark, sf):
    lines = [F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.when(_id() % 2 == 0, F.repeat(F.lit("a"), F.lit(50))), F.col("o_orderstatus")]
    return _orders(spark, sf).select("id", text.snapshot(lines, 60).alias("text"))


@query("""SELECT id, CASE WHEN m >= 11 THEN y || 'Q3' WHEN m >= 9 THEN y || 'H1' WHEN m >= 5 THEN y || 'Q1' ELSE (y - 1) || 'FY' END AS latest FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)""")
def latest_expected(spark, sf):
    return _orders(spark, sf).select("id", periods.latest_expected(F.col("o_orderdate")).alias("latest"))


_HINTS = ("%sh1 怎么样", "去年年报%s", "99年年报", "%s年第二季度", "今年季报", "前年半年报", "看%s二季报", "%s Q3", "%s年中报", "没有", "%s年年度报告")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN y || 'H1' WHEN 1 THEN y || 'FY' WHEN 2 THEN '1999FY' WHEN 3 THEN y || 'Q2' WHEN 5 THEN '2024H1' WHEN 6 THEN y || 'Q2' WHEN 7 THEN y || 'Q3' WHEN 8 THEN y || 'H1' WHEN 10 THEN y || 'FY' END AS hint,
 CASE WHEN o_orderkey % 11 IN (4, 9) THEN NULL WHEN o_orderkey % 11 = 5 THEN true ELSE o_orderkey % 11 IN (0, 3, 6, 8) AND y = '2024' END AS fits FROM (SELECT o_orderkey, CAST(year(o_orderdate) + 28 AS VARCHAR) AS y FROM orders)""")
def period_hints(spark, sf):
    """The period a free text asks for, on a day of 2026, and whether 2024Q2 is that."""
    asked = F.replace(_turn(_HINTS), F.lit("%s"), (F.year("o_orderdate") + 28).cast("string"))
    hint = periods.period_hint(asked, F.lit("2026-05-01").cast("date"))
    return _orders(spark, sf).select("id", hint.alias("hint"), periods.matches_hint(F.lit("2024Q2"), hint).alias("fits"))


@query("""SELECT event_id, CASE WHEN ts IS NULL THEN '尚未抓取' WHEN m < 60 THEN m || ' 分钟前' WHEN m < 1440 THEN (m // 60) || ' 小时前' ELSE (m // 1440) || ' 天前' END AS fresh, coalesce(date_trunc('day', ts) = DATE '2024-03-01', false) AS today, coalesce(ts >= TIMESTAMP '2024-02-23 12:00:00', false) AS this_week
 FROM (SELECT event_id, ts, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-03-01 12:00:00') - epoch_us(ts)) / 60e6 + 0.5) AS BIGINT)) AS m FROM (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN ts END AS ts FROM events))""")
def freshness(spark, sf):
    from brightledger.sources.tables import events_with_time

    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    e = events_with_time(spark, sf).withColumn("ts", F.when(F.col("event_id") % 50 > 0, F.col("ts")))
    return e.select("event_id", periods.freshness(F.col("ts"), now).alias("fresh"), periods.updated_today(F.col("ts"), now).alias("today"), periods.updated_this_week(F.col("ts"), now).alias("this_week"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS i, o_orderkey % 9 - 4 AS gate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 END AS ago, o_orderkey % 7 = 0 AS full_, o_orderkey % 13 > 0 AS auto_ FROM orders),
 w AS (SELECT *, greatest(CASE WHEN ago < 30 THEN 30 - ago ELSE 0 END, CASE WHEN gate > 0 THEN gate ELSE 0 END) + i * 8 AS w FROM o)
 SELECT id, CAST(CASE WHEN auto_ AND (NOT full_ OR ago IS NOT NULL) AND w > 0 THEN w END AS DOUBLE) AS seconds,
  CASE WHEN NOT auto_ THEN '自动抓取已关：排队任务暂不开始下载' WHEN full_ AND ago IS NULL THEN CASE WHEN i = 0 THEN '等待下载槽空闲' ELSE '排队第 ' || (i + 1) || ' 位' END
   WHEN ago IS NOT NULL THEN CASE WHEN w > 0 THEN '上次失败，' || w || 's 后重试' ELSE '上次失败，即将重试' END WHEN w > 0 THEN '约 ' || w || 's 后可下载' WHEN i = 0 THEN '即将领取' ELSE '排队第 ' || (i + 1) || ' 位' END AS reason FROM w""")
def download_waits(spark, sf):
    """How long queued downloads wait, and why."""
    ago = F.when(_id() % 3 == 0, (_id() % 60).cast("double"))
    wait = periods.download_wait(_id() % 5, F.lit(7.5), _id() % 9 - 4.0, ago, _id() % 7 == 0, _id() % 13 > 0)
    return _orders(spark, sf).select("id", wait["seconds"].alias("seconds"), wait["reason"].alias("reason"))


@query(f"""SELECT o_orderkey AS id, coalesce(CASE WHEN kind IS NOT NULL THEN '2020' || kind END, '1999FY') AS period FROM (SELECT o_orderkey, {_of(("FY", "H1", "Q1", None))} AS kind FROM orders)""")
def healed_periods(spark, sf):
    """The title's period goes before the stored one, unless the title is of no report."""
    title = _turn(("2020年年度报告", "2020年半年度报告", "2020年第一季度报告", "关于召开会议的通知"))
    return _orders(spark, sf).select("id", periods.effective_period(title, F.col("o_orderdate").cast("timestamp"), F.lit("1999FY")).alias("period"))


_OWN = ("平安银行：2020年年度报告", "某某：别家科技股份有限公司2020年年度报告", "某某：平安银行股份有限公司2020年年度报告")


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 1 AS own FROM orders")
def own_issuers(spark, sf):
    return _orders(spark, sf).select("id", periods.names_own_issuer(F.lit("平安银行股份有限公司"), _turn(_OWN)).alias("own"))


_CHANGES = """c AS (SELECT o_orderkey AS id, o_totalprice - 150000 AS v, o_totalprice / 2 - 50000 AS x, CASE WHEN o_orderkey % 4 = 0 THEN CAST(12.5 AS DOUBLE) END AS pct, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice - 100000 END AS p FROM orders)"""


@query(f"""WITH {_CHANGES}, k AS (SELECT *, CASE WHEN pct IS NULL THEN coalesce(p, x) END AS b FROM c) SELECT id, CASE WHEN pct IS NOT NULL OR p IS NOT NULL THEN 'disclosed' ELSE 'computed' END AS source,
 CASE WHEN pct IS NOT NULL THEN pct WHEN b = 0 OR (v > 0 AND b < 0) OR (v < 0 AND b > 0) THEN NULL ELSE (v - b) / abs(b) * 100 END AS pct,
 CASE WHEN pct IS NOT NULL THEN 'pct' WHEN b = 0 OR (v > 0 AND b < 0) OR (v < 0 AND b > 0) THEN 'qualitative' WHEN v = b THEN 'flat' ELSE 'pct' END AS kind FROM k WHERE abs(v) > 2000 AND (b IS NULL OR (abs(b) > 2000 AND abs(v) < 4 * abs(b)))""")
def resolved_changes(spark, sf):
    """Changes by the best evidence: the filing's percentage, its base, or the other filing's value."""
    rows = _orders(spark, sf).select("id", (F.col("o_totalprice") - 150000).alias("v"), (F.col("o_totalprice") / 2 - 50000).alias("x"), F.when(_id() % 4 == 0, 12.5).alias("pct"), F.when(_id() % 4 == 1, F.col("o_totalprice") - 100000).alias("p"))
    base = F.when(F.col("pct").isNull(), F.coalesce("p", "x"))
    rows = rows.filter((F.abs("v") > 2000) & (base.isNull() | ((F.abs(base) > 2000) & (F.abs("v") < 4 * F.abs(base)))))
    out = finance.resolve_yoy(rows, "y", F.col("v"), F.col("p"), F.col("pct"), F.col("x"), F.lit("revenue"))
    return out.select("id", F.col("y.source").alias("source"), F.when(~F.col("y.na_percent"), F.col("y.pct")).alias("pct"), F.col("y.kind").alias("kind"))


@query("""SELECT o_orderkey AS id, r / (1 + g / 100) AS implied, CASE WHEN r > 0 THEN c / r * 100 END AS debt, CASE WHEN p > 0 THEN c / p * 100 END AS conversion, CASE WHEN r > 0 THEN (r - c) / r * 100 END AS margin, (r - q) * (p / q) AS from_revenue, c - p - (r - q) * (p / q) AS from_margin
 FROM (SELECT o_orderkey, o_totalprice AS r, o_orderkey % 90 AS g, o_totalprice * 0.6 AS c, o_totalprice - 200000 AS p, o_totalprice * 0.8 AS q FROM orders)""")
def ratios(spark, sf):
    """Implied bases, ratios and what revenue and margin bring to profit."""
    r = F.col("o_totalprice")
    c, p, q = r * 0.6, r - 200000, r * 0.8
    bridge = finance.profit_bridge(r, q, c, p)
    return _orders(spark, sf).select("id", finance.implied_prior(r, _id() % 90).alias("implied"), finance.debt_ratio(c, r).alias("debt"), finance.cash_conversion(c, p).alias("conversion"), finance.gross_margin(r, c).alias("margin"),
                                     bridge["from_revenue"].alias("from_revenue"), bridge["from_margin"].alias("from_margin"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_totalprice / 1e5 AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 5e4 END AS h, o_totalprice / 1e5 * CASE o_orderkey % 2 WHEN 0 THEN 3.0 ELSE 1.0 END AS w FROM orders)
 SELECT id, CASE WHEN off AND h IS NOT NULL THEN a + h ELSE a END AS converted, off AND h IS NOT NULL AS folded, CASE WHEN off AND h IS NULL THEN 'BAD' ELSE 'OK' END AS status FROM (SELECT *, abs(w - a) > greatest(0.02, 0.01 * w) AS off FROM q)""")
def third_quarters(spark, sf):
    """Earnings a share of a third quarter alone, or with the half year where only that fits."""
    r = F.col("o_totalprice")
    rows = _orders(spark, sf).select("id", (r / 1e5).alias("a"), F.when(_id() % 3 > 0, r / 5e4).alias("h"), (r / 1e5 * F.when(_id() % 2 == 0, 3.0).otherwise(1.0)).alias("w"))
    rows = rows.withColumn("c", finance.comparable_q3(F.col("w"), F.col("a"), F.col("h"), F.lit("eps")))
    return rows.select("id", F.col("c.converted").alias("converted"), F.col("c.folded").alias("folded"), finance.check_status(F.col("w"), F.col("a"), F.col("c.converted"), F.lit("eps")).alias("status"))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 5 = 0 THEN 3.0 ELSE greatest(1.0, least(9.0, floor(c_acctbal / 1000 + 0.5))) END AS DOUBLE) AS setting FROM customer")
def clamped_settings(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), finance.clamp(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 1000), 1, 9, 3).alias("setting"))


@query("""WITH o AS (SELECT o_orderkey AS report, round(o_totalprice, 2) AS v, round(o_totalprice * 0.8, 2) AS p FROM orders)
 SELECT report, v AS value, CASE WHEN p >= 1000 THEN p END AS prior_value, CAST(CASE WHEN report % 5 > 0 THEN 25.5 END AS DOUBLE) AS yoy_pct, 2 AS source_page,
  CAST(round(0.91 + CASE WHEN report % 2 = 0 THEN 0.05 ELSE 0 END - CASE WHEN report % 6 = 3 THEN 0.12 ELSE 0 END, 2) AS DOUBLE) AS confidence FROM o WHERE v >= 1000""")
def extracted_revenue(spark, sf):
    """Revenue out of page texts: a table of key figures, a page that agrees for even keys, and for some a rival. Amounts under 1000 yuan are
    no revenue, and no prior revenue."""
    v, p = F.format_string("%.2f", F.round("o_totalprice", 2)), F.format_string("%.2f", F.round(F.col("o_totalprice") * 0.8, 2))
    o = _dealt(_orders(spark, sf)).select(_id().alias("report"), "id", v.alias("v"), p.alias("p"), (F.round("o_totalprice", 2) >= 1000).alias("large"))
    change = F.when(_id() % 5 > 0, " 25.5%").otherwise("")
    key = o.select("report", F.lit(2).alias("page"), F.concat(F.lit("主要会计数据 单位：元\n营业收入 "), "v", F.lit(" "), "p", change).alias("content"))
    rival = F.concat(F.lit("合并利润表 单位：元\n营业收入 "), F.when(_id() % 2 == 0, F.col("v")).when(_id() % 6 == 3, F.lit("999999999.00 5000.00")).otherwise("-"))
    other = o.filter("large").select("report", F.lit(7).alias("page"), rival.alias("content"))
    found = extract.metrics(key.unionByName(other), "report").filter("metric = 'revenue'")
    return found.select("report", F.round("value", 2).alias("value"), F.round("prior_value", 2).alias("prior_value"), "yoy_pct", F.col("source_page"), "confidence")


#: Metrics in money with a label of each, in the order in which they stand on the page, and what the choice's confidence must be.
_LINES = (
    ("revenue", "营业总收入", 0.94), ("net_profit", "归属于上市公司股东的净利润", 0.91), ("total_assets", "资产总计", 0.94), ("total_liabilities", "负债合计", 0.94),
    ("operating_cash_flow", "经营活动产生的现金流量净额", 0.94), ("operating_cost", "营业成本", 0.94), ("non_recurring_pnl", "非经常性损益合计", 0.96),
    ("profit_ex_non_recurring", "扣除非经常性损益后归属于母公司所有者的净利润", 0.96), ("cash_and_equivalents", "货币资金", 0.82), ("restricted_cash", "受限货币资金", 0.94),
    ("short_term_borrowings", "短期借款", 0.94), ("long_term_borrowings", "长期借款", 0.94), ("bonds_payable", "应付债券", 0.94), ("current_portion_debt", "一年内到期的非流动负债", 0.94),
    ("goodwill", "商誉", 0.94), ("equity_parent", "归属于母公司股东的权益", 0.94),
)


@query(f"""WITH m AS (SELECT unnest([{", ".join(f"{{'k': {k}, 'metric': '{m}', 'label': '{label}', 'c': {c}}}" for k, (m, label, c) in enumerate(_LINES))}]) AS m),
 o AS (SELECT c_custkey AS report, c_custkey % 5 AS form, m.k, m.metric, m.label, m.c, CAST(round(c_acctbal * 100) AS BIGINT) + 500000 + 100000 * m.k AS cents FROM customer, m),
 t AS (SELECT *, CASE form WHEN 3 THEN 1000 WHEN 4 THEN -1 ELSE 1 END * cents / 100 AS value, CASE form WHEN 0 THEN (cents * 4 // 5) / 100 WHEN 2 THEN (cents * 2 // 5) / 100 WHEN 3 THEN (cents * 4 // 5) * 10.0 WHEN 4 THEN (cents * 4 // 5) / 100 END AS prior FROM o)
 SELECT report, metric, label AS source_label, CAST(round(value, 2) AS DOUBLE) AS value, CAST(round(prior, 2) AS DOUBLE) AS prior_value, CAST(CASE form WHEN 0 THEN 25.5 WHEN 1 THEN 3.5 WHEN 2 THEN 88.8 WHEN 4 THEN -12.5 END AS DOUBLE) AS yoy_pct, CAST(CASE WHEN form = 3 AND metric = 'non_recurring_pnl' THEN 0.9 ELSE c END AS DOUBLE) AS confidence FROM t
 UNION ALL SELECT c_custkey, 'eps', '基本每股收益', (c_custkey % 500 + 100) / 100, 0.5, 8.5, 0.96 FROM customer
 UNION ALL SELECT c_custkey, 'roe', '加权平均净资产收益率', (c_custkey % 2000 + 100) / 100, 5.25, NULL, 0.96 FROM customer""")
def extracted_metrics(spark, sf):
    """All 18 metrics of a page, in five forms of its columns: prior value and change, a bare change before the year to date, a restated prior
    value, a unit in the label, and a negative figure in brackets."""
    shown = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    amounts = lambda c: F.struct(F.lit(" ").alias("gap"), shown(c).alias("v"), shown(F.floor(c * 4 / 5)).alias("p"), shown(F.floor(c * 2 / 5)).alias("q"), shown(c * 3).alias("ytd"))

    def line(x: Column) -> Column:
        a, form = x["a"], _id() % 5
        return F.concat(
            F.lit("\n"), x["label"], F.when(form == 3, "（千元） ").when(form == 4, " (").otherwise(" "), a["v"], F.when(form == 4, ") ").otherwise(" "),
            F.when(form == 1, F.concat(F.lit("3.5 "), a["ytd"], F.lit(" 1.2"))).otherwise(a["p"]), F.when(form == 2, F.concat(F.lit(" "), a["q"])).otherwise(""),
            F.when(form == 0, " 25.5%").when(form == 2, " 88.8%").when(form == 4, " (12.5%)").otherwise(""),
        )

    labels = F.array(*[F.lit(label) for _, label, _ in _LINES])
    lines = F.transform(labels, lambda label, k: F.struct(label.alias("label"), amounts(F.round(F.col("c_acctbal") * 100).cast("long") + 500000 + 100000 * k).alias("a")))
    small = [F.lit("\n基本每股收益（元/股） "), shown(_id() % 500 + 100), F.lit(" 0.50 8.5%\n加权平均净资产收益率 "), shown(_id() % 2000 + 100), F.lit("% 5.25%\n")]
    page = F.concat(F.lit("主要会计数据 单位：元"), F.array_join(F.transform(lines, line), ""), *small)
    pages = _dealt(table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))).select(_id().alias("report"), F.lit(3).alias("page"), page.alias("content"))
    return extract.metrics(pages, "report").select("report", "metric", "source_label", F.round("value", 2).alias("value"), F.round("prior_value", 2).alias("prior_value"), "yoy_pct", "confidence")


_OPINIONS = ("公司聘请的会计师事务所出具了标准无保留意见的审计报告。", "会计师事务所出具了非标准无保留意见。", "本期为带强调事项段的无保留意见。", "注册会计师对本报告无法表示意见。", "上年审计机构发表保留意见的说明。", "公司简介一切正常，没有其他。")
_BASE = (0.55 + 0.35 + 0.2 + 0.15, 0.64 + 0.2 + 0.15, 0.68, 0.72 + 0.2, 0.66 + 0.15 - 0.45, None)


@query(f"""WITH o AS (SELECT o_orderkey AS report, CAST(o_orderkey % 20 + 1 AS INTEGER) AS page, {_of(("unqualified", "qualified", "unqualified_emphasis", "disclaimer", "qualified", None))} AS type, {_of(_BASE)} AS s,
 {_of(("标准无保留意见", "非标准审计意见", "带强调事项的无保留意见", "无法表示意见", "保留意见", None))} AS label FROM orders)
 SELECT report, type, label, CASE WHEN type = 'unqualified' THEN 'standard' ELSE 'non_standard' END AS kind, page, CAST(round(s + CASE WHEN page <= 12 THEN 0.08 ELSE 0 END, 6) AS DOUBLE) AS score FROM o WHERE type IS NOT NULL""")
def opinions(spark, sf):
    """Audit opinions of one sentence each, with what stands around them."""
    pages = _orders(spark, sf).select(_id().alias("report"), (_id() % 20 + 1).cast("int").alias("page"), _turn(_OPINIONS).alias("content"))
    return extract.audit_opinions(pages, "report")


_HEARD = (("营业受入", "营业收入"), ("应受帐款", "应收账款"), ("豆泊", "豆粕"), ("同笔", "同比"), ("现金", "现金"))
_READINGS = (("收", "shou"), ("受", "shou"), ("账", "zhang"), ("帐", "zhang"), ("比", "bi"), ("笔", "bi"), ("应", "ying"), ("营", "ying"), ("业", "ye"), ("入", "ru"), ("款", "kuan"), ("同", "tong"))


@query(f"SELECT o_orderkey AS id, o_custkey || {_of(tuple(b for _, b in _HEARD))} || '增长' || o_orderstatus AS text, CAST(o_orderkey % 5 IN (0, 1, 3) AS INTEGER) AS n FROM orders")
def heard_texts(spark, sf):
    """Spoken words on each order, put right by how they sound."""
    said = F.concat(F.col("o_custkey").cast("string"), _turn(tuple(a for a, _ in _HEARD)), F.lit("增长"), F.col("o_orderstatus"))
    dealt = _dealt(_orders(spark, sf).select("id", "o_custkey", "o_orderstatus"))
    rows = dealt.select("id", said.alias("text"), homophones.known_terms(F.lit(""), F.array().cast("array<string>")).alias("terms"))
    found = homophones.corrected(rows, spark.createDataFrame(list(_READINGS), "character string, reading string"))
    return found.select("id", "text", F.size("replacements").alias("n"))


@query("""SELECT c_custkey AS report, ['第一节 概述', '第二节 公司简介', '第三节 财务'][k] AS title, [3, 6 + c_custkey % 7, 30][k] AS page, [5 + c_custkey % 7, 29, 30][k] AS end_page, 'toc' AS source FROM customer, range(1, 4) t(k) WHERE c_custkey % 5 > 0
 UNION ALL SELECT c_custkey, title, page, [5 + c_custkey % 7, 30][k], 'standard' FROM (SELECT c_custkey, k, ['管理层讨论与分析', '公司治理'][k] AS title, [3, 6 + c_custkey % 7][k] AS page FROM customer, range(1, 3) t(k) WHERE c_custkey % 5 = 0) WHERE k = 1
 UNION ALL SELECT c_custkey, '公司治理', 6 + c_custkey % 7, 6 + c_custkey % 7, 'standard' FROM customer WHERE c_custkey % 5 = 0""")
def outlines(spark, sf):
    """Sections of each customer's report, by its contents page, or for every fifth, which has none, by what pages begin with."""
    c = table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))
    toc = _id() % 5 > 0
    second, contents = (_id() % 7 + 5).cast("int"), "目录\n第一节 概述 ........ 3\n第二节 公司简介 …… P"
    page = lambda at, text: F.struct(at.cast("int").alias("page"), text.alias("content"))
    every = F.array(
        page(F.lit(2), F.when(toc, F.concat(F.lit(contents), second.cast("string"), F.lit("\n第三节 财务 .... 30"))).otherwise("封面")), page(F.lit(3), F.when(toc, "第一节 概述 正文").otherwise("管理层讨论与分析 正文")),
        page(second + 1, F.when(toc, "第二节 公司简介 正文").otherwise("公司治理 正文")), page(F.lit(30), F.lit("正文")),
    )
    found = outline.outline(c.select(_id().alias("report"), F.inline(every)), "report")
    return found.select("report", "title", "page", "end_page", "source")
