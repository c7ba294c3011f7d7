"""Texts written by ear: longer terms first, places taken once, against plain Python."""

import pytest
from pyspark.sql import functions as F

from brightledger.operators import homophones

READ = {
    "gui": "归规", "mu": "母木", "jing": "净静经精", "li": "利力锂里丽", "run": "润", "ying": "营赢", "ye": "业叶", "shou": "收受", "ru": "入如", "tong": "同铜通", "bi": "比笔", "dou": "豆", "po": "粕破", "bo": "泊波",
    "mao": "毛", "lv": "率律", "zi": "紫子", "jin": "金今", "kuang": "矿况", "yan": "盐炎", "kou": "扣", "fei": "非飞",
}
READINGS = [(c, r) for r, cs in READ.items() for c in cs]
# text, context, further terms, what it becomes
CASES = [
    ("规木静力润 增长", "", [], "归母净利润 增长"), ("归母净利润与归母静利", "", [], "归母净利润与归母净利"), ("赢业受如同笔", "", [], "营业收入同比"), ("毛力律", "", [], "毛利率"), ("豆泊和豆破", "", [], "豆粕和豆粕"),
    ("里炎价格", "紫金矿业", [], "锂盐价格"), ("里炎价格", "", [], "里炎价格"), ("子今矿叶", "", ["紫金矿业"], "紫金矿业"), ("tong bi", "", [], "tong bi"), (None, "", [], ""), ("同比同笔", "", [], "同比同比"), ("飞静力", "", ["非净利"], "非净利"),
]


def plain(text, terms):
    chars = list(" ".join((text or "").split()))
    sound = lambda s: "".join(next((r for r, cs in READ.items() if c in cs), c.lower()) for c in s)
    before, locked = list(chars), [False] * len(chars)
    for t in terms:
        for i in range(len(chars) - len(t) + 1):
            run = "".join(before[i : i + len(t)])
            if any(locked[i : i + len(t)]) or not (run == t or (sound(run) == sound(t) and any("一" <= c <= "鿿" for c in run))):
                continue
            chars[i : i + len(t)] = list(t)
            locked[i : i + len(t)] = [True] * len(t)
    out = "".join(chars)
    for wrong, right in homophones.CONFUSED:
        out = out.replace(wrong, right) if right in terms else out
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t, c, m) for i, (t, c, m, _) in enumerate(CASES)], "id int, text string, context string, more array<string>")
    asked = rows.select("id", "text", homophones.known_terms(F.col("context"), F.col("more")).alias("terms"))
    readings = spark.createDataFrame(READINGS, "character string, reading string")
    return {r["id"]: r for r in asked.join(homophones.corrected(asked, readings).withColumnRenamed("text", "out"), "id").collect()}


def test_cases(found):
    for i, (text, _, _, want) in enumerate(CASES):
        assert found[i]["out"] == want == plain(text, found[i]["terms"])
        assert all(r["from"] != r["to"] and (text or "")[r["index"]] == r["from"][0] for r in found[i]["replacements"])


def test_order_of_terms(found):
    terms = found[0]["terms"]
    assert [len(t) for t in terms] == sorted((len(t) for t in terms), reverse=True) and "锂盐" not in terms and "锂盐" in found[5]["terms"]


def nodes(plan):
    yield plan
    name, inner = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        inner = [plan.executedPlan()]
    elif "QueryStage" in name:
        inner = [plan.plan()]
    for p in (*inner, *(plan.children().apply(i) for i in range(plan.children().size()))):
        yield from nodes(p)


def test_terms_of_many_texts_are_not_broadcast(spark):
    """Spark takes what is generated from a small table for small."""
    rows = spark.range(2000).select("id", F.concat(F.lit("同笔"), "id").alias("text"), homophones.known_terms(F.lit(""), F.array().cast("array<string>")).alias("terms"))
    df = homophones.corrected(rows, spark.createDataFrame(READINGS, "character string, reading string"))
    assert {r["text"] for r in df.collect()} == {f"同比{i}" for i in range(2000)}
    sent = [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "BroadcastExchange"]
    assert max(sent, default=0) < 1000


def test_texts_are_put_right_where_they_are(spark):
    """Runs of all texts are not sent through an exchange, which took ten times the table."""
    rows = spark.range(100).select("id", F.concat(F.lit("同笔"), "id").alias("text"), homophones.known_terms(F.lit(""), F.array(F.lit("西安"))).alias("terms"))
    df = homophones.corrected(rows, spark.createDataFrame(READINGS, "character string, reading string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["text"] for r in df.collect()} == {f"同比{i}" for i in range(100)}


def test_readings_that_run_together(spark):
    """A run sounds like a term if both read the same on the whole; a character may be silent, or outside the first plane."""
    readings = [("西", "xi"), ("安", "an"), ("昂", "ang"), ("先", "xian"), ("哥", "g"), ("默", ""), ("𠮷", "ji"), ("吉", "ji")]
    rows = spark.createDataFrame([(1, "去西昂", ["先哥"]), (2, "去先默", ["西安"]), (3, "去𠮷西", ["吉西"]), (4, "默默先", ["西默安"]), (5, "x先哥", ["先"])], "id int, text string, terms array<string>")
    got = {r["id"]: r["text"] for r in homophones.corrected(rows, spark.createDataFrame(readings, "character string, reading string")).collect()}
    assert got == {1: "去先哥", 2: "去西安", 3: "去吉西", 4: "西默安", 5: "x先哥"}
