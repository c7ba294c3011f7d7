"""Text of filings, names and answers, as Columns; white space includes the full-width space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.binding import let
from brightledger.operators.contains import contained, met
from brightledger.operators.rank import first_rows, held

SPACE = r"(?U)\s+"


def normal_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), SPACE, ""))


def logical_id(code: Column, published: Column, title: Column) -> Column:
    """A filing's id by content: company, day and title."""
    return F.sha2(F.concat_ws("|", code, F.date_format(published, "yyyy-MM-dd"), normal_title(title)), 256)


def clip(text: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


# Sector and industry by the words of a market's label; the first that fits counts.
MARKET_INDUSTRIES = (
    ("银行", "金融", "银行"), ("保险", "金融", "保险"), ("证券|券商", "金融", "券商"), ("多元金融|非银", "金融", "非银金融"),
    ("白酒", "消费", "白酒"), ("乳制品|乳品", "消费", "乳制品"), ("调味", "消费", "调味品"), ("啤酒", "消费", "啤酒"), ("家用电器|白色家电|黑色家电|小家电|家电", "消费", "家电"), ("免税", "消费", "免税"),
    ("农林牧渔|养殖|饲料|农产品", "消费", "农林牧渔"), ("食品饮料", "消费", "食品饮料"), ("商贸零售|零售", "消费", "商贸零售"), ("社会服务|酒店|旅游", "消费", "社会服务"), ("传媒", "消费", "传媒"),
    ("半导体|集成电路", "科技", "半导体"), ("消费电子", "科技", "消费电子"), ("光模块|光通信", "科技", "光通信"), ("面板|显示器件", "科技", "面板"), ("存储", "科技", "存储"),
    ("计算机设备|计算机应用|软件|计算机", "科技", "计算机"), ("通信", "科技", "通信设备"), ("电子", "科技", "电子"),
    ("电池|锂电", "新能源", "锂电"), ("光伏|太阳能", "新能源", "光伏"), ("储能", "新能源", "储能"), ("新能源车", "新能源", "新能源车"), ("电力设备|风电", "新能源", "电力设备"),
    ("创新药|化学制药", "医药", "创新药"), ("医疗器械", "医药", "医疗器械"), ("CXO", "医药", "CXO"), ("中药", "医药", "中药"), ("医疗服务", "医药", "医疗服务"), ("疫苗", "医药", "疫苗"), ("医药|生物", "医药", "医药"),
    ("国防军工|军工|航空装备|兵器", "制造军工", "军工"), ("轨交|铁路设备", "制造军工", "轨交装备"), ("工控|机器人", "制造军工", "工控机器人"),
    ("煤炭", "周期", "煤炭"), ("石油|石化", "周期", "石油石化"), ("有色|金属", "周期", "有色"), ("化工", "周期", "化工"), ("钢铁", "周期", "钢铁"), ("汽车", "周期", "汽车"), ("机械", "周期", "工程机械"),
    ("运输|物流|港口|机场|航运|公路", "周期", "交通运输"), ("建筑", "周期", "建筑"), ("房地产", "周期", "房地产"), ("公用|电力", "周期", "公用事业"),
)
#: Two industries need words of their own in both texts: pattern of label and name together, and a further one of either.
NEEDS_NAME, NEEDS_TEXT = {"新能源车": ("新能源车|汽车零部件", "汽车|新能源")}, {"CXO": ("CXO|服务", "医药|生物")}
# Sector and industry by the words of a company's name.
NAME_INDUSTRIES = (
    ("银行", "金融", "银行"), ("保险|人寿|太保|人保", "金融", "保险"), ("证券|券商", "金融", "券商"), ("茅台|五粮液|泸州老窖|汾酒|洋河|白酒", "消费", "白酒"), ("啤酒", "消费", "啤酒"),
    ("电器|家电|智家", "消费", "家电"), ("牧原|温氏|牧|禽|渔", "消费", "农林牧渔"), ("中芯|华虹|晶圆代工", "科技", "半导体"), ("芯片|半导体|微电子|集成电路|燧原|沐曦|寒武|海光|龙芯", "科技", "AI芯片"),
    ("光伏|硅料|硅片", "新能源", "光伏"), ("锂电|电池", "新能源", "锂电"), ("新能源车|比亚迪", "新能源", "新能源车"), ("制药|医药|生物|疫苗|中药|CXO|康德", "医药", "医药"), ("煤炭|煤业", "周期", "煤炭"),
    ("石油|石化", "周期", "石油石化"), ("港口|港务|上港|机场|高速|航运|铁路", "周期", "交通运输"), ("军工|兵器|航空发动机", "制造军工", "军工"),
)
UNKNOWN = ("其他", "待分类")


def _ladder(rules: Sequence[tuple[Column, str, str]]) -> Column:
    """The sector and industry of the first rule that holds; null if none does."""
    made = lambda s, i: F.struct(F.lit(s).alias("sector"), F.lit(i).alias("industry"))
    return F.coalesce(*[F.when(c, made(s, i)) for c, s, i in rules])


def classify(market: Column, name: Column) -> Column:
    """A company's ``sector, industry`` by its market's label, which its name may refine within technology, else by its name."""
    label, own = F.regexp_replace(F.coalesce(market, F.lit("")), SPACE, ""), F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, "")
    both = F.concat(label, own)

    def holds(pattern: str, industry: str) -> Column:
        if industry in NEEDS_NAME:
            first, second = NEEDS_NAME[industry]
            return own.rlike(first) & both.rlike(second)
        if industry in NEEDS_TEXT:
            first, second = NEEDS_TEXT[industry]
            return both.rlike(first) & both.rlike(second)
        return both.rlike(pattern)

    told = F.when(label != "", _ladder([(holds(p, i), s, i) for p, s, i in MARKET_INDUSTRIES]))
    named = _ladder([(own.rlike(p), s, i) for p, s, i in NAME_INDUSTRIES])
    chip = (named["industry"] == "AI芯片") | ((named["industry"] == "半导体") & told["industry"].isin("电子", "消费电子"))
    unknown = F.struct(F.lit(UNKNOWN[0]).alias("sector"), F.lit(UNKNOWN[1]).alias("industry"))
    return F.when((told["sector"] == "科技") & chip, named).otherwise(F.coalesce(told, named, unknown))


def industry_of(name: Column, unknown: str = UNKNOWN[1]) -> Column:
    """The industry that a name alone tells."""
    found = classify(F.lit(None).cast("string"), name)["industry"]
    return F.when(found == UNKNOWN[1], unknown).otherwise(found)


# Endings of company names, which go in three steps; marks of share classes go first.
ENDINGS = (
    "(?:股份有限公司|有限责任公司|有限公司)$",
    "(?:股份|集团|控股|有限)$",
    "(?:科技|电子|制药|医药|国际|投资|能源|智能|信息|通信|光电|生物|材料|实业|发展|制造|电器)$",
)
SHARE_CLASS = "(?i)-[UW]$"
# Spoken names of companies.
ALIASES = {
    "招行": "招商银行", "工行": "工商银行", "建行": "建设银行", "中行": "中国银行", "农行": "农业银行", "交行": "交通银行", "邮储": "邮储银行", "浦发": "浦发银行", "兴业": "兴业银行", "民生": "民生银行",
    "平安银行": "平安银行", "平安": "中国平安", "国寿": "中国人寿", "太保": "中国太保", "人保": "中国人保", "茅台": "贵州茅台", "洋河": "洋河股份", "美的": "美的集团", "海尔": "海尔智家", "格力": "格力电器",
    "伊利": "伊利股份", "海天": "海天味业", "农夫": "农夫山泉", "宁德": "宁德时代", "中芯": "中芯国际", "海康": "海康威视", "立讯": "立讯精密", "寒武": "寒武纪", "沐曦": "沐曦股份", "燧原": "燧原科技",
    "富士康": "工业富联", "韦尔": "韦尔股份", "澜起": "澜起科技", "隆基": "隆基绿能", "通威": "通威股份", "亿纬": "亿纬锂能", "恒瑞": "恒瑞医药", "药明": "药明康德", "迈瑞": "迈瑞医疗", "三一": "三一重工",
    "神华": "中国神华", "紫金": "紫金矿业", "万华": "万华化学", "牧原": "牧原股份", "温氏": "温氏股份", "上港": "上港集团",
}


def name_variants(name: Column) -> Column:
    """A company's name and what is left of it as endings go, one after another; at least two characters each."""
    endings = F.array(*[F.lit(e) for e in (SHARE_CLASS, *ENDINGS)])
    left = lambda found, ending: F.concat(found, F.array(F.regexp_replace(F.element_at(found, -1), ending, F.lit(""))))
    out = F.aggregate(endings, F.array(F.regexp_replace(name, SPACE, "")), left)
    return F.array_distinct(F.filter(out, lambda x: F.length(x) >= 2))


def official_name(asked: Column) -> Column:
    """The company that a text names by a spoken name, the longest that it has; null if it has none."""
    first = lambda plain: F.coalesce(*[F.when(plain.contains(k), F.lit(ALIASES[k])) for k in sorted(ALIASES, key=lambda k: (-len(k), k))])
    return let(F.regexp_replace(asked, SPACE, ""), first)


CODE, EXACT, EMBEDDED, ALIAS, SIMILAR, SPELLED, CONTAINS = 1, 4, 2, 3, 5, 6, 7


def match_names(queries: DataFrame, companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``query, code, stage``: the best stage at which a query names a company.

    1 code, 2 the whole name in the text, 3 a spoken name, 4 exactly the name, 5 a variant, the beginning, or four characters of
    it, 6 its spelling in letters, 7 a part that only one company has. Of several companies the one with the shortest name, then
    the smallest code. ``companies`` has code and name, and spelled and initials where there are any (``spelled_names``);
    ``aliases`` has alias and name. Names are found by an equal join on what texts have of their length, so no side need be small. Repeated
    queries and companies count once.
    """
    queries, companies = queries.select("query").filter("query IS NOT NULL").distinct(), companies.filter("code IS NOT NULL")
    q = held(queries, q=F.regexp_replace("query", SPACE, ""), clean=F.lower(without_noise(F.col("query"))), official=official_name(F.col("query")))
    if aliases is not None:
        known = aliases.select("alias", F.col("name").alias("told"))
        said = contained(q, "q", known, "alias").join(q.select("query", "q"), "q").join(known, "alias").groupBy("query").agg(F.max_by("told", F.struct(F.length("alias"), "alias")).alias("told"))
        q = q.join(said, "query", "left").withColumn("official", F.coalesce("official", "told")).drop("told")
    for c in ("spelled", "initials"):
        companies = companies if c in companies.columns else companies.withColumn(c, F.lit(None).cast("string"))
    one = companies.groupBy("code").agg(F.first(F.struct("name", "spelled", "initials")).alias("c")).select("code", "c.*")  # of dropDuplicates() Spark shares no exchange
    named = held(one, low=F.lower("name"), variants=name_variants(F.col("name")))
    clean, name, said = F.col("clean"), F.col("low"), F.col("official")
    some = clean != ""
    letters = clean.rlike("^[a-z]+$") & (F.col("spelled").contains(clean) | F.col("initials").startswith(clean))
    stage = (
        F.when(F.col("q").contains(F.col("code")), CODE).when(F.col("q").contains(F.col("name")), EMBEDDED)
        .when((F.col("name") == said) | F.col("name").contains(said) | said.contains(F.col("name")), ALIAS).when(some & (clean == name), EXACT)
        .when(some & (F.exists("variants", lambda v: F.lower(v) == clean) | name.startswith(clean) | ((F.length(clean) >= 4) & name.contains(clean))), SIMILAR)
        .when(some & letters, SPELLED).when(some & name.contains(clean), CONTAINS)
    )
    asked, told, has, letter, lower = "asked", "told", "has", "letter", "lower"
    by = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    of = lambda kind: F.get(F.filter("texts", lambda t: t["kind"] == kind), F.lit(0))["text"]

    def filed(rows: DataFrame, key: str, *texts: Column) -> DataFrame:
        """``id, texts``: a row's texts by kind. All that read them share this exchange, so that texts are made once; by a key that no join
        needs, as Spark leaves out an exchange by the others."""
        return rows.select(F.col(key).alias("id"), F.array_distinct(F.filter(F.concat(*texts), lambda t: t["text"] != "")).alias("texts")).repartition(F.hash("id"))

    # whatever any stage can join, the texts and parts of all kinds in one join; the stages are then told on these pairs alone
    q = filed(q, "query", F.array(by(asked, F.col("q")), by(told, said), by(has, said), by(letter, F.when(clean.rlike("^[a-z]+$"), clean)), by(lower, clean)))
    names = F.array(by(asked, F.col("code")), by(asked, F.col("name")), by(told, F.col("name")), by(has, F.col("name")), by(letter, F.col("spelled")), by(letter, F.col("initials")), by(lower, name))
    known = filed(named, "code", names, F.transform("variants", lambda v: by(lower, F.lower(v))))
    asking, knowing = (rows.select("id", F.inline_outer("texts")) for rows in (q, known))
    whole, part, of_query = F.col("whole"), F.col("part"), F.col("kind").isin(asked, told)
    pairs = met(asking.filter(of_query).unionByName(knowing.filter(~of_query)), knowing.filter(of_query).unionByName(asking.filter(~of_query)))
    pairs = pairs.select(F.when(of_query, whole).otherwise(part).alias("query"), F.when(of_query, part).otherwise(whole).alias("code"))
    q = held(q, q=of(asked), clean=of(lower), official=of(told)).withColumnRenamed("id", "query").drop("texts")
    hits = pairs.join(named, "code").join(q, "query").select("query", "code", F.length("name").alias("n"), stage.alias("stage")).filter("stage IS NOT NULL")
    best = hits.groupBy("query").agg(F.min(F.struct("stage", "n", "code")).alias("best"), (F.min("code") == F.max("code")).alias("alone"))
    return best.filter((F.col("best.stage") < CONTAINS) | F.col("alone")).select("query", "best.code", "best.stage")


def spelled_names(companies: DataFrame, readings: DataFrame) -> DataFrame:
    """Adds ``spelled`` and ``initials``: a name's characters by their readings (``character, reading``), others as they are, in lower case.
    Of several readings of a character the first in order counts."""
    once = readings.groupBy("character").agg(F.min(F.lower("reading")).alias("reading"))
    letters = companies.select("name").distinct().select("name", F.posexplode(F.split("name", "")).alias("at", "character")).filter("character <> ''")
    read = letters.join(once, "character", "left").withColumn("reading", F.coalesce("reading", F.lower("character")))
    parts = read.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "reading"))).alias("r"))  # a name's characters
    spelled = F.array_join("r.reading", "").alias("spelled")
    return companies.join(parts.select("name", spelled, F.array_join(F.transform("r", lambda x: F.substring(x["reading"], 1, 1)), "").alias("initials")), "name", "left")


def all_terms(question: str, hay: Column) -> Column:
    """Whether a text has all words of a query, in any case."""
    out = F.lit(True)
    for word in question.lower().split():
        out = out & F.lower(hay).contains(word)
    return out


# Words by which a text is a question, and what says nothing of its subject, in the order in which it goes.
QUESTION = (
    "是否|怎么|如何|为何|为什么|增长|下降|同比|环比|变化|多少|怎样|什么|哪些|对比|分析|解读|说明|原因|缓慢|加快|看法|值得|关注|好不好|好吗|行不行|买吗|买入|卖出|加仓|减仓|持有|值得买|推荐买|能买|该买|[？?]"
)
NOISE = (
    ("怎么样", " "), (r"(20\d{2}|\d{2})\s*年", " "), ("今年|去年|前年|明年", " "), ("半年度报告|半年度|半年报|中报|年度报告|年报|一季报|二季报|三季报|季报|第一季度|第二季度|第三季度", " "),
    (r"(?i)(?<![A-Za-z0-9_])(?:FY|H1|Q[1-3])(?![A-Za-z0-9_])", " "), (r"[（(]\s*(\d{6})\s*[）)]", " $1 "), (QUESTION, " "), ("业绩|财报|报表|情况|表现|数据|营收|利润|净利润|收入", " "),
    ("最近|好不好|好吗|行不行|怎么样", " "), (r"(?U)[？?，,。.!！、\s]+", " "),
)


def without_noise(question: Column) -> Column:
    """A question without periods, business words and what only asks; a code in brackets stays."""
    for pattern, by in NOISE:
        question = F.regexp_replace(question, pattern, by)
    return F.trim(question)


def asks(question: Column) -> Column:
    """Whether a text is a question rather than a name or a code: by its words, or for its length."""
    q = F.trim(question)
    named = q.rlike(r"^\d{6}$") | q.rlike("^[一-鿿A-Za-z0-9]{1,8}$")
    return F.coalesce((q != "") & (q.rlike(QUESTION) | ((F.length(q) >= 12) & ~named)), F.lit(False))


# Words in titles that call for attention, longer ones first.
ATTENTION = "业绩快报|风险提示|问询函|关注函|预告|更正|修订|补充|取消|摘要"


def attention(title: Column) -> Column:
    """The words of a title that call for attention, in order, none inside another."""
    return F.regexp_extract_all(title, F.lit(f"({ATTENTION})"), 1)


def number_tokens(text: Column) -> Column:
    """The numbers of a text as they are printed."""
    return F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?%?)"), 1)


STOP_TERMS = ("报告期", "公司", "本期", "上年", "同比", "情况")


def ngrams(text: Column, sizes: Sequence[int] = (3, 4)) -> Column:
    """Distinct runs of Chinese characters of some lengths, without common ones."""

    def grams(n: int) -> Column:
        runs = F.regexp_extract_all(text, F.lit(r"([一-龥]{%d,})" % n), 1)
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))))

    out = [grams(n) for n in sizes]
    return F.array_except(F.array_distinct(F.concat(*out)), F.array(*[F.lit(s) for s in STOP_TERMS]))


def best_page(pages: DataFrame, quotes: DataFrame, report: str) -> DataFrame:
    """``quote_id, page, hits``: the page that has most of a quote's numbers and runs, on its own page or a neighbour's."""
    terms = quotes.select("quote_id", report, F.col("page").alias("cited"), F.array_union(number_tokens(F.col("quote")), ngrams(F.col("quote"))).alias("terms"))
    near = terms.select("*", F.explode(F.array(F.col("cited"), F.col("cited") - 1, F.col("cited") + 1)).alias("page"))
    scored = near.join(pages.select(report, "page", "content"), [report, "page"])
    hits = F.size(F.filter("terms", lambda t: F.col("content").contains(t)))
    return first_rows(scored.withColumn("hits", hits).filter("hits > 0"), ["quote_id"], [F.desc("hits"), F.abs(F.col("page") - F.col("cited")), "page"]).select("quote_id", "page", "hits")


CITATION = r"【E(\d+)】"


def cited(answer: Column) -> Column:
    """The evidence numbers that an answer cites, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), 1))


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\s*【E\d+】", "")


def page_citations(answer: Column, pages: Column) -> Column:
    """Marks of evidence as marks of pages, by a map from number to page; unknown ones go."""
    marks = F.regexp_extract_all(answer, F.lit(CITATION), 1)
    return F.aggregate(
        marks, answer,
        lambda text, m: F.replace(text, F.concat(F.lit("【E"), m, F.lit("】")), F.coalesce(F.concat(F.lit("[P"), F.try_element_at(pages, m).cast("string"), F.lit("]")), F.lit(""))),
    )


# Digits and units of Chinese numerals.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: Column) -> Column:
    """A numeral as a number up to 9999: Arabic digits, also of full width, Chinese digits one by one, or with units, where a last digit behind
    hundreds or thousands counts one unit lower; null for other texts."""
    plain = F.translate(F.trim(text), "０１２３４５６７８９", "0123456789")
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    value = F.create_map(*[F.lit(x) for pair in (DIGITS | UNITS).items() for x in pair])
    one_by_one = F.aggregate(letters, F.lit(0), lambda n, c: n * 10 + F.coalesce(F.try_element_at(value, c), F.lit(0)))

    def step(s: Column, c: Column) -> Column:
        v = F.coalesce(F.try_element_at(value, c), F.lit(0))
        unit = c.isin(*UNITS)
        return F.struct(
            F.when(unit, s["total"] + F.greatest(s["cur"], F.lit(1)) * v).otherwise(s["total"]).alias("total"), F.when(unit, 0).otherwise(v).alias("cur"),
            F.when(unit, v).otherwise(s["unit"]).alias("unit"), (s["bad"] | (unit & (s["cur"] == 0) & (v != 10))).alias("bad"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"), F.lit(0).alias("unit"), F.lit(False).alias("bad"))
    lower = lambda s: F.when((s["unit"] >= 100) & ~plain.rlike("[零〇].$"), (s["cur"] * s["unit"] / 10).cast("int")).otherwise(s["cur"])
    whole = F.aggregate(letters, start, step, lambda s: F.when(~s["bad"], s["total"] + lower(s)))
    known = "".join(DIGITS)
    return (
        F.when(plain.rlike(r"^\d{1,4}$"), plain.try_cast("int")).when(plain.rlike(f"^[{known}]{{1,4}}$"), one_by_one)
        .when(plain.rlike(f"^[{known}{''.join(UNITS)}]+$") & plain.rlike("[十百千]"), F.when(whole.between(1, 9999), whole))
    )


def unwrap_json(text: Column) -> Column:
    """The JSON object in a model's text: without its thoughts and code fences."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))


VERDICT = "summary string, confidence double, points array<struct<title: string, text: string, page: int>>"


def parse_verdict(text: Column) -> Column:
    """A verdict out of a model's text: null as a whole without a summary, points without title or text left out."""
    v = F.from_json(unwrap_json(text), VERDICT)
    points = F.filter(F.coalesce(v["points"], F.array().cast("array<struct<title: string, text: string, page: int>>")), lambda p: (F.trim(p["title"]) != "") & (F.trim(p["text"]) != ""))
    return F.when(F.trim(v["summary"]) != "", F.struct(v["summary"].alias("summary"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["confidence"])).alias("confidence"), points.alias("points")))


def error_text(error: Column) -> Column:
    """A queue's last error as people read it: without its prefix, some in words, others as they are; null for none."""
    said = F.trim(F.regexp_replace(error, r"(?i)^Error:\s*", ""))
    return (
        F.when(said.isNull() | (said == ""), None).when(said.rlike("(?i)Downloaded object is not a PDF"), "下载内容不是 PDF").when(said.contains("交易所拦截了 PDF"), "交易所拦截了 PDF 下载")
        .when(said.rlike(r"(?i)^PDF \d+$"), F.concat(F.lit("PDF 请求失败（"), F.regexp_extract(said, r"(\d+)$", 1), F.lit("）"))).otherwise(said)
    )


def merge_texts(generated: Column, fallback: Column, excluded: Column, most: int = 3) -> Column:
    """Generated texts, then fallback ones, each once by normal form, without excluded ones, up to a number."""
    key = lambda t: F.lower(F.regexp_replace(t, r"(?U)[\s\p{P}]+", ""))
    every = F.concat(generated, fallback)
    first = F.filter(every, lambda t: F.lit(True))
    kept = F.filter(first, lambda t, i: (key(t) != "") & ~F.array_contains(F.transform(excluded, key), key(t)) & ~F.array_contains(F.transform(F.slice(every, F.lit(1), i), key), key(t)))
    return F.slice(kept, 1, most)


def snapshot(lines: Sequence[Column], most: int = 2200) -> Column:
    """Lines that are there, one below another, clipped."""
    return clip(F.concat_ws("\n", *lines), most)
