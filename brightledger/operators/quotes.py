"""Where on a page a question or a quote is answered.

A question becomes numbers and terms, in Columns. Questions meet the cited page and its neighbours by a join; only the search in one page's
text, for the best run of characters, is a helper over Arrow batches. Places are given in the page's own characters, blanks included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.functions.binding import let

# Lengths of quotes, and how far around a number its terms are looked for.
LEAST, MOST, BACK, AHEAD, TRAIL, WIDE, AMOUNT_NEAR = 8, 120, 80, 16, 24, 80, 48
# Points for a term, for a number, and what a quote without a number needs.
TERM_POINTS, NUMBER_POINTS, WEAK = 24, 80, 72
# Words of a question that are no terms, particles that part terms, and short names with what pages call them.
STOP_TERMS = (
    "这里", "这边", "这个", "那个", "这些", "那些", "什么", "怎么", "怎样", "如何", "为什么", "为何", "请问", "请说", "告诉", "可以", "是否", "是不是", "有没有", "多少", "哪个", "哪些",
    "一下", "看看", "解释", "分析", "原因", "影响", "相关", "的话", "地方", "内容", "数据", "情况", "问题", "上面", "下面", "刚才", "目前", "当前", "本页", "这页", "那页", "财报", "报告",
    "公司", "我们", "你们", "他们",
)
PARTICLES = r"[的是了吗呢吧在和与及对把被让给从向到为以而且或等与同并也又就都还很不没无么啥啥呀啊哦嗯\s，。！？、；：\"'（）()\[\]【】《》,.!?;:]+"
CALLED = {"营收": ("营业收入",), "收入": ("营业收入",), "净利": ("归母净利润", "净利润"), "利润": ("归母净利润", "净利润"), "现金流": ("经营活动产生的现金流量净额", "经营现金流")}
NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|\d+(?:\.\d+)?%)"
BARE_NUMBER = r"((?<![.\d])\d+\.\d+(?![.\d])|(?<![.\d])\d{3,}(?![.\d%]))"
AMOUNT = re.compile(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|-?\d+(?:\.\d+)?%?")
STOPS = re.compile("[。；;！？]")
BLANKS = r"[\s\x{A0}\x{3000}]"
BLANK_CHARACTERS = tuple(" \t\n\x0b\f\r\xa0\u3000")  # the same, one by one


def question_numbers(question: Column) -> Column:
    """The numbers of a question that tell something: with separators, per cents, decimals, and whole ones of three digits or more."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(question, F.lit(p), F.lit(1)) for p in (NUMBER, BARE_NUMBER)]))


def question_terms(question: Column) -> Column:
    """Chinese terms of a question, longest first: runs of 2 to 12 characters between particles, of runs over four their runs of four and
    three, without common words, and what short names stand for."""
    runs = F.flatten(F.transform(F.split(question, PARTICLES), lambda c: F.regexp_extract_all(c, F.lit(r"([一-鿿]+)"), F.lit(1))))
    grams = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))
    of = lambda r: F.concat(F.array(F.when(F.length(r).between(2, 12), r)), F.when(F.length(r) > 4, F.concat(grams(r, 4), grams(r, 3))).otherwise(F.array().cast("array<string>")))
    terms = F.array_except(F.array_distinct(F.array_compact(F.flatten(F.transform(runs, of)))), F.array(*[F.lit(t) for t in STOP_TERMS]))
    called = F.create_map(*[x for k, v in CALLED.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(called, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(terms, more)), lambda a, b: F.length(b) - F.length(a))


def quote_range(page: Column, quote: Column) -> Column:
    """``start, end`` of a quote on a page if white space does not count, from 0 in the page's own characters; null if it is not there."""
    blank = lambda c: c.isin(*BLANK_CHARACTERS)

    def spots_of(at: Column, size: Column) -> Column:
        spots = F.filter(F.transform(F.split(page, ""), lambda c, i: F.when((c != "") & ~blank(c), i)), lambda i: i.isNotNull())
        return let(spots, lambda spots: F.struct(F.get(spots, at - 1).alias("start"), (F.get(spots, at + size - 2) + 1).alias("end")))

    def found(needle: Column) -> Column:
        bare = F.translate(page, "".join(BLANK_CHARACTERS), "")
        return F.when(needle != "", let(F.instr(bare, needle), lambda at: F.when(at > 0, spots_of(at, F.length(needle)))))

    return let(F.regexp_replace(quote, BLANKS, ""), found)


def variants(number: str) -> list[str]:
    """How a number may be printed: with or without separators and a per cent sign."""
    bare = number.removesuffix("%")
    forms = [number, bare, bare.replace(",", "")]
    return list(dict.fromkeys(forms if number.endswith("%") else [*forms, f"{bare}%", f"{bare.replace(',', '')}%"]))


def places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def around_number(text: str, at: int, size: int, terms: list[str]) -> tuple[int, int, int]:
    """The quote around a number: from the first term before it to the last close behind it and the end of that clause."""
    low = max(0, at - BACK)
    before = [i for i in (text[low:at].rfind(t) for t in terms) if i >= 0]
    start, end, hits = min([at, *[low + i for i in before]]), at + size, len(before)
    stop = re.search("[。；;！？\n]", text[end : end + AHEAD])
    limit = end + (stop.start() if stop else AHEAD)
    for t in terms:
        i = text[end:limit].find(t)
        if i >= 0:
            end, hits = end + i + len(t), hits + 1
    trail = text[end : end + TRAIL]
    stop = STOPS.search(trail)
    if stop and stop.start() > 0:
        end += stop.start()
    elif trail[:1] in ("，", ","):
        soft = re.search("[。；;]", trail)
        end += soft.start() if soft and soft.start() > 0 else min(len(trail), 12)
    if end - start < LEAST:
        start = max(0, at - math.ceil((LEAST - (end - start)) / 2))
        end = min(len(text), start + LEAST)
    return start, end, hits


def best_run(text: str, numbers: list[str], terms: list[str]) -> tuple[int, int] | None:
    """The run of characters of a page on one line that answers best; None if nothing does well enough."""
    anchors = [t for t in terms if len(t) >= 4]
    if len(text) < LEAST or not numbers and (len(terms) < 2 or not anchors):
        return None
    found: list[tuple[int, int, int, bool]] = []

    def add(start: int, end: int, number: bool, hits: int) -> None:
        if end - start >= LEAST:
            found.append((end - start + hits * TERM_POINTS + NUMBER_POINTS * number, start, end, number))

    held = lambda start, end: sum(t in text[start:end] for t in terms)
    digit = lambda start, end: bool(re.search(r"\d", text[start:end]))
    for form in (v for n in numbers for v in variants(n)):
        for at in places(text, form):
            start, end, hits = around_number(text, at, len(form), terms)
            add(start, end, True, max(hits, held(start, end)))
    firsts = sorted(((text.find(t), len(t)) for t in terms if t in text), key=lambda x: x[0])
    for i, (start, _) in enumerate(firsts):
        for at, size in firsts[i + 1 :]:
            if at + size - start > WIDE:
                break
            if not STOPS.search(text[start : at + size]) and held(start, at + size) >= 2:
                add(start, at + size, digit(start, at + size), held(start, at + size))
    for t in anchors if not numbers else ():
        for at in places(text, t):
            end = at + len(t)
            amount = AMOUNT.search(text[end : end + AMOUNT_NEAR])
            end = end + amount.end() if amount else end
            end = min(len(text), at + LEAST) if end - at < LEAST else end
            if not STOPS.search(text[at + len(t) : end]):
                add(at, end, digit(at, end), 2)
    if not found:
        return None
    score, start, end, number = max(found, key=lambda x: (x[0], x[2] - x[1]))
    if not number and (score < WEAK or not any(t in text[start:end] for t in anchors)):
        return None
    while start < end and text[start] == " ":
        start += 1
    while end > start and text[end - 1] == " ":
        end -= 1
    return (start, min(end, start + MOST)) if end - start >= LEAST else None


def on_one_line(content: str) -> tuple[str, list[int]]:
    """A text with each run of white space as one blank, none at its ends, and where each of its characters was."""
    out, at = [], []
    for m in re.finditer(r"\S|\s+", content):
        if m.start() and m.end() < len(content) or not m.group().isspace():
            out.append(" " if m.group().isspace() else m.group())
            at.append(m.start())
    return "".join(out), at


def page_quotes(questions: DataFrame, pages: DataFrame, report: str, radius: int = 1) -> DataFrame:
    """``question_id, page, quote, start, end``: where a question (``question_id``, the report, ``page``, ``question``) is answered.

    The cited page goes first; only where it has nothing the pages up to ``radius`` away count, the longest quote first, one with a digit
    before others, then the nearer and the earlier page. Questions without an answer have no row; null texts answer nothing.
    """
    tokens = questions.select("question_id", report, F.col("page").alias("cited"), F.trim(F.regexp_replace("question", rf"{BLANKS}+", " ")).alias("q"))
    tokens = tokens.select("question_id", report, "cited", question_numbers(F.col("q")).alias("numbers"), question_terms(F.col("q")).alias("terms"))
    near = tokens.withColumn("page", F.explode(F.sequence(F.col("cited") - radius, F.col("cited") + radius))).filter("page >= 1")
    asked = near.join(pages.select(report, "page", "content"), [report, "page"]).select("question_id", "cited", "page", "content", "numbers", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quote, start, end = [], [], []
            for content, numbers, terms in zip(*[b.column(c).to_pylist() for c in ("content", "numbers", "terms")], strict=True):
                text, at = on_one_line(content or "")
                hit = best_run(text, numbers or [], terms or [])
                quote.append(text[hit[0] : hit[1]] if hit else None)
                start.append(at[hit[0]] if hit else None)
                end.append(at[hit[1] - 1] + 1 if hit else None)
            columns = [*[b.column(c) for c in ("question_id", "cited", "page")], pa.array(quote, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["question_id", "cited", "page", "quote", "start", "end"])

    kinds = dict(asked.dtypes)
    schema = f"question_id {kinds['question_id']}, cited {kinds['cited']}, page {kinds['page']}, quote string, start int, end int"
    hits = asked.mapInArrow(run, schema).filter("quote IS NOT NULL")
    score = F.length("quote") + F.when(F.col("quote").rlike(r"\d"), 100).otherwise(0)
    away = F.abs(F.col("page") - F.col("cited"))
    order = Window.partitionBy("question_id").orderBy(away > 0, F.desc(F.when(away > 0, score)), away, "page")
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "cited")
