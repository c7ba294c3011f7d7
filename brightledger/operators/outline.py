"""Outlines of reports: sections with their pages, from the contents page, or from what pages look like.

Contents entries are brought to pages by the page labels, else by the first page that has their title, else by their printed number. A
report whose contents give fewer than three sections is outlined by rules: for each usual section the page that scores best, and headings that
pages begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.operators.rank import first_rows, held

# Usual sections and the words by which they are found, marks of references to other places, and forms of entries and headings.
SECTIONS = (
    ("summary", "报告摘要与主要会计数据", ("报告摘要", "主要会计数据", "主要财务指标")), ("mda", "管理层讨论与分析", ("管理层讨论与分析", "经营情况讨论与分析", "经营分析")),
    ("risk", "风险因素与重大风险提示", ("重大风险提示", "风险因素", "风险提示")), ("financials", "财务报表", ("财务报表", "合并资产负债表", "合并利润表", "合并现金流量表")),
    ("notes", "财务报表附注", ("财务报表附注", "会计报表附注")), ("governance", "公司治理", ("公司治理", "董事会报告", "监事会报告")),
)
REFERS = "本报告|详见|参见|请参阅|已在|见本"
CHAPTER, NUMBERED = r"第[一二三四五六七八九十百\d]+[章节]", r"第[一二三四五六七八九十百零〇两\d]+[章节]"
ENTRY = rf"({NUMBERED}\s*[^\n\d.…·．]{{1,42}}?)\s*[.．…·]+\s*(?:[Pp]\s*)?(\d{{1,3}})(?![A-Za-z0-9_])"
LEADER = r"\s*(?:[.．…·]{2,}|…+)"
HEADING = r"第[一二三四五六七八九十百]+[章节]\s*[^。；;]{2,42}"
LEAST, MOST_PAGE, MOST_FOUND, TOP, BEFORE, LONG = 3, 500, 12, 220, 60, 600


def is_contents(content: Column) -> Column:
    """Whether a page lists contents: by its title, by leaders, or by three chapters or more."""
    chapters = F.size(F.regexp_extract_all(content, F.lit(f"({CHAPTER})"), F.lit(1)))
    return F.substring(content, 1, 180).rlike(r"目\s*录") | content.rlike("[.．…·]{5,}") | (chapters >= 3)


def section_score(content: Column, terms: tuple[str, ...]) -> Column:
    """How well a page begins a section: by a chapter heading with one of its words, a word near the top, and length; -1 for none."""

    def of(term: str) -> Column:
        at = F.instr(content, term)
        before = F.substring(content, F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)))
        points = F.when(content.rlike(rf"{CHAPTER}\s*{term}"), 100).otherwise(0) + F.when(at <= TOP, 30).otherwise(0) + F.when(F.length(content) > LONG, 5).otherwise(0)
        return F.when((at > 0) & ~before.rlike(REFERS), points).otherwise(-1)

    return F.greatest(*[of(t) for t in terms])


def listed(pages: DataFrame, report: str, labels: DataFrame | None) -> DataFrame:
    """Sections that contents pages list, with the pages they were brought to; each title once."""
    whole = ENTRY.replace(r"\s*[.．…·]+", LEADER)
    hits = pages.filter("contents").select(report, "page", F.posexplode(F.regexp_extract_all("content", F.lit(f"({whole})"), F.lit(1))).alias("n", "hit"))
    highlight = F.trim(F.regexp_replace(F.regexp_extract("hit", whole, 1), r"\s+", " "))
    entries = hits.select(report, "page", "n", highlight.alias("highlight"), F.regexp_extract("hit", whole, 2).cast("int").alias("printed"))
    entries = entries.withColumn("title", F.trim(F.regexp_replace("highlight", r"[.．…·\s]+$", ""))).filter(f"title <> '' AND printed BETWEEN 1 AND {MOST_PAGE}")
    once = first_rows(entries, [report, "title"], ["page", "n"]).drop("page", "n")
    key = F.substring(F.regexp_replace("title", rf"^{NUMBERED}\s*", ""), 1, 18)
    texts = pages.filter("NOT contents").select(report, F.col("page").alias("at"), "content")
    named = once.withColumn("key", key).join(texts, report).filter(F.col("content").contains(F.col("title")) | ((F.length("key") >= 2) & F.col("content").contains(F.col("key"))))
    found = once.join(named.groupBy(report, "title").agg(F.min("at").alias("named")), [report, "title"], "left")
    there = pages.select(report, F.col("page").alias("printed"), F.col("page").alias("same")).distinct()
    found = found.join(there, [report, "printed"], "left")
    if labels is None:
        found = found.withColumn("labelled", F.lit(None).cast("int"))
    else:
        found = found.join(labels.groupBy(report, "printed").agg(F.min("page").alias("labelled")), [report, "printed"], "left")
    placed = found.withColumn("page", F.coalesce("labelled", "named", "same")).filter("page IS NOT NULL")
    enough = placed.groupBy(report).count().filter(f"count >= {LEAST}").select(report)
    order = F.row_number().over(Window.partitionBy(report).orderBy("printed", "title"))
    return placed.join(enough, report, "left_semi").select(
        report, F.concat(F.lit("toc-"), order.cast("string")).alias("id"), "title", F.lit(1).alias("level"), "page", "highlight", F.lit("toc").alias("source"), order.alias("turn"))


def by_rules(pages: DataFrame, report: str) -> DataFrame:
    """Usual sections on their best page, and up to ``MOST_FOUND`` headings of further pages."""
    texts = pages.filter("NOT contents")
    rules = F.array(*[
        F.struct(
            F.lit(i).alias("turn"), F.lit(k).alias("id"), F.lit(title).alias("title"), section_score(F.col("content"), terms).alias("score"),
            F.coalesce(*[F.when(F.col("content").contains(t), F.lit(t)) for t in terms], F.lit(title)).alias("highlight"),
        )
        for i, (k, title, terms) in enumerate(SECTIONS)
    ])
    scored = texts.select(report, "page", F.inline(rules)).filter("score > 0")
    usual = first_rows(scored, [report, "id"], [F.desc("score"), "page"]).select(report, "id", "title", F.lit(1).alias("level"), "page", "highlight", F.lit("standard").alias("source"), "turn")
    match = F.regexp_extract("content", HEADING, 0)
    heads = held(texts.select(report, "page", "content"), highlight=match).filter("highlight <> ''")
    title = F.trim(F.regexp_replace(F.regexp_extract("highlight", "^(第[^第]*)", 1), r"\s+", " "))
    heads = heads.select(report, "page", title.alias("title"), "highlight")
    known = usual.groupBy(report).agg(F.collect_list(F.struct("page", "title")).alias("known"))  # six at most
    each = heads.groupBy(report).agg(F.array_sort(F.collect_list(F.struct("page", "title", "highlight"))).alias("heads")).join(known, report, "left")  # a report's pages
    kinds = "array<struct<page: int, title: string, highlight: string>>"
    none, before = F.array().cast(kinds), F.coalesce("known", F.array().cast("array<struct<page: int, title: string>>"))

    def take(found: Column, h: Column) -> Column:
        clash = lambda x: (x["page"] == h["page"]) | x["title"].contains(h["title"])
        free = (F.size(found) < MOST_FOUND) & ~F.exists(found, clash) & ~F.exists(before, clash)
        return F.when(free, F.concat(found, F.array(h))).otherwise(found)

    more = each.select(report, F.inline(F.aggregate(F.col("heads").cast(kinds), none, take)))
    more = more.select(report, F.concat(F.lit("detected-"), F.col("page").cast("string")).alias("id"), "title", F.lit(2).alias("level"), "page", "highlight", F.lit("detected").alias("source"), F.lit(len(SECTIONS)).alias("turn"))
    return usual.unionByName(more)


def outline(pages: DataFrame, report: str, labels: DataFrame | None = None) -> DataFrame:
    """``report, id, title, level, page, end_page, highlight, source`` of each report's sections; a section ends before the next begins.

    Pages are rows ``page, content``, null texts empty; labels are ``report, printed, page`` where printed numbers are known.
    """
    rows = pages.select(report, F.col("page").cast("int").alias("page"), F.coalesce("content", F.lit("")).alias("content"))
    rows = held(rows, contents=is_contents(F.col("content")))
    toc = listed(rows, report, labels)
    found = toc.unionByName(by_rules(rows.join(toc.select(report).distinct(), report, "left_anti"), report))
    after = F.lead("page").over(Window.partitionBy(report).orderBy("page", "level", "turn", "id"))
    return found.withColumn("end_page", F.greatest(F.col("page"), F.coalesce(after, F.col("page")) - 1)).select(report, "id", "title", "level", "page", "end_page", "highlight", "source")
