"""Citations in answers: marks of evidence become marks of pages beside what they support. All in Columns.

An answer carries marks such as 【E3】 or [E3] of evidence and [P12] or [PDF 12] of pages. Citations are an array of structs ``id, page, quote,
report``. Null answers are empty texts, and citations without a page of one or more place nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightledger.functions.binding import let

CITATIONS = "array<struct<id: string, page: int, quote: string, report: string>>"
MARK = r"【\s*E\s*\d+\s*】|\[\s*E\s*\d+\s*\]"
PILE = rf"(?i)((?:\s*(?:{MARK}))+\s*$)"
PAGE_MARK = r"\[P(\d+)\]"
# Units that stay with a number, words by which clauses are told, and what ends a clause.
UNITS = "亿千瓦时|亿元|万人|万片|万吨|万千瓦|百分点|%|亿|万|元|倍|吨|片"
KEYWORDS = ("营收", "营业收入", "净利润", "归母", "毛利率", "毛利", "财务费用", "营业成本", "现金流", "发电量", "销量", "售价", "研发", "存货", "应收")
CLOSES = "，。；、"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def without_marks(text: Column) -> Column:
    """An answer without marks of evidence, and without the gaps that they leave."""
    for pattern, by in ((rf"(?i){MARK}", ""), (r"\s{2,}", " "), (r"\s+([，。；：！？、])", "$1"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def once_a_page(text: Column) -> Column:
    """Of marks of one page in a row one stays."""
    return F.regexp_replace(text, r"(\[P(\d+)\])(?:\s*\[P\2\])+", "$1")


def pages_marked(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, PAGE_MARK), lambda p: p.try_cast("int")))


def first_by(items: Column, same) -> Column:
    """Items of an array that are the ``same`` as no earlier one, in order."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: same(x, y)))


def unique_by_page(citations: Column) -> Column:
    """The first citation of each page of a report."""
    return first_by(citations, lambda a, b: a["page"].eqNullSafe(b["page"]) & a["report"].eqNullSafe(b["report"]))


def inserted(text: Column, after: Column, mark: Column) -> Column:
    """A mark put in after so many characters, unless a mark is there already."""
    rest = F.substring(text, after + 1, F.length(text))
    return F.when(rest.rlike(rf"^\s*{PAGE_MARK}"), text).otherwise(F.concat(F.substring(text, F.lit(1), after), mark, rest))


def placed(text: Column, citation: Column) -> Column:
    """A citation's page marked behind the first number of its quote that the text has, with its unit; without such a number at the end of
    the clause that has most of the quote's keywords; else nowhere."""
    mark = F.concat(F.lit("[P"), citation["page"].cast("string"), F.lit("]"))
    quote = F.coalesce(citation["quote"], F.lit(""))
    numbers = F.filter(_all(quote, r"(\d+(?:\.\d+)?%?)"), lambda d: (F.length(F.replace(d, F.lit("%"), F.lit(""))) >= 2) & text.contains(d))

    def behind(number: Column) -> Column:
        def with_unit(end: Column) -> Column:
            unit = F.regexp_extract(F.substring(text, end + 1, F.lit(24)), rf"^(\s*(?:{UNITS}))", 1)
            return inserted(text, end + F.length(unit), mark)

        return let(F.instr(text, number) + F.length(number) - 1, with_unit)

    def in_clause(clauses: Column) -> Column:
        keys = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: quote.contains(k))
        worth = let(keys, lambda ks: F.transform(clauses, lambda c: F.aggregate(ks, F.lit(0), lambda n, k: n + F.when(c.contains(k), F.length(k)).otherwise(0))))

        def at_best(worth: Column) -> Column:
            def at_clause(at: Column) -> Column:
                upto = F.aggregate(F.slice(clauses, F.lit(1), at), F.lit(0), lambda n, c: n + F.length(c))
                close = F.when(F.get(clauses, at - 1).rlike(f"[{CLOSES}]$"), 1).otherwise(0)
                return inserted(text, upto - close, mark)

            best = F.array_max(worth)
            return F.when(best > 0, let(F.array_position(worth, best).cast("int"), at_clause)).otherwise(text)

        return F.when(F.size(clauses) > 0, let(worth, at_best)).otherwise(text)

    by_clause = let(F.filter(F.split(text, f"(?<=[{CLOSES}])"), lambda c: c != ""), in_clause)
    return F.when(text.contains(mark), text).otherwise(let(F.get(numbers, F.lit(0)), lambda number: F.when(number.isNotNull(), behind(number)).otherwise(by_clause)))


def with_page_marks(answer: Column, citations: Column, pool: Column | None = None) -> Column:
    """An answer whose marks of evidence have become marks of pages.

    Marks inside the text are replaced where they stand. A pile of marks at the end is dealt to the numbers and clauses that its quotes
    support, each page once; without any mark all citations are. Marks of unknown evidence go. ``pool`` holds further evidence that marks
    may name.
    """
    every = F.coalesce(citations, F.array().cast(CITATIONS)) if pool is None else F.concat(F.coalesce(pool, F.array().cast(CITATIONS)), F.coalesce(citations, F.array().cast(CITATIONS)))
    own = unique_by_page(F.coalesce(citations, F.array().cast(CITATIONS)))

    def marked_by(every: Column) -> Column:
        named = lambda number: F.try_element_at(F.filter(every, lambda c: F.upper(F.trim(c["id"])) == F.concat(F.lit("E"), number)), F.lit(-1))

        def replaced(body: Column, mark: Column) -> Column:
            page = named(F.regexp_extract(mark, r"(\d+)", 1))["page"]
            return let(page, lambda page: F.replace(body, mark, F.when(page >= 1, F.concat(F.lit("[P"), page.cast("string"), F.lit("]"))).otherwise("")))

        def parted(text: Column, pile: Column) -> Column:
            body = F.when(pile != "", F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(pile)), r"\s+$", "")).otherwise(text)
            inside = let(body, lambda body: once_a_page(F.aggregate(F.array_distinct(_all(body, rf"(?i)({MARK})")), body, replaced)))
            return let(inside, lambda inside: let(pages_marked(inside), lambda marked: dealt(inside, marked, pile)))

        def dealt(body: Column, marked: Column, pile: Column) -> Column:
            usable = lambda cs: let(F.filter(cs, lambda c: (c["page"] >= 1) & ~F.array_contains(marked, c["page"])), unique_by_page)
            piled = usable(F.transform(_all(pile, r"(?i)E\s*(\d+)"), named))
            queue = let(piled, lambda piled: F.when((F.size(piled) == 0) & (F.size(marked) == 0), usable(own)).otherwise(piled))
            return once_a_page(without_marks(F.aggregate(queue, body, placed)))

        text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?i)\[\s*PDF\s*(\d+)\s*\]", "[P$1]")
        return let(text, lambda text: let(F.regexp_extract(text, PILE, 1), lambda pile: parted(text, pile)))

    return let(F.filter(every, lambda c: F.trim(c["id"]) != ""), marked_by)


def answer_tokens(answer: Column) -> Column:
    """An answer as an array of ``kind`` (text or mark), ``text``, and of a mark ``evidence`` or ``page``."""
    mark = r"【(?:E\d+|第\s*\d+\s*页)】|\[P\d+\]"
    text = F.coalesce(answer, F.lit(""))
    for pattern, by in ((r"(?i)\[\s*PDF\s*(\d+)\s*\]", "[P$1]"), (r"(】)(?=【)", "$1 "), (r"(\])(?=\[P)", "$1 ")):
        text = F.regexp_replace(text, pattern, by)
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)({mark}|.+?(?={mark}|\z))"), F.lit(1))
    part = lambda p, pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    is_mark = lambda p: p.rlike(f"^(?:{mark})$")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.when(is_mark(p), "mark").otherwise("text").alias("kind"), p.alias("text"), F.when(is_mark(p), part(p, r"^【(E\d+)】$")).alias("evidence"),
            F.when(is_mark(p), part(p, r"^(?:【第\s*|\[P)(\d+)")).try_cast("int").alias("page"),
        ),
    )


def answer_sources(answer: Column, sources: Column) -> Column:
    """The sources that an answer's marks of evidence name, each filing once, in the marks' order: ``sources`` is an array of structs with
    ``id``, ``report``, ``company`` and ``period``; without a report, company and period tell filings apart."""
    marks = F.transform(F.filter(answer_tokens(answer), lambda t: t["evidence"].isNotNull()), lambda t: t["evidence"])
    found = F.filter(F.transform(marks, lambda e: F.get(F.filter(sources, lambda s: F.upper(s["id"]) == e), F.lit(0))), lambda s: s.isNotNull())
    filing = lambda s: F.coalesce(s["report"], F.concat_ws(":", s["company"], s["period"]))
    return first_by(found, lambda a, b: filing(a) == filing(b))
