"""Spoken texts whose words were written by ear: runs of characters that sound like a known term become that term.

A run is as long as a term and reads as it does, without tones. Of the places found in a text longer terms go first, then terms in order, then earlier
places, and a place taken is not taken again. Readings are a parameter (``character, reading``), of which the first in order counts; characters without
one read as they are. They are a dictionary, whose size is bounded by the characters that there are; every task has it, so that a text is put right
where it is, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.binding import let
from brightledger.operators.rank import held

# Terms of reports that are always known, those of metals, which count where the context speaks of them, and confusions that do not
# sound alike.
TERMS = (
    "归母净利润", "扣非净利润", "归母净利", "营业收入", "营业成本", "毛利率", "净利率", "经营现金流", "自由现金流", "资本开支", "净资产收益率", "基本每股收益", "稀释每股收益", "资产负债率", "存货周转", "应收账款",
    "合同负债", "非经常性损益", "同比", "环比", "豆粕", "生猪", "吨价", "出货量", "装机量",
)
METALS = ("锂盐", "碳酸锂", "氢氧化锂", "锂精矿", "锂辉石", "电解铜", "阴极铜", "矿产金", "冶炼", "选矿")
METAL_CONTEXT = "锂|有色|电池|新能源|紫金|赣锋|天齐|盛新|雅化|永兴|中矿|盐湖|宁德|亿纬|国轩|科达|华友|盛屯|洛阳钼|江西铜|铜陵非|藏格|永杉|川能|融捷"
CONFUSED = (("豆泊", "豆粕"), ("豆波", "豆粕"), ("归母静利", "归母净利"))


def known_terms(context: Column, more: Column) -> Column:
    """The terms for one text: those always known, the company's name and others that the context brings (``more``), and those of metals where
    the context speaks of them; longer ones first."""
    brought = F.filter(F.transform(F.coalesce(more, F.array().cast("array<string>")), F.trim), lambda t: F.length(t) >= 2)
    in_order = lambda ts: F.array(*[F.lit(t) for t in sorted(set(ts), key=lambda t: (-len(t), t))])
    fixed = F.when(F.concat_ws("|", context, more).rlike(METAL_CONTEXT), in_order(TERMS + METALS)).otherwise(in_order(TERMS))
    every = F.array_sort(F.transform(F.array_union(fixed, brought), lambda t: F.struct((-F.length(t)).alias("shorter"), t.alias("term"))))
    return F.when(F.size(brought) == 0, fixed).otherwise(F.transform(every, lambda t: t["term"]))  # as most bring none


def dictionary(readings: DataFrame) -> dict[int, str]:
    """The reading of each character by its code point; at most one for each character that there is."""
    once = readings.filter("length(character) = 1 AND reading IS NOT NULL").groupBy("character").agg(F.min(F.lower("reading")).alias("reading"))
    return {ord(r["character"]): r["reading"] for r in once.collect()}


def reads(text: Column, known: dict[int, str]) -> Column:
    """How each character of a text reads, in order."""
    # an array by code point, empty where there is no reading, given as one text, which Spark cuts once and not for each row
    used, first = set("".join(known.values())), min(known, default=0)
    mark = next(c for c in map(chr, range(1, 0x3000)) if c not in used and not c.isprintable())
    table = F.split(F.lit(mark.join("=" + known[i] if i in known else "" for i in range(first, max(known, default=0) + 1))), mark)
    one = lambda c: let(F.get(table, F.ascii(c) - first), lambda r: F.when(r != "", F.substr(r, F.lit(2))).otherwise(F.lower(c)))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def corrected(texts: DataFrame, readings: DataFrame, sizes: Sequence[int] = tuple(range(2, 9))) -> DataFrame:
    """``id, text, replacements`` of rows ``id, text, terms`` (arrays as ``known_terms`` gives them): replacements are an array of ``from, to,
    index`` by place. Null texts are empty. Terms have the lengths in ``sizes``; ids are unique."""
    known, fixed = dictionary(readings), sorted({*TERMS, *METALS})
    rows = texts.select("id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"), "terms")
    rows = held(rows, text=F.col("text"), terms=F.col("terms"), read=reads(F.col("text"), known))
    rows = held(rows, sound=F.array_join("read", ""))
    # only terms that the whole text sounds of are looked for place by place; how the fixed ones read is told beforehand
    sound, said = F.col("sound"), {t: "".join(known.get(ord(c), c.lower()) for c in t) for t in fixed}
    term = lambda t, n, key: F.struct(F.array_position("terms", t).cast("int").alias("turn"), n.alias("n"), t.alias("term"), key.alias("key"))
    heard = F.array(*[F.when(sound.contains(F.lit(said[t])), term(F.lit(t), F.lit(len(t)), F.lit(said[t]))) for t in fixed])
    others = F.transform(F.filter("terms", lambda t: ~t.isin(*fixed)), lambda t: let(reads(t, known), lambda r: term(t, F.size(r), F.array_join(r, ""))))
    fits = lambda t: (t["turn"] > 0) & t["n"].isin(*sizes) & (t["n"] <= F.size("read")) & sound.contains(t["key"])
    rows = held(rows, heard=F.array_sort(F.concat(F.filter(heard, fits), F.filter(others, fits))))
    run = lambda t, start: F.substring(F.col("text"), start + 1, t["n"])
    begins = lambda t, start: F.startswith(t["key"], F.get("read", start))
    sounds = lambda t, start: begins(t, start) & (F.array_join(F.slice("read", start + 1, t["n"]), "") == t["key"]) & ((run(t, start) == t["term"]) | run(t, start).rlike("[一-鿿]"))
    starts = lambda t: F.filter(F.sequence(F.lit(0), F.size("read") - t["n"]), lambda start: sounds(t, start))
    place = lambda t, start: F.struct((t["turn"] - 1).alias("turn"), start.alias("start"), t["n"].alias("n"), run(t, start).alias("run"), t["term"].alias("term"))
    found = F.flatten(F.transform("heard", lambda t: F.transform(starts(t), lambda start: place(t, start))))  # by terms, then places
    none = F.array().cast("array<struct<turn: int, start: int, n: int, run: string, term: string>>")
    free = lambda taken, h: ~F.exists(taken, lambda t: (t["start"] < h["start"] + h["n"]) & (h["start"] < t["start"] + t["n"]))
    taken = F.aggregate(found, none, lambda acc, h: F.when(free(acc, h), F.concat(acc, F.array(h))).otherwise(acc))
    both = held(rows, taken=F.coalesce(taken, none)).select("id", "text", "terms", "taken")
    by_place = F.array_sort(F.transform("taken", lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n"), t["term"].alias("term"))))
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    upto = lambda acc, t: F.struct((t["start"] + t["n"]).alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, t["start"] - acc["at"]), t["term"]).alias("out"))
    put = F.aggregate(by_place, begun, upto, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    both = held(both, out=F.when(F.size("taken") == 0, F.col("text")).otherwise(put))
    out = F.col("out")
    for wrong, right in CONFUSED:
        out = F.when(F.array_contains("terms", right), F.replace(out, F.lit(wrong), F.lit(right))).otherwise(out)
    changed = F.transform(F.filter("taken", lambda t: t["run"] != t["term"]), lambda t: F.struct(t["start"].alias("index"), t["run"].alias("from"), t["term"].alias("to")))
    return both.select("id", out.alias("text"), F.array_sort(changed).alias("replacements"))
