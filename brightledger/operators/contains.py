"""Joins on contained texts.

Parts of up to ``REACH`` characters are met as they are: texts are cut into what has the length of some part and begins with its first two
characters, and cuts meet parts by an equal join. Which lengths follow which beginning is a table of ``HEADS`` hashes at most, the only thing that
is broadcast. A text that contains a longer part has all grams of the part, runs of so many characters: each long part is filed under that of its
longest grams (of ``SIZES``) which fewest texts have; long texts meet it under this gram by an equal join, and only then are compared. Nothing is nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.binding import let

#: Lengths of grams, each twice the one before.
SIZES = (1, 2, 4, 8)
#: Characters of a part that is met as it is, at most 64; over the largest of ``SIZES``.
REACH = 32
#: Hashes of beginnings; those of two share their lengths, which costs cuts that meet nothing.
HEADS = 1 << 15
#: Places of a text that are cut from one row, so that long texts are not copied for each of their places.
PIECE = 64


def grams(text: Column, every: bool) -> Column:
    """The distinct grams of a text of all sizes, or only those of the largest size that it has."""

    def of(shorter: Column, at: int) -> Column:
        if at == len(SIZES):
            return shorter
        k, left = SIZES[at - 1], lambda a: F.greatest(F.size(a) - SIZES[at - 1], F.lit(0))
        longer = F.zip_with(F.slice(shorter, F.lit(1), left(shorter)), F.slice(shorter, F.lit(k + 1), left(shorter)), lambda a, b: F.concat(a, b))
        return let(longer, lambda g: F.concat(shorter, of(g, at + 1)) if every else F.when(F.size(g) > 0, of(g, at + 1)).otherwise(shorter))

    return F.array_distinct(let(F.filter(F.split(text, ""), lambda c: c != ""), lambda letters: of(letters, 1)))


def _short(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """``met`` for parts of up to ``REACH`` characters."""
    parts = parts.filter(F.length("text").between(1, REACH))
    head = lambda begin: F.pmod(F.xxhash64("kind", begin), F.lit(HEADS)).alias("__head")
    heads = parts.select(head(F.substring("text", 1, 2)), F.expr("shiftleft(1L, length(text) - 1)").alias("__bit")).groupBy("__head").agg(F.bit_or("__bit").alias("__lengths"))
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(PIECE))
    pieces = wholes.filter("text <> ''").select("kind", "id", F.explode(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(PIECE + REACH - 1)))).alias("__piece"))
    spots = pieces.select("kind", "id", "__piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("__piece")))).alias("__at"))
    spots = spots.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("__k"))
    spots = spots.withColumn("__head", head(F.substring(F.col("__piece"), F.col("__at"), F.col("__k")))).join(F.broadcast(heads), "__head")
    fits = lambda n: (F.bit_get("__lengths", n - 1) == 1) & ((n == 1) == (F.col("__k") == 1)) & (F.col("__at") + n - 1 <= F.length("__piece"))
    cuts = spots.select("kind", "id", "__piece", "__at", F.explode(F.filter(F.sequence(F.lit(1), F.lit(REACH)), fits)).alias("__n"))
    cuts = cuts.select("kind", F.col("id").alias("whole"), F.substring(F.col("__piece"), F.col("__at"), F.col("__n")).alias("text"))
    return cuts.join(parts.select("kind", "text", F.col("id").alias("part")), ["kind", "text"]).select("kind", "whole", "part")


def _long(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """``met`` for longer parts. Texts go through the exchange of grams as 16 bytes, and once more for the comparison with their candidates."""
    wholes, parts = (rows.filter(F.length("text") > REACH) for rows in (wholes, parts))
    key = F.unhex(F.md5("text")).alias("__key")
    filed = wholes.select("kind", "text").distinct().select("kind", key, F.explode(grams(F.col("text"), False)).alias("__gram"))
    often = filed.groupBy("kind", "__gram").agg(F.count("*").alias("__n"))
    own = parts.select("kind", "text").distinct().select("kind", "text", F.explode(grams(F.col("text"), False)).alias("__gram"))
    # a gram that no text has is the rarest, and drops its part
    rarest = own.join(often, ["kind", "__gram"], "left").groupBy("kind", "text").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    asked = parts.join(rarest, ["kind", "text"]).select("kind", "__gram", F.col("text").alias("__part"), F.col("id").alias("part"))
    pairs = filed.join(asked, ["kind", "__gram"]).select("kind", "__key", "__part", "part")
    return pairs.join(wholes.select("kind", "text", "id", key), ["kind", "__key"]).filter(F.col("text").contains(F.col("__part"))).select("kind", F.col("id").alias("whole"), "part")


def met(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """``kind, whole, part``: the ids of texts and of parts of the same kind that they contain, of rows ``kind, text, id``. A pair may come more
    than once. Null and empty parts are in no text."""
    return _short(wholes, parts).unionByName(_long(wholes, parts))


def contained(wholes: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """The distinct pairs ``whole, part`` of texts and parts that they contain. Null and empty parts are in no text."""
    texts = wholes.select(F.lit(0).alias("kind"), F.col(whole).alias("text")).filter("text <> ''").distinct().withColumn("id", F.unhex(F.md5("text")))
    names = parts.select(F.lit(0).alias("kind"), F.col(part).alias("text")).filter("text <> ''").distinct().withColumn("id", F.col("text"))
    pairs = met(texts, names).select(F.col("whole").alias("id"), "part")
    return pairs.join(texts, "id").select(F.col("text").alias(whole), F.col("part").alias(part)).distinct()
