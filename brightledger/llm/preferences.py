"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (same role, same text) is rendered once as the prompt; what follows in each conversation
is its completion, with a mask of the characters to learn from: the texts of assistant turns and their end marks.

Null roles and texts count as empty. Rows without a conversation or a pair are left out, and so are pairs that lack a side.
Turns are ordered by number, then role and text, nulls first; repeated rows are turns of their own. Where one conversation is
the other's prefix its completion is empty. An empty table gives an empty result. Other columns play no part. A conversation is
one row of the result, so its turns meet in one task, in time and memory linear in their length; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def rendered(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, _one), "")


def _one(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(BODY), t["text"], F.lit(END))


def _size(t: Column) -> Column:
    return F.length(t["role"]) + F.length(t["text"]) + F.lit(len(HEAD + BODY + END))


def mask(turns: Column) -> Column:
    """Spans ``start:end`` of learned characters in the rendered text, joined by commas; turns carry ``upto``, where they end in
    their whole conversation."""

    def span(t: Column, begin: Column) -> Column:
        end = t["upto"] - begin
        return F.concat_ws(":", (end - _size(t) + F.length(t["role"]) + F.lit(len(HEAD + BODY))).cast("string"), end.cast("string"))

    first = F.get(turns, F.lit(0))
    learned = F.filter(turns, lambda t: t["role"] == LEARNED)
    return F.array_join(F.transform(learned, lambda t: span(t, first["upto"] - _size(first))), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """Of turns with ``pair_id, chosen`` (boolean), ``turn, role, text``: one row for each pair that has both sides.

    ``n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    known = turns.filter("pair_id IS NOT NULL AND chosen IS NOT NULL").select("pair_id", F.col("chosen").alias("side"), "turn", text("role"), text("text"))
    # one shuffle serves the running ends and the pairs; ends are added up turn by turn, so work is linear in the turns
    order = W.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = known.repartition("pair_id").withColumn("upto", F.sum(F.length("role") + F.length("text") + len(HEAD + BODY + END)).over(order))
    row = F.struct("turn", "role", "text", "upto")
    side = lambda chosen: F.array_sort(F.collect_list(F.when(F.col("side") == chosen, row)))
    pairs = placed.groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    same = lambda i: (F.get("a", i)["role"] == F.get("b", i)["role"]) & (F.get("a", i)["text"] == F.get("b", i)["text"])
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~same(i))
    cut = pairs.filter((F.size("a") > 0) & (F.size("b") > 0)).withColumn("n", F.coalesce(F.array_min(differs), shorter))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    parts = cut.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return parts.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"), mask(F.col("a")).alias("chosen_mask"),
        rendered(F.col("b")).alias("rejected"), mask(F.col("b")).alias("rejected_mask"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """All conversations, each even number chosen over the odd number that follows it."""
    return format_preferences(
        conversations.select(
            F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(1) == 0).alias("chosen"), "turn", "role", "text"
        )
    )


_SIDE = """SELECT pair, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM r WHERE side = %d GROUP BY pair"""
_SPANS = f"""array_to_string(list_transform(list_filter(range(1, len(%s) + 1), lambda i: %s[i].role = '{LEARNED}'), lambda i:
  CAST(coalesce(list_sum(list_transform(%s[1:i - 1], lambda z: length(z.role) + length(z.text) + {len(HEAD + BODY + END)})), 0) + length(%s[i].role) + {len(HEAD + BODY)} AS BIGINT)
  || ':' || CAST(coalesce(list_sum(list_transform(%s[1:i], lambda z: length(z.role) + length(z.text) + {len(HEAD + BODY + END)})), 0) AS BIGINT)), ',')"""
_TEXT = "array_to_string(list_transform(%s, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)), '')"
ORACLE_SQL = f"""
WITH r AS (SELECT conv_id >> 1 AS pair, conv_id & 1 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 a AS ({_SIDE % 0}), b AS ({_SIDE % 1}),
 n AS (SELECT pair, a.t AS a, b.t AS b,
   coalesce(list_min(list_filter(range(1, least(len(a.t), len(b.t)) + 1), lambda i: a.t[i] <> b.t[i])) - 1, least(len(a.t), len(b.t))) AS n FROM a JOIN b USING (pair)),
 c AS (SELECT pair, n, a[1:n] AS p, a[n + 1:] AS x, b[n + 1:] AS y FROM n)
SELECT CAST(pair AS BIGINT) AS pair_id, CAST(n AS BIGINT) AS n_prompt_turns, {_TEXT % "p"} AS prompt, {_TEXT % "x"} AS chosen, {_SPANS % (("x",) * 5)} AS chosen_mask,
       {_TEXT % "y"} AS rejected, {_SPANS % (("y",) * 5)} AS rejected_mask FROM c"""
