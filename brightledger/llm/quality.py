"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measured`` names what can be measured, ``RULES`` bounds measures, and ``apply_rules`` turns both into columns; nothing
leaves the JVM. Measures leave a generator, so that later filters on them are not pushed below and do not count twice. Nulls count as empty texts, an empty text has no words and fails the base rule, repeated rows are judged
alike one by one, and columns of the input other than ``doc_id``, ``text`` and ``lang`` play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.common import BLANK, words

#: Frequent function words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "on", "be", "by", "this", "are", "was", "from", "at"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "par", "pour", "au", "sur", "avec", "ou"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``; a bound of None is open, and a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("shouts_per_word", None, 0.5),
    Rule("stop_words_per_word", 0.01, None),
    Rule("dup_line_share", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: a lambda is computed for each element with all it mentions, so the value is
    bound as the only element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many positions lie in a window of words that occurs twice or more; words are given by their hashes.

    Windows are told apart by a 64-bit hash. Texts whose windows all differ, the usual case, stop at a set size.
    """
    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def starts(ranked: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(ranked, a)["h"] == F.get(ranked, b)["h"], F.lit(False))
        twice = F.transform(ranked, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
        return F.array_sort(F.array_compact(twice))

    def reach(at: Column) -> Column:
        # a start brings as many new positions as lie before the next start, a whole window at most
        gaps = F.transform(at, lambda s, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - s, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def covered(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(ranked, lambda r: bound(starts(r), reach))

    count = bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n <= window, F.lit(0)).otherwise(count).cast("long")


def _among(found: list[str]):
    return lambda w: F.lower(w).isin(found)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts and ratios that rules speak of."""
    blank = rf"(?s)^[{BLANK}]*$"
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = F.lit(None)
    for lang, found in STOP_WORDS.items():
        stop = F.when(F.col("lang") == lang, F.size(F.filter("words", _among(found)))).otherwise(stop)
    split = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text")).select(
        "doc_id", "lang", "text", words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: ~line.rlike(blank)).alias("lines"),
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_shouts": F.regexp_count("text", F.lit(r"!")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_stop_words": stop,
        "n_repeat_words": bound(F.transform("words", lambda w: F.xxhash64(w)), lambda h: repeated_words(h)),
    }
    counted = split.select("doc_id", F.inline(F.array(F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))))
    per_word = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words"))
    return counted.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_shouts").alias("shouts_per_word"),
        per_word("n_stop_words").alias("stop_words_per_word"),
        F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")).alias("dup_line_share"),
    )


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table passes."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & F.coalesce(F.col(r.measure) >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(F.col(r.measure) <= r.high, F.lit(True))
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All measures of each document, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``apply_rules`` with production thresholds."""
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stop = " ".join(
        f"WHEN lang = '{k}' THEN len(list_filter(words, lambda x: lower(x) IN ({', '.join(repr(x) for x in v)})))" for k, v in STOP_WORDS.items()
    )
    tests = []
    for r in RULES:
        tests += [f"coalesce({r.measure} >= {r.low}, true)"] if r.low is not None else []
        tests += [f"coalesce({r.measure} <= {r.high}, true)"] if r.high is not None else []
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 g AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
 h AS (SELECT rid, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM g),
 r AS (SELECT rid, i FROM h QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
 c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, {WINDOW}) AS o(k) GROUP BY rid),
 m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_shouts,
   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CASE {stop} END AS n_stop_words
   FROM w LEFT JOIN c USING (rid)),
 q AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word,
   n_shouts / nullif(n_words, 0) AS shouts_per_word, n_stop_words / nullif(n_words, 0) AS stop_words_per_word,
   n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
   n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept FROM q"""


ORACLE_SQL = _sql()
