"""Token counts in delta-maintained rollups.

Every batch of changes becomes signed deltas by source, language and tokenizer version: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference of counts. Totals are sums of deltas, so batches may come
in any order. A batch is one folder, written whole and marked by the writer's success file; committing a batch again does
nothing, so a job that is lost and run again counts nothing twice.

Null counts are 0 tokens; null sources, languages and versions are groups of their own. Repeated rows count as often as they
occur. An empty batch commits and adds nothing; groups whose documents have all gone are left out of totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.llm.common import WORD, new_path, materialize

KEYS = ["source", "lang", "tokenizer"]
#: Counting rules by tokenizer version, for texts of this library's own making; each is a pattern of one token.
VERSIONS = {"words/1": WORD, "pieces/1": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[!-/:-@\[-`{-~]"}


def deltas(changes: DataFrame) -> DataFrame:
    """Signed deltas of ``op`` (insert, delete or revise), the key columns, ``n_tokens`` and, for revisions, ``old_tokens``.

    Rows with another ``op`` raise an error when they are read.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "revise", new - old).otherwise(sign * new)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the batch is in the rollup, by itself or in what was compacted."""
    fs, at = _files(spark, f"{path}/batch={batch}/_SUCCESS")
    return fs.exists(at) or not _ledger(spark, path).filter(F.col("batch") == batch).isEmpty()


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The names of the batches that were compacted."""
    fs, at = _files(spark, f"{path}/ledger/_SUCCESS")
    return spark.read.schema("batch string").parquet(f"{path}/ledger") if fs.exists(at) else spark.createDataFrame([], "batch string")


def _parts(spark: SparkSession, path: str) -> list[str]:
    """What counts: the compacted totals and the batches after them."""
    fs, at = _files(spark, path)
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    names = [x.toString() for x in found if x.getName() == "compacted" or x.getName().startswith("batch=")]
    return [p for p in names if fs.exists(_files(spark, f"{p}/_SUCCESS")[1])]


def commit(path: str, batch: str, changes: DataFrame) -> bool:
    """Adds a batch unless it is there already; says whether it did. What a lost attempt left is overwritten."""
    if committed(changes.sparkSession, path, batch):
        return False
    deltas(changes).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches; no rows where there are none.

    Batches are small next to what they count; ``compact`` makes one of many when there are more than a reader likes.
    """
    whole = _parts(spark, path)
    if not whole:
        return spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    rows = spark.read.parquet(*whole)
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the totals as the beginning of a new rollup at ``to``, with a ledger of the batches in them, so that a batch that comes
    again adds nothing there either; batches after it are committed there."""
    names = [p.rpartition("/batch=")[2] for p in _parts(spark, path) if "/batch=" in p]
    held = _ledger(spark, path).unionByName(spark.createDataFrame([(n,) for n in names], "batch string"))
    held.write.mode("overwrite").parquet(f"{to}/ledger")
    totals(spark, path).write.mode("overwrite").parquet(f"{to}/compacted")


def counted(docs: DataFrame) -> DataFrame:
    """One row for each document and tokenizer version: keys, a hash of the text, the estimated and the counted tokens."""
    text = F.coalesce("text", F.lit(""))
    counts = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.regexp_count(text, F.lit(v)).cast("long").alias("n_tokens")) for k, v in VERSIONS.items()])
    rows = docs.select("doc_id", "source", "lang", F.md5(text).alias("hash"), F.ceil(F.length(text) / 5).alias("old_tokens"), F.explode(counts).alias("c"))
    return rows.select("doc_id", "source", "lang", "hash", "old_tokens", "c.tokenizer", "c.n_tokens")


def query(docs: DataFrame) -> DataFrame:
    """Totals after three batches over all documents: estimated counts come in, counted tokens revise them, and of documents
    with one text all but the first by id, source and language are deleted. The second batch is committed twice."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "rollup")
    rows = materialize(counted(docs), "token-counts")
    old, none = F.col("old_tokens"), F.lit(None).cast("long")
    commit(path, "estimates", rows.withColumn("op", F.lit("insert")).withColumn("n_tokens", old))
    for _ in range(2):
        commit(path, "counts", rows.withColumn("op", F.lit("revise")))
    # what goes is everything less the first of each text, so that no group of copies is ever gathered
    first = rows.groupBy("hash", "tokenizer").agg(F.min(F.struct("doc_id", "source", "lang", "n_tokens")).alias("f"))
    first = first.select(F.lit("insert").alias("op"), "f.source", "f.lang", "tokenizer", "f.n_tokens", none.alias("old_tokens"))
    gone = rows.select(F.lit("delete").alias("op"), *KEYS, "n_tokens", none.alias("old_tokens"))
    commit(path, "duplicates", gone.unionByName(first))
    return totals(spark, path)


ORACLE_SQL = f"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS text FROM documents
           QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS FIRST, source NULLS FIRST, lang NULLS FIRST) = 1),
 c AS ({" UNION ALL ".join(f"SELECT source, lang, '{k}' AS tokenizer, len(regexp_extract_all(text, '{v}')) AS n FROM d" for k, v in VERSIONS.items())})
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY 1, 2, 3"""
