"""What the corpus operators share: reading tables and writing intermediate results to the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, as a character class body: space, \t, \n, \v, \f, \r.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a session on one machine (tests) names none, one of our own. A cluster must
    name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; ``release`` removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    return path


#: What this process has written to shared folders: paths, and the catalog's tables of those that are tables.
_WRITTEN: dict[str, str | None] = {}


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if table := _WRITTEN.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Removes all intermediate results of this process: call it when the results that rest on them have been read or written."""
    _remove(spark, list(_WRITTEN))


#: What the stages of a pipeline have written and left for their results.
_LEFT: set[str] = set()


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a pipeline. Its documents are the stored result of the stage before, so what that one left is removed first,
    but for what the documents still read."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT & set(_WRITTEN)
        read = docs.inputFiles() if left else []
        gone = [p for p in left if not any(p.rpartition("/")[2] in x for x in read)]  # names are unique
        _remove(spark, gone)
        before = set(_WRITTEN)
        out = f(spark, docs, sf_dir)
        _LEFT.difference_update(gone)
        _LEFT.update(set(_WRITTEN) - before)
        return out

    return run


def discard(spark: SparkSession, frames: Iterable[DataFrame]) -> None:
    """Removes stored frames that nothing rests on any more."""
    _remove(spark, [df.stored_at for df in frames])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is written inside is removed at the end, but for the frames put into the list. Nothing else may rest on it by then."""
    before, kept = set(_WRITTEN), []
    yield kept
    stay = {df.stored_at for df in kept}
    _remove(spark, [p for p in _WRITTEN if p not in before and p not in stay])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: later steps neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return stored(spark.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Notes where a frame is stored, for ``scratch``."""
    _WRITTEN[path], df.stored_at = table, path
    return df


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def join_salted(rows: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``small``, which has one row for each ``key``; rows of one key are dealt to ``salts`` parts by the
    column ``spread``, each of which gets its own copy of the key's row, so that a hot key does not end in one task."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")
