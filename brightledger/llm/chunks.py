"""Texts in chunks of about one size, for operators whose tasks work on many texts at once and more than one time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.llm import wordhash
from brightledger.llm.common import new_path, stored

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 20


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by a column: such tables are joined on it without moving rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    out = df.write.format("parquet").option("path", path).option("compression", "zstd")
    out.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    return stored(spark.table(table), path, table)


def by_chunk(df: DataFrame, name: str) -> DataFrame:
    return bucketed(df, name, "chunk")


def chunks(docs: DataFrame, keep: Sequence[str], most: int | None = None) -> DataFrame:
    """Texts and the kept columns in chunks of about ``most`` bytes, stored ``by_chunk``: ``chunk, text`` and ``c0, c1, ...``, all
    but the first arrays."""
    most = most or CHUNK
    kept = [T.StructField(f"c{i}", T.ArrayType(docs.schema[c].dataType)) for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("text", T.ArrayType(T.StringType())), *kept])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            offsets, _ = wordhash.buffers(b.column(0))
            for first, last in wordhash.parts(offsets, most):
                at = pa.array([0, last - first], pa.int32())
                part = [pa.ListArray.from_arrays(at, c.slice(first, last - first)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *part], names=names)
                number += 1

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    return by_chunk(rows.mapInArrow(run, schema), "chunks")


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, pa.Array]]:
    """Batch, place in it, number and texts of every chunk."""
    for b in batches:
        texts = b.column("text")
        for i in range(b.num_rows):
            yield b, i, b.column("chunk")[i].as_py(), texts[i].values
