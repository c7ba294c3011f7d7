"""Connected components of a graph given by edges, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.llm.common import join_salted, materialize

#: Edges, both ways, that one task contracts at once when no more are left.
REST = 20_000


def rest(edges: DataFrame) -> DataFrame:
    """``a, to`` for every node of a few edges: the smallest node of its component."""
    schema = T.StructType([edges.schema["a"], T.StructField("to", edges.schema["a"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict = {}

        def root(x):
            while (up := to.setdefault(x, x)) != x:
                to[x] = x = to[up]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, high = sorted((root(x), root(y)))
                to[high] = low
            kind = b.schema.field(0).type
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(list(to), kind), pa.array([root(x) for x in list(to)], kind)], names=["a", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``; label is some node of the component, the same for all.

    In each round every node is replaced by its smallest neighbour if that is smaller. Nodes should be hashes: in random
    order a round leaves a fraction of the nodes, so rounds grow with the logarithm of their number. Counts per node are
    combined before they are shuffled, edges between the same two nodes once replaced are one, and a hub's edges are dealt to
    several tasks. The last ``REST`` edges are contracted in one task: rounds cost the driver as much however little is left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialize(both.filter("a != b").distinct(), "edges")
    nodes, steps = now.select(F.col("a").alias("node")).distinct(), []
    while left := now.count():
        if left <= REST:
            steps.append(materialize(rest(now), "step"))
            break
        step = materialize(now.groupBy("a").agg(F.min("b").alias("to")).withColumn("to", F.least("a", "to")), "step")
        steps.append(step)
        one = join_salted(now, step, "a", "b").select("b", F.col("to").alias("a"))
        two = join_salted(one, step.withColumnRenamed("a", "b"), "b", "a").select("a", F.col("to").alias("b"))
        now = materialize(two.filter("a != b").distinct(), "edges")
    found = nodes.withColumn("label", F.col("node"))
    for step in steps:
        found = join_salted(found, step.withColumnRenamed("a", "label"), "label", "node", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(found, "components")
