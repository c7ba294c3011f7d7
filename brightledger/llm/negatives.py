"""Hard negatives by an exact nearest-neighbour join over Voronoi cells.

A row's score for an anchor is their inner product. One more coordinate, ``sqrt(M * M - x * x)`` with the greatest length M, lifts all
candidates to one length, anchors get 0 there; then the largest product is the smallest distance, and distances have bounds:

1. Pivots are fitted on a bounded sample of anchors; an anchor belongs to the cell of its nearest pivot. A cell knows its radius. How
   many pivots there are is what costs least on the sample: more cells are smaller and prune more, but a row that no bound excludes
   goes to each of them.
2. A bounded sample of rows gives each anchor a score that the last row it looks for has at least (that so many rows of the sample
   reach), and the cell the largest distance at which anything can serve one of its anchors.
3. A candidate goes to those cells only that it might serve: by the triangle inequality over its distance from the pivot, and by
   its length times the radius around its product with the pivot. For negatives, whose scores are bounded on both sides, what lies
   nearer than all anchors' upper bounds is left out too.
4. A cell's anchors and candidates are dealt to a grid of blocks; each compares its rows exactly and keeps the best of each anchor.
   What the blocks of an anchor kept is ranked at the end.

This is done twice: for an anchor's positives (cells are split by label there), and for negatives between shares of their scores.
What the driver holds is bounded: samples, pivots and a few numbers for each cell. Bounds prune where vectors have structure; without
any, each anchor's cell is compared with nearly all rows, a stated query set against all rows, in blocks.

Components become ``floor(scale * x)``, and scores are exact. Rows with a null id, label or vector, with null or non-finite components,
or of a scaled length of 2**31 or more (whose scores need not fit 64 bits) take no part. Shorter vectors end in zeros. Of rows with one
id the one with the smallest label, then vector, counts. Ties go to the smaller id. An anchor without positives, or a positive without
negatives, has no rows; an empty table gives an empty result. Columns other than the three named play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.llm.ann import lloyd, squared
from brightledger.llm.common import materialize
from brightledger.llm.near import groups

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Rows of the samples at most, and bytes; anchors a pivot, pivots at most; parts that a cell's labels are dealt to.
SAMPLE, SAMPLE_BYTES, PER_PIVOT, PIVOTS, LABELS = 4096, 1 << 25, 16, 256, 16
#: What it costs to bring a row to a cell, in comparisons with an anchor.
MOVE = 500
#: Anchors and candidates in a block, and candidates compared at once.
ANCHORS, CANDIDATES, AT_ONCE = 1024, 1 << 16, 2048
#: Share of the positive's score, in twentieths, that a negative has at least and at most.
AT_LEAST, AT_MOST = 10, 19
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, v scaled to whole numbers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna()
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**31 / scale))
    rows = rows.filter(~bad).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    one = rows.filter(length < 2.0**62).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), len(flat) // max(1, len(column)))


def best(groups_of: list[np.ndarray], score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest scores of each group, ties to smaller ids."""
    order = np.lexsort((ids, -score, *groups_of[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups_of], axis=0)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < top]


def reached(scores: np.ndarray, allowed: np.ndarray, top: int, low: np.ndarray) -> np.ndarray:
    """For each row the ``top``-th largest allowed score, ``low`` if there are fewer."""
    if scores.shape[1] < top:
        return low
    worst = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    last = np.partition(np.where(allowed, scores, worst), -top, axis=1)[:, -top]
    return np.where(last == worst, low, last)


class Space:
    """What all tasks know: the greatest length, the sample and the pivots."""

    def __init__(self, most: float, ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, pivots: np.ndarray):
        # doubles hold products below 2**53 exactly, by Cauchy and Schwarz
        self.kind = np.float64 if most < 2.0**53 else np.int64
        self.most, self.ids, self.labels, self.sample, self.pivots = most, ids, labels, sample.astype(self.kind), pivots
        self.low = self.kind(-(2**53)) if self.kind is np.float64 else np.int64(-(2**62))

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each anchor, and how far it is."""
        d = squared(q.astype(np.float64), self.pivots)
        own = d.argmin(1)
        return own, np.sqrt(d[np.arange(len(q)), own])

    def serves(self, x: np.ndarray, cell: np.ndarray, radius: np.ndarray, low: np.ndarray, far: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether candidates may serve groups of anchors, given by their cell, radius, least and greatest score looked for, and the
        greatest distance at which an anchor's least score is met."""
        x, length = x.astype(np.float64), np.sqrt((x.astype(np.float64) ** 2).sum(1))
        p = self.pivots[cell]
        product = x @ p.T
        away = np.sqrt(np.maximum(self.most - 2 * product + (p * p).sum(1)[None, :], 0))
        spread = length[:, None] * radius[None, :]
        slack = 1e-6 * (1 + np.sqrt(self.most))
        return (product + spread >= low[None, :] - slack) & (product - spread <= high[None, :] + slack) & (away - radius[None, :] <= far[None, :] + slack)


def fitted(most: float, ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, some: tuple[np.ndarray, np.ndarray, np.ndarray], anchors: int, top: int) -> Space:
    """The space whose cells cost least by the sample. some: ids, labels and vectors of a sample of the anchors."""
    own, own_labels, q = some
    found, count = [], 1
    while count <= max(1, min(PIVOTS, anchors // PER_PIVOT)):
        pivots = lloyd(q.astype(np.float64), count, np.random.default_rng(7)) if q.shape[1] else np.zeros((1, 0))
        space = Space(most, ids, labels, sample, pivots)
        cell, away = space.cells(q)
        allowed = (own_labels[:, None] == labels[None, :]) & (own[:, None] != ids[None, :])
        least = reached(q.astype(space.kind) @ space.sample.T, allowed, top, np.full(len(q), space.low)).astype(np.float64)
        far = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1) + most - 2 * least, 0))
        there = np.unique(cell)
        over = lambda f, x: np.array([f(x[cell == k]) for k in there])  # noqa: B023, E731
        hit = space.serves(sample[:512], there, over(np.max, away), over(np.min, least), over(np.max, far), np.full(len(there), np.inf))
        share = np.array([(cell == k).mean() for k in there])
        found.append((float((hit * (MOVE + anchors * share)[None, :]).sum()), count, space))
        count *= 4
    return min(found, key=lambda x: x[:2])[2]


def _joined(space, anchors: DataFrame, rows: DataFrame, group: Callable[[np.ndarray], np.ndarray], bounds: list, compare, schema: str, v: str) -> DataFrame:
    """Blocks of anchors (``group, id, label, v`` and ``low, high, ids``) and of the rows that may serve their group, given to ``compare``.

    group: of labels, which part of a cell's groups a row can be in (-1: any); bounds: ``(group, cell, part, radius, low, far, high, anchors)``.
    """
    spark = rows.sparkSession
    number, cell, part, radius, low, far, high, _ = (np.array(x) for x in zip(*bounds, strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                some = b.slice(lo, AT_ONCE)
                x, own = matrix(some.column("v"), space.value.kind), group(some.column("label").to_numpy())
                hit = space.value.serves(x, cell, radius, low, far, high) & ((own[:, None] == part[None, :]) | (own[:, None] < 0))
                at, to = np.nonzero(hit)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(x) + 1)), pa.int32()), pa.array(number[to], pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["id", "label", "v", "groups"])

    served = materialize(rows.select(F.col("vec_id").alias("id"), "label", F.col("v").cast(v).alias("v")).mapInArrow(deal, f"id long, label long, v {v}, groups array<int>"), "served")
    wide = served.select("id", "label", "v", F.explode("groups").alias("group"))
    count = {r["group"]: r["n"] for r in served.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row a cell
    grid = [(int(g), -(-int(n) // ANCHORS), -(-count[g] // CANDIDATES)) for g, *_, n in bounds if g in count]
    sizes = F.broadcast(spark.createDataFrame(grid, "group int, blocks int, slices int"))
    dealt = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    ask = [F.col(c) for c in ("low", "high", "ids")]
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high", "ids")]
    mine = anchors.select("group", "id", "label", F.col("v").cast(v).alias("v"), *ask).join(sizes, "group")
    mine = mine.select("group", dealt("blocks").alias("i"), every("slices").alias("j"), F.lit(True).alias("asks"), "id", "label", "v", *ask)
    theirs = wide.join(sizes, "group").select("group", every("blocks").alias("i"), dealt("slices").alias("j"), F.lit(False).alias("asks"), "id", "label", "v", *none)
    keys = ["group", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            asks = t.column("asks").combine_chunks()
            a, c = t.filter(asks).combine_chunks(), t.filter(pa.compute.invert(asks)).combine_chunks()
            if a.num_rows and c.num_rows:
                yield from compare(a, c)

    return mine.unionByName(theirs).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _lists(t: pa.Table, name: str, width: int, kind: type) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width).astype(kind)


def _bounds(asked: DataFrame) -> list[tuple]:
    """A row for each group of anchors."""
    agg = [F.first("cell"), F.first("part"), F.max("radius"), F.min("least"), F.max("far"), F.max("greatest"), F.count("*")]
    return [tuple(r) for r in asked.groupBy("group").agg(*agg).collect()]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, relabel: Callable[[Column, Column], Column] = lambda i, label: label,
    positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
) -> DataFrame:
    """For each row with ``is_anchor`` (on ``vec_id``) its first ``positives`` other rows of the same label, and for each of these the first
    ``negatives`` rows of other labels whose scores lie between the shares ``AT_LEAST`` and ``AT_MOST`` of the positive's."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, scale).withColumn("label", relabel(F.col("vec_id"), F.col("label"))), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    size = rows.agg(F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("short"), F.max(length).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("wide"), F.count_if(is_anchor).alias("anchors")).first()
    if not size["anchors"]:
        return spark.createDataFrame([], RESULT)
    if size["short"] < size["d"]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size["d"]) - F.size("v"))))
    v = "array<short>" if (size["wide"] or 0) < 1 << 15 else "array<long>"
    most_rows = min(SAMPLE, max(16, SAMPLE_BYTES // (8 * max(1, size["d"]))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_rows).toArrow().combine_chunks()
    some = rows.filter(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_rows).toArrow().combine_chunks()
    columns = lambda t: (t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v").combine_chunks(), np.int64))
    space = spark.sparkContext.broadcast(fitted(size["most"], *columns(drawn), columns(some), size["anchors"], positives))
    ask = "group int, cell int, part int, radius double, least double, far double, greatest double, id long, label long, v array<long>, low array<long>, high array<long>, ids array<long>"

    def part_of(label: np.ndarray) -> np.ndarray:
        return label % LABELS

    def asking(b: pa.RecordBatch, q: np.ndarray, part: np.ndarray, least: np.ndarray, greatest: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
        s = space.value
        cell, radius = s.cells(q)
        far = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1) + s.most - 2 * least.astype(np.float64), 0))
        wide = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
        columns = [pa.array((cell * LABELS + part).astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(radius), pa.array(least.astype(np.float64)), pa.array(far), pa.array(greatest.astype(np.float64))]
        return pa.RecordBatch.from_arrays([*columns, *[b.column(c) for c in ("vec_id", "label", "v")], *[wide(x) for x in arrays]], names=[x.split()[0] for x in ask.split(", ")])

    def seek_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                q, label, ids = matrix(b.column("v"), s.kind), b.column("label").to_numpy(), b.column("vec_id").to_numpy()
                allowed = (label[:, None] == s.labels[None, :]) & (ids[:, None] != s.ids[None, :])
                least = reached(q @ s.sample.T, allowed, positives, np.full(len(q), s.low))
                none = np.full((len(q), 1), np.iinfo(np.int64).max)
                yield asking(b, q, part_of(label), least, np.full(len(q), np.inf), [least[:, None], none, none])

    def take_positives(a: pa.Table, c: pa.Table) -> Iterator[pa.RecordBatch]:
        s = space.value
        q, x = matrix(a.column("v").combine_chunks(), s.kind), matrix(c.column("v").combine_chunks(), s.kind)
        own, ids, label, other = a.column("id").to_numpy(), c.column("id").to_numpy(), a.column("label").to_numpy(), c.column("label").to_numpy()
        low, held = _lists(a, "low", 1, s.kind), [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=s.kind), np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(x), AT_ONCE):
            score = q @ x[lo : lo + AT_ONCE].T
            i, j = np.nonzero((label[:, None] == other[None, lo : lo + AT_ONCE]) & (own[:, None] != ids[None, lo : lo + AT_ONCE]) & (score >= low))
            held = [np.concatenate(p) for p in zip(held, (own[i], score[i, j], ids[lo + j]), strict=True)]
            keep = best([held[0]], held[1], held[2], positives)
            held = [h[keep] for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[2]), pa.array(held[1].astype(np.int64))], names=["anchor_id", "vec_id", "score"])

    anchors = rows.filter(is_anchor)
    asked = materialize(anchors.select("vec_id", "label", "v").mapInArrow(seek_positives, ask), "anchors")
    found = _joined(space, asked, rows, part_of, _bounds(asked), take_positives, "anchor_id long, vec_id long, score long", v)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    first = found.withColumn("rank", rank).filter(F.col("rank") <= positives)
    first = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # a few for each anchor
    first = materialize(first, "positives")

    def seek_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                q, label = matrix(b.column("v"), s.kind), b.column("label").to_numpy()
                many = np.diff(b.column("ids").offsets.to_numpy())
                at = np.arange(positives)[None, :] < many[:, None]
                ps, ids = np.full(at.shape, -1), np.zeros(at.shape, dtype=np.int64)
                ps[at], ids[at] = b.column("scores").flatten().to_numpy(), b.column("ids").flatten().to_numpy()
                floor, high = -(-AT_LEAST * (ps % 20) // 20) + AT_LEAST * (ps // 20), AT_MOST * (ps % 20) // 20 + AT_MOST * (ps // 20)
                high[ps < 0] = -(2**62)  # nothing lies between the shares of a negative score, nor of none
                score, low = q @ s.sample.T, floor.astype(s.kind)
                differs = label[:, None] != s.labels[None, :]
                for k in range(positives):
                    allowed = differs & (score >= floor[:, k, None]) & (score <= high[:, k, None])
                    low[:, k] = reached(score, allowed, negatives, low[:, k])
                low[ps < 0] = 2**52 if s.kind is np.float64 else 2**62
                some = np.flatnonzero((ps >= 0).any(1))
                if len(some):
                    yield asking(b.take(pa.array(some)), q[some], np.zeros(len(some), dtype=np.int64), low[some].min(1), high[some].max(1), [low[some], high[some], np.stack([ids, ps], axis=2)[some].reshape(len(some), -1)])

    def take_negatives(a: pa.Table, c: pa.Table) -> Iterator[pa.RecordBatch]:
        s = space.value
        q, x = matrix(a.column("v").combine_chunks(), s.kind), matrix(c.column("v").combine_chunks(), s.kind)
        own, ids, label, other = a.column("id").to_numpy(), c.column("id").to_numpy(), a.column("label").to_numpy(), c.column("label").to_numpy()
        low, high, pairs = _lists(a, "low", positives, s.kind), _lists(a, "high", positives, s.kind), _lists(a, "ids", 2 * positives, np.int64)
        none = np.zeros(0, dtype=np.int64)
        held = [none, none, np.zeros(0, dtype=s.kind), none]
        for lo in range(0, len(x), AT_ONCE):
            score = q @ x[lo : lo + AT_ONCE].T
            i, j = np.nonzero((label[:, None] != other[None, lo : lo + AT_ONCE]) & (score >= low.min(1)[:, None]) & (score <= high.max(1)[:, None]))
            here = score[i, j]
            for k in range(positives):
                ok = (here >= low[i, k]) & (here <= high[i, k])
                new = (i[ok], np.full(ok.sum(), k), here[ok], ids[lo + j[ok]])
                held = [np.concatenate(p) for p in zip(held, new, strict=True)]
            keep = best(held[:2], held[2], held[3], negatives)
            held = [h[keep] for h in held]
        i, k = held[0], held[1]
        columns = [own[i], pairs[i, 2 * k], pairs[i, 2 * k + 1], held[3], held[2].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    lists = first.select(F.col("anchor_id").alias("vec_id"), F.col("p.vec_id").alias("ids"), F.col("p.score").alias("scores"))
    asked = materialize(anchors.join(lists, "vec_id").select("vec_id", "label", "v", "ids", "scores").mapInArrow(seek_negatives, ask), "anchors")
    bounds = _bounds(asked)
    if not bounds:
        return spark.createDataFrame([], RESULT)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _joined(space, asked, rows, lambda label: np.full(len(label), -1), bounds, take_negatives, schema, v)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(*[x.split()[0] for x in RESULT.split(", ")])


def query(vectors: DataFrame) -> DataFrame:
    """Each vector whose id is divisible by 50 is an anchor; where the id is divisible by 7 the label is the next of ten."""
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


#: All pairs of anchors and rows, for a small table.
ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= {NEGATIVES}"""
