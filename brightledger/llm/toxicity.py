"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; the predicted probabilities of earlier categories, as
log-odds, are features of later ones. So that a later model sees predictions as good as it will get, it is trained with
out-of-fold ones: each part of the sample predicted by a model that was fitted on the other parts.

Features of a text are its distinct words and prefixes of words (so that unseen forms count), hashed.
The models are fitted on a bounded sample of labelled documents: up to ``SAMPLE`` documents of each value of the last category, by a
hash of the id, and of each of them up to ``MOST`` features, by their hash. Every document is scored, whole.

Null texts are empty and get the model's base rate; labels that are null or of unknown documents are left out before the
sample is drawn; a document that repeats, or has several labels, is learned from once (the least of its labels and texts).
Repeated rows are scored one by one. A category without examples of both kinds gets a constant probability, and without labels
no document is toxic. An empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from brightledger.llm import wordhash
from brightledger.llm.common import read, stage as pipeline_stage

SAMPLE, MOST, FEATURES, FOLDS, BITS = 2000, 8192, 1500, 3, 20
#: The verdict's threshold on the last probability is learned between these.
LIMITS = (0.2, 0.6)
PREFIXES = (4, 5)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each part of a string column: first text, number of texts, and the pairs of text and distinct feature."""
    mask = np.uint64((1 << BITS) - 1)
    for w in wordhash.words(column):
        found = [(w.hashes, w.of)]
        for size in PREFIXES:
            hashes, which = w.prefix(size)
            found.append((hashes, w.of[which]))
        keys = np.concatenate([(of.astype(np.uint64) << np.uint64(BITS)) | (h & mask) for h, of in found])
        keys = np.unique(keys)
        yield w.first, w.n, (keys >> np.uint64(BITS)).astype(np.int64), (keys & mask).astype(np.int64)


@dataclass
class Linear:
    """A logistic model over hashed features and the log-odds of earlier categories."""

    weights: np.ndarray
    chained: np.ndarray
    base: float

    def odds(self, n: int, of: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        value = self.weights[feature]
        here = np.flatnonzero(value)
        return np.bincount(of[here], value[here], minlength=n) + earlier @ self.chained + self.base


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def chosen(n: int, of: np.ndarray, feature: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The features that tell the kinds apart best, by the score of a two-proportion test; those of a single text never."""
    size = 1 << BITS
    seen = np.bincount(feature, minlength=size).astype(float)
    hit = np.bincount(feature, y[of].astype(float), minlength=size)
    rate = y.mean()
    score = np.abs(hit - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate) * (1 - seen / (n + 1)), 1e-9))
    score[seen < 2] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return best[score[best] > 0]


def fit(n: int, of: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Linear:
    """Penalised logistic regression by Newton steps along conjugate directions."""
    weights = np.zeros(1 << BITS)
    rate = (y.sum() + 0.5) / (n + 1)
    if n == 0 or y.min() == y.max():
        return Linear(weights, np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    keep = chosen(n, of, feature, y, FEATURES)
    column = np.full(1 << BITS, -1)
    column[keep] = np.arange(len(keep))
    here = column[feature] >= 0
    row, col = of[here], column[feature[here]]
    k = len(keep)
    cost = np.concatenate([np.full(k, penalty), np.full(earlier.shape[1], penalty), [1e-3]])

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[:k][col], minlength=n) + earlier @ v[k:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(col, r[row], minlength=k), earlier.T @ r, [r.sum()]])

    def loss(v: np.ndarray) -> float:
        z = times(v)
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(cost * v * v))

    v = np.zeros(k + earlier.shape[1] + 1)
    v[-1] = np.log(rate / (1 - rate))
    now = loss(v)
    for _ in range(25):
        p = probability(times(v))
        gradient = back(p - y) + cost * v
        curve = p * (1 - p)
        step, rest = np.zeros_like(v), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(30):
            along = back(curve * times(way)) + cost * way
            far = size / (way @ along)
            step, rest = step + far * way, rest - far * along
            new = rest @ rest
            if new < 1e-4 * (gradient @ gradient):
                break
            way, size = rest + new / size * way, new
        pace = 1.0
        while (then := loss(v + pace * step)) > now and pace > 1e-3:
            pace /= 2
        if now - then < 1e-4 * abs(now):
            break
        v, now = v + pace * step, then
    weights[keep] = v[:k]
    return Linear(weights, v[k:-1], float(v[-1]))


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold within LIMITS that tells the kinds apart best (F1) on held-out predictions; of equals the middle."""
    options = np.round(np.arange(LIMITS[0], LIMITS[1] + 0.001, 0.02), 2)
    hits = [(np.sum((p > t) & (y > 0)), np.sum(p > t)) for t in options]
    f1 = np.array([2 * a / max(b + y.sum(), 1) for a, b in hits])
    return float(np.median(options[f1 >= f1.max() - 1e-9]))


def train(rows: list[tuple[int, np.ndarray]], values: np.ndarray) -> tuple[list[Linear], float]:
    """The chain's models from rows of fold and features and a column of 0 and 1 for each category, and the threshold on the
    last category's probability."""
    n = len(rows)
    fold = np.array([f for f, _ in rows], dtype=np.int64)
    of = np.repeat(np.arange(n), [len(x) for _, x in rows])
    feature = np.concatenate([np.asarray(x, dtype=np.int64) for _, x in rows]) if n else np.zeros(0, dtype=np.int64)
    models, earlier, held_out = [], np.zeros((n, 0)), np.zeros(n)
    for k in range(values.shape[1]):
        y = values[:, k]
        if k:
            earlier = np.column_stack([earlier, np.clip(held_out, -10, 10)])
        models.append(fit(n, of, feature, earlier, y))
        held_out = np.zeros(n)
        for f in range(FOLDS):
            inside = fold != f
            place = np.cumsum(inside) - 1
            pick = inside[of]
            model = fit(int(inside.sum()), place[of[pick]], feature[pick], earlier[inside], y[inside])
            held_out[~inside] = model.odds(n, of, feature, earlier)[~inside]
    return models, best_limit(probability(held_out), values[:, -1]) if n else LIMITS[1]


def fewest(of: np.ndarray, n: int, most: int) -> np.ndarray:
    """Which features to keep, ``most`` a text: the smallest, as features are hashes; they come in order of text and feature."""
    begin = np.searchsorted(of, np.arange(n))
    return np.arange(len(of)) - begin[of] < most


def sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int) -> DataFrame:
    """``fold``, the categories and ``features`` of up to ``most`` labelled documents of each value of the last category: at most
    2 * most rows of MOST numbers, as ids are drawn one by one and only among those of documents."""
    named = labels.select("doc_id", *[c.cast("int").alias(k) for k, c in categories.items()]).na.drop()
    order = F.xxhash64("doc_id")
    last = list(categories)[-1]
    known = named.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*sorted(categories, key=lambda c: c != last))).alias("v"))
    known = known.select("doc_id", *[F.col(f"v.{c}").alias(c) for c in categories])
    kinds = [known.filter(F.col(last) == v).orderBy(order, "doc_id").limit(most) for v in (0, 1)]
    some = kinds[0].unionByName(kinds[1]).withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "fold", *categories).agg(F.min("text").alias("text"))
    columns, bound = ["fold", *categories], MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, of, feature in features(b.column("text")):
                keep = fewest(of, n, bound)
                of, feature = of[keep], feature[keep]
                cut = np.searchsorted(of, np.arange(n + 1))
                part = b.slice(first, n)
                found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], found], names=[*columns, "features"])

    return rows.select("text", *columns).mapInArrow(run, ", ".join(f"{c} int" for c in columns) + ", features array<int>")


def learned(sample: DataFrame, names: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], float]:
    """The chain's models, each as the places and values of its weights, its chained weights and its base, and the threshold. One
    task fits them, as the sample is bounded: the driver holds neither the sample nor what fitting takes."""

    def fitted(found: pa.Table | None) -> tuple[list[Linear], float]:
        if found is None:
            return train([], np.zeros((0, len(names))))
        fold, lists = found.column("fold").to_pylist(), found.column("features").combine_chunks()
        values = np.column_stack([found.column(c).to_numpy() for c in names]).astype(float)
        rows = list(zip(fold, [x.values.to_numpy() for x in lists], strict=True))
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0], len(rows[i][1]), rows[i][1].tobytes(), tuple(values[i])))
        return train([rows[i] for i in order], values[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        models, limit = fitted(pa.Table.from_batches(held) if held else None)
        where = [np.flatnonzero(m.weights) for m in models]
        columns = [list(range(len(models))), where, [m.weights[w] for m, w in zip(models, where, strict=True)], [m.chained for m in models], [m.base for m in models], [limit] * len(models)]
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k", "place", "weight", "chained", "base", "limit"])

    rows = sample.repartition(1).mapInArrow(run, "k int, place array<int>, weight array<double>, chained array<double>, base double, limit double").collect()
    if not rows:  # an empty sample may have no task
        models, limit = fitted(None)
        return [(np.flatnonzero(m.weights), m.weights[np.flatnonzero(m.weights)], m.chained, m.base) for m in models], limit
    rows.sort(key=lambda r: r["k"])
    return [(np.array(r["place"], dtype=np.int64), np.array(r["weight"]), np.array(r["chained"]), r["base"]) for r in rows], rows[0]["limit"]


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, most: int = SAMPLE, own: list[str] | None = None, verdict: str = "rejected") -> DataFrame:
    """``doc_id``, ``p_<category>`` and the verdict, by its name, for every document.

    ``categories`` are Columns of labels, in the chain's order; the last one decides, by a threshold that out-of-fold
    predictions of the sample give. With ``own``, ``text`` among them, rows are these columns of the documents and the verdict.
    """
    categories = categories or {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    names = list(categories)
    sparse, limit = learned(sampled(docs, labels, categories, most), names)
    held = docs.sparkSession.sparkContext.broadcast(sparse)  # at most FEATURES weights a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = []
        for where, value, chained, base in held.value:
            weights = np.zeros(1 << BITS)
            weights[where] = value
            chain.append(Linear(weights, chained, base))
        for b in batches:
            for first, n, of, feature in features(b.column(place)):
                earlier = np.zeros((n, 0))
                for m in chain:
                    earlier = np.column_stack([earlier, np.clip(m.odds(n, of, feature, earlier), -10, 10)])
                p = [pa.array(probability(earlier[:, k])) for k in range(len(names))]
                over = pa.array(probability(earlier[:, -1]) > limit)
                part = b.slice(first, n)
                out = [part.column(0), *p, over] if own is None else [*part.columns, over]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    place = 1 if own is None else own.index("text")
    if own is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        schema = StructType([StructField("doc_id", LongType()), *[StructField(f"p_{c}", DoubleType()) for c in names], StructField(verdict, BooleanType())])
    else:
        rows = docs.select(*own)
        schema = StructType([*rows.schema.fields, StructField(verdict, BooleanType())])
    return rows.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its probabilities and the verdict."""
    return score(docs, labels).withColumnRenamed("rejected", "toxic").withColumn("kept", ~F.col("toxic"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with their own columns: each row by its own text, whatever its id. Rows without a text
    are not toxic, and without labels all rows stay."""
    verdict = "rejected"
    while verdict in (c.lower() for c in docs.columns):
        verdict += "_"
    return score(docs, read(spark, sf_dir, "labels"), own=docs.columns, verdict=verdict).filter(~F.col(verdict)).drop(verdict)
