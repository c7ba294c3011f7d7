"""Approximate nearest neighbours by balanced posting lists.

The measure is the inner product. Vectors are put into bands of about one length; in a band one more coordinate lifts all
vectors to the band's length, and then the nearest vector is the one of largest product. Each band has centroids, each centroid
a posting list; vectors near a boundary go to two lists. A query

* gets a reference score, its ``top``-th best among ``REFERENCE`` vectors of the table: bands too short to reach it are left out,
* finds centroids by a walk of their neighbour graph, which goes on as long as centroids lie within ``ratio`` times the distance
  at which a vector of the band would have the reference score, and
* is compared with all vectors of these centroids' lists, exactly and in double precision.

The ratio is learned twice: from the sample alone, and then raised or lowered to the least under which ``AIM`` of the true
neighbours of ``TRIALS`` queries, which are compared with the whole table once, are in lists that are looked into. So clustered
vectors need few lists, vectors without any structure many, and queries unlike other rows count as they are.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors and ``SAMPLE_BYTES`` at most, by a hash), in two steps: cells, and
centroids in each cell. Every vector is indexed. There are ``CENTROIDS`` at most, near the square root of the largest tables
meant, so they, their graph and the cells' sizes have a fixed bound; they are all that is broadcast. Rows are dealt by cell: a
vector goes to the cells of its lists, a query with the numbers of its lists to their cells. Large cells are dealt to a grid of
blocks of vectors and of queries.

Vectors that are null, zero, of another length than most, or with null or non-finite components take no part, nor do rows
without an id. Ties go to the smaller id. Rows of one id and one vector count once; a query is never its own neighbour, nor is
a row of the same id. An empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.llm.common import materialize
from brightledger.llm.near import groups

TOP = 20
SAMPLE, SAMPLE_BYTES, CENTROIDS, LIST = 1 << 18, 1 << 27, 1 << 14, 32
#: Vectors and queries in a block of a cell.
BLOCK, QUERIES = 20_000, 2000
#: A vector goes to further lists up to this ratio of its nearest centroid's distance, and to so many at most.
REPLICA_RATIO, REPLICAS = 1.05, 2
#: Lengths of a band differ by this factor at most; all shorter ones are in the last of so many bands.
BAND, BANDS = 1.25, 24
#: Vectors for reference scores: half of them the longest of the sample. For the ratio one of so many vectors of the sample, queries
#: among them, and the share of their neighbours to be found; steps by which the ratio is raised, so many at most, and halved then.
REFERENCE, HOLD, TRIALS, AIM, RAISE, RAISES, HALVES = 4096, 4, 512, 0.96, 1.05, 40, 3
#: Neighbours of a centroid in the graph, and from how many a walk goes on at least. A query looks into further lists until they hold so many vectors.
DEGREE, LEAST, ENTRIES = 24, 400, 32


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes their length ``most``."""
    rest = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, rest])


def directed(q: np.ndarray, most: float) -> np.ndarray:
    """Unit queries among vectors lifted to that length."""
    return np.column_stack([q * most, np.zeros(len(q))])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def lloyd(x: np.ndarray, count: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds; each moves centroids of the smallest lists into the longest ones, so that lists stay
    balanced."""
    distinct = np.unique(x, axis=0)
    count = min(count, len(distinct))
    points = distinct[random.choice(len(distinct), count, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([squared(p, points).argmin(1) for p in np.array_split(x, 1 + len(x) // 4000)])
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(points)
        np.add.at(sums, own, x)
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
        small, large = np.argsort(sizes)[: count // 20], np.argsort(-sizes)[: count // 20]
        for a, b in zip(small, large, strict=True):
            if sizes[a] * 4 < sizes[b]:
                members = np.flatnonzero(own == b)
                points[a] = x[members[random.integers(len(members))]]
    return points


@dataclass
class Band:
    """The centroids of one band: the length of its lifted vectors, centroids, their cells and numbers, the graph's neighbours."""

    most: float
    points: np.ndarray
    cell: np.ndarray
    first: int
    graph: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, most: float, count: int, first: int, first_cell: int) -> Band:
        """Of vectors no longer than ``most``, by cells of about as many centroids as there are cells."""
        random = np.random.default_rng(7)
        x = lifted(x, most)
        cells = lloyd(x, max(1, round(count**0.5)), random)
        own = np.concatenate([squared(p, cells).argmin(1) for p in np.array_split(x, 1 + len(x) // 4000)])
        share = np.maximum(1, np.round(np.bincount(own, minlength=len(cells)) * count / len(x))).astype(int)
        found = [lloyd(x[own == k], n, random) for k, n in enumerate(share) if (own == k).any()]
        points = np.concatenate(found)
        cell = np.repeat(np.arange(len(found)), [len(p) for p in found]) + first_cell
        degree = min(DEGREE, len(points))
        graph = np.empty((len(points), degree), dtype=np.int64)
        for lo in range(0, len(points), 1000):
            graph[lo : lo + 1000] = np.argpartition(squared(points[lo : lo + 1000], points), degree - 1, axis=1)[:, :degree]
        far = random.integers(len(points), size=(len(points), 4))  # a few links to anywhere keep the graph in one piece
        return Band(most, points, cell, first, np.column_stack([graph, far]))

    def within(self, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Distances of queries from the centroids that walks of the graph find within each one's limit, infinite for those not
        met: from one of each cell and some more to the nearest ``ENTRIES``, then on from whatever is near enough. All queries take
        their steps side by side."""
        n = len(self.points)
        far, done = np.full((len(q), n), np.inf), np.zeros((len(q), n), dtype=bool)
        start = np.union1d(np.arange(0, n, max(1, n // 16)), np.flatnonzero(np.diff(self.cell, prepend=-1)))
        far[:, start] = np.sqrt(squared(q, self.points[start]))
        k = min(ENTRIES, len(start)) - 1
        while True:
            near = np.maximum(limit, np.partition(far, k, axis=1)[:, k])
            i, c = np.nonzero(~done & (far <= near[:, None]))
            if not len(i):
                return far
            done[i, c] = True
            met = np.zeros_like(done)
            met[np.repeat(i, self.graph.shape[1]), self.graph[c].ravel()] = True
            i, c = np.nonzero(met & np.isinf(far))
            for lo in range(0, len(i), 50_000):
                at, to = i[lo : lo + 50_000], c[lo : lo + 50_000]
                far[at, to] = np.sqrt(((self.points[to] - q[at]) ** 2).sum(1))

    def replicas(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows their lists: the row and the list of each pair, that of the nearest centroid and those hardly farther."""
        far = np.sqrt(squared(lifted(x, self.most), self.points))
        few = min(REPLICAS, far.shape[1])
        near = np.argpartition(far, few - 1, axis=1)[:, :few]
        away = np.take_along_axis(far, near, axis=1)
        row, k = np.nonzero(away <= REPLICA_RATIO * away.min(axis=1, keepdims=True))
        return row, near[row, k] + self.first


@dataclass
class Index:
    """The bands, the reference vectors and the ratio."""

    bands: list[Band]
    reference: np.ndarray
    ids: np.ndarray
    ratio: float

    @staticmethod
    def band_of(length: np.ndarray, most: float) -> np.ndarray:
        return np.clip(np.floor(np.log(most / length) / np.log(BAND)), 0, BANDS - 1).astype(np.int64)

    @staticmethod
    def fit(x: np.ndarray, ids: np.ndarray, n: int, most: float, top: int) -> Index:
        """Of a sample of a table of n vectors no longer than ``most``."""
        whole, known = x, ids
        x, ids = x[: max(1, len(x) - len(x) // HOLD)], ids[: max(1, len(x) - len(x) // HOLD)]
        length = np.sqrt((x * x).sum(1))
        of = Index.band_of(length, most)
        count, bands, first, cell = min(CENTROIDS, max(1, n // LIST)), [], 0, 0
        for b in range(BANDS):
            part = x[of == b]
            # a band without vectors in the sample has one list, at its own length along no direction
            part = part if len(part) else np.zeros((1, x.shape[1]))
            bands.append(Band.fit(part, most * BAND**-b, max(1, round(count * (of == b).mean())), first, cell))
            first, cell = first + len(bands[-1].points), int(bands[-1].cell[-1]) + 1
        longest = np.argsort(-length, kind="stable")[: REFERENCE // 2]
        others = np.setdiff1d(np.arange(len(x)), longest)[: REFERENCE - len(longest)]
        chosen = np.concatenate([longest, others])
        out = Index(bands, x[chosen], ids[chosen], 0.0)
        out.ratio = out.learn(whole[len(x) :], known[len(x) :], most, n, top)
        return out

    def references(self, q: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
        """Of unit queries the ``top``-th best product among the reference vectors, less rounding; minus infinity if there are fewer."""
        rough = q @ self.reference.T
        rough[ids[:, None] == self.ids[None, :]] = -np.inf
        if rough.shape[1] < top:
            return np.full(len(q), -np.inf)
        best = np.partition(rough, -top, axis=1)[:, -top]
        return best - 1e-9 * np.abs(best)

    def reach(self, band: Band, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector of the band has that product with a unit query; 0 if none has."""
        return np.sqrt(np.maximum(2 * band.most**2 - 2 * band.most * np.maximum(score, -band.most), 0))

    def learn(self, x: np.ndarray, ids: np.ndarray, most: float, n: int, top: int) -> float:
        """The ratio under which AIM of the lists are found that hold trial queries' nearest among vectors that no centroid was
        fitted on: as many of them as ``top`` of the table are."""
        few = min(max(1, round(top * len(x) / n)), len(x) - 1)
        if few < 1:
            return 1.0
        random, found = np.random.default_rng(11), []
        trial = random.choice(len(x), min(TRIALS, len(x)), replace=False)
        q = x[trial] / np.sqrt((x[trial] * x[trial]).sum(1))[:, None]
        score = q @ x.T
        score[ids[trial][:, None] == ids[None, :]] = -np.inf
        level = self.references(q, ids[trial], top)
        near = np.argpartition(-score, few - 1, axis=1)[:, :few]
        of = Index.band_of(np.sqrt((x * x).sum(1)), most)
        for b, band in enumerate(self.bands):
            i, k = np.nonzero((of[near] == b) & (self.reach(band, level) > 0)[:, None])
            if not len(i):
                continue
            row, lists = band.replicas(x[near[i, k]])
            away = np.sqrt(((directed(q[i[row]], band.most) - band.points[lists - band.first]) ** 2).sum(1))
            least = np.full(len(i), np.inf)
            np.minimum.at(least, row, away)
            found.append(least / self.reach(band, level)[i])
        return float(np.quantile(np.concatenate(found), AIM)) if found else 1.0

    def tune(self, q: np.ndarray, level: np.ndarray, sizes: np.ndarray, asked: np.ndarray, found: np.ndarray) -> float:
        """The ratio under which unit queries look into AIM of the lists that hold their true neighbours: ``asked`` are the queries'
        numbers, ``found`` a row of lists for each of their neighbours, any of which will do, filled up by -1."""
        if not len(asked):
            return self.ratio
        need = np.full(found.shape, np.inf)
        for band in self.bands:
            i, k = np.nonzero((found >= band.first) & (found < band.first + len(band.points)))
            reach = self.reach(band, level)[asked[i]]
            for at in np.array_split(np.arange(len(i)), 1 + len(i) // 50_000):
                away = np.sqrt(((directed(q[asked[i[at]]], band.most) - band.points[found[i[at], k[at]] - band.first]) ** 2).sum(1))
                need[i[at], k[at]] = away / np.maximum(reach[at], 1e-300)
        self.ratio = float(np.quantile(need.min(axis=1), AIM)) * (1 + 1e-9)

        def share(ratio: float) -> float:
            self.ratio, hit = ratio, np.zeros(len(asked), dtype=bool)
            for lo in range(0, len(q), 64):
                at, number, _ = self.lists(q[lo : lo + 64], level[lo : lo + 64], sizes)
                seen = np.zeros((min(64, len(q) - lo), len(sizes) + 1), dtype=bool)
                seen[at, number] = True
                mine = np.flatnonzero((asked >= lo) & (asked < lo + 64))
                hit[mine] = seen[asked[mine, None] - lo, found[mine]].any(axis=1)
            return float(hit.mean())

        # walks of the graph may end before a list that is near enough, and short lists are filled up: what is looked into counts
        low = high = self.ratio
        for _ in range(RAISES):
            if share(high) >= AIM:
                break
            low, high = high, high * RAISE
        for _ in range(HALVES if high > low else 0):
            middle = (low + high) / 2
            low, high = (low, middle) if share(middle) >= AIM else (middle, high)
        self.ratio = high
        return self.ratio

    def lists(self, q: np.ndarray, level: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists that unit queries look into: the query, the list and its cell of each pair."""
        out = [(np.zeros(0, dtype=np.int64),) * 3]
        for band in self.bands:
            held, limit = sizes[band.first : band.first + len(band.points)], self.ratio * self.reach(band, level)
            on = np.flatnonzero(limit > 0)
            if not len(on) or not held.any():
                continue
            far = band.within(directed(q[on], band.most), limit[on])
            pick = far <= limit[on][:, None]
            for i in np.flatnonzero(pick @ held < LEAST):
                order = np.argsort(far[i], kind="stable")
                order = order[np.isfinite(far[i][order])]
                pick[i, order[: np.searchsorted(np.cumsum(held[order]), LEAST) + 1]] = True
            i, k = np.nonzero(pick)
            out.append((on[i], k + band.first, band.cell[k]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added up in order of the components, so that equal rows get equal sums."""
    out = np.zeros(len(x))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


class Best:
    """The best candidates of queries that a task has met so far."""

    def __init__(self, top: int):
        self.top, self.parts, self.rows, self.kept = top, [], 0, 0
        self.least: dict[int, float] = {}

    def add(self, query: np.ndarray, have: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, have, score))
        self.rows += len(query)
        if self.rows > 2 * self.kept + 50_000:
            self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        query, have, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((have, -score, query))
        query, have, score = query[order], have[order], score[order]
        new = np.ones(len(query), dtype=bool)  # a vector that is in two lists is found twice
        new[1:] = (query[1:] != query[:-1]) | (have[1:] != have[:-1]) | (score[1:] != score[:-1])
        query, have, score = query[new], have[new], score[new]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = rank == self.top - 1
        self.least.update(zip(query[full].tolist(), score[full].tolist(), strict=True))
        keep = rank < self.top
        self.parts = [(query[keep], have[keep], score[keep])]
        self.rows = self.kept = int(keep.sum())

    def take(self) -> pa.RecordBatch:
        self.merge()
        query, have, score = self.parts[0] if self.parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        self.__init__(self.top)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(have), pa.array(score)], names=["query_id", "vec_id", "score"])


def trial(rows: DataFrame, fitted: Broadcast, q: np.ndarray, ids: np.ndarray, most: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a few unit queries each of the ``top`` nearest of all rows: the query's number, and the lists that the neighbour is in."""
    asks = rows.sparkSession.sparkContext.broadcast((q, ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = asks.value
        kept, have, score, x = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, q.shape[1])))
        for b in batches:
            for lo in range(0, b.num_rows, 5000):
                part = b.slice(lo, 5000)
                v, found = matrix(part.column(1)), part.column(0).to_numpy()
                rough = q @ v.T
                rough[ids[:, None] == found[None, :]] = -np.inf
                few = min(top, len(found))
                near = np.argpartition(-rough, few - 1, axis=1)[:, :few]
                i, k = np.repeat(np.arange(len(q)), few), near.ravel()
                kept, have, score = np.append(kept, i), np.append(have, found[k]), np.append(score, rough[i, k])
                x = np.concatenate([x, v[k]])
                order = np.lexsort((have, -score, kept))
                first = np.searchsorted(kept[order], np.arange(len(q)))
                order = order[np.arange(len(order)) - first[kept[order]] < top]
                kept, have, score, x = kept[order], have[order], score[order], x[order]
        on = np.flatnonzero(np.isfinite(score))
        lists = np.full((len(kept), REPLICAS), -1)
        of = Index.band_of(np.sqrt((x * x).sum(1)), most) if len(x) else np.zeros(0, dtype=np.int64)
        for k in np.unique(of[on]):
            mine = on[of[on] == k]
            for at in np.array_split(mine, 1 + len(mine) // 1000):
                row, number = fitted.value.bands[k].replicas(x[at])
                lists[at[row], np.arange(len(row)) - np.searchsorted(row, row)] = number
        nested = pa.ListArray.from_arrays(pa.array(np.arange(0, REPLICAS * len(on) + 1, REPLICAS), pa.int32()), pa.array(lists[on].ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(kept[on]), pa.array(have[on]), pa.array(score[on]), nested], names=["asked", "id", "score", "lists"])

    near = rows.mapInArrow(best, "asked long, id long, score double, lists array<int>")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    few = near.withColumn("place", place).filter(F.col("place") <= top).select("asked", "lists").toArrow()  # TRIALS * top at most
    return few.column("asked").to_numpy(), matrix(few.column("lists").combine_chunks()).astype(np.int64).reshape(-1, REPLICAS)


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row with ``is_query`` (on ``vec_id``) the ``top`` rows of largest inner product."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_column, vector_column), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == length["d"])
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x, F.sqrt)
    whole = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most")).first()
    most = whole["most"] * (1 + 1e-12)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * length["d"])), max(20_000, 16 * min(CENTROIDS, whole["n"] // LIST)))).toArrow()
    index = Index.fit(matrix(drawn.column("v").combine_chunks()), drawn.column("vec_id").to_numpy(), whole["n"], most, top)
    fitted = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                x = matrix(part.column(1))
                of = Index.band_of(np.sqrt((x * x).sum(1)), most)
                for k in np.unique(of):
                    band, some = fitted.value.bands[k], np.flatnonzero(of == k)
                    row, lists = band.replicas(x[some])
                    at = pa.array(some[row])
                    columns = [pa.array(band.cell[lists - band.first], pa.int32()), pa.array(lists, pa.int32()), part.column(0).take(at), part.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "list", "id", "v"])

    posted = materialize(rows.mapInArrow(deal, "cell int, list int, id long, v array<double>"), "lists")
    last = index.bands[-1]
    sizes, cells = np.zeros(last.first + len(last.points), dtype=np.int64), np.zeros(int(last.cell[-1]) + 1, dtype=np.int64)
    for r in posted.groupBy("cell", "list").count().collect():  # a row for each centroid
        sizes[r["list"]] = r["count"]
        cells[r["cell"]] += r["count"]
    size = spark.sparkContext.broadcast(sizes)
    some = rows.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(TRIALS, max(1, SAMPLE_BYTES // (64 * length["d"])))).toArrow()
    if some.num_rows:
        q, ids = matrix(some.column("v").combine_chunks()), some.column("vec_id").to_numpy()
        q = q / np.sqrt((q * q).sum(1))[:, None]
        asked, found = trial(rows, fitted, q, ids, most, top)
        index.tune(q, index.references(q, ids, top), sizes, asked, found)
    fitted = spark.sparkContext.broadcast(index)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                q, ids = matrix(part.column(1)), part.column(0).to_numpy()
                q = q / np.sqrt((q * q).sum(1))[:, None]
                at, number, cell = fitted.value.lists(q, fitted.value.references(q, ids, top), size.value)
                order = np.lexsort((cell, at))
                at, number, cell = at[order], number[order], cell[order]
                cut = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)), pa.int32()), pa.array(number, pa.int32()))
                at, cell = pa.array(at[cut]), pa.array(cell[cut], pa.int32())
                yield pa.RecordBatch.from_arrays([cell, lists, part.column(0).take(at), part.column(1).take(at)], names=["cell", "lists", "id", "v"])

    asked = materialize(rows.filter(is_query).mapInArrow(choose, "cell int, lists array<int>, id long, v array<double>"), "queries")
    count = dict(asked.groupBy("cell").count().collect())  # a row for each cell
    grid = [(c, int(-(-n // BLOCK)), -(-count[c] // QUERIES)) for c, n in enumerate(cells.tolist()) if n and c in count]
    blocks = F.broadcast(spark.createDataFrame(grid, "cell int, rows int, columns int"))
    block = lambda of: F.pmod(F.xxhash64("id", "v"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    vector_rows = posted.join(blocks, "cell").select("cell", block("rows").alias("i"), every("columns").alias("j"), F.array("list").alias("lists"), F.lit(False).alias("asks"), "id", "v")
    query_rows = asked.join(blocks, "cell").select("cell", every("rows").alias("i"), block("columns").alias("j"), "lists", F.lit(True).alias("asks"), "id", "v")
    keys = ["cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        for t in groups(batches, keys):
            asks = t.column("asks").to_numpy()
            ids, v, lists = t.column("id").to_numpy(), matrix(t.column("v").combine_chunks()), t.column("lists").combine_chunks()
            number = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(number, kind="stable")
            for mine in np.split(row[order], np.flatnonzero(np.diff(number[order])) + 1):
                who, have = mine[asks[mine]], mine[~asks[mine]]
                if not len(who) or not len(have):
                    continue
                few = min(top, len(have))
                x, found = v[have], ids[have]
                for lo in range(0, len(who), 500):
                    mark = who[lo : lo + 500]
                    rough = v[mark] @ x.T
                    rough[ids[mark][:, None] == found[None, :]] = -np.inf
                    known = np.array([best.least.get(i, -np.inf) for i in ids[mark].tolist()])
                    least = np.maximum(np.partition(rough, -few, axis=1)[:, -few], known)
                    with np.errstate(invalid="ignore"):
                        least = np.fmax(least - 1e-9 * np.maximum(np.abs(least), 1), np.finfo(float).min)
                    i, j = np.nonzero(rough >= least[:, None])
                    best.add(ids[mark[i]], found[j], exact(v[mark[i]], x[j]))
            if best.kept > 1_000_000:
                yield best.take()
        yield best.take()

    laid = vector_rows.unionByName(query_rows).repartition(*keys).sortWithinPartitions(*keys)
    found = laid.mapInArrow(compare, "query_id long, vec_id long, score double").distinct()
    # each task has kept the best of a query's candidates that it met
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """Each vector whose id is divisible by 20 against all."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
