"""Removal of long repeated strings by a logarithmic family of sparse suffix arrays.

A byte goes if some string of ``length`` bytes over it also starts anywhere else, in its own document or another.

Suffixes are sampled: of the ``length // 2``-byte strings inside each window of ``length`` bytes the one with the smallest
hash is the window's anchor. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a run of
windows with one anchor is one suffix: it is known by its *core*, the anchor's string, and by its *whole*, all bytes of the
run. A repeated whole settles all windows of the run. Where a core has several wholes (where a passage begins or ends), the
windows of one run of each whole go into a second round, one by one. A core with a single, unrepeated whole settles that
nothing repeats.

Strings are ordered by 64-bit fingerprints and told apart by another 64 bits; both are sums over mixed eight-byte grams, so that
no regular text brings different strings together. Each chunk of texts sorts its suffixes, each once, and deals them to the
index's parts by their fingerprints: a line that stands in every document is one entry a chunk, and what surrounds it is spread.

A ``Family`` keeps the index in levels, tables in the shared folder that hold each part's sorted array. A new batch of chunks
gets its arrays, is merge-scanned against every level for what is there already, becomes a level of its own, and levels of
equal size are merged, so that an entry is moved a logarithmic number of times. When all batches are in, each chunk is told
which of its strings repeat.

Null texts are empty; texts shorter than ``length`` bytes keep all; strings are judged on the input and never cross documents;
repeated rows repeat each other. An empty table gives an empty result. A very long text is a chunk of its own, with some 80
bytes of memory a byte. Further columns are carried along if asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.llm import wordhash
from brightledger.llm.chunks import bucketed, chunks, each_chunk
from brightledger.llm.common import discard, scratch, stage as pipeline_stage
from brightledger.llm.wordhash import INVERSE, ODD, mixed, powers

LENGTH = 200
#: Batches that a corpus comes in, and entries in a part of the index.
BATCHES, ENTRIES = 4, 500_000
REPEATED, VARIED, FIRST = 1, 2, 4


def in_order(values: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by value, then check; values are hashes, so two checks of one value are hardly ever there."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], checks[order]
    return np.lexsort((checks, values)) if ((v[1:] == v[:-1]) & (c[1:] < c[:-1])).any() else order


class Level:
    """A sorted array of distinct strings, known by value and check, and which of them occur twice."""

    def __init__(self, values: np.ndarray, checks: np.ndarray, twice: np.ndarray):
        order = in_order(values, checks)
        values, checks, twice = values[order], checks[order], twice[order]
        first = np.ones(len(values), dtype=bool)
        first[1:] = (values[1:] != values[:-1]) | (checks[1:] != checks[:-1])
        at = np.flatnonzero(first)
        more = np.diff(np.append(at, len(values))) > 1
        self.values, self.checks = values[at], checks[at]
        self.twice = (np.logical_or.reduceat(twice, at) if len(at) else twice) | more

    def place(self, values: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Where strings are in the array; -1 for those that are not there."""
        out = np.full(len(values), -1)
        if not len(self.values):
            return out
        lo, hi = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        while (open_ := np.flatnonzero(lo < hi)).size:
            hit = self.checks[lo[open_]] == checks[open_]
            out[open_[hit]] = lo[open_[hit]]
            lo[open_] = np.where(hit, hi[open_], lo[open_] + 1)
        return out

    def scan(self, older: Level) -> None:
        """Marks what an older level has: by a merge-scan, as both are sorted."""
        self.twice |= older.place(self.values, self.checks) >= 0

    @staticmethod
    def merged(levels: list[Level]) -> Level:
        return Level(*(np.concatenate([getattr(x, k) for x in levels]) for k in ("values", "checks", "twice")))


def unpacked(blobs: list[bytes], kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


class Family:
    """The index as a logarithmic family of levels: tables of ``bucket, values, checks, twice``, one sorted array a part.

    ``add`` takes a batch of rows ``chunk, bucket, values, checks``; an entry once a chunk. ``levels`` holds size and table of
    each level, larger ones first, and is all there is to keep between batches that come on different days.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        size, merging = 1, []
        while len(merging) < len(self.levels) and self.levels[-1 - len(merging)][0] == size:
            merging.append(len(self.levels) - 1 - len(merging))
            size *= 2
        names = [f"l{i}" for i in range(len(self.levels))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    rows = b.column("pieces")[i].as_py() or []
                    values, checks = unpacked([r["values"] for r in rows]), unpacked([r["checks"] for r in rows])
                    new = Level(values, checks, np.zeros(len(values), dtype=bool))
                    held = []
                    for n in names:
                        x = b.column(n)[i].as_py() or {"values": b"", "checks": b"", "twice": b""}
                        held.append(Level(unpacked([x["values"]]), unpacked([x["checks"]]), unpacked([x["twice"]], np.bool_)))
                        new.scan(held[-1])
                    out = Level.merged([new, *[held[k] for k in merging]])
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b.column("bucket")[i].as_py()], pa.int32()), "values": [out.values.tobytes()], "checks": [out.checks.tobytes()], "twice": [out.twice.tobytes()]})

        both = pieces(batch)
        for n, (_, table) in zip(names, self.levels, strict=True):
            both = both.join(table.select("bucket", F.struct("values", "checks", "twice").alias(n)), "bucket", "full_outer")
        made = bucketed(both.mapInArrow(run, "bucket int, values binary, checks binary, twice binary"), "level", "bucket")
        discard(batch.sparkSession, [self.levels[k][1] for k in merging])  # the merged level is written
        self.levels = [*self.levels[: len(self.levels) - len(merging)], (size, made)]

    def answers(self, asked: DataFrame) -> DataFrame:
        """``chunk, answers`` of rows as ``add`` takes them: an array of ``bucket, marks``, a byte for each entry in its order: REPEATED if
        a level has it twice or two levels have it, FIRST in one of the chunks that have it."""
        names = [f"l{i}" for i in range(len(self.levels))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    rows = b.column("pieces")[i].as_py()
                    values, checks = unpacked([r["values"] for r in rows]), unpacked([r["checks"] for r in rows])
                    times, bucket = np.zeros(len(values), dtype=np.int64), b.column("bucket")[i].as_py()
                    for n in names:
                        x = b.column(n)[i].as_py() or {"values": b"", "checks": b"", "twice": b""}
                        level = Level(unpacked([x["values"]]), unpacked([x["checks"]]), unpacked([x["twice"]], np.bool_))
                        at = level.place(values, checks)
                        times[at >= 0] += 1 + level.twice[at[at >= 0]]
                    marks = np.where(times > 1, REPEATED, 0).astype(np.uint8)
                    order = in_order(values, checks)
                    first = np.ones(len(values), dtype=bool)
                    first[1:] = (values[order[1:]] != values[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
                    marks[order[first]] |= FIRST
                    yield answered(bucket, rows, marks, 8)

        both = pieces(asked)
        for n, (_, table) in zip(names, self.levels, strict=True):
            both = both.join(table.select("bucket", F.struct("values", "checks", "twice").alias(n)), "bucket", "left")
        return told(both.mapInArrow(run, "chunk long, bucket int, marks binary"))


def pieces(asked: DataFrame) -> DataFrame:
    """Rows of a part in one row: parts are of a bounded size."""
    return asked.groupBy("bucket").agg(F.collect_list(F.struct("chunk", "values", "checks")).alias("pieces"))


def answered(bucket: int, rows: list[dict], marks: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each piece with its part of the marks."""
    cut = np.cumsum([0] + [len(r["values"]) // width for r in rows])
    found = [marks[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "marks": pa.array(found, pa.binary())})


def told(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks")).alias("answers"))


def varied(asked: DataFrame) -> DataFrame:
    """``chunk, answers`` of rows ``chunk, bucket, values, checks``, here cores and, for each, the least and the largest whole that the
    chunk has of it: VARIED where more than one whole is there. A core is one entry a chunk, however many wholes it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column("pieces")[i].as_py()
                cores, ends = unpacked([r["values"] for r in rows]), unpacked([r["checks"] for r in rows]).reshape(-1, 2)
                distinct, code = np.unique(cores, return_inverse=True)
                order = np.argsort(code, kind="stable")
                at = np.searchsorted(code[order], np.arange(len(distinct)))
                low, high = np.minimum.reduceat(ends[order, 0], at), np.maximum.reduceat(ends[order, 1], at)
                yield answered(b.column("bucket")[i].as_py(), rows, np.where(low != high, VARIED, 0).astype(np.uint8)[code], 8)

    return told(pieces(asked).mapInArrow(run, "chunk long, bucket int, marks binary"))


class Asked:
    """The distinct values of a chunk, dealt to buckets: in order of bucket and value.

    entry: for each value given, its place in that order; place: for each entry, where it was first given; twice: whether it
    was given more than once. ``checks`` has one or more columns for each entry.
    """

    def __init__(self, values: np.ndarray, buckets: int):
        distinct, place, inverse, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        # parts are ranges of the fingerprints, so each bucket's entries are in order
        self.bounds = np.searchsorted(((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        self.values, self.entry, self.place, self.twice = distinct, inverse, place, count > 1

    def rows(self, chunk: int, checks: np.ndarray) -> pa.RecordBatch:
        full = np.flatnonzero(np.diff(self.bounds))

        def packed(x: np.ndarray, width: int) -> pa.Array:
            blobs = pa.Array.from_buffers(pa.binary(), len(self.bounds) - 1, [None, pa.py_buffer((self.bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            return blobs.take(pa.array(full))

        wide = 8 * (1 if checks.ndim == 1 else checks.shape[1])
        columns = [pa.array(np.full(len(full), chunk)), pa.array(full.astype(np.int32)), packed(self.values, 8), packed(checks, wide)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "values", "checks"])

    def marks(self, answers: list[dict] | None) -> np.ndarray:
        """The marks of each entry; what the chunk itself has twice is repeated."""
        out = np.where(self.twice, REPEATED, 0).astype(np.uint8)
        for x in answers or []:
            out[self.bounds[x["bucket"]] : self.bounds[x["bucket"] + 1]] |= np.frombuffer(x["marks"], dtype=np.uint8)
        return out


def minima(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values: of two, four, eight and so on, and of the last two that overlap."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :])


#: Bytes of a gram, and places that are worked on at once, so that their numbers stay in a processor's cache.
GRAM, BLOCK = 8, 1 << 14
#: What makes another hash of a hash, and what tells lengths apart.
OTHER, BY_LENGTH = np.uint64(0x5851F42D4C957F2D), 0xD1342543DE82EF95


class Runs:
    """The sampled suffixes of a chunk: runs of windows ``start ... stop`` with one anchor, their cores and wholes. Checks are
    computed when they are asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        n, half = len(raw), length // 2
        self.length, self.raw = length, raw
        self.sums, self.back = self.summed(), powers(INVERSE, n + 1)
        none = np.zeros(0, dtype=np.int64)
        self.start = self.stop = none
        self.core = self.whole = none.astype(np.uint64)
        if n < length:
            return
        valid = np.ones(n - length + 1, dtype=bool)
        for end in offsets[1:].tolist():
            valid[max(0, end - length + 1) : end] = False  # also of shorter texts, whose places all lie in this range
        anchors = self.anchors(half)
        changes = anchors[1:] != anchors[:-1]
        opens, closes = valid.copy(), valid.copy()
        opens[1:] &= changes | ~valid[:-1]
        closes[:-1] &= changes | ~valid[1:]
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes)
        at = anchors[self.start]
        self.core = mixed(self.fingerprint(at, at + half) ^ OTHER)
        self.whole = self.fingerprint(self.start, self.stop + length)

    def summed(self, check: bool = False) -> np.ndarray:
        """Sums over the grams before each place; for checks over grams mixed again."""
        n = len(self.raw)
        wide = np.concatenate([self.raw, np.zeros(GRAM, dtype=np.uint8)])
        grams, ahead, out = np.ndarray(n, "<u8", wide, strides=(1,)), powers(ODD, n), np.zeros(n + 1, dtype=np.uint64)
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            x = mixed(grams[lo:hi] + np.uint64(1))
            if check:
                x = mixed(x ^ OTHER)
            x *= ahead[lo:hi]
            sums = out[lo + 1 : hi + 1]
            np.cumsum(x, out=sums)
            sums += out[lo]
        return out

    def anchors(self, half: int) -> np.ndarray:
        """Where the string of ``half`` bytes with the smallest hash begins, for every window."""
        n, width, low = len(self.raw), self.length - half + 1, np.uint64(0xFFFFFFFF)
        size, out = np.uint64(half * BY_LENGTH & (1 << 64) - 1), np.empty(n - self.length + 1, dtype=np.int64)
        for lo in range(0, len(out), BLOCK):
            hi = min(lo + BLOCK, len(out))
            end = hi + width - 1
            x = self.sums[lo + half - GRAM + 1 : end + half - GRAM + 1] - self.sums[lo:end]
            x *= self.back[lo:end]
            x += size
            x = mixed(x)
            x &= ~low
            x |= np.arange(lo, end, dtype=np.uint64)
            out[lo:hi] = minima(x, width) & low
        return out

    @functools.cached_property
    def others(self) -> np.ndarray:
        return self.summed(check=True)

    @functools.cached_property
    def check(self) -> np.ndarray:
        """Of each whole."""
        return self.fingerprint(self.start, self.stop + self.length, True)

    def fingerprint(self, start: np.ndarray, end: np.ndarray, check: bool = False) -> np.ndarray:
        """Of the bytes from start to before end; strings have GRAM bytes at least, and grams that reach beyond them do not count."""
        sums, last = self.others if check else self.sums, end - GRAM + 1
        return mixed((sums[last] - sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(BY_LENGTH))

    def windows(self, some: np.ndarray) -> np.ndarray:
        """Where the windows of some runs begin."""
        start, count = self.start[some], self.stop[some] - self.start[some] + 1
        return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    steps = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The ``keep`` columns and ``n_bytes, n_removed, n_spans, kept`` of every row: kept are the remaining bytes, or as text
    what they spell, without characters of which only some bytes are left."""
    spark = docs.sparkSession
    stored = chunks(docs, keep)
    # a chunk of a megabyte has some 20,000 suffixes
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() * 20_000 // ENTRIES)

    def read(texts: pa.Array):
        offsets, raw = wordhash.buffers(texts)
        runs = Runs(raw, offsets, length)
        return offsets, raw, runs, Asked(runs.core, buckets), Asked(runs.whole, buckets)

    def ask_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, texts in each_chunk(batches):
            _, _, runs, cores, _ = read(texts)
            ends = np.empty((len(cores.values), 2), dtype=np.uint64)
            ends[:, 0], ends[:, 1] = np.iinfo(np.uint64).max, 0
            np.minimum.at(ends[:, 0], cores.entry, runs.whole)
            np.maximum.at(ends[:, 1], cores.entry, runs.whole)
            yield cores.rows(chunk, ends)

    def ask_wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, texts in each_chunk(batches):
            _, _, runs, _, wholes = read(texts)
            yield wholes.rows(chunk, runs.check[wholes.place])

    def sorted_out(b: pa.RecordBatch, i: int, texts: pa.Array):
        """The chunk, its runs, which of them are repeated whole, and the windows that the second round asks about."""
        offsets, raw, runs, cores, wholes = read(texts)
        marks = wholes.marks(b.column("wholes")[i].as_py())
        several = (cores.marks(b.column("cores")[i].as_py()) & VARIED)[cores.entry] > 0
        at = runs.windows(wholes.place[((marks & FIRST) > 0) & several[wholes.place]])
        return offsets, raw, runs, (marks & REPEATED)[wholes.entry] > 0, at, Asked(mixed(runs.fingerprint(at, at + length)), buckets)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, chunk, texts in each_chunk(batches):
            _, _, runs, _, at, asked = sorted_out(b, i, texts)
            some = at[asked.place]
            yield asked.rows(chunk, runs.fingerprint(some, some + length, True))

    def indexed(rows: DataFrame, name: str) -> DataFrame:
        """The answers to what chunks ask, by a family that takes the chunks in batches."""
        with scratch(spark) as kept:
            arrays, family = bucketed(rows, "arrays", "bucket"), Family()
            for k in range(BATCHES):
                family.add(arrays.filter(F.pmod(F.xxhash64("chunk"), F.lit(BATCHES)) == k))
            kept.append(bucketed(family.answers(arrays).withColumnRenamed("answers", name), name, "chunk"))
        return kept[0].hint("shuffle_hash")

    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    names, carried = out.names, len(fields)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, _, texts in each_chunk(batches):
            offsets, raw, runs, whole, at, asked = sorted_out(b, i, texts)
            again = at[(asked.marks(b.column("windows")[i].as_py()) & REPEATED)[asked.entry] > 0]
            gone = covered(len(raw), np.concatenate([runs.start[whole], again]), np.concatenate([runs.stop[whole] + length, again + length]))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(raw)]
            opens[inner] = gone[inner]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            removed, size = count(gone), np.diff(offsets)
            left = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(left), pa.py_buffer(raw[~gone].tobytes())])
            if as_text:
                kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
            own = [b.column(f"c{k}")[i].values for k in range(carried)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(removed), pa.array(count(opens)), kept], names=names)

    schema, texts = "chunk long, bucket int, values binary, checks binary", stored.select("chunk", "text")
    cores = bucketed(varied(texts.mapInArrow(ask_cores, schema)).withColumnRenamed("answers", "cores"), "cores", "chunk").hint("shuffle_hash")
    both = stored.join(cores, "chunk", "left").join(indexed(texts.mapInArrow(ask_wholes, schema), "wholes"), "chunk", "left")
    windows = indexed(both.select("chunk", "text", "cores", "wholes").mapInArrow(ask_windows, schema), "windows")
    return both.join(windows, "chunk", "left").mapInArrow(third, out)


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``remove_repeats``."""
    rows = remove_repeats(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated strings, their ``n_chars`` set anew: row by row, whatever their ids; null texts become
    empty."""
    others = {c: f"own{i}" for i, c in enumerate(docs.columns) if c != "text"}  # other names than the result's
    rows = remove_repeats(docs.select("text", *[F.col(c).alias(n) for c, n in others.items()]), keep=list(others.values()), as_text=True)
    columns = {c: F.col("kept") if c == "text" else F.col(others[c]) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in columns.items()])
