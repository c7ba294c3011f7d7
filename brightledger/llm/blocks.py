"""Removal of repeated passages by fixed-block anchors.

A window of ``window`` words goes where its words also start in a document of a smaller id. A window of 13 words, wherever it begins,
holds exactly one whole block of seven words that begins at a multiple of seven in its document:

1. *Index.* Each document's blocks at multiples of seven words, which do not overlap, are reference blocks.
2. *Probe.* Every rolling run of seven words is looked up. It is a hit if it is a reference block of some document and another
   document has it, too.
3. *Extend.* Only windows around hits can repeat. They are compared as wholes, and the smallest id that has each one says which of its
   other places go. Windows that overlap or follow each other make up maximal repeats.

Texts stay where they are, in chunks; what moves are packed arrays, a row for each chunk and part of the hashes' range. A chunk sends
each run once, with the smallest id that has it, so a passage that stands in a third of all documents is one entry a chunk. Parts hold
some ``ENTRIES`` entries, ``PARTS`` parts at most (beyond some 400 TB of text a part grows). Probes are told apart by 48 bits, since a
false hit costs no more than a comparison, and windows by 96.

Null texts have no words. A row with a null id loses nothing and takes nothing from others; rows of one id do not take from each other, and
within a document no repeat counts. Windows are judged on the input, whole, however long the text: a text longer than a chunk is a chunk
of its own, scanned piece by piece, with some 30 bytes of memory a byte. Further columns are carried along if asked for. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.llm import wordhash
from brightledger.llm.chunks import bucketed, chunks, each_chunk
from brightledger.llm.common import WORD
from brightledger.llm.near import groups
from brightledger.llm.suffix import told
from brightledger.llm.wordhash import BLANK, INVERSE, ODD, mixed, powers

WINDOW = 13
#: Bytes of text in a chunk, entries in a part of the hashes' range, and parts at most.
CHUNK, ENTRIES, PARTS = 1 << 22, 2_000_000, 1 << 15
#: Bytes that a probe's hash has.
SHORT = 6
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def block_of(window: int) -> int:
    """The longest block of which each window holds a whole one, wherever it begins."""
    return (window + 1) // 2


class Scan:
    """The words of a chunk's texts: hashes, the text and the place of each, and where texts begin among them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, piece: int = wordhash.PART):
        found, at = [], 0
        while at < len(raw):
            to = min(len(raw), at + piece)
            while to < len(raw) and not BLANK[raw[to]]:  # a piece ends before a blank or with a text
                ahead = np.flatnonzero(BLANK[raw[to : to + 4096]])
                end = int(offsets[np.searchsorted(offsets, to)])
                to = min(to + (int(ahead[0]) if len(ahead) else 4096), end, len(raw))
                if to == end:
                    break
            found.append(self._piece(raw[at:to], at, offsets))
            at = to
        none = np.zeros(0, dtype=np.int64)
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none.astype(np.uint64), none, none)
        self.of = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.of, np.arange(len(offsets)))

    @staticmethod
    def _piece(text: np.ndarray, at: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~BLANK[text]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n, side="right")] - at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(ODD, n), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]), starts + at, ends + at

    def runs(self, size: int, odd: int = ODD) -> np.ndarray:
        """Hashes of all runs of so many words, those across texts too."""
        h, n = mixed(self.hashes ^ np.uint64(odd)), max(0, len(self.hashes) - size + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            out += h[k : k + n] * np.uint64(pow(odd, k, 1 << 64))
        return mixed(out)

    def inside(self, size: int) -> np.ndarray:
        """Which runs of so many words lie in one text."""
        return self.of[: max(0, len(self.of) - size + 1)] == self.of[size - 1 :]


class Entries:
    """The distinct values of some places in order, each with the smallest id that has it.

    entry: for each place its value's number; several: whether ids differ."""

    def __init__(self, ids: np.ndarray, *values: np.ndarray):
        order = np.lexsort(values[::-1]) if len(values) > 1 else np.argsort(values[0], kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in values], axis=0)
        at = np.flatnonzero(new)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.values = [v[order[at]] for v in values]
        self.least = np.minimum.reduceat(ids[order], at) if len(at) else ids
        self.several = np.maximum.reduceat(ids[order], at) != self.least if len(at) else new
        self.order, self.at = order, at

    def any(self, marked: np.ndarray) -> np.ndarray:
        """Whether one of a value's places is marked."""
        return np.logical_or.reduceat(marked[self.order], self.at) if len(self.at) else marked


def narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Whole numbers as the smallest and, in as few bytes as they need, what they exceed it by."""
    low = int(x.min()) if len(x) else 0
    more = x.astype(np.uint64) - np.array([low]).astype(np.uint64)
    return low, more.astype(next(t for t in (np.uint16, np.uint32, np.uint64) if not len(x) or more.max() <= np.iinfo(t).max))


def part_bounds(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's range begins in sorted values of so many bits, and their number."""
    first = [-(-(k << bits) // parts) for k in range(parts)]
    return np.append(np.searchsorted(values, np.array(first, dtype=np.uint64)), len(values))


def packed(chunk: int, bounds: np.ndarray, least: np.ndarray, values: Sequence[tuple[np.ndarray, int]], flags: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each part that has entries: values cut to so many bytes each, ids, and the bits of the flags."""
    low, ids = narrow(least)
    raw = [np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize)[:, :width] for v, width in values]
    rows: dict[str, list] = {c: [] for c in ROW.names}
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[k], bounds[k + 1]
        new = (chunk, k, int(b - a), [x[a:b].tobytes() for x in raw], low, ids[a:b].tobytes(), [np.packbits(f[a:b]).tobytes() for f in flags])
        for c, x in zip(ROW.names, new, strict=True):
            rows[c].append(x)
    if rows["chunk"]:
        yield pa.RecordBatch.from_pydict(rows, schema=ROW)


ROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("values", pa.list_(pa.binary())), ("low", pa.int64()), ("ids", pa.binary()), ("flags", pa.list_(pa.binary()))])
ROW_SQL = "chunk long, part int, n int, values array<binary>, low long, ids binary, flags array<binary>"


def _unpack(t: pa.Table, widths: Sequence[tuple[type, int]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Counts, values, ids and flags of the rows of one part."""
    counts = t.column("n").to_numpy()
    blobs = t.column("values").to_pylist()
    values = []
    for k, (kind, width) in enumerate(widths):
        raw = np.frombuffer(b"".join(b[k] for b in blobs), dtype=np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), np.dtype(kind).itemsize), dtype=np.uint8)
        wide[:, :width] = raw
        values.append(wide.view(kind).ravel())
    ids = []
    for low, n, b in zip(t.column("low").to_pylist(), counts.tolist(), t.column("ids").to_pylist(), strict=True):
        more = np.frombuffer(b, dtype={2: np.uint16, 4: np.uint32, 8: np.uint64}[len(b) // n])
        ids.append((more.astype(np.uint64) + np.array([low]).astype(np.uint64)).astype(np.int64))
    flags = []
    for row in zip(*t.column("flags").to_pylist(), strict=True):
        flags.append(np.concatenate([np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=n) for f, n in zip(row, counts.tolist(), strict=True)]).astype(bool))
    return counts, values, np.concatenate(ids), flags


def _answer(rows: DataFrame, judge, name: str, widths: Sequence[tuple[type, int]]) -> DataFrame:
    """``chunk`` and, by its name, an array of ``bucket, marks``: the bits that ``judge(values, ids, flags)`` gives to a part's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["part"]):
            counts, values, ids, flags = _unpack(t, widths)
            marks = judge(values, ids, flags)
            cut = np.cumsum(np.append(0, counts))
            blobs = [np.packbits(marks[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), t.column("part").combine_chunks(), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "marks"])

    laid = rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "chunk long, bucket int, marks binary")
    return bucketed(told(laid).withColumnRenamed("answers", name), name, "chunk").hint("shuffle_hash")


def _told(bounds: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The bits of all entries of a chunk."""
    out = np.zeros(int(bounds[-1]), dtype=bool)
    for x in answers or []:
        a, b = bounds[x["bucket"]], bounds[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["marks"], dtype=np.uint8), count=int(b - a))
    return out


def without_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, doc_id: str = "doc_id") -> DataFrame:
    """The ``keep`` columns and ``n_words, repeats, kept`` of every row: repeats are the maximal runs of words that go (from 0, ends
    after their last), kept is what remains, its words joined by one space."""
    spark, block = docs.sparkSession, block_of(window)
    own = docs.select("text", F.col(doc_id).cast("long").alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)])
    stored = chunks(own, own.columns[1:], CHUNK)
    # a byte of a chunk has a sixth of a word, roughly
    parts = min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() * (CHUNK // 6) // ENTRIES))

    def read(b: pa.RecordBatch, i: int, texts: pa.Array):
        """The chunk's bytes and texts, words, ids, and the runs that are probed with the places where they begin."""
        offsets, raw = wordhash.buffers(texts)
        ids = b.column("c0")[i].values
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        scan = Scan(raw, offsets)
        at = np.flatnonzero(scan.inside(block) & known[scan.of[: max(0, len(scan.of) - block + 1)]])
        runs = Entries(ids[scan.of[at]], scan.runs(block)[at] >> np.uint64(64 - 8 * SHORT))
        return offsets, raw, scan, ids, known, at, runs, part_bounds(runs.values[0], 8 * SHORT, parts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, chunk, texts in each_chunk(batches):
            _, _, scan, _, _, at, runs, bounds = read(b, i, texts)
            reference = runs.any((at - scan.bounds[scan.of[at]]) % block == 0)
            yield from packed(chunk, bounds, runs.least, [(runs.values[0], SHORT)], [reference, runs.several])

    def hits(values: list[np.ndarray], ids: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
        e = Entries(ids, *values)
        return (e.any(flags[0]) & (e.several | e.any(flags[1])))[e.entry]

    def around(b: pa.RecordBatch, i: int, texts: pa.Array):
        """What ``read`` gives first, and the windows around hits with where they begin."""
        offsets, raw, scan, ids, known, at, runs, bounds = read(b, i, texts)
        hit = np.zeros(len(scan.of) + 1, dtype=np.int64)
        hit[at + 1] = _told(bounds, b.column("hits")[i].as_py())[runs.entry]
        hit = np.cumsum(hit)
        inside = scan.inside(window)
        some = np.arange(len(inside))
        some = some[inside & known[scan.of[: len(inside)]] & (hit[window - block + 1 : window - block + 1 + len(inside)] > hit[: len(inside)])]
        wide = Entries(ids[scan.of[some]], scan.runs(window)[some], (scan.runs(window, 0xD1342543DE82EF95)[some] >> np.uint64(32)).astype(np.uint32))
        return offsets, raw, scan, ids, some, wide, part_bounds(wide.values[0], 64, parts)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, chunk, texts in each_chunk(batches):
            _, _, _, _, _, wide, bounds = around(b, i, texts)
            yield from packed(chunk, bounds, wide.least, [(wide.values[0], 8), (wide.values[1], 4)], [])

    def earlier(values: list[np.ndarray], ids: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
        e = Entries(ids, *values)
        return e.least[e.entry] < ids

    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("repeats", SPANS), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, _, texts in each_chunk(batches):
            offsets, raw, scan, ids, some, wide, bounds = around(b, i, texts)
            elsewhere = _told(bounds, b.column("windows")[i].as_py())
            go = some[elsewhere[wide.entry] | (ids[scan.of[some]] > wide.least[wide.entry])]
            n = len(scan.of)
            gone = np.cumsum(np.bincount(go, minlength=n + 1) - np.bincount(go + window, minlength=n + 1))[:n] > 0
            edge = np.zeros(n + 1, dtype=bool)
            edge[scan.bounds] = True
            left, right = np.append(False, gone), np.append(gone, False)
            start = np.flatnonzero(right & (~left | edge))
            end = np.flatnonzero(left & (~right | edge))
            own = np.searchsorted(scan.bounds, start, side="right") - 1
            first = scan.bounds[own]
            spans = pa.StructArray.from_arrays([pa.array((start - first).astype(np.int32)), pa.array((end - first).astype(np.int32))], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, scan.bounds).astype(np.int32)), spans)
            columns = [b.column(f"c{k + 1}")[i].values for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(scan.bounds)), spans, joined(raw, offsets, scan, ~gone)], names=out.names)

    texts = [c for c in stored.columns if c in ("chunk", "text", "c0")]
    found = _answer(stored.select(*texts).mapInArrow(probe, ROW_SQL), hits, "hits", [(np.uint64, SHORT)])
    hit = stored.join(found, "chunk", "left")
    windows = _answer(hit.select(*texts, "hits").mapInArrow(extend, ROW_SQL), earlier, "windows", [(np.uint64, 8), (np.uint32, 4)])
    return hit.join(windows, "chunk", "left").mapInArrow(remove, out)


def joined(raw: np.ndarray, offsets: np.ndarray, scan: Scan, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with a space between two: a word is followed by a blank or ends its text, so the byte after it
    becomes the space, but for a text's last word."""
    last = np.zeros(len(kept), dtype=bool)
    which = np.flatnonzero(kept)
    of = scan.of[which]
    last[which[np.append(of[1:] != of[:-1], True)] if len(which) else which] = True
    starts, ends = scan.starts[which], scan.ends[which] + ~last[which]
    size = ends - starts
    steps = np.zeros(len(raw) + 2, dtype=np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    text = np.where(BLANK[raw], np.uint8(32), raw)[np.cumsum(steps[: len(raw)], dtype=np.int8) > 0]
    each = np.bincount(of, weights=size, minlength=len(offsets) - 1).astype(np.int64)
    at = np.append(0, np.cumsum(each))
    # the bytes are whole words of valid texts
    return pa.Array.from_buffers(pa.large_string(), len(each), [None, pa.py_buffer(at), pa.py_buffer(text.tobytes())]).cast(pa.string())


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``without_repeats``."""
    rows = without_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window as a text, for a small table.
ORACLE_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS t FROM documents),
 x AS (SELECT rid, doc_id, unnest(range(1, len(t) - {WINDOW - 2})) AS s, unnest(list_transform(range(1, len(t) - {WINDOW - 2}), lambda i: array_to_string(t[i:i + {WINDOW - 1}], ' '))) AS g FROM w),
 m AS (SELECT rid, s, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM x),
 c AS (SELECT DISTINCT rid, s + unnest(range({WINDOW})) AS i FROM m WHERE again),
 e AS (SELECT rid, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS i FROM w),
 k AS (SELECT e.rid, count(*) FILTER (c.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept FROM e LEFT JOIN c ON c.rid = e.rid AND c.i = e.i GROUP BY 1)
SELECT w.doc_id, CAST(len(w.t) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)"""
