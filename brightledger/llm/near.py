"""Near duplicates by bottom-k sketches of one hash function.

1. Every text becomes its set of word shingles, each a 64-bit hash; the ``k`` smallest are its sketch. Texts with one set form
   a class, which goes on as one row however many copies it has.
2. Inverted lists of retained values find overlaps. Two sets of the similarity asked for share ``least`` values of their
   sketches: the smallest ``k`` of their union are a random sample of it, and of 64 such values fewer than 16 are shared in less
   than 1e-17 of pairs just at 0.75, less often than two shingles have one hash; sets of ``k`` shingles or fewer are held whole,
   and there the number is exact. So each class is listed only under its ``k - least + 1`` rarest values: passages that many
   documents share are looked at only where little else is there.
3. Long lists are dealt out in blocks, each pair of blocks a task of its own. In a block, pairs whose union's sketch shows too
   small an overlap fall; of what remains a spanning forest goes out, never all pairs.
4. What hangs together is verified on whole texts, again in pairs of blocks: exact counts of common shingles decide each
   link, and a spanning forest of the links goes out. Its components are the groups.

Null texts are empty; texts without words have no shingles and are linked with nothing; ties go to the smallest doc_id, nulls
last. Rows of one doc_id and text count once for the groups and are all returned. An empty table gives an empty result.
Input columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm import wordhash
from brightledger.llm.common import join_salted, materialize, scratch, stage as pipeline_stage
from brightledger.llm.graphs import components

WORDS, PERCENT, K, LEAST = 5, 75, 64, 16
#: Classes in a block of a list. Whole texts are dealt to as many blocks as the root of their shingles by TEXT_BLOCK, so that
#: neither tasks nor copies of texts grow as fast as a group, and to more where a block would hold over TEXT_MOST.
BLOCK, TEXT_BLOCK, TEXT_MOST = 1000, 8000, 2_000_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each part: first text, number of texts, the distinct shingles in order of text and hash, and where each text's begin."""
    for w in wordhash.words(column):
        hashes, of = wordhash.shingles(w, WORDS)
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, of = hashes[new], of[new]
        yield w.first, w.n, hashes, np.searchsorted(of, np.arange(w.n + 1))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns."""
    sums = np.zeros((len(hashes) + 1, 2), dtype=np.uint64)
    np.cumsum(wordhash.mixed(hashes + np.uint64(1)), out=sums[1:, 0])
    np.cumsum(wordhash.mixed(hashes ^ np.uint64(wordhash.ODD)), out=sums[1:, 1])
    keys = sums[at[1:]] - sums[at[:-1]]
    return wordhash.mixed(keys + np.diff(at).astype(np.uint64)[:, None])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n`` (shingles), ``cid`` (16 bytes that stand for the set) and ``sketch``, its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, hashes, at in shingle_sets(b.column(1)):
                size = np.diff(at)
                keep = np.minimum(size, K)
                cut = np.concatenate([[0], np.cumsum(keep)])
                take = np.repeat(at[:-1] - cut[:-1], keep) + np.arange(cut[-1])
                cid = [x.tobytes() for x in set_keys(hashes, at)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, n), pa.array(size, pa.int64()), pa.array(cid, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes[take].view(np.int64))),
                    ],
                    names=["doc_id", "n", "cid", "sketch"],
                )

    schema = "doc_id long, n long, cid binary, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in rows sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        differs = np.zeros(b.num_rows - 1, dtype=bool)
        for k in keys:
            c = b.column(k)
            differs |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def common(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share; of: the sets' numbers, value: their values, each once in a set."""
    out = np.zeros((n, n), dtype=np.float32)
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    some = count[code] > 1
    of, code = of[some], column[code[some]]
    if n == 2:
        out[0, 1] = out[1, 0] = len(of) // 2
        return out
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    width = 1 + (int(code[-1]) if len(code) else -1)
    step = max(64, (1 << 22) // n)
    for lo in range(0, width, step):
        a, b = np.searchsorted(code, [lo, lo + step])
        part = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        part[of[a:b], code[a:b] - lo] = 1
        out += part @ part.T
    return out


def forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``linked(i, js)`` tells which of js are linked with i."""
    edges, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            new, rest = rest[hit], rest[~hit]
            edges += [(int(i), int(j)) for j in new]
            queue += new.tolist()
    return edges


def alike(sketch: np.ndarray, size: np.ndarray, shared: np.ndarray):
    """The filter of step 3 for ``forest``; sketch: a row of sorted values for each class, filled up with the largest number.
    Values are unsigned, as in the order that chose the smallest."""
    full = np.minimum(size, K)

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        o = shared[i, js]
        union = full[i] + full[js] - o
        whole = (size[i] <= K) & (size[js] <= K)
        ok = np.where(whole, 100 * o >= PERCENT * union, o >= LEAST)
        ok &= 100 * np.minimum(size[i], size[js]) >= PERCENT * np.maximum(size[i], size[js])
        ask = np.flatnonzero(ok & ~whole)
        if len(ask):  # of the smallest K values of the union, those in both
            both = np.sort(np.concatenate([np.broadcast_to(sketch[i], (len(ask), K)), sketch[js[ask]]], axis=1), axis=1)
            twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.uint64).max)
            rank = np.arange(1, 2 * K)[None, :] - np.cumsum(twice, axis=1) + 1
            ok[ask] = (twice & (rank <= K)).sum(axis=1) >= LEAST
        return ok

    return linked


def lists(classes: DataFrame) -> DataFrame:
    """Rows ``value, cid, n, sketch`` of the inverted lists, under each class's rarest values only; values of one class are left out."""
    entries = classes.select("cid", F.explode("sketch").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = entries.join(often, "value").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    size = F.size("sketch")  # at most K, and so are the collected values
    least = F.when(F.col("n") <= PERCENT * K // 100, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(LEAST))
    listed = F.greatest(F.lit(0), size - least + 1 - (size - F.size("values"))).cast("int")
    return ranked.join(classes, "cid").select("cid", "n", "sketch", F.explode(F.slice("values", F.lit(1), listed)).alias("v")).select("v.value", "cid", "n", "sketch")


def blocks(rows: DataFrame, key: str, weight, most: int) -> DataFrame:
    """Rows dealt to pairs of blocks ``i <= j`` of their key, so that each two rows of a key meet; keys of one row are left out."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows"), F.ceil(F.sum(weight) / most).cast("int").alias("parts")).filter("rows > 1")
    dealt = rows.join(sizes.select(key, F.greatest("parts", F.lit(1)).alias("parts")), key)
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    # a block of a key with one more block meets it in one pair; only a lone block meets itself
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (j != F.col("own")) | (F.col("parts") == 1))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges ``a, b`` of forests over the classes that may be linked."""
    dealt = blocks(materialize(lists(classes), "lists"), "value", F.lit(1), BLOCK)
    sort = ["value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, sort):
            cid = t.column("cid").to_pylist()
            size = t.column("n").to_numpy()
            flat = t.column("sketch").combine_chunks()
            count = np.minimum(size, K)
            of = np.repeat(np.arange(len(cid)), count)
            values = flat.flatten().to_numpy().view(np.uint64)
            sketch = np.full((len(cid), K), np.iinfo(np.uint64).max, dtype=np.uint64)
            sketch[of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)] = values
            edges = forest(len(cid), alike(sketch, size, common(of, values, len(cid))))
            if edges:
                yield pa.RecordBatch.from_pydict({"a": [cid[i] for i, _ in edges], "b": [cid[j] for _, j in edges]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    laid = dealt.repartition(*sort).sortWithinPartitions(*sort).select(*sort, "cid", "n", "sketch")
    return laid.mapInArrow(run, "a binary, b binary").distinct()


def verified(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Edges ``a, b`` of forests over the classes whose whole texts are linked; found: components of candidates."""
    members = classes.select("cid", "n", "rep").join(found.select(F.col("node").alias("cid"), "label"), "cid")
    members = materialize(members, "members")
    total = F.sum("n")
    parts = F.greatest(F.lit(1), F.floor(F.sqrt(total / TEXT_BLOCK)), F.ceil(total / TEXT_MOST)).cast("int")
    members = join_salted(members, members.groupBy("label").agg(parts.alias("parts")), "label", "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    # rows of one doc_id may differ in text: those of another set are told by their shingles
    rows = members.hint("merge").join(texts, members["rep"].eqNullSafe(texts["rep"])).select("label", "cid", "parts", "text")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (j != F.col("own")) | (F.col("parts") == 1))
    dealt = dealt.withColumn("other", F.explode(others)).select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "text")
    sort = ["label", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, sort):
            own, seen, of, values = t.column("cid").to_pylist(), {}, [], []
            for first, n, hashes, at in shingle_sets(t.column("text").combine_chunks()):
                keys = set_keys(hashes, at)
                for k in range(n):
                    if (key := keys[k].tobytes()) == own[first + k] and key not in seen:
                        seen[key] = len(seen)
                        values.append(hashes[at[k] : at[k + 1]])
            if len(seen) < 2:
                continue
            size = np.array([len(v) for v in values])
            of = np.repeat(np.arange(len(size)), size)
            shared = common(of, np.concatenate(values), len(size))
            linked = lambda i, js: 100 * shared[i, js] >= PERCENT * (size[i] + size[js] - shared[i, js])  # noqa: B023, E731
            if edges := forest(len(size), linked):
                cid = list(seen)
                yield pa.RecordBatch.from_pydict({"a": [cid[i] for i, _ in edges], "b": [cid[j] for _, j in edges]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return dealt.repartition(*sort).sortWithinPartitions(*sort).mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: a group is what links connect, its id the smallest doc_id."""
    rows = materialize(sketches(docs), "sketches")
    own = rows.filter("n > 0")
    classes = materialize(own.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    with scratch(docs.sparkSession) as kept:
        found = components(candidates(classes))
        kept.append(components(verified(docs, classes, found)))
    linked = kept[0]
    named = classes.select("cid", "rep").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = join_salted(named, smallest, "label", "cid").select("cid", "component_id")
    whole = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(by_class, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the documents' own columns. Rows are told apart by a stored
    number: ids may be null or repeat (of one id the first stored row stays, of null ids one if no other is there). Rows without
    words all stay."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("own")), "rows")
    with scratch(spark) as kept:
        found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "own.text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
        named = materialize(found.join(rows.select("row", F.col("own.doc_id").alias("id")), "row"), "named")
        first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"), F.count("*").alias("n")).filter("n > 1")
        gone = join_salted(named, first, "group", "row").filter("row <> first").select("row")
        kept.append(materialize(gone, "near"))
    return rows.join(kept[0], "row", "left_anti").select("own.*")


#: Exact links for a small table: every pair of documents with a common shingle, and what they reach.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
 s AS (SELECT rid, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {WORDS} THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - {WORDS - 2}), lambda i: array_to_string(t[i:i + {WORDS - 1}], ' ')) END) AS s FROM w),
 k AS (SELECT min(rid) AS cls, len(s) AS n, s FROM s WHERE len(s) > 0 GROUP BY s),
 c AS (SELECT rid, cls FROM s JOIN k ON s.s = k.s),
 x AS (SELECT cls, n, unnest(s) AS g FROM k),
 f AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY g) > 1),
 p AS (SELECT a.cls AS a, b.cls AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.g = b.g AND a.cls < b.cls GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * o >= {PERCENT} * (na + nb - o)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT cls AS root, cls AS node FROM k UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a),
 m AS (SELECT r.node AS cls, min(w.doc_id) AS component_id FROM r JOIN c ON c.cls = r.root JOIN w ON w.rid = c.rid GROUP BY 1)
SELECT w.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(m.component_id, w.doc_id) AS kept
FROM w JOIN s USING (rid) LEFT JOIN c USING (rid) LEFT JOIN m USING (cls)"""
