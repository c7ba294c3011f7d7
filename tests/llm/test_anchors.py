"""Repeated passages, the filter audit and hard negatives against plain Python, with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightledger.llm import blocks, interactions, negatives, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["part", "digest", "first", "rows", "A", "E", "good", "toxic", "step", "kept", "n_words", "repeats", "chunk", "hits", "windows", "c0", "__id", "__c0", "__salt", "every", "id", "v", "groups", "group", "rank", "score"]


def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(draw.randint(0, 90))]
        if k % 3 == 0:
            lo = draw.randint(0, 30)
            own[10:10] = passage[lo : lo + draw.randint(11, 30)]
        rows.append((1000 - k if k % 2 else k, draw.choice([" ", "\n", " \t "]).join(own)))
    long = " ".join(word() for _ in range(30_000))
    rows += [(None, " ".join(passage)), (None, None), (7, None), (8, ""), (9, " \n\t"), (500, " ".join(passage)), (500, " ".join(passage)), (501, " ".join(passage)), (502, "x " * 200), (503, "x " * 300)]
    rows += [(504, long), (505, long + " more"), (506, "é" * 2000 + " ü ö " * 30), (507, " ü ö " * 30), (508, " ".join(passage).upper()), (-3, " ".join(passage[:13])), (-2, " ".join(passage[1:13]))]
    return rows


def plain_passages(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - 12):
            if i is not None:
                least[tuple(w[s : s + 13])] = min(i, least.get(tuple(w[s : s + 13]), i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - 12):
            if i is not None and least[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts()], DOCS)


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("size", [blocks.CHUNK, 3000])
def test_passages(docs, size, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", size)
    got = [tuple(r) for r in blocks.query(docs.repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(plain_passages(texts()), key=key)


def test_passages_keep_columns_and_spans(docs):
    wide = docs.withColumns({c: F.lit("z") for c in CLASHING})
    assert blocks.query(wide).count() == len(texts())
    found = blocks.without_repeats(wide.select("doc_id", "text", "source"), keep=("doc_id", "source")).filter("doc_id = 501").first()
    assert found["source"] == "s" and [tuple(x) for x in found["repeats"]] == [(0, 60)] and found["kept"] == "" and found["n_words"] == 60
    assert blocks.query(docs.limit(0)).collect() == []
    assert blocks.without_repeats(docs, window=5).count() == len(texts())


def test_every_window_has_one_block():
    for window in (5, 6, 13, 14):
        size = blocks.block_of(window)
        starts = range(0, 10 * size, size)
        assert all(sum(s <= b and b + size <= s + window for b in starts) >= 1 for s in range(5 * size))


def test_scan_in_pieces():
    text = [t or "" for _, t in texts()]
    raw = np.frombuffer("".join(text).encode(), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in text]))
    whole, parts = blocks.Scan(raw, offsets), blocks.Scan(raw, offsets, piece=64)
    for a, b in ((whole.hashes, parts.hashes), (whole.starts, parts.starts), (whole.ends, parts.ends), (whole.of, parts.of)):
        assert np.array_equal(a, b)
    assert len(whole.of) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in text) and wordhash.PART > 64


def audit_rows():
    base = [(i, t, "en", ["a", "b", None, ""][n % 4], 1) for n, (i, t) in enumerate(texts())]
    shout = [(2000 + k, "LOUD " * 210 + ("#" if k % 2 else ""), "en", "a", 1) for k in range(6)]
    clean = [(3000 + k, " ".join(f"w{k}x{j}" for j in range(250)), "en", "c", 1) for k in range(4)]
    return base + shout + clean


AUDIT_LABELS = [(7, 1, 0), (8, 1, None), (8, 0, 1), (500, 1, 1), (None, 1, 1), (2000, None, 1), (2001, 1, 0), (3000, 1, 1), (99999, 1, 1)]


def plain_audit(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failing = []
    for i, t, _, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        mine = [x for x in AUDIT_LABELS if i is not None and x[0] == i]
        failing.append((s or "", {k for k in f if f[k]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in sorted({x[0] for x in failing}):
        own, shares, steps = [x for x in failing if x[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                hit = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(hit)
                steps.append((part, order, k + 1, len(left), len(hit), sum(f in x[1] for x in own) - len(hit), sum(x[1] == {f} for x in own), sum(x[2] for x in hit), sum(x[3] for x in hit)))
        out += [(*s, shares[s[1][s[2] - 1]]) for s in steps]
    return out


def test_audit(spark):
    docs, labels = spark.createDataFrame(audit_rows(), DOCS), spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    want = plain_audit(audit_rows())
    for d in (docs, docs.withColumns({c: F.lit("z") for c in CLASHING})):
        got = interactions.query(d, labels)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert interactions.query(docs.limit(0), labels).collect() == []
    assert interactions.query(docs, labels.limit(0)).count() == 600 * len({r[3] or "" for r in audit_rows()})


def test_shares_add_up(spark):
    rows = spark.createDataFrame(audit_rows(), DOCS)
    found = interactions.query(rows, spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int"))
    sums = found.filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("shares"), F.sum("removed").alias("gone")).collect()
    assert all(r["shares"] == 120 * r["gone"] for r in sums)


def vector_rows(kind):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    x = centres[draw.integers(6, size=400)] + 0.2 * draw.normal(size=(400, 8)) if kind == "clusters" else draw.normal(size=(400, 8))
    rows = [(int(k), [float(c) for c in v], int(draw.integers(4))) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[50][1], k % 2) for k in range(60)]  # many ties
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * 6, 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (2200, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(2250, [1.0, 2.0], 1), (2300, [], 2), (2350, [0.0] * 8, 1), (2400, [1e30] * 8, 1), (50, rows[50][1], rows[50][2]), (-100, rows[9][1], 3), (2450, [-1.0] * 8, 77)]
    return rows


def plain_negatives(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) or abs(x) >= 2**31 / 256 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        w = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in w) >= 2**62:
            continue
        seen[i] = min(seen.get(i, (label, w)), (label, w))
    ids = list(seen)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in ids:
        if a % 50:
            continue
        score = {b: dot(seen[a][1], seen[b][1]) for b in ids if b != a}
        for p in sorted((b for b in score if seen[b][0] == seen[a][0]), key=lambda b: (-score[b], b))[:5]:
            fit = sorted((b for b in score if seen[b][0] != seen[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]), key=lambda b: (-score[b], b))[:3]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit)]
    return out


@pytest.mark.parametrize(("kind", "small"), [("clusters", True), ("clusters", False), ("none", True)])
def test_negatives(spark, kind, small, monkeypatch):
    if small:
        for name, value in (("SAMPLE", 40), ("PER_PIVOT", 1), ("MOVE", 0), ("ANCHORS", 3), ("CANDIDATES", 50)):
            monkeypatch.setattr(negatives, name, value)
    rows = vector_rows(kind)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.query(frame.withColumns({c: F.lit("z") for c in CLASHING})).collect())
    assert got == sorted(plain_negatives(rows))


def test_negatives_without_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 2)]):
        got = negatives.query(spark.createDataFrame(rows, schema))
        assert got.columns == [x.split()[0] for x in negatives.RESULT.split(", ")] and got.collect() == []


def test_negatives_of_large_components(spark):
    """Products beyond 2**53, which doubles do not hold."""
    draw = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in draw.integers(1, 4_000_000, size=4)], int(k % 3)) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in negatives.query(frame).collect()) == sorted(plain_negatives(rows))


def test_cells_prune_clusters(spark):
    """Candidates go to few cells where vectors have structure, and to no cell twice."""
    draw = np.random.default_rng(2)
    centres = np.round(draw.normal(size=(20, 16)) * 2000)
    own = draw.integers(20, size=2000)
    x = centres[own] + np.round(draw.normal(size=(2000, 16)) * 30)
    most = float((x * x).sum(1).max())
    space = negatives.Space(most, np.arange(20), own[:20], x[:20], centres)
    cell = np.arange(20)
    radius = np.array([np.sqrt(negatives.squared(x[own == k], centres[k : k + 1])).max() for k in range(20)])
    low = np.array([0.9 * float((centres[k] ** 2).sum()) for k in range(20)])
    far = np.sqrt((centres**2).sum(1) * 1.2 + most - 2 * low)
    hit = space.serves(x, cell, radius, low, far, np.full(20, np.inf))
    assert hit[np.arange(2000), own].all() and hit.mean() < 0.3
