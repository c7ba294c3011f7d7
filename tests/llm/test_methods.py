"""Operators against brute force, held-out data or exact properties, on a small table."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightledger.llm import ann, chunks, lm, mixing, near, quality, rollups, suffix, toxicity
from brightledger.llm.common import materialize, new_path, read, release

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_repeated_strings(docs, texts, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 1 << 15)  # many chunks
    length, count = 200, Counter()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    for r in suffix.query(docs.repartition(3)).collect():
        b, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())


def test_a_line_in_every_document(spark, monkeypatch):
    """A line shorter than a match, between other words in each text, is no match; with copies of some texts, against brute force."""
    monkeypatch.setattr(chunks, "CHUNK", 1 << 13)
    random = np.random.default_rng(8)
    words = lambda n: " ".join("".join(random.choice(list("abcdefgh"), 6)) for _ in range(n))
    line = words(21)
    assert len(line) < 150
    rows = [(i, f"{words(20)} {line} {words(20)}") for i in range(300)]
    rows += [(300 + i, rows[i][1][: 260 + i]) for i in range(20)] + [(400, "ab" * 400), (401, "ba" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    for r in suffix.query(docs.repartition(4)).collect():
        t, gone = dict(rows)[r.doc_id], set()
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone.update(range(p, p + 200))
        assert (r.n_bytes, r.n_removed) == (len(t), len(gone)), r.doc_id


def test_levels():
    """Merging keeps what occurs twice, values that differ in their check only are different, and scans find older entries."""
    random = np.random.default_rng(1)
    values, checks = random.integers(0, 50, 600).astype(np.uint64), random.integers(0, 3, 600).astype(np.uint64)
    pairs = Counter(zip(values.tolist(), checks.tolist(), strict=True))
    parts = [suffix.Level(values[k::3], checks[k::3], np.zeros(200, dtype=bool)) for k in range(3)]
    whole = suffix.Level.merged([suffix.Level.merged(parts[:2]), parts[2]])
    assert list(zip(whole.values.tolist(), whole.checks.tolist(), strict=True)) == sorted(pairs)
    assert whole.twice.tolist() == [pairs[p] > 1 for p in sorted(pairs)]
    place = whole.place(values, checks)
    assert np.array_equal(whole.values[place], values) and np.array_equal(whole.checks[place], checks)
    assert whole.place(np.array([7], dtype=np.uint64), np.array([9], dtype=np.uint64)).tolist() == [-1]


def test_family_of_levels(spark):
    """Batches that come one by one: sizes are powers of two, larger ones first, and answers are those of all batches."""
    random, family, rows = np.random.default_rng(2), suffix.Family(), []
    schema = "chunk long, bucket int, values binary, checks binary"
    for k in range(7):
        values = np.unique(random.integers(0, 300, 60).astype(np.uint64))
        rows.append((k, 0, values.tobytes(), values.tobytes()))
        family.add(spark.createDataFrame([rows[-1]], schema))
        sizes = [n for n, _ in family.levels]
        assert sum(sizes) == k + 1 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    count = Counter(v for r in rows for v in np.frombuffer(r[2], dtype=np.uint64).tolist())
    firsts = Counter()
    for r in family.answers(spark.createDataFrame(rows, schema)).collect():
        values, marks = np.frombuffer(rows[r.chunk][2], dtype=np.uint64), np.frombuffer(r.answers[0]["marks"], dtype=np.uint8)
        assert [bool(m & suffix.REPEATED) for m in marks] == [count[v] > 1 for v in values.tolist()]
        firsts.update(values[(marks & suffix.FIRST) > 0].tolist())
    assert set(firsts.values()) == {1} and set(firsts) == set(count)


def linked(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    have = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            have[x].append(i)
    pairs = {(a, b) for l in have.values() for a in l for b in l if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates(docs, texts):
    want = linked(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()} == want


def test_near_duplicates_in_one_group(spark, monkeypatch):
    """A group of near copies that spans several blocks of lists and of texts, and a passage that all share."""
    monkeypatch.setattr(near, "BLOCK", 20)
    monkeypatch.setattr(near, "TEXT_BLOCK", 500)
    random = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(150):
        w = list(base)
        for k in random.choice(120, random.integers(0, 8), replace=False):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, passage + " " + " ".join(f"own{i}-{k}" for k in range(60))) for i in range(60)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(dict(rows))


@pytest.mark.parametrize("size, of", [(36, 48), (45, 60), (60, 80)])
def test_near_duplicates_of_nested_texts(spark, size, of):
    """Pairs at exactly 0.75, one text the beginning of the other, whose sketches reach past the middle of all hashes."""
    rows = []
    for p in range(3000):
        w = [f"{p}-{k}" for k in range(of + 4)]
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(w[: size + 4]))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_near_duplicates_stage_goes_by_rows(spark):
    """Repeated rows, null ids and one id with several texts, against plain Python: each group keeps one row, others stay."""
    a, b, c, d, e, f, g = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg")
    rows = [
        (1, a), (1, a), (2, a), (None, b), (None, b), (3, c), (None, c + " more"), (None, d), (None, e), (4, f), (4, g), (-1, f),
        (None, ""), (None, None), (None, ""), (5, e + " more"), (5, e + " more"),
    ]
    groups = defaultdict(list)
    for i, (n, top) in linked({i: t for i, (_, t) in enumerate(rows)}).items():
        groups[top if n else -1 - i].append(rows[i])
    want = Counter(min(own, key=lambda r: (r[0] is None, r[0])) for own in groups.values())
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, lang string")
    for d in (docs, docs.repartition(3)):
        got = near.stage(spark, d, "").collect()
        assert Counter((r.doc_id, "" if r.text is None else r.text) for r in got) == Counter((i, "" if t is None else t) for i, t in want.elements())
        assert {r.lang for r in got} == {"own"}


def best_share(cells):
    """The share under which left-out tokens are most probable, by trying shares; cells: how often which factor occurs."""
    low, high = 0.0, 0.999
    for _ in range(3):
        options = np.linspace(low, high, 2001)
        best = int(np.argmax(sum(n * np.log(1 + options * (f - 1)) for f, n in cells.items())))
        low, high = options[max(best - 1, 0)], options[min(best + 1, 2000)]
    return float(options[best])


def rounded(ratio):
    """Factors are told apart by halves of powers of two."""
    return 2.0 ** (min(80, max(-80, round(2 * math.log2(ratio)))) / 2) if ratio > 0 else 0.0


def plain_model(words, learned):
    """Counts, and the shares of histories by length and size, learned by leaving out each token, in plain Python."""
    grams = {1: Counter(), 2: Counter(), 3: Counter()}
    for i in learned:
        w = ["<s>", *words[i], "</s>"]
        for k in grams:
            grams[k].update(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    n = sum(c for k, c in grams[1].items() if k != ("<s>",))
    kinds = len(grams[1]) - (("<s>",) in grams[1])
    plain = lambda x, less=0: (grams[1][x,] - less + 0.1) / (n - less + 0.1 * (kinds + 1))
    size = lambda c: int(math.log2(c)) + 1 if c else 0
    shares = {1: defaultdict(float), 2: defaultdict(float)}
    found = defaultdict(Counter)
    for i in learned:
        w = ["<s>", *words[i], "</s>"]
        for v, x in zip(w, w[1:], strict=False):
            h = grams[1][v,]
            found[size(h)][rounded((grams[2][v, x] - 1) / (h - 1) / plain(x, 1) if h > 1 else 0)] += 1
    shares[1].update({k: best_share(c) for k, c in found.items()})
    found = defaultdict(Counter)
    for i in learned:
        w = ["<s>", *words[i], "</s>"]
        for u, v, x in zip(w, w[1:], w[2:], strict=False):
            h, one = grams[2][u, v], grams[1][v,]
            if h > 1:
                s = shares[1][size(one)]
                shorter = s * (grams[2][v, x] - 1) / (one - 1) + (1 - s) * plain(x, 1)
                found[size(h)][rounded((grams[3][u, v, x] - 1) / (h - 1) / shorter)] += 1
    shares[2].update({k: best_share(c) for k, c in found.items()})
    return grams, n, plain, size, shares


def test_scores(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1 << 15)  # many chunks
    monkeypatch.setattr(lm, "STRETCH", 7)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    words = {i: WORD.findall(lowered(t)) for i, t in texts.items()}
    grams, n, plain, size, shares = plain_model(words, [i for i in words if zlib.crc32(str(i).encode()) % 10])
    assert any(shares[2].values())
    for i, w in words.items():
        base = score = known = 0
        w = ["<s>", *w, "</s>"]
        for k in range(1, len(w)):
            x, v = w[k], w[k - 1]
            p = plain(x)
            base += math.log10(p)
            known += grams[1][x,] > 0
            for h in (w[k - 1 : k], w[k - 2 : k] if k > 1 else []):
                if h and (c := grams[len(h)][tuple(h)]):
                    s = shares[len(h)][size(c)]
                    p = s * grams[len(h) + 1][(*h, x)] / c + (1 - s) * p
            score += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w) - 1, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=2e-4)


def test_stretches_meet_the_states_of_whole_texts(monkeypatch):
    """Where texts are cut makes no difference, and every state's arcs and failure arcs make a distribution."""
    random = np.random.default_rng(5)
    texts = pa.array([" ".join(random.choice(list("abcdefg"), 300, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(6)])
    g = lm.Grams(texts)
    words, pairs = g.counts(np.ones(6, dtype=bool))
    t = lm.Triples(g, pairs)
    share = np.where(np.arange(64) > 1, 0.5, 0.0)
    a = lm.Automaton(lm.Model(int(words.sum()) - 6, 8, share, share), g, t, words, pairs, t.counts(g, np.ones(6, dtype=bool)))
    found = [a.traverse(g)]
    for stretch in (2, 7, 1 << 20):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        found.append(a.traverse(g))
    assert all(np.array_equal(found[0], x) for x in found)
    known = np.flatnonzero(np.arange(len(g.words)) != g.begin)
    unknown = 0.1 / (int(words.sum()) - 6 + 0.1 * 9)
    stop = int(np.flatnonzero(g.words == lm.STOP)[0])
    for state in range(len(a.fall)):
        last = state - 1 if 0 < state <= a.n else g.pairs[state - a.n - 1] % a.n if state else -1
        if last == stop:
            continue
        to, weight = a.step(np.full(len(known), state), known)
        fall, at = 1.0, state
        while at:
            fall, at = fall * 10 ** a.fall[at], a.fail[at]
        assert math.isclose(float(np.sum(10**weight)) + fall * unknown, 1, rel_tol=1e-9)


def test_what_occurs_twice_scores_higher(spark):
    random = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choice(vocabulary, 120)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:60])]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i].score for i in range(60) if not got[i].held_out and not got[1000 + i].held_out]
    once = [got[i].score for i in range(60, 300) if not got[i].held_out]
    assert min(twice) > max(once)


def test_scores_beat_the_base_on_held_out_texts(spark):
    held = lm.score(read(spark, MEDIUM, "documents")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    known = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    rows = toxicity.query(docs, known).join(labels.join(known, "doc_id", "left_anti").select("doc_id", F.col("toxic").alias("is")), "doc_id")
    n = {(r["toxic"], r["is"]): r["count"] for r in rows.groupBy("toxic", "is").count().collect()}
    assert n[True, 1] / (n[True, 1] + n.get((False, 1), 0)) > 0.9
    assert n.get((True, 0), 0) / (n[False, 0] + n.get((True, 0), 0)) < 0.03


def test_sample_is_bounded_and_of_known_documents(spark, monkeypatch):
    """Labels without a document take no place in the sample, repeated documents and labels count once, long texts are bounded."""
    monkeypatch.setattr(toxicity, "MOST", 50)
    docs = spark.createDataFrame([(i % 30, " ".join(f"w{i}-{k}" for k in range(200))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(-500, 30)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    got = toxicity.sampled(docs, labels, categories, 10).collect()
    assert Counter(r.toxic for r in got) == {0: 10, 1: 10}
    assert all(len(r.features) <= 50 for r in got)


def test_toxicity_stage_goes_by_rows(spark, tmp_path):
    """A toxic row takes away no other row of its id, nor other rows without an id."""
    bad, good = (lambda i: f"you idiot and moron number {i}"), (lambda i: f"a fair and calm note number {i}")
    known = [(i, bad(i) if i % 2 else good(i)) for i in range(80)]
    rows = [*known, (None, bad(90)), (None, good(91)), (None, good(91)), (100, bad(92)), (100, good(93)), (101, bad(94)), (101, bad(94)), (102, good(95)), (None, None)]
    base = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in known], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs = spark.createDataFrame([("own", i, t) for i, t in rows], "lang string, doc_id long, text string")
    got = toxicity.stage(spark, docs, base)
    assert got.columns == docs.columns
    left = Counter((r.lang, r.doc_id, r.text) for r in got.collect() if r.text is not None)
    assert left == Counter(("own", i, t) for i, t in rows if t is not None and "idiot" not in t)


def test_recall(spark):
    """The query's own rows on the table against brute force; equal scores count as equal."""
    v = read(spark, "/root/testdata/sf0.1", "embeddings")
    p = v.select("vec_id", "embedding").toPandas()
    x, ids = np.array(p.embedding.tolist(), dtype=float), p.vec_id.to_numpy()
    got = ann.query(v).toPandas().groupby("query_id").score.apply(list)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        least = np.sort(s)[-20] - 1e-9
        hit, total = hit + sum(z >= least for z in got[q]), total + 20
    assert hit >= 0.9 * total


def test_recall_of_queries_unlike_other_rows(spark):
    """Rows in clusters, queries anywhere."""
    random, n = np.random.default_rng(5), 12_000
    x = random.normal(size=(200, 32))[random.integers(200, size=n)] + 0.15 * random.normal(size=(n, 32))
    x[::20] = random.normal(size=(len(x[::20]), 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}))
    got = ann.query(rows).toPandas().groupby("query_id").score.apply(list)
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -9
        hit += sum(z >= np.sort(s)[-20] - 1e-9 for z in got[q])
    assert hit >= 0.9 * 20 * len(got)


def vectors_of(kind, n):
    random = np.random.default_rng(0)
    if kind.startswith("clustered"):
        x = random.normal(size=(200, 64))[random.integers(200, size=n)] + 0.3 * random.normal(size=(n, 64))
    else:
        x = random.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x * np.exp(0.5 * random.normal(size=n))[:, None] if kind.endswith("uneven") else x


@pytest.mark.parametrize("kind, most", [("plain", 0.6), ("uneven", 0.2), ("clustered", 0.05), ("clustered uneven", 0.2)])
def test_lists_hold_the_neighbours_and_little_else(kind, most):
    """Of 50,000 vectors: share of true neighbours in the lists that queries look into, and of all vectors compared."""
    x = vectors_of(kind, 50_000)
    n, ids, longest = len(x), np.arange(len(x)), float(np.sqrt((x * x).sum(1)).max()) * (1 + 1e-12)
    some = np.random.default_rng(1).choice(n, 25_000, replace=False)
    index = ann.Index.fit(x[some], some, n, longest, 20)
    sizes, has = np.zeros(sum(len(b.points) for b in index.bands), dtype=int), []
    of = ann.Index.band_of(np.sqrt((x * x).sum(1)), longest)
    for k in np.unique(of):
        for part in np.array_split(np.flatnonzero(of == k), 25):
            row, lists = index.bands[k].replicas(x[part])
            np.add.at(sizes, lists, 1)
            has.append(np.column_stack([part[row], lists]))
    asked = ids[:: n // 100]
    q = x[asked] / np.linalg.norm(x[asked], axis=1)[:, None]
    at, number, _ = index.lists(q, index.references(q, asked, 20), sizes)
    has = np.concatenate(has)
    hit = 0
    for i, me in enumerate(asked):
        s = x @ x[me]
        s[me] = -np.inf
        held = np.zeros(n, dtype=bool)
        held[has[np.isin(has[:, 1], number[at == i]), 0]] = True
        hit += held[np.argsort(-s)[:20]].sum()
    assert hit >= 0.9 * 20 * len(asked)
    assert sizes[number].sum() <= most * n * len(asked)


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.copies * r["size"]
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.copies <= 2
    largest = {s: max(r["size"] for r in rows if r.source == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()), rel_tol=1e-9)
    assert sorted(mixing.mix(docs.repartition(5)).collect()) == sorted(rows)


def test_smaller_budgets_are_nested(docs):
    less = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.6).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, share=1.1).collect()}
    assert all(less[i] <= more[i] for i in less) and sum(less.values()) < sum(more.values())


def test_rollups_commit_once(spark):
    path, schema = new_path(spark, "test"), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", "b", None, "t", 7, None)], schema)
    two = spark.createDataFrame([("delete", "b", None, "t", 7, None), ("revise", "a", "en", "t", 12, 10)], schema)
    assert rollups.commit(path, "two", two) and rollups.commit(path, "one", one) and not rollups.commit(path, "one", one)
    want = [("a", "en", "t", 2, 17)]
    assert [tuple(r) for r in rollups.totals(spark, path).collect()] == want
    rollups.compact(spark, path, path + "-new")
    before = sorted(rollups.totals(spark, path).collect())
    again = spark.createDataFrame([("insert", "a", "en", "t", 5, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    names = [p.rpartition("/batch=")[2] for p in rollups._parts(spark, path)]
    assert names and not any(rollups.commit(path + "-new", n, again) for n in names)  # what was compacted is committed there, too
    rollups.compact(spark, path + "-new", path + "-newer")
    assert not any(rollups.commit(path + "-newer", n, again) for n in names)
    assert sorted(rollups.totals(spark, path + "-newer").collect()) == before
    assert [tuple(r) for r in rollups.totals(spark, path + "-new").collect()] == want
    with pytest.raises(Exception, match="unknown op"):
        rollups.commit(path, "bad", spark.createDataFrame([("move", "a", "en", "t", 1, None)], schema))


def test_rollups_without_batches(spark):
    assert rollups.totals(spark, new_path(spark, "none")).collect() == []


def test_release_removes_what_was_written(spark):
    stored = chunks.bucketed(spark.range(3).withColumnRenamed("id", "chunk"), "kept", "chunk")
    path = materialize(spark.range(3), "kept").inputFiles()[0]
    assert stored.count() == 3 and os.path.exists(path.removeprefix("file://"))
    release(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not [t for t in spark.catalog.listTables() if t.name.startswith("kept_")]


def test_clean_documents_pass_the_quality_rules(spark):
    docs, labels = read(spark, MEDIUM, "documents"), read(spark, MEDIUM, "labels")
    rows = quality.query(docs).join(labels, "doc_id").filter("quality = 1 AND toxic = 0 AND NOT base_failed")
    assert rows.filter("NOT kept").count() <= 0.02 * rows.count()


def test_repeated_words(spark):
    w = [f"w{i}" for i in range(30)]
    cases = [" ".join(w), " ".join(w + w[:8]), " ".join(["x"] * 20), " ".join(w[:8]), ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(cases)], "doc_id long, text string, lang string")
    assert [r.n_repeat_words for r in quality.query(docs).orderBy("doc_id").collect()] == [0, 16, 20, 0, 0]
