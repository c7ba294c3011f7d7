"""Nulls, empties, repeats, clashing columns and empty tables through every operator and stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brightledger.llm import ann, lm, mixing, near, preferences, quality, rollups, suffix, toxicity
from brightledger.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHING = ["n", "cid", "sketch", "kept", "size", "hash", "key", "copies", "chunk", "toxic", "ids", "decoded", "label", "rep", "n_bytes", "own", "words", "copy", "whole", "threshold", "row", "__row", "rejected", "__rejected", "group", "id"]


def rows():
    word = " ".join(f"w{i}" for i in range(400))
    return [
        (1, word, "en", "a", 1), (2, word, "en", "a", 1), (2, word, "en", "a", 1), (3, word + " more", "en", None, 1), (None, "one two three", None, "b", None),
        (None, None, None, None, None), (5, "", "xx", "b", 0), (6, " \n\t ", "de", "c", 5), (7, "The idiot and the moron of it", "en", "c", 9), (8, "é" * 3000, "fr", "", 3000),
        (9, "long " * 40000, "en", "a", 1), (-4, "a", "es", "d", 1), (10, "x y z w v u t s r q " * 5, "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("z") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    found = [(1, 1, 0), (7, 0, 1), (7, 0, 1), (5, None, 1), (None, 1, 0), (99, 1, 1), (9, 1, 0), (10, 1, 0)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, x: toxicity.query(d, x), "near": lambda d, x: near.near_duplicates(d), "suffix": lambda d, x: suffix.query(d),
    "lm": lambda d, x: lm.score(d), "quality": lambda d, x: quality.query(d), "mixing": lambda d, x: mixing.query(d), "rollups": lambda d, x: rollups.query(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(name, docs, clashing, labels):
    f = OPERATORS[name]
    for d in (docs, clashing, clashing.select(*reversed(clashing.columns))):
        found = f(d, labels).collect()
        if name != "rollups":
            assert len(found) == len(rows())
    assert f(docs.limit(0), labels).count() == 0
    assert f(docs, labels.limit(0)).columns


def test_near_groups(docs):
    found = {r.doc_id: r for r in near.near_duplicates(docs).filter("doc_id IS NOT NULL").collect()}
    assert found[2].component_id == 1 and found[3].component_id == 1 and not found[3].kept
    assert found[5].component_id == 5 and found[5].n_shingles == 0 and found[5].kept
    assert found[-4].n_shingles == 1


def test_suffix_counts(docs):
    found = {r.doc_id: r for r in suffix.query(docs).filter("doc_id IS NOT NULL").collect()}
    assert found[1].n_removed == found[1].n_bytes > 0 and found[1].n_spans == 1
    assert found[8].n_bytes == 6000 and found[8].n_removed == 6000
    assert found[7].n_removed == 0


def test_stages(spark, clashing, labels, tmp_path):
    base = f"file://{tmp_path}"
    labels.write.parquet(f"{base}/labels.parquet")
    for d in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, base)
            rows = out.collect()
            if name != "bpe":
                assert out.columns == d.columns, name
            assert rows or not d.count()


def test_pipeline_keeps_order_of_stages(spark, docs, labels, tmp_path):
    base = f"file://{tmp_path}"
    docs.write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    out = corpus_pipeline.run(spark, base)
    assert out.count() > 0 and "n_tokens" in out.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "source_mix", "bpe"]


def plain_mix(rows):
    """How often the mix takes each (doc_id, text, source), by sorting hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left, open_ = left - sum(target[s] for s in full), open_ - full
    taken = Counter()
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, upto, by_hash = target[s] - whole * total[s], 0, defaultdict(list)
        for i, t, x in rows:
            if x == s:
                by_hash[hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:8]].append((i, t, x))
        for h in sorted(by_hash):
            n = sum(size(t) for _, t, _ in by_hash[h])
            upto += n
            extra = upto <= budget or (upto - n <= budget and 2 * (budget - upto + n) > n)
            for r in by_hash[h]:
                taken[r] += whole + extra
    return taken


def plain_repeats(texts):
    """Texts without the bytes that a repeated string of 200 bytes covers."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for b in raw:
        gone = {q for p in range(len(b) - 199) if count[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        out.append(bytes(x for q, x in enumerate(b) if q not in gone).decode("utf-8", "ignore"))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage's rows on what the stage before it kept, with repeated rows and null ids; what toxicity keeps is stated."""
    random = np.random.default_rng(4)
    words = lambda n: " ".join("".join(random.choice(list("abcdefghij"), 5)) for _ in range(n))
    passage, base = words(60), f"file://{tmp_path}"
    clean = [(i, f"{words(40)} {passage if i % 7 == 0 else ''} {words(30)}", "ab"[i % 2]) for i in range(40)]
    clean += [clean[3], (None, clean[5][1] + " end", "b"), (None, words(50), None), (None, words(50), "c"), (77, clean[1][1], "a"), (77, words(45), "a"), (78, "", "a"), (None, None, None)]
    toxic = [(200 + i, f"you idiot and moron {words(12)}", "a") for i in range(40)] + [(None, f"you idiot and moron {words(12)}", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in [*clean, *toxic]], DOCS)
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    key = lambda r: tuple((x is None, str(x)) for x in (r[0], r[1], r[2]))
    rows, now = [*clean, *toxic], spark.read.parquet(f"{base}/documents.parquet")
    want = {"toxicity": lambda rows: clean, "near_duplicates": plain_groups, "repeated_strings": lambda rows: [(i, t, s) for (i, _, s), t in zip(rows, plain_repeats([t for _, t, _ in rows]), strict=True)], "source_mix": lambda rows: list(plain_mix(rows).elements())}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, now = sorted(want[name](rows), key=key), materialize(stage(spark, now, base), f"test-{name}")
        got = [(r.doc_id, r.text, r.source) for r in now.collect()]
        assert sorted(((i, t or "", s) for i, t, s in got), key=key) == sorted(((i, t or "", s) for i, t, s in rows), key=key), name
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, " ".join(map(str, library.encode(t or "", add_special_tokens=False).ids))) for i, t, _ in rows]
    out = corpus_pipeline.run(spark, base).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in out) == Counter((i, hashlib.sha256(x.encode()).hexdigest()) for i, x in ids)


def plain_groups(rows):
    """One row of each group of near copies: the smallest id, nulls last."""
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i) if sets[i] else -1 - i].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_vectors(spark):
    data = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(20, [0.0, 0.0, 0.0]), (40, None), (61, [1.0, None, 2.0]), (62, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (63, [1.0]), (5, [5.0, 1.0, 2.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"list": F.lit(1), "v": F.lit(2), "id": F.lit(3), "score": F.lit(4)})
    found = ann.query(v).collect()
    good = {i: x for i, x in data[:60]}
    for q in (0, 20, 40):
        mine = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        want = sorted(((i, sum(a * b for a, b in zip(good[q], x, strict=True))) for i, x in good.items() if i != q), key=lambda p: (-p[1], p[0]))[:20]
        assert mine == want
    assert ann.query(v.limit(0)).count() == 0
    assert ann.query(v.filter("vec_id < 3")).count() == 2


def test_long_conversations(spark):
    """Work on a conversation is linear in its turns; masks against plain Python."""
    turns = [(c, k, "assistant" if k % 2 else "user", f"{c if k > 20 else ''} turn {k}") for c in (0, 1) for k in range(4000)]
    (row,) = preferences.query(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert row.n_prompt_turns == 21
    at, spans = 0, []
    for _, k, role, text in turns[21:4000]:
        end = at + len(f"<|{role}|>\n{text}<|end|>\n")
        if role == "assistant":
            spans.append(f"{at + len(role) + 5}:{end}")
        at = end
    assert row.chosen_mask == ",".join(spans) and len(row.chosen) == at


def test_preferences(spark):
    data = [(0, 1, "assistant", "b"), (0, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (2, 0, "user", None), (3, 0, None, ""), (None, 0, "user", "x"), (4, 0, "user", "alone"), (6, 0, "user", "q"), (7, 0, "user", "q"), (7, 1, "assistant", "r"), (7, 1, "assistant", "r")]
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"a": F.lit(1), "n": F.lit(2), "p": F.lit(3)})
    found = {r.pair_id: r for r in preferences.query(c).collect()}
    assert set(found) == {0, 1, 3}
    assert found[0].prompt == "<|user|>\na<|end|>\n" and found[0].chosen == "<|assistant|>\nb<|end|>\n" and found[0].chosen_mask == "14:23"
    assert found[3].chosen == "" and found[3].rejected.count("r<|end|>") == 2 and found[3].n_prompt_turns == 1
    assert preferences.query(c.limit(0)).count() == 0
