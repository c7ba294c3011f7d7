"""What keeps operators within the driver's memory and the time of tasks."""

import os
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from brightledger.llm import graphs, suffix, toxicity


def plain_components(edges):
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        old, new = label[a], label[b]
        label = {x: new if v == old else v for x, v in label.items()}
    return {frozenset(x for x in label if label[x] == v) for v in set(label.values())}


def found_components(spark, edges):
    rows = graphs.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert len({bytes(r.node) for r in rows}) == len(rows)
    label = {bytes(r.node): bytes(r.label) for r in rows}
    return {frozenset(x for x in label if label[x] == v) for v in set(label.values())}


def test_few_edges_take_one_step(spark, monkeypatch):
    """A path, a star and a circle: edges, one step and the labels are written, however long the path is."""
    node = lambda *x: repr(x).encode()
    edges = [(node("p", i), node("p", i + 1)) for i in range(50)] + [(node("s", 0), node("s", i)) for i in range(1, 20)] + [(node("c", i), node("c", (i + 1) % 9)) for i in range(9)]
    written = []
    monkeypatch.setattr(graphs, "materialize", lambda df, name, f=graphs.materialize: written.append(name) or f(df, name))
    assert found_components(spark, edges) == plain_components(edges)
    assert written == ["edges", "step", "components"]


def test_rounds_before_the_rest(spark, monkeypatch):
    """More edges than one task takes are contracted in rounds until few are left."""
    random = np.random.default_rng(5)
    names = [random.bytes(8) for _ in range(120)]
    edges = [(names[a], names[b]) for a, b in random.integers(0, 120, (90, 2)) if a != b]
    for most in (40, 0):
        monkeypatch.setattr(graphs, "REST", most)
        assert found_components(spark, edges) == plain_components(edges)


def test_models_are_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the models and not the sample."""
    rows = [(i, ("vile rot " if i % 3 == 0 else "fair day ") + f"word{i % 7} more text") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")

    def elsewhere(*sample, driver=os.getpid(), f=toxicity.train):
        assert os.getpid() != driver
        return f(*sample)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    found = toxicity.query(docs, labels).collect()
    assert {r.doc_id for r in found if r.toxic} == {i for i in range(0, 120, 3)}


def test_runs_of_a_chunk_in_blocks():
    """A chunk's places are worked on in blocks: besides sums, powers and anchors no arrays of all places are made."""
    raw = np.random.default_rng(6).integers(97, 123, 1 << 20).astype(np.uint8)
    offsets = np.array([0, 5000, 5100, 1 << 19, 1 << 20])
    suffix.Runs(raw, offsets, 200)  # powers are kept
    tracemalloc.start()
    runs = suffix.Runs(raw, offsets, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(raw) and "others" not in vars(runs)
    windows = sum(max(0, n - 199) for n in np.diff(offsets))
    assert (runs.stop - runs.start + 1).sum() == windows
    b, strings = raw.tobytes(), {}
    for lo, hi in zip(runs.start[:300].tolist(), runs.stop[:300].tolist(), strict=True):
        strings[b[lo : hi + 200]] = None
    again = suffix.Runs(raw[: 1 << 19], offsets[:4], 200)
    assert np.array_equal(again.whole[:300], runs.whole[:300]) and np.array_equal(again.check[:300], runs.check[:300]) and len(set(runs.whole[:300].tolist())) == len(strings)
