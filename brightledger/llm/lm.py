"""Language-model scores by a weighted backoff automaton.

Counts of n-grams over the training documents become an automaton. Its states are histories of two words, of one word, and
the empty one. A state has an arc for each word seen after it, which leads to the longest history that is a state, and a
failure arc, taken for every other word, to the state of the next shorter history; at the empty history every word has its
smoothed unigram. Weights are log10 probabilities of

    p(w | h) = share(h) * count(h, w) / count(h) + (1 - share(h)) * p(w | shorter h)

so an arc weighs log10 p(w | h), and a failure arc log10 (1 - share(h)). A share depends on the length and the count of the
history and is learned from all training tokens by deleted interpolation: what part of the history's say predicts a token best
that is left out of the counts. Histories of two words seen once predict nothing then, so they are no states. One pass from
left to right carries the state from word to word and adds up the weights; long texts are cut, and as a state knows two words
at most, a part that begins two words early meets the state that the whole text would have.

The automaton grows with the corpus and is never in one place. Each chunk of texts asks for the counts of its own n-grams and
says what it adds to them; counts are added up where the n-gram's hash belongs, and go back. A frequent word or pair is one
number a chunk. Words and pairs are asked for first; three words only where the first two were seen twice. From the answers
the chunk builds the part of the automaton that its texts can reach.

N-grams are told apart by 63 bits of hash. Null texts are empty and score their end only; a null doc_id counts as an empty
text (held out); repeated rows are learned from as often as they occur. Without training documents every token is unknown.
An empty table gives an empty result. A very long text is a chunk of its own, with some 150 bytes of memory a byte of text.
Columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm import wordhash
from brightledger.llm.chunks import by_chunk, chunks, each_chunk
from brightledger.llm.common import materialize
from brightledger.llm.wordhash import ODD, mixed

ADDED = 0.1
BEGIN, STOP = (np.uint64(x) for x in mixed(np.array([1, 2], dtype=np.uint64)))
ONE = np.uint64(1)
#: Cells of the histogram of how much better a history predicts: halves of a power of two around 1, and one for never.
NEVER, CELLS = 0, 162
#: Bytes of text in a chunk: more of them repeat more n-grams, which are asked for once.
CHUNK = 1 << 21
#: Values that a task adds up, and tokens that are read in a row before a text is cut.
VALUES, STRETCH = 8_000_000, 64


def training(doc_ids: list[int | None]) -> np.ndarray:
    """Which documents are learned from."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 10 != 0 for x in doc_ids], dtype=bool)


class Grams:
    """The tokens of a chunk's texts. Words, pairs and triples are numbered within the chunk.

    of, word, before, pair: of each token its text, its word, the word before it (or the beginning), and both; first: whether
    it is its text's first; begin: the number of the beginning among the words.
    """

    def __init__(self, texts: pa.Array):
        (w,) = wordhash.words(texts, 1 << 62)
        n = len(texts)
        count = np.diff(w.bounds())
        begin = np.cumsum(count + 2) - count - 2
        stream = np.empty(int((count + 2).sum()), dtype=np.uint64)
        stream[np.arange(len(w.hashes)) + 2 * w.of + 1] = w.hashes
        stream[begin], stream[begin + count + 1] = BEGIN, STOP
        self.words, number = np.unique(stream, return_inverse=True)
        at = np.ones(len(stream), dtype=bool)
        at[begin] = False
        at = np.flatnonzero(at)
        self.word, self.before, self.begin = number[at], number[at - 1], int(number[begin[0]])
        self.pairs, self.pair = np.unique(self.before * len(self.words) + self.word, return_inverse=True)
        self.of, self.n = np.repeat(np.arange(n), count + 1), n
        self.first = np.zeros(len(at), dtype=bool)
        self.first[np.cumsum(count + 1) - count - 1] = True

    def counts(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and pair occurs in the texts that are learned from; for the beginning, how many texts these are."""
        some = learned[self.of]
        words = np.bincount(self.word[some], minlength=len(self.words))
        words[self.begin] = int(learned.sum())
        return words, np.bincount(self.pair[some], minlength=len(self.pairs))

    def keys(self) -> np.ndarray:
        """Hashes of the words, then of the pairs; the last bit tells them apart."""
        h, w = np.divmod(self.pairs, len(self.words))
        return np.concatenate([self.words & ~ONE, self._pair(h, w) | ONE])

    def _pair(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return mixed(self.words[h] * np.uint64(ODD) + self.words[w])


class Triples:
    """The three-word n-grams of a chunk that begin with a pair seen twice or more.

    at: the tokens that end one; triple: its number for each; history, pair: of each triple its first two and its last two words.
    """

    def __init__(self, g: Grams, pair_count: np.ndarray):
        at = np.flatnonzero(~g.first)
        self.at = at[pair_count[g.pair[at - 1]] > 1]
        found, place, self.triple = np.unique(g.pair[self.at - 1] * len(g.words) + g.word[self.at], return_index=True, return_inverse=True)
        self.history, self.word = np.divmod(found, len(g.words))
        self.pair = g.pair[self.at[place]]

    def counts(self, g: Grams, learned: np.ndarray) -> np.ndarray:
        return np.bincount(self.triple[learned[g.of[self.at]]], minlength=len(self.pair))

    def keys(self, g: Grams) -> np.ndarray:
        h, w = np.divmod(g.pairs[self.history], len(g.words))
        return mixed(g._pair(h, w) * np.uint64(ODD) + g.words[self.word])


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as bytes, all first bytes before all second ones: high bytes are much alike."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


ASKED = "chunk long, bucket int, size int, data binary"


def asks(chunk: int, keys: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A chunk's keys in order with its own counts, a row for each bucket of keys."""
    order = np.argsort(keys)
    keys, count, codec = keys[order], count[order], pa.Codec("zstd")
    owner = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.append(np.flatnonzero(np.diff(owner, prepend=np.uint64(buckets))), len(keys))
    data, sizes = [], np.diff(cut)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        data.append(codec.compress(planes(np.diff(keys[lo:hi], prepend=np.uint64(0)), 8) + planes(count[lo:hi], 4), asbytes=True))
    return pa.RecordBatch.from_pydict({"chunk": np.full(len(sizes), chunk), "bucket": owner[cut[:-1]].astype(np.int32), "size": sizes.astype(np.int32), "data": pa.array(data, pa.binary())})


def told(answers: list[dict] | None, keys: np.ndarray) -> np.ndarray:
    """The counts of a chunk's keys from the answers to what it asked."""
    codec, out = pa.Codec("zstd"), np.zeros(len(keys), dtype=np.int64)
    found = sorted(answers or [], key=lambda x: x["bucket"])
    if found:
        out[np.argsort(keys)] = np.concatenate([numbers(codec.decompress(x["data"], x["size"] * 6, asbytes=True), 6) for x in found])
    return out


def summed(asked: DataFrame, tasks: int) -> DataFrame:
    """Of rows of ``ASKED``: rows of the same kind with each key's count over all rows. Rows without a chunk are passed on, and
    one a task is added that holds the number of training tokens and of distinct ones (as far as keys of words go) as data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows, values, counts = pa.Codec("zstd"), [], [], []
        for b in batches:
            for chunk, bucket, size, data in zip(*[b.column(c).to_pylist() for c in ("chunk", "bucket", "size", "data")], strict=True):
                if chunk is None:
                    yield pa.RecordBatch.from_pydict({"chunk": [None], "bucket": [bucket], "size": [size], "data": [data]}, schema=schema)
                    continue
                raw = codec.decompress(data, size * 12, asbytes=True)
                rows.append((chunk, bucket, size))
                values.append(np.cumsum(numbers(raw[: 8 * size], 8), dtype=np.uint64))
                counts.append(numbers(raw[8 * size :], 4).astype(np.uint32))
        if not rows:
            return
        value, count = np.concatenate(values), np.concatenate(counts)
        del values, counts
        order = np.argsort(value)
        value = value[order]
        first = np.concatenate([[True], value[1:] != value[:-1]])
        total = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(first))
        types = (value[first] & ONE == 0) & (total > 0) & (value[first] != BEGIN & ~ONE)
        spread = np.empty(len(value), dtype=np.int64)
        spread[order] = total[np.cumsum(first) - 1]
        at = 0
        for lo in range(0, len(rows), 2000):
            part, blobs = rows[lo : lo + 2000], []
            for _, _, n in part:
                blobs.append(codec.compress(planes(spread[at : at + n], 6), asbytes=True))
                at += n
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in part], schema.field(k).type) for k in range(3)], pa.array(blobs, pa.binary())], schema=schema)
        whole = np.array([total[types].sum(), types.sum()], dtype=np.int64).tobytes()
        yield pa.RecordBatch.from_pydict({"chunk": [None], "bucket": [TOTALS], "size": [2], "data": [whole]}, schema=schema)

    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("data", pa.binary())])
    return asked.repartition(tasks, "bucket").mapInArrow(run, ASKED)


#: In place of a bucket, of rows without a chunk: totals as data; and, less a cell's number, how much is in that cell as size.
TOTALS, HISTOGRAM = -1, -2


def cell_rows(seen: np.ndarray) -> pa.RecordBatch:
    """The cells that hold something, as rows of ``ASKED``."""
    at = np.flatnonzero(seen)
    columns = [pa.nulls(len(at), pa.int64()), pa.array((HISTOGRAM - at).astype(np.int32)), pa.array(seen[at].astype(np.int32)), pa.nulls(len(at), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "size", "data"])


def histogram(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' cells: 64 * CELLS numbers at most."""
    out = np.zeros(64 * CELLS, dtype=np.int64)
    for r in rows.filter(F.col("chunk").isNull() & (F.col("bucket") <= HISTOGRAM)).groupBy("bucket").agg(F.sum("size").alias("n")).collect():
        out[HISTOGRAM - r["bucket"]] = r["n"]
    return out


def sizes(count: np.ndarray) -> np.ndarray:
    """Classes of histories: powers of two of their counts; 0 for those never seen."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def cells(history: np.ndarray, gram: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Of training tokens, by class of history: how often it predicts the token by which factor better than the shorter history
    does, the token itself left out of all counts."""
    better = np.divide(gram - 1, history - 1, out=np.zeros(len(history)), where=history > 1) / shorter
    cell = np.where(better > 0, np.clip(np.round(2 * np.log2(np.maximum(better, 1e-30))), -80, 80).astype(np.int64) + 81, NEVER)
    return np.bincount(sizes(history) * CELLS + cell, minlength=64 * CELLS)


def learn_shares(found: np.ndarray) -> np.ndarray:
    """The share of each class of histories under which the left-out tokens are most probable."""
    factor = np.exp2((np.arange(CELLS) - 81) / 2)
    factor[NEVER] = 0
    out = np.zeros(64)
    for k, n in enumerate(found.reshape(64, CELLS)):
        slope = lambda x, n=n: float(np.sum(n * (factor - 1) / (1 + x * (factor - 1))))
        low, high = 0.0, 0.999
        if k == 0 or not n.sum() or slope(low) <= 0:
            continue
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        out[k] = low
    return out


@dataclass
class Model:
    """What all chunks share: training tokens, distinct ones, and the shares of one- and two-word histories."""

    tokens: int
    types: int
    one: np.ndarray
    two: np.ndarray

    def plain(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        """Probabilities without a history, with so many tokens left out."""
        return (count - less + ADDED) / (self.tokens - less + ADDED * (self.types + 1))

    def evidence_one(self, g: Grams, words: np.ndarray, pairs: np.ndarray, learned: np.ndarray) -> np.ndarray:
        some = learned[g.of]
        return cells(words[g.before[some]], pairs[g.pair[some]], self.plain(words[g.word[some]], 1))

    def evidence_two(self, g: Grams, t: Triples, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, learned: np.ndarray) -> np.ndarray:
        some = learned[g.of[t.at]]
        at = t.at[some]
        h, share = words[g.before[at]], self.one[sizes(words[g.before[at]])]
        said = np.divide(pairs[g.pair[at]] - 1, h - 1, out=np.zeros(len(at)), where=h > 1)
        shorter = np.where(h > 1, share, 0) * said + (1 - np.where(h > 1, share, 0)) * self.plain(words[g.word[at]], 1)
        return cells(pairs[g.pair[at - 1]], triples[t.triple[some]], shorter)


class Automaton:
    """The part of the automaton that a chunk's texts reach. State 0 is the empty history, then come the words, then the pairs.

    keys: arcs as state and word in order, with ``weight`` and ``target``; fall, fail: weight and target of failure arcs;
    plain, own: of each word the weight of the empty history's arc and where it leads.
    """

    def __init__(self, m: Model, g: Grams, t: Triples, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray):
        n = len(g.words)
        self.n, plain = n, m.plain(words)
        h, w = np.divmod(g.pairs, n)
        share = m.one[sizes(words)]
        second = share[h] * np.divide(pairs, words[h], out=np.zeros(len(pairs)), where=words[h] > 0) + (1 - share[h]) * plain[w]
        deep = m.two[sizes(pairs)]
        third = deep[t.history] * triples / np.maximum(pairs[t.history], 1) + (1 - deep[t.history]) * second[t.pair]
        self.plain, self.own = np.log10(plain), np.where(words > 0, np.arange(n) + 1, 0)
        state = np.where(pairs > 1, np.arange(len(pairs)) + n + 1, self.own[w])
        self.fall = np.concatenate([[0.0], np.log10(1 - share), np.log10(1 - deep)])
        self.fail = np.concatenate([np.zeros(n + 1, dtype=np.int64), self.own[w]])
        seen, known = pairs > 0, triples > 0
        keys = np.concatenate([(h[seen] + 1) * n + w[seen], (t.history[known] + n + 1) * n + t.word[known], [np.iinfo(np.int64).max]])
        weight = np.concatenate([np.log10(second[seen]), np.log10(third[known]), [0.0]])
        target = np.concatenate([state[seen], state[t.pair[known]], [0]])
        order = np.argsort(keys)
        self.keys, self.weight, self.target = keys[order], weight[order], target[order]
        self.start = int(self.own[g.begin])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word in each of many states, and what that weighs."""
        to, weight, todo = np.zeros(len(state), dtype=np.int64), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            here, w = state[todo], word[todo]
            root = here == 0
            done = todo[root]
            to[done], weight[done] = self.own[w[root]], weight[done] + self.plain[w[root]]
            todo, here, w = todo[~root], here[~root], w[~root]
            key = here * self.n + w
            at = np.searchsorted(self.keys, key)
            arc = self.keys[at] == key
            hit = todo[arc]
            to[hit], weight[hit] = self.target[at[arc]], weight[hit] + self.weight[at[arc]]
            todo, here = todo[~arc], here[~arc]
            weight[todo] += self.fall[here]
            state = state.copy()
            state[todo] = self.fail[here]
        return to, weight

    def traverse(self, g: Grams) -> np.ndarray:
        """The weight that each token adds: all stretches of the texts are read side by side, each from left to right."""
        out = np.zeros(len(g.word))
        begin = np.flatnonzero(g.first)
        count = np.diff(np.append(begin, len(g.word)))
        parts = -(-count // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(begin, parts) + nth * STRETCH
        length = np.minimum(np.repeat(begin + count, parts) - start, STRETCH)
        order = np.argsort(-length, kind="stable")
        start, length, nth = start[order], length[order], nth[order]
        state = np.where(nth == 0, self.start, 0)
        inner = np.flatnonzero(nth > 0)
        for back in (2, 1):
            state[inner], _ = self.step(state[inner], g.word[start[inner] - back])
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))  # stretches longer than i come first
            state, out[start[:n] + i] = self.step(state[:n], g.word[start[:n] + i])
        return out


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    stored = chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], CHUNK)
    # a task adds up about VALUES values; a chunk has up to one word and one pair for each 4 bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() * CHUNK // 2 // VALUES)
    buckets = 4 * tasks

    def read(batches: Iterator[pa.RecordBatch], rounds: int):
        """Of each chunk its number, ids, which are learned from, its n-grams and, as far as asked for, their counts."""
        for b, i, chunk, texts in each_chunk(batches):
            ids = b.column("c0")[i].as_py()
            g, learned, found, t = Grams(texts), training(ids), [], None
            if rounds:
                count = told(b.column("first")[i].as_py(), g.keys())
                found = [count[: len(g.words)], count[len(g.words) :]]
                t = Triples(g, found[1])
            if rounds > 1:
                found.append(told(b.column("second")[i].as_py(), t.keys(g)))
            yield chunk, ids, learned, g, t, found

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, learned, g, _, _ in read(batches, 0):
            yield asks(chunk, g.keys(), np.concatenate(g.counts(learned)), buckets)

    def grouped(answers: DataFrame, name: str) -> DataFrame:
        rows = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "size", "data")).alias(name))
        return by_chunk(rows, name).hint("shuffle_hash")

    answers = materialize(summed(stored.mapInArrow(ask_first, ASKED), tasks), "counts")
    totals = answers.filter(F.col("chunk").isNull() & (F.col("bucket") == TOTALS)).collect()  # two numbers a task
    tokens, types = sum((np.frombuffer(r["data"], dtype=np.int64) for r in totals), np.zeros(2, dtype=np.int64)).tolist()
    none = np.zeros(64)
    bare = Model(tokens, types, none, none)
    both = stored.join(grouped(answers, "first"), "chunk", "left")

    def ask_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(64 * CELLS, dtype=np.int64)
        for chunk, _, learned, g, t, found in read(batches, 1):
            seen += bare.evidence_one(g, *found, learned)
            yield asks(chunk, t.keys(g), t.counts(g, learned), buckets)
        yield cell_rows(seen)

    answers = materialize(summed(both.mapInArrow(ask_second, ASKED), tasks), "counts")
    half = Model(tokens, types, learn_shares(histogram(answers)), none)
    whole = both.join(grouped(answers, "second"), "chunk", "left")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(64 * CELLS, dtype=np.int64)
        for _, _, learned, g, t, found in read(batches, 2):
            seen += half.evidence_two(g, t, *found, learned)
        yield cell_rows(seen)

    model = Model(tokens, types, half.one, learn_shares(histogram(whole.mapInArrow(look, ASKED))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, learned, g, t, found in read(batches, 2):
            a = Automaton(model, g, t, *found)
            add = lambda x, g=g: np.bincount(g.of, x, minlength=g.n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(~learned), pa.array(np.bincount(g.of, minlength=g.n)),
                    pa.array(add(found[0][g.word] > 0).astype(np.int64)), pa.array(np.full(g.n, tokens)),
                    pa.array(add(a.plain[g.word])), pa.array(add(a.traverse(g))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

