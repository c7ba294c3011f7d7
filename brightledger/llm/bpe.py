"""BPE encoding and decoding by a tokenization automaton.

The automaton's arc labels are tokens, and its state is the token read last. It starts as one state with an arc for each base
symbol; then the merges build one gadget each, in order. The gadget of ``a b -> c``

* takes the arc ``b`` from state ``a``,
* gives each state that then has an arc ``a`` an arc ``c``, and
* gives state ``c`` the arcs that state ``b`` had before.

What is accepted in the end are exactly the token sequences that merging yields. The full table has a square of the
vocabulary's size; since a gadget only copies rows and columns, an arc's presence follows from the gadgets that made its two
ends, and ``Automaton.arcs`` looks it up along them, for many arcs at once.

A second table, over symbols, gives for each position the tokens that end there, the longest first. Prefixes have one
accepted sequence each, so one pass from left to right finds the token by which each prefix ends, and going back from the
word's end reads off the arc labels. Words are split as the tokenizer's file says; white space is dropped. Where the library
knows another Unicode version than the packages used here, its character classes and normal form count (``unlike``).

Null texts count as empty; empty texts have no tokens; an empty table gives an empty result. Very long texts are one row, with
some 100 bytes of memory a word of the 250 texts encoded at once. Rows are encoded one by one, so repeated rows give equal rows.
Other columns than the two named play no part.
"""

from __future__ import annotations

import copy
import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from brightledger.llm.common import stage as pipeline_stage

#: White space as the tokenizer's regular expressions see it.
WHITE = "\t-\r \x85\xa0  -     　"
#: Characters at which Python's split() would cut although they are not white space here.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
SPACES = re.compile(f"[{WHITE}]+")
#: Fixed value: the file's word pattern, with white space spelled out.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
#: The same with other letters and numbers put in.
PIECE_OF = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+"
#: A mark of each of the usual combining classes: marks of other classes change places with some of them.
MARKS = "\u0334\u3099\u094d\u05b0\u0321\u0323\u0300\u0307\u0345"
#: Longer words are encoded one by one.
LONG = 48
#: So many words are encoded at once, and so many texts.
WORDS, TEXTS = 16_000, 250
#: So many distinct words of a task's texts are remembered.
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def ranges(points: set[int]) -> str:
    """Code points as the inside of a character class."""
    at = np.array(sorted(points))
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ((x[0], x[-1]) for x in np.split(at, cut)))


@functools.cache
def unlike() -> dict[str, str]:
    """Classes ``odd``, the characters that the tokenizers library and the packages used here see differently (they know other
    Unicode versions), and ``letters`` and ``numbers`` as the library's expressions see them. Whatever versions are installed,
    texts without odd characters take the usual path, others the library's classes and normal form."""
    every = [c for c in (*range(0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c < 0xE000]  # other planes are not assigned
    whole = "".join(map(chr, every))
    seen, odd = {}, set()
    for kind in "LNM":
        runs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(whole)
        seen[kind] = {ord(c) for run, _ in runs for c in run}
        own = {ord(c) for c in regex.findall(rf"\p{{{kind}}}", whole)}
        odd |= seen[kind] ^ own
    solid = [chr(c) for c in every if not chr(c).isspace()]
    nfc, lower = lambda x: unicodedata.normalize("NFC", x), lambda x: x.replace("Σ", "σ").lower()
    asked = [(normalizers.Lowercase(), lower, solid), *[(normalizers.NFC(), nfc, [f"a{c}{m}a{m}{c}" for c in solid]) for m in MARKS]]
    for theirs, own, texts in asked:
        lines = "\n".join(texts)
        pairs = zip(theirs.normalize_str(lines).split("\n"), own(lines).split("\n"), strict=True)
        odd |= {ord(c) for c, (a, b) in zip(solid, pairs, strict=True) if a != b}
    return {"odd": ranges(odd | {0xFFFF}), "letters": ranges(seen["L"]), "numbers": ranges(seen["N"])}


def load(path: str) -> dict:
    """What the automaton needs of a tokenizer's JSON file; raises ValueError for files of another kind."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, names = whole["model"], [x["type"] for x in whole["normalizer"]["normalizers"]]
    kind = (model["type"], model["end_of_word_suffix"], model["unk_token"], model["ignore_merges"], whole["decoder"], names)
    if kind != ("BPE", "</w>", None, False, None, ["NFC", "Replace", "Lowercase"]):
        raise ValueError(f"{path} is not a BPE with word ends: {kind}")
    return {"vocab": model["vocab"], "merges": [tuple(x) for x in model["merges"]], "special": {x["content"]: x["id"] for x in whole["added_tokens"]}, "unlike": unlike()}


class Automaton:
    """Compiled merges. Labels: bytes inside a word (0-255), bytes that end one (256-511), then the merges in order."""

    def __init__(self, spec: dict):
        vocab, merges = spec["vocab"], spec["merges"]
        symbols = byte_symbols()
        base = [*symbols, *(s + "</w>" for s in symbols)]
        label = {s: i for i, s in enumerate(base)}
        n = len(base) + len(merges)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.length = np.ones(n, dtype=np.int64)
        content: list[tuple[int, ...]] = [(i,) for i in range(len(base))]
        for i, (a, b) in enumerate(merges, len(base)):
            if (text := a + b) in label:
                raise ValueError(f"two merges make {text!r}")
            label[text], self.left[i], self.right[i] = i, label[a], label[b]
            content.append(content[label[a]] + content[label[b]])
            self.length[i] = len(content[i])
        self.base, self.n = len(base), n
        #: When a label came up: 0 for symbols, then 1, 2, ... for merges.
        self.born = np.maximum(np.arange(n) - len(base) + 1, 0)
        pairs = self.left[len(base) :] * n + self.right[len(base) :]
        self._hash(pairs)
        names = {i: s for s, i in label.items()}
        self.ids = np.array([vocab[names[i]] for i in range(n)], dtype=np.int32)
        self.names = [names[i] for i in range(n)]
        self._symbols(content)

    def _hash(self, pairs: np.ndarray) -> None:
        """A table by which merges are found by their two halves: keys and ranks, each near the slot of its key."""
        size = 1 << 18
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        left, ranks, slot = pairs, np.arange(1, len(pairs) + 1), self._slot(pairs)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]  # of several for one slot the last stays
            won = self.keys[slot] == left
            self.ranks[slot[won]] = ranks[won]
            left, ranks, slot = left[~won], ranks[~won], (slot[~won] + 1) & (size - 1)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """When each pair merges, from 1; 0 if it never does."""
        out, todo, slot = np.zeros(len(pairs), dtype=np.int64), np.arange(len(pairs)), self._slot(pairs)
        while len(todo):
            have, want = self.keys[slot], pairs[todo]
            hit = have == want
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (have >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _symbols(self, content: list[tuple[int, ...]]) -> None:
        """step and end: from node and byte to the node of the longest suffix that begins a token, inside and at the end of a
        word; found: the longest token that ends there; shorter: the next shorter token that ends where a token does."""
        ways: list[dict[int, int]] = [{}]
        token = [-1]
        for t, seq in enumerate(content):
            at = 0
            for s in seq:
                if s not in ways[at]:
                    ways[at][s] = len(ways)
                    ways.append({})
                    token.append(-1)
                at = ways[at][s]
            token[at] = t
        count = len(ways)
        inner = [i for i, w in enumerate(ways) if w]
        row = np.zeros(count, dtype=np.int32)  # what goes on has a row of the dense tables, other nodes use their suffix's
        row[inner] = np.arange(len(inner))
        step = np.zeros((len(inner), 256), dtype=np.int32)
        end = np.zeros((len(inner), 256), dtype=np.int32)
        fail, found, level, self.levels = np.zeros(count, dtype=np.int32), np.full(count, -1), [0], []
        while level:
            after, taken, ways_in = [], [], []
            for node in level:
                f = fail[node]
                found[node] = token[node] if token[node] >= 0 else found[f]
                if not ways[node]:
                    row[node] = row[f]
                    continue
                if node:
                    step[row[node]], end[row[node]] = step[row[f]], end[row[f]]
                    taken.append((row[node], row[f]))
                for s, to in ways[node].items():
                    table = step if s < 256 else end
                    fail[to] = table[row[f], s & 255] if node else 0
                    table[row[node], s & 255] = to
                    ways_in.append((row[node], s, to))
                    after.append(to)
            self.levels.append((np.array(taken, dtype=np.int32).reshape(-1, 2), np.array(ways_in, dtype=np.int32).reshape(-1, 3)))
            level = after
        self.rows, self.row, self.found = len(inner), row, found
        self.shorter = np.full(self.n, -1)
        for node in range(count):
            if token[node] >= 0:
                self.shorter[token[node]] = found[fail[node]]
        self.step, self.end = step, end

    def __getstate__(self) -> dict:
        """Without the dense tables, which ``ready`` makes where they are used."""
        return {k: v for k, v in self.__dict__.items() if k not in ("step", "end")}

    def ready(self) -> Automaton:
        """A copy with the dense tables: level by level, a node begins with its suffix's row and gets its own ways."""
        out = copy.copy(self)
        out.step = np.zeros((self.rows, 256), dtype=np.int32)
        out.end = np.zeros((self.rows, 256), dtype=np.int32)
        for taken, ways in self.levels:
            for table in (out.step, out.end):
                table[taken[:, 0]] = table[taken[:, 1]]
            inside = ways[:, 1] < 256
            for table, some in ((out.step, ways[inside]), (out.end, ways[~inside])):
                table[some[:, 0], some[:, 1] & 255] = some[:, 2]
        return out

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether state x has an arc y, for arrays of both."""
        ok = np.ones(len(x), dtype=bool)
        at, when = np.arange(len(x)), np.full(len(x), 1 << 40)
        x, y = x.astype(np.int64), y.astype(np.int64)
        while len(at):
            merged = self.rank(x * self.n + y)
            gone = (merged > 0) & (merged <= when)
            ok[at[gone]] = False
            bx, by = self.born[x], self.born[y]
            more = ~gone & ((bx > 0) | (by > 0))
            at, x, y, bx, by = at[more], x[more], y[more], bx[more], by[more]
            # the younger end's gadget copied the arc: by its first half if the label is younger, else from its second half's state
            x, y, when = np.where(bx >= by, self.right[x], x), np.where(by >= bx, self.left[y], y), np.where(by > bx, by, bx - 1)
        return ok

    def arc(self, x: int, y: int) -> bool:
        """The same for one arc."""
        return bool(self.arcs(np.array([x]), np.array([y]))[0])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of all words, one after another, and how many each has; no word is empty."""
        sizes = np.array([len(w) for w in words])
        short = np.flatnonzero(sizes <= LONG)
        labels, owner, place = [], [], []
        for i in np.flatnonzero(sizes > LONG):
            labels.append(self._long(words[i]))
            owner.append(np.full(len(labels[-1]), i))
            place.append(np.arange(len(labels[-1])))
        order = short[np.argsort(-sizes[short], kind="stable")]
        if len(order):
            self._short(words, order, sizes[order], labels, owner, place)
        labels, owner = np.concatenate(labels), np.concatenate(owner)
        return labels[np.lexsort((np.concatenate(place), owner))], np.bincount(owner, minlength=len(words))

    def _short(self, words: list[bytes], order: np.ndarray, sizes: np.ndarray, labels: list, owner: list, place: list) -> None:
        """All words of ``order``, the longest first, in step."""
        width = int(sizes[0])
        text = np.zeros((len(order), width), dtype=np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join([words[i] for i in order]), dtype=np.uint8)
        last = np.full((len(order), width + 1), -1, dtype=np.int32)
        node = np.zeros(len(order), dtype=np.int64)
        for i in range(width):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # words longer than i come first
            ends = sizes[:n] == i + 1
            at = self.row[node[:n]]
            node[:n] = np.where(ends, self.end[at, text[:n, i]], self.step[at, text[:n, i]])
            found, todo = self.found[node[:n]].copy(), np.arange(n)
            while len(todo):
                t = found[todo]
                before = last[todo, i + 1 - self.length[t]]
                ask = np.flatnonzero(before >= 0)
                bad = ask[~self.arcs(before[ask], t[ask])]
                todo = todo[bad]
                found[todo] = self.shorter[found[todo]]
            last[:n, i + 1] = found
        at, rows = sizes.copy(), np.arange(len(order))
        while len(rows):  # from each word's end to its beginning
            t = last[rows, at[rows]]
            labels.append(t)
            owner.append(order[rows])
            at[rows] -= self.length[t]
            place.append(at[rows])
            rows = rows[at[rows] > 0]

    def _long(self, word: bytes) -> np.ndarray:
        known: dict[tuple[int, int], bool] = {}
        last, node = [-1], 0
        for i, b in enumerate(word):
            node = int((self.end if i + 1 == len(word) else self.step)[self.row[node], b])
            t = int(self.found[node])
            while (x := last[i + 1 - self.length[t]]) >= 0:
                if (ok := known.get((x, t))) is None:
                    ok = known[x, t] = self.arc(x, t)
                if ok:
                    break
                t = int(self.shorter[t])
            last.append(t)
        found, at = [], len(word)
        while at:
            found.append(last[at])
            at -= int(self.length[last[at]])
        return np.array(found[::-1])


class Encoder:
    """Texts to ids and back; remembers what runs between white space became."""

    def __init__(self, automaton: Automaton, special: dict[str, int], unlike: dict[str, str]):
        self.automaton, self.special = automaton.ready(), special
        self.odd = re.compile(f"[{unlike['odd']}]")
        self.odd_piece = re.compile(PIECE_OF.format(white=WHITE, **unlike))
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        #: What runs became: ids as bytes, and labels.
        self.ids: dict[str, bytes] = {}
        self.labels: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        """Normalised runs between white space, and special tokens' contents with a leading space to tell them apart."""
        if "<|" not in text:
            return self._runs(text)
        return [r for x in self.split.split(text) for r in ([" " + x] if x in self.special else self._runs(x))]

    def _runs(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif self.odd.search(text):
            text = self.normal.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        odd = any(c in text for c in NOT_WHITE)
        return [x for x in SPACES.split(text) if x] if odd else text.split()

    def _words(self, run: str) -> list[str]:
        if not run.isascii() and self.odd.search(run):
            return self.odd_piece.findall(run)
        if run.isalpha():
            return [run]
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return [run] if run[0] == " " else PIECE.findall(run)

    def learn(self, runs: set[str]) -> None:
        """Encodes the words of new runs; a word is a run of itself, and longer runs are put together."""
        whole, mixed = [], []
        for r in runs:
            found = self._words(r)
            if len(found) == 1:
                whole.append(r)
            else:
                mixed.append((r, found))
        for s, i in self.special.items():
            self.ids[" " + s], self.labels[" " + s] = np.int32(i).tobytes(), s
        words = {w for _, found in mixed for w in found}.difference(self.ids)
        words.update(w for w in whole if w[0] != " ")
        words, a, all_ids, all_labels = list(words), self.automaton, self.ids, self.labels
        for lo in range(0, len(words), WORDS):
            part = words[lo : lo + WORDS]
            labels, count = a.encode_words([w.encode() for w in part])
            ids, names = a.ids[labels].tobytes(), [a.names[i] for i in labels.tolist()]
            at = 0
            for w, n in zip(part, count.tolist(), strict=True):
                to = at + n
                all_ids[w] = ids[4 * at : 4 * to]
                all_labels[w] = names[at] if n == 1 else " ".join(names[at:to])
                at = to
        for r, found in mixed:
            all_ids[r] = b"".join([all_ids[w] for w in found])
            all_labels[r] = " ".join([all_labels[w] for w in found])

    def forget(self) -> None:
        self.ids.clear()
        self.labels.clear()

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Of each text its ids as bytes of 32-bit numbers, and the decoded text."""
        runs = [self.pieces(t or "") for t in texts]
        if len(self.ids) > REMEMBERED:
            self.forget()
        if new := set().union(*runs).difference(self.ids):
            self.learn(new)
        ids, labels = self.ids.__getitem__, self.labels.__getitem__
        return [b"".join(map(ids, r)) for r in runs], [" ".join(map(labels, r)) for r in runs]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) and ``decoded``, for each row. The vocabulary, of fixed size, is broadcast."""
    spec = load(path)
    held = docs.sparkSession.sparkContext.broadcast((Automaton(spec), spec["special"], spec["unlike"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*held.value)  # its tables go with the task
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, decoded = encoder.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                arrays = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def _digests() -> list:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.col("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def query(docs: DataFrame, path: str) -> DataFrame:
    """Digests of what ``encode`` returns for every text."""
    return encode(docs, path).select(*_digests())


def stage(path: str):
    """A pipeline stage: every document's ``doc_id, n_tokens, ids`` and digests of the ids and the decoded text."""

    @pipeline_stage
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        return encode(docs, path).select(*_digests(), "ids")

    return run
