"""Encoding against the library that defines it, on texts that hold all its odd cases."""

import pickle

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from brightledger.llm import bpe
from brightledger.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \n", "Hello <|endoftext|>World's don't  I'LL 12345", "ΑΣ Σ İstanbul \x1c\x1d x\x85y é é 日本語 😀👍🏽 ½ ² Ⅷ",
    "a" * 500 + "zq" * 300, "​﻿­ a b　c", "ﬁ ǅ ß ẞ", "''s 's'tt", "<|startoftext|><|endoftext|> <| x |>",
    "the the the theatre " * 300,
]


def encoder_of(path):
    spec = bpe.load(path)
    return bpe.Encoder(pickle.loads(pickle.dumps(bpe.Automaton(spec))), spec["special"], spec["unlike"])


def test_like_the_library():
    encoder, library = encoder_of(PATH), Tokenizer.from_file(PATH)
    ids, decoded = encoder.encode(TEXTS)
    for text, mine, back in zip(TEXTS, ids, decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine, dtype=np.int32).tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_every_code_point_like_the_library():
    """Between letters, alone, before a mark, and twice. Of planes without characters some; surrogates are no characters."""
    encoder, library = encoder_of(PATH), Tokenizer.from_file(PATH)
    points = (*range(0x40000), *range(0xE0000, 0xE1000), *range(0x40000, 0x110000, 997))
    every = [chr(c) for c in points if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 1 << 15):
        part = every[lo : lo + (1 << 15)]
        texts = [" ".join(f"a{c}b {c} {c}\u0307 {c}{c}" for c in part[k : k + 32]) for k in range(0, len(part), 32)]
        ids, decoded = encoder.encode(texts)
        for text, mine, back, want in zip(texts, ids, decoded, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(mine, dtype=np.int32).tolist() == want.ids, text
            assert back == library.decode(want.ids, skip_special_tokens=False)


def test_documents_like_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode(docs, PATH).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_long_words_take_the_same_path():
    a = bpe.Automaton(bpe.load(PATH))
    word = b"internationalization"
    assert a._long(word).tolist() == a.encode_words([word, b"a"])[0].tolist()[:-1]


def test_rows(spark):
    rows = [(1, "A cat", "x"), (1, "A cat", "y"), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.query(docs, PATH).collect(), key=str)
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.n_tokens)] == [0, 2, 2]
    assert bpe.query(docs.limit(0), PATH).count() == 0
