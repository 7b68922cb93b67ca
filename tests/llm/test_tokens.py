"""Encoding: the tree equals the whole at any seam, also inside runs without a border; decoding gives the text back."""

import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm.tokens import VOCABULARY, Codec, encoded

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
RANKS = open(VOCABULARY, "rb").read() if os.path.exists(VOCABULARY) else b""
WHOLE = Codec(RANKS, 1 << 40) if RANKS else None
TREE = Codec(RANKS, 3) if RANKS else None
PIECES = ["'re", "'s", "'", " ", "  ", "\n", "\r\n", "\t", "a", "aa", "é", " ", " ", "1", "23", "!!", "…", "😡", "👨‍👩", "电", "<|endoftext|>", " luz", "\x1c", "\x85", "х", "ab" * 40, "=" * 70, "7" * 50, " " * 60, "电力" * 30, "😡" * 30, "\n" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_tree_equals_whole(text):
    ids = WHOLE.encode(text)
    assert TREE.encode(text) == ids and TREE.decode(ids) == text


def test_long_texts():
    rnd = random.Random(3)
    runs = ["".join(rnd.choice(letters) for _ in range(8_000)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "0123456789", "电力свет", "=-~", "=😡…", " \n", "a'", "áñz", "'s")]
    for text in ("x" * 50_000, " " * 50_000, "".join(rnd.choice(PIECES) for _ in range(5_000)), *runs):
        for leaf in (50, 1000):
            assert Codec(RANKS, leaf).encode(text) == WHOLE.encode(text)
        assert TREE.decode(WHOLE.encode(text[:3000])) == text[:3000]


def test_a_text_without_blanks_costs_bounded_windows():
    rnd = random.Random(4)
    tree, seen = Codec(RANKS), []
    whole = tree.bpe.encode_ordinary

    class Counting:
        _encode_single_piece = staticmethod(tree.bpe._encode_single_piece)

        @staticmethod
        def encode_ordinary(part):
            seen.append(len(part))
            return whole(part)

    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 17))
    tree.bpe = Counting
    t = time.process_time()
    assert tree.encode(text) == whole(text) and time.process_time() - t < 10
    assert sum(seen) < 2 * len(text) and tree.joins == (1 << 17) // 256 - 1


def test_equals_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["¿Qué ocurrió? <|endoftext|>", " \n  x", "it's 12,5 %\r\n\r\n👉 AL56", "电力 свет", "​ ﻿x́x́"]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [WHOLE.encode(x) for x in texts]


def test_rows(spark):
    data = [(1, None, 7), (2, "", 7), (3, " ", 7), (4, "hola", 7), (4, "hola", 7), (None, "x", 7), (5, "luz " * 30_000, 7)]
    got = encoded(spark.createDataFrame(data, "doc_id long, text string, ids int"))
    by = sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr)
    assert got.columns == ["doc_id", "ids"] and by == sorted(((d, WHOLE.encode(t)) for d, t, _ in data), key=repr)
    assert encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CORPUS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(CORPUS), reason="no test tables here")
def test_every_text_of_the_corpus_longer_than_a_leaf_is_joined():
    import pyarrow.parquet as pq

    tree = Codec(RANKS)
    texts = [t for t in pq.read_table(CORPUS, columns=["text"])["text"].to_pylist() if t]
    joined = 0
    for t in texts:
        before = tree.joins
        assert tree.encode(t) == WHOLE.encode(t)
        assert (tree.joins > before) == (len(t) > tree.leaf)
        joined += tree.joins > before
    assert joined > len(texts) / 2
