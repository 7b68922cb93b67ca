"""Encoding the whole corpus with a public byte-level tokenizer (problem 7).

A text is a monoid element: every text is cut in halves down to small leaves, halves are encoded recursively and neighbours
are joined by re-encoding a window around the seam that grows until the tokens outside it provably stay. Two proofs end
a window:

* A sure border: the tokenizer splits a text into pieces before any merge, and behind a letter or digit that is followed by
  a blank or a sign, or behind a sign that is followed by a blank, a piece ends whatever stands around.
* An agreeing pair: inside a piece, a row of tokens is the encoding of its bytes exactly if each pair of neighbours encodes
  to itself. So the old tokens stand where the last old and the first new one, both within one run of characters of one
  class, encode together to just these two. Texts without blanks thus cost a bounded window at each seam too.

Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("GRIDPULSE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges; it belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once at the bottom of the tree.
LEAF = 256
#: First width of the window on each side of a seam, in characters.
WINDOW = 24
BLANKS, SIGNS = " \n\t\r", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~¡¿"


def _kind(ch: str) -> str:
    """Class of a character in the pattern, for those of which every edition of the character tables says the same."""
    if ch in BLANKS:
        return "S"
    if ch in SIGNS:
        return "O"
    kind = unicodedata.category(ch)
    return kind[0] if kind[0] in "LN" else "O" if kind[0] in "MPS" and ch != "'" else ""


#: What ends a piece for sure: (character before, character after), looked up by the characters' codes.
_BEFORE = [1 if chr(c).isalnum() else 2 if chr(c) in SIGNS else 0 for c in range(0x250)]
_AFTER = [3 if chr(c) in BLANKS else 1 if chr(c) in SIGNS else 0 for c in range(0x250)]


def is_border(text: str, i: int) -> bool:
    """A piece ends before character i for sure; it depends on the two characters around alone."""
    a, b = ord(text[i - 1]), ord(text[i])
    return a < 0x250 and b < 0x250 and bool(_BEFORE[a] & _AFTER[b])


class Codec:
    """leaf: characters encoded at once; joins counts the seams that were joined."""

    def __init__(self, ranks: bytes, leaf: int = LEAF):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.leaf = leaf
        self.joins = 0
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for raw, n in table.items():
            self.bytes_of[n] = raw
        self.length = [len(x) for x in self.bytes_of]
        self.agrees = lru_cache(1 << 16)(self._agrees)

    def _agrees(self, a: int, b: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; none for a null or an empty text."""
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.bpe.encode_ordinary(text[start:end])
        seam = (start + end) // 2
        left, right = self._encode(text, start, seam), self._encode(text, seam, end)
        return self.join(text, start, seam, end, left, right)

    def join(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of text[start:seam] and text[seam:end]."""
        self.joins += 1
        if is_border(text, seam):
            return left + right
        width = WINDOW
        while True:
            low, high = max(start, seam - width), min(end, seam + width)
            a = next((i for i in range(seam - 1, low, -1) if is_border(text, i)), start if low == start else None)
            b = next((i for i in range(seam + 1, high) if is_border(text, i)), end if high == end else None)
            cut = self._cut_left(text, seam, width, left) if a is None else (a, self._count(reversed(left), text[a:seam]))
            keep = self._cut_right(text, seam, width, right) if b is None else (b, self._count(right, text[seam:b]))
            if cut and keep:
                (a_, i), (b_, j) = cut, keep
                window = self.bpe.encode_ordinary(text[a_:b_])
                if (a is not None or self.agrees(left[-i - 1], window[0])) and (b is not None or self.agrees(window[-1], right[j])):
                    return left[: len(left) - i] + window + right[j:]
            width *= 2

    def _count(self, tokens: Any, part: str) -> int:
        """How many tokens make up the part's bytes."""
        left, n = len(part.encode()), 0
        for t in tokens:
            if left <= 0:
                break
            left -= self.length[t]
            n += 1
        return n

    def _cut_left(self, text: str, seam: int, width: int, left: list[int]) -> tuple[int, int] | None:
        """(character, tokens cut off) of a token's start in a run of one class at the end of the left half.

        Two characters before the start and two behind it are of the run, so both sides lie in one piece.
        """
        run = _run(text, seam - width, seam + 1, seam)
        spare, n = len(text[seam - width : seam].encode()) - 16, 0
        size = 0
        for t in reversed(left):
            if size + self.length[t] > spare:
                break
            size += self.length[t]
            n += 1
        while n and run:
            at = _characters(text[seam - width : seam], size, from_end=True)
            if at is not None and n < len(left):
                return seam - at, n
            n -= 1
            size -= self.length[left[-n - 1]]
        return None

    def _cut_right(self, text: str, seam: int, width: int, right: list[int]) -> tuple[int, int] | None:
        """(character, tokens cut off) of a token's start in a run of one class at the beginning of the right half."""
        run = _run(text, seam - 1, seam + width, seam)
        spare, n = len(text[seam : seam + width].encode()) - 16, 0
        size = 0
        for t in right:
            if size + self.length[t] > spare:
                break
            size += self.length[t]
            n += 1
        while n and run:
            at = _characters(text[seam : seam + width], size, from_end=False)
            if at is not None and n < len(right):
                return seam + at, n
            n -= 1
            size -= self.length[right[n]]
        return None

    def decode(self, ids: list[int]) -> str:
        """The exact text; bytes are concatenated up the tree, as a character may be spread over tokens."""
        return self._bytes(ids).decode("utf-8")

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.bpe.decode_bytes(ids)
        return self._bytes(ids[: len(ids) // 2]) + self._bytes(ids[len(ids) // 2 :])


def _run(text: str, low: int, high: int, seam: int) -> bool:
    """All characters from low to high are of one known class."""
    kind = _kind(text[seam])
    return bool(kind) and all(_kind(ch) == kind for ch in text[low:high])


def _characters(part: str, size: int, from_end: bool) -> int | None:
    """How many characters at one end of the part have that many bytes; None if the byte lies within a character."""
    raw = part.encode()
    some = raw[len(raw) - size :] if from_end else raw[:size]
    at = len(raw) - size if from_end else size
    if at < len(raw) and raw[at] & 0xC0 == 0x80:
        return None
    return len(some.decode())


@lru_cache(2)
def codec(ranks: bytes) -> Codec:
    """One for each Python worker, whatever the number of its tasks."""
    return Codec(ranks)


def encoded(documents: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row.

    Null and empty texts give an empty list, blank ones are encoded as they are; special tokens' strings are ordinary
    text; rows are neither dropped nor merged, also with null or repeated keys. The vocabulary file, of fixed size, is read
    by the driver and broadcast. One map-side pass over the scan at any size: texts are never shuffled.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        tree = codec(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                lists = [tree.encode(t.as_py()) for t in texts.slice(at, 512)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, column).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
