"""Evaluation passages that occur in corpus documents (problem 8).

A prefix-filtered set join of windows: every run of LENGTH words of an item is a set that must be contained whole, so the
one rarest word of it, by document frequency in the whole corpus, is a sufficient prefix: a document without that word
cannot contain the window. Documents meet items only through those words; the word's position in the document and in
the window bounds where the window may lie, the document's length whether it fits, and the words are then compared
exactly over the item-sized window around it. Items beyond what a task may hold are joined in blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.words import words
from gridpulse.plans.lineage import blocks, bounded_rows

LENGTH = 12
#: Characters of items that are handed to every task at a time.
MOST_CHARS = 20_000_000


def frequencies(documents: DataFrame, column: str, vocabulary: frozenset[str]) -> dict[str, int]:
    """Documents of the whole corpus that hold each word of the items; counted in each task before the shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        wanted = shared.value
        for b in batches:
            for t in b[column]:
                if isinstance(t, str):
                    seen.update(wanted.intersection(words(t)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": "object", "n": "int64"})

    counted = documents.where(F.col(column).isNotNull()).select(column).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in bounded_rows(counted, len(vocabulary), "the items' vocabulary")}


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", length: int = LENGTH, most: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that contain at least `length` consecutive words of the item.

    Items of fewer words, null and empty texts match nothing; a document that repeats a passage, and repeated rows, count
    once. Items of more than `most` characters in all are met in several blocks, each by a pass over all documents. Of an
    item_id with several texts every text counts.
    """
    out = None
    for block in blocks(items.where("item_id IS NOT NULL AND texto IS NOT NULL").select("item_id", "texto").distinct(), F.length("texto"), most):
        found = _leaks(documents, [(int(r.item_id), words(r.texto)) for r in block.collect()], key, column, length)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _leaks(documents: DataFrame, listed: list[tuple[int, list[str]]], key: str, column: str, length: int) -> DataFrame:
    vocabulary = frozenset(w for _, ws in listed if len(ws) >= length for w in ws)
    rarity = frequencies(documents, column, vocabulary)
    prefix: dict[str, list[tuple[int, int, int]]] = {}
    for n, (_, ws) in enumerate(listed):
        for start in range(len(ws) - length + 1):
            at = min(range(start, start + length), key=lambda i: (rarity.get(ws[i], 0), ws[i], i))
            if rarity.get(ws[at], 0):  # a window with a word that the corpus lacks occurs nowhere
                prefix.setdefault(ws[at], []).append((n, start, at - start))
    shared = documents.sparkSession.sparkContext.broadcast((listed, prefix))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, by_word = shared.value
        for b in batches:
            docs: list[int] = []
            found: list[int] = []
            for doc, text in zip(b[key], b[column]):
                ws = words(text)
                if len(ws) < length:
                    continue
                hit: set[int] = set()
                for p, w in enumerate(ws):
                    for n, start, offset in by_word.get(w, ()):
                        item, passage = texts[n]
                        low = p - offset
                        if item not in hit and low >= 0 and low + length <= len(ws) and ws[low : low + length] == passage[start : start + length]:
                            hit.add(item)
                docs += [doc] * len(hit)
                found += sorted(hit)
            yield pd.DataFrame({key: docs, "item_id": found}).astype({key: "int64", "item_id": "int32"})

    rows = documents.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, column)
    return rows.mapInPandas(join, f"{key} long, item_id int")
