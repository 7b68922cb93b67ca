"""A gazetteer of any size: handed to every task if it is small, else each record carries the entries near its own words.

Words are near if they share a word left after up to two deletions; that covers two insertions, deletions, substitutions
and swaps. With an entry come all entries of its stem, as they decide whether a bare name is unambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.words import fold

#: Most entries that are handed to every task.
MOST_ENTRIES = 50_000
WORD = re.compile(r"[a-z0-9]+")


def deletions(word: str, edits: int = 1) -> set[str]:
    """The word and what is left of it after up to so many deletions."""
    found, last = {word}, {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def plain(text: str) -> str:
    return " ".join(WORD.findall(fold(text)))


def near_keys(word: str) -> set[str]:
    """What words near this one share with it; short words are never met with errors."""
    return deletions(word, 2) if 5 <= len(word) <= 40 else {word}


def keys_of(texts: DataFrame, id_: str, column: str, stem: Callable[[str], str]) -> DataFrame:
    """(id, stem, key) for each word of a text's stem; stem(text) leaves out words that many names share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s, k) for i, s in zip(b["i"], map(stem, b["t"])) for w in set(s.split()) for k in near_keys(w)]
            yield pd.DataFrame(rows, columns=["i", "stem", "k"]).astype({"i": "int64"})

    return texts.select(F.col(id_).cast("long").alias("i"), F.col(column).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").mapInPandas(run, "i long, stem string, k string").distinct()


def attached(records: DataFrame, id_: str, column: str, entries: DataFrame, stem: Callable[[str], str]) -> DataFrame:
    """(id, entries): the entries (barrio_id, nombre, municipio) whose name or municipality has a word near one of the record's.

    stem(name) is the part of a name that tells it from others. A word meets the distinct stems that hold it, not rows of
    the gazetteer; records without a near entry have no row.
    """
    e = entries.select(F.col("barrio_id").cast("long").alias("barrio_id"), "nombre", "municipio")
    names = keys_of(e, "barrio_id", "nombre", stem)
    towns = keys_of(e.where("municipio IS NOT NULL").groupBy("municipio").agg(F.min("barrio_id").alias("barrio_id")), "barrio_id", "municipio", plain)
    family = names.select(F.col("i").alias("barrio_id"), "stem").distinct()
    words = keys_of(records, id_, column, plain).select("i", "k")
    by_name = words.join(names.select("stem", "k").distinct(), "k").select("i", "stem").distinct().join(family, "stem").select("i", "barrio_id")
    by_town = words.join(towns.select(F.col("i").alias("barrio_id"), "k"), "k").select("i", "barrio_id")
    met = by_name.unionByName(by_town).distinct().join(e, "barrio_id")
    return met.groupBy("i").agg(F.sort_array(F.collect_set(F.struct("barrio_id", "nombre", "municipio"))).alias("entries")).withColumnRenamed("i", id_)
