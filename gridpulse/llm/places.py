"""Mapping free-entered places to the entries of a reference list (problem 4).

A multi-pattern automaton over canonical names and their aliases finds embedded mentions; the longest match that does not
overlap another wins. Values without a mention go to token-set similarity: the value's words, misspelt ones taken for the
nearest word of the list, are a set, and an entry's score is the share of its words' letters found in that set, in any
order. Candidates come from an index of each entry's rarest words, as many as leave too little for the least score.

Rules: an added word ("Alturas de", "Viejo") is part of a name, so a mention whose neighbouring added word belongs to no
alias of the entry is another place, which is not on the list; a bare name stands for an entry with a leading word only
if no other entry bears that name; a municipality that contradicts the entry's own makes it another place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.addresses import LEADS, LINK, TAILS, Fuzzy, barrio_parts, distance, stem_of, within_one
from gridpulse.llm.gazetteer import MOST_ENTRIES, WORD, attached
from gridpulse.llm.words import fold
from gridpulse.plans.lineage import within

NONE = -1
#: Least share of an entry's letters that a value must hold.
SIMILAR = 0.75
#: Words that carry no weight in a set.
LIGHT = {"el", "la", "los", "las", "de", "del", "y", "en"}


class Places:
    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.entry: dict[int, tuple[tuple[str, str, str], str]] = {}
        family: dict[str, set[int]] = {}
        self.towns: set[str] = set()
        for key, name, town in entries:
            words = WORD.findall(fold(name or ""))
            if not words:
                continue
            parts = barrio_parts(words)
            town = " ".join(WORD.findall(fold(town or "")))
            self.entry[key] = (parts, town)
            family.setdefault(parts[1], set()).add(key)
            if town:
                self.towns.add(town)
        self.family = family
        self.weights = {stem: {w: len(w) for w in stem.split() if w not in LIGHT} or {w: len(w) for w in stem.split()} for stem in family}
        self.stem_words = Fuzzy({w for ws in self.weights.values() for w in ws}, 2)
        used = Counter(w for ws in self.weights.values() for w in ws)
        self.prefix: dict[str, list[str]] = {}
        for stem, ws in self.weights.items():
            rest = sum(ws.values())
            for w in sorted(ws, key=lambda w: (used[w], w)):
                if rest < SIMILAR * sum(ws.values()):  # without the words before, the score can't be reached
                    break
                self.prefix.setdefault(w, []).append(stem)
                rest -= ws[w]
        self.exact = {parts: key for key, (parts, _) in self.entry.items()}
        self.town_words = Fuzzy({w for t in self.towns for w in t.split()})
        self.automaton = ahocorasick.Automaton()
        leads: dict[str, set[str]] = {}
        for written, meant in LEADS.items():
            leads.setdefault(meant, set()).add(written)
        tails: dict[str, set[str]] = {}
        for written, meant in TAILS.items():
            tails.setdefault(meant, set()).add(written)
        aliases: dict[str, int] = {}
        for key, ((lead, stem, tail), _) in self.entry.items():
            for a in leads.get(lead, {""}):
                for link in ("", "de ", "del ") if a else ("",):
                    for z in tails.get(tail, {""}):
                        aliases[f" {a} {link}{stem} {z} ".replace("  ", " ").replace("  ", " ")] = key
            if lead and not tail and len(family[stem]) == 1:
                aliases.setdefault(f" {stem} ", key)
        for alias, key in aliases.items():
            self.automaton.add_word(alias, (len(alias), key))
        if aliases:
            self.automaton.make_automaton()
        self.find = lru_cache(1 << 17)(self._find)

    def _find(self, text: str) -> int:
        words = WORD.findall(fold(text))
        if not words or not self.entry:
            return NONE
        return key if (key := self.mention(words)) is not None else self.similar(words)

    def agrees(self, key: int, rest: list[str]) -> bool:
        """No added word beside the mention, and no other municipality in the rest."""
        town = self.entry[key][1]
        said = [t for t in self.towns if all(any(self.town_words.find(r) == w for r in rest) for w in t.split())]
        return not said or not town or town in said

    def mention(self, words: list[str]) -> int | None:
        line = " " + " ".join(words) + " "
        best: tuple[int, int, int] | None = None  # longest first, then the earliest
        for end, (length, key) in self.automaton.iter(line):
            at = end - length + 1
            if best is None or (length, -at) > (best[0], -best[1]):
                best = (length, at, key)
        if best is None:
            return None
        length, at, key = best
        before, after = line[: at + 1].split(), line[at + length - 1 :].split()
        parts = self.entry[key][0]
        while before and before[-1] in LINK:
            before = before[:-1]
        lead, tail = LEADS.get(before[-1], "") if before else "", TAILS.get(after[0], "") if after else ""
        used = barrio_parts(line[at : at + length].split())
        if (lead and not used[0] and lead not in ("la", "el", "barrio", parts[0])) or (tail and not used[2]):
            return self.exact.get((lead or used[0], parts[1], tail or used[2]), NONE)
        return key if self.agrees(key, before + after) else NONE

    def scored(self, words: list[str]) -> list[tuple[int, int, int, str]]:
        """(letters missing less letters found, first and last place, stem) of each similar stem, best first."""
        at: dict[str, tuple[int, int]] = {}  # each word of the list: letters that agree, at which place
        for i, w in enumerate(words):
            if near := self.stem_words.find(w):
                agree = len(near) - (0 if near == w else distance(w, near))
                if near not in at or agree > at[near][0]:
                    at[near] = (agree, i)
        found = []
        for stem in {stem for w in at for stem in self.prefix.get(w, ())}:
            ws = self.weights[stem]
            met = [at[w] for w in ws if w in at]
            agree, total = sum(n for n, _ in met), sum(ws.values())
            if agree >= SIMILAR * total:
                places = [i for _, i in met]
                found.append((total - 2 * agree, min(places), max(places), stem))
        return sorted(found)

    def similar(self, words: list[str]) -> int:
        """The most similar entry that its added words and municipality do not exclude; ties go to the one named first.

        Words of 5 to 7 letters may have one typing error, longer ones two. Other words of the value may be anything.
        """
        for _, first, last, stem in self.scored(words):
            before, after = words[:first], words[last + 1 :]
            while before and before[-1] in LIGHT - set(LEADS):
                before = before[:-1]
            lead = near_word(before[-1], LEADS) if before else ""
            tail = near_word(after[0], TAILS) if after else ""
            key = self.exact.get((lead, stem, tail))
            if key is None and not tail and lead in ("", "la", "el", "barrio") and len(self.family[stem]) == 1:
                only = next(iter(self.family[stem]))
                key = only if self.entry[only][0][0] and not self.entry[only][0][2] and lead in ("", self.entry[only][0][0]) else None
            if key is not None and self.agrees(key, before + after):
                return key
        return NONE


def near_word(word: str, table: dict[str, str]) -> str:
    if word in table:
        return table[word]
    if len(word) < 5:
        return ""
    return next((meant for written, meant in table.items() if len(written) >= 5 and within_one(word, written)), "")


@lru_cache(64)
def places_of(entries: tuple[tuple[int, str, str | None], ...]) -> Places:
    """One for each list in a Python worker, whatever the number of its tasks."""
    return Places(list(entries))


def mapped(values: DataFrame, key: str, column: str, entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(key, barrio_id): the entry that each value means, -1 if none, for each key whose value is not null or blank.

    entries: barrio_id, nombre, municipio. Up to `most` entries are handed to every task: the values never move, each is
    mapped where it lies, and a repeated value costs a look-up. Beyond, every distinct value is joined with the entries
    near its own words and mapped among those, with the same result. A key with several values takes the entry of the first
    found in order of id, and -1 only if none of them means an entry. An empty list of entries maps everything to -1.
    """
    # \p{Z} and the like: a value of odd spaces only is blank
    visible = F.regexp_replace(F.col(column), r"[\s\p{Z}\p{Cf}\p{Cc}]+", "") != ""
    asked = values.where(F.col(key).isNotNull() & F.col(column).isNotNull() & visible).select(F.col(key).alias("k"), F.col(column).alias("v"))
    listed = entries.where("barrio_id IS NOT NULL AND nombre IS NOT NULL").select("barrio_id", "nombre", "municipio").distinct().orderBy("barrio_id", "nombre", "municipio")
    if within(listed, most):
        shared = values.sparkSession.sparkContext.broadcast(tuple((int(r.barrio_id), r.nombre, r.municipio) for r in listed.collect()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places = places_of(shared.value)
            for b in batches:
                yield pd.DataFrame({"k": b["k"], "barrio_id": [places.find(v) for v in b["v"]]})

        found = asked.mapInPandas(run, "k long, barrio_id int")
    else:
        texts = asked.select("v").distinct().withColumn("n", F.xxhash64("v"))
        near = attached(texts, "n", "v", listed, stem_of)

        def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                lists = [tuple((e["barrio_id"], e["nombre"], e["municipio"]) for e in es) if es is not None else () for es in b["entries"]]
                yield pd.DataFrame({"v": b["v"], "barrio_id": [places_of(es).find(v) for v, es in zip(b["v"], lists)]})

        found = texts.join(near, "n", "left").select("v", "entries").mapInPandas(among, "v string, barrio_id int").join(asked, "v").select("k", "barrio_id")
    best = F.coalesce(F.min(F.when(F.col("barrio_id") != NONE, F.col("barrio_id"))), F.lit(NONE))
    return found.groupBy(F.col("k").alias(key)).agg(best.cast("int").alias("barrio_id"))
