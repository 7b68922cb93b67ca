"""Which address records denote the same location (problem 1).

Addresses are parsed into components, abbreviations are expanded from locale dictionaries, the order is made
canonical, and records join on hierarchical keys with explicit rules for missing components.

Streets
    A street is all words of its name (of any length where its type or a marked number says that it is one), a letter behind
    its number ("5 A"), and its type. The type is told apart only where several types of one name are in use; a street
    without a type is then of the most frequent one. A house number keeps its letter ("12A").

Locations and their keys
    house     (street, number)            + municipality
    corner    ({street, street})          + municipality
    building  (zone, building, barrio)    (the barrio fixes the municipality)

Missing components
    * cross streets never take part in the key, so they may be left out;
    * a missing municipality is taken from the barrio, then from the record's own municipality column;
    * a record that still has none (rule "floating") joins the one municipality in which the whole input has its street
      and number (or corner); if several have it, the municipality in which that street crosses one of the record's
      cross streets decides; if none does, the one municipality whose records name no cross street; else it stays apart;
    * a building without a barrio, a street alone, a stretch ("desde .. hasta", "entre" without number), an area or a
      vague text denote no location.

Defined results: null, blank and unparsable addresses give no location and no pair; a null id gives none; repeated rows
count once; very long texts are parsed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.gazetteer import MOST_ENTRIES, WORD, attached, deletions
from gridpulse.llm.words import fold
from gridpulse.plans.lineage import settled, small, within

# Abbreviations of Spanish street addresses.
STREET_TYPES = {
    "calle": "calle", "cll": "calle", "c": "calle", "cl": "calle",
    "avenida": "avenida", "av": "avenida", "ave": "avenida", "avda": "avenida",
    "calzada": "calzada", "calz": "calzada", "czda": "calzada",
    "paseo": "paseo", "pso": "paseo", "ps": "paseo",
    "callejon": "callejon", "callej": "callejon", "cjon": "callejon",
}
NUMBER_MARKS = {"no", "num", "numero", "nro", "#"}
BETWEEN = {"entre", "e/", "entr"}
CORNER = {"esq", "esquina"}
BUILDING = {"edif", "edificio", "ed", "edf"}
ZONE = {"zona", "zna", "z", "zon"}
BARRIO_MARKS = {"rpto", "reparto", "rep"}
TOWN_MARKS = {"mun", "mcpio", "municipio", "mpio"}
STRETCH = {"desde", "hasta"}
LEADS = {
    "alturas": "alturas", "alt": "alturas", "alts": "alturas", "ampliacion": "ampliacion", "amp": "ampliacion", "ampl": "ampliacion",
    "barrio": "barrio", "bo": "barrio", "b": "barrio", "jardines": "jardines", "jard": "jardines", "jdnes": "jardines",
    "loma": "loma", "parcelacion": "parcelacion", "parc": "parcelacion", "parcelac": "parcelacion", "residencial": "residencial", "res": "residencial",
    "resid": "residencial", "villa": "villa", "el": "el", "la": "la",
}
TAILS = {"viejo": "viejo", "vieja": "viejo", "vja": "viejo", "vjo": "viejo"}
LINK = {"de", "del"}
#: Words that open a remark; a remark runs to the next separator.
REMARKS = {"urgente", "frente", "al", "donde", "detras", "cerca", "casa", "favor", "ojo"}

_TOKEN = re.compile(r"[ce]/|[a-z]+|\d+(?:[a-df-xz](?![a-z/]))?|#|[,;.\n()]")
_NUMBER, _LETTER = re.compile(r"\d+[a-z]?"), re.compile(r"(\d) ?- ?([a-df-xz])\b")
FIELDS = ["kind", "street", "number", "other", "barrio", "town", "crossings", "types"]
PARSED = "kind string, street string, number string, other string, barrio string, town string, crossings array<string>, types array<string>"


def number_of(token: str) -> str | None:
    """A number without leading zeros, with its letter; None if the token is none."""
    if not _NUMBER.fullmatch(token):
        return None
    return str(int(token)) if token.isdigit() else f"{int(token[:-1])}{token[-1]}"


def distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            least = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, older[j - 2] + 1)
            row.append(least)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def within_one(a: str, b: str) -> bool:
    return distance(a, b, 1) <= 1


class Fuzzy:
    """Words of a fixed list, found with typing errors through their deletion neighbourhood.

    The nearest word is found if no other is as near; words of less than five letters only without an error, of less
    than eight with one.
    """

    def __init__(self, words: set[str], edits: int = 1):
        self.words, self.edits, self.near = words, edits, {}
        for w in words:
            if len(w) >= 5:
                for x in deletions(w, edits if len(w) >= 8 else 1):
                    self.near.setdefault(x, set()).add(w)
        self.find = lru_cache(1 << 16)(self._find)

    def _find(self, word: str) -> str | None:
        if word in self.words:
            return word
        if len(word) < 5:
            return None
        close = {w for x in deletions(word, self.edits) for w in self.near.get(x, ())}
        ranked = sorted((d, w) for w in close if (d := distance(word, w, self.edits)) <= (self.edits if len(w) >= 8 else 1))
        if not ranked or (len(ranked) > 1 and ranked[1][0] == ranked[0][0]):
            return None
        return ranked[0][1]


def barrio_parts(tokens: list[str]) -> tuple[str, str, str]:
    """(leading word, stem, trailing word) of a neighbourhood's folded name."""
    lead = LEADS.get(tokens[0], "") if len(tokens) > 1 else ""
    rest = tokens[1:] if lead else tokens
    while len(rest) > 1 and rest[0] in LINK:
        rest = rest[1:]
    tail = TAILS.get(rest[-1], "") if len(rest) > 1 else ""
    return lead, " ".join(rest[:-1] if tail else rest), tail


def stem_of(name: str) -> str:
    """The part of a neighbourhood's name without its added words."""
    words = WORD.findall(fold(name))
    return barrio_parts(words)[1] if words else ""


class Parser:
    """gazetteer: (name, municipality) of the neighbourhoods; its size is bounded by the city."""

    def __init__(self, gazetteer: list[tuple[str, str]]):
        self.entries: dict[tuple[str, str, str], tuple[str, str]] = {}
        self.by_stem: dict[str, list[tuple[str, str]]] = {}
        self.towns: dict[tuple[str, ...], str] = {}
        for name, town in gazetteer:
            town_words = tuple(re.findall(r"[a-z0-9]+", fold(town or "")))
            if town_words:
                self.towns[town_words] = " ".join(town_words)
            if words := re.findall(r"[a-z0-9]+", fold(name or "")):
                parts = barrio_parts(words)
                entry = (" ".join(words), " ".join(town_words))
                self.entries[parts] = entry
                self.by_stem.setdefault(parts[1], []).append(entry)
        self.stems = {tuple(stem.split()): stem for stem in self.by_stem}
        self.widths = sorted({len(ws) for ws in self.stems}, reverse=True)
        stem_words = {w for ws in self.stems for w in ws}
        self.stem_words, self.stem_words_marked = Fuzzy(stem_words), Fuzzy(stem_words, 2)
        self.town_words = Fuzzy({w for t in self.towns for w in t})
        self.known = set(self.towns.values())

    def town_at(self, tokens: list[str], i: int) -> tuple[str, int] | None:
        for words, town in self.towns.items():
            if i + len(words) <= len(tokens) and all(t == w or (len(w) > 4 and self.town_words.find(t) == w) for t, w in zip(tokens[i:], words)):
                return town, len(words)
        return None

    def barrio_at(self, tokens: list[str], i: int, marked: bool = False) -> tuple[str | None, str, int] | None:
        """(name or None if ambiguous, municipality, tokens used) of a neighbourhood that begins at i."""
        j, lead = i, ""
        while j < len(tokens) and tokens[j] in LEADS and not lead:
            lead, j = LEADS[tokens[j]], j + 1
            while j < len(tokens) and tokens[j] in LINK | {"."}:
                j += 1
        if j >= len(tokens) or not tokens[j].isalpha():
            return None
        find = (self.stem_words_marked if marked else self.stem_words).find
        stem = next((x for n in self.widths if (x := self.stems.get(tuple(map(find, tokens[j : j + n]))))), None)
        if stem is None:
            return None
        j += stem.count(" ") + 1
        tail = TAILS.get(tokens[j], "") if j < len(tokens) else ""
        used = j - i + bool(tail)
        if found := self.entries.get((lead, stem, tail)):
            return *found, used
        family = self.by_stem[stem]
        if not tail and not lead and len(family) == 1:
            return *family[0], used
        towns = {t for _, t in family}
        return None, towns.pop() if len(towns) == 1 else "", used

    def parse(self, text: str | None) -> dict | None:
        """The components of one address, or None if it denotes no location."""
        if not text or not (raw := _TOKEN.findall(_LETTER.sub(r"\1\2", fold(text.replace("º", "o ").replace("°", "o "))))):
            return None
        tokens: list[str] = []
        for k, t in enumerate(raw):
            if t == "." and tokens and (tokens[-1] in STREET_TYPES or tokens[-1] in NUMBER_MARKS | CORNER | BUILDING | ZONE | BARRIO_MARKS | TOWN_MARKS or (tokens[-1] in LEADS and len(tokens[-1]) < 6) or tokens[-1] in TAILS):
                continue
            tokens.append(t)
        if any(t in STRETCH for t in tokens):
            return None
        barrio = town = town_of_barrio = None
        kept: list[str] = []
        plain: list[str] = []
        remark = False
        for t in tokens:
            remark = t in REMARKS or (remark and t not in ",;.\n" and t not in TOWN_MARKS | BARRIO_MARKS)
            if not remark:
                plain.append(t)
        tokens = plain
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if t in TOWN_MARKS and (hit := self.town_at(tokens, i + 1)):
                town, i = hit[0], i + 1 + hit[1]
                kept.append(";")
            elif t in BARRIO_MARKS:
                hit = self.barrio_at(tokens, i + 1, marked=True)
                kept.append(";")
                if hit:
                    barrio, town_of_barrio, i = hit[0] or barrio, hit[1] or town_of_barrio, i + 1 + hit[2]
                else:  # an unknown neighbourhood: skip to the next separator
                    i += 1
                    while i < len(tokens) and tokens[i] not in ",;.\n" and tokens[i] not in TOWN_MARKS | BUILDING | ZONE | NUMBER_MARKS:
                        i += 1
            elif (hit := self.town_at(tokens, i)) and (i == 0 or tokens[i - 1] not in STREET_TYPES):
                town, i = hit[0], i + hit[1]
                kept.append(";")
            elif (i == 0 or tokens[i - 1] not in STREET_TYPES) and (hit := self.barrio_at(tokens, i)):
                barrio, town_of_barrio, i = hit[0] or barrio, hit[1] or town_of_barrio, i + hit[2]
                kept.append(";")
            else:
                kept.append(t)
                i += 1
        town = town or town_of_barrio or None
        return self.locate(kept, barrio, town)

    @staticmethod
    def locate(tokens: list[str], barrio: str | None, town: str | None) -> dict | None:
        out = {"barrio": barrio, "town": town, "street": None, "number": None, "other": None, "crossings": [], "types": []}

        def number_after(marks: set[str]) -> str | None:
            return next((n for a, b in zip(tokens, tokens[1:]) if a in marks and (n := number_of(b))), None)

        if building := number_after(BUILDING):
            zone = number_after(ZONE)
            if not zone or not barrio:
                return None
            return out | {"kind": "building", "street": f"zona {zone}", "number": building}
        pieces: list[tuple[str, list[str]]] = [("", [])]  # (what opened it, its tokens)
        for k, t in enumerate(tokens):
            last = tokens[k - 1] if k else ""
            if t in BETWEEN:
                pieces.append(("between", []))
            elif t in CORNER:
                pieces.append(("near" if last == "casi" else "corner", []))
            elif t == "casi":
                continue
            elif t in ("y", "con", "a") and k + 1 < len(tokens) and not (t == "a" and tokens[k + 1] in NUMBER_MARKS):
                pieces.append(("and", []))
            elif t == "c/" and pieces[-1][1] and pieces[-1][1][-1] not in (",", ";", ".", "\n") and "de" not in pieces[-1][1][-1:]:
                pieces.append(("and", []))
            elif t in (";", "\n", "(", ")"):
                pieces.append(("cut", []))
            else:
                pieces[-1][1].append("c" if t == "c/" else t)
        house = None
        streets: list[tuple[str, str]] = []
        types: dict[str, str] = {}
        for how, words in pieces:
            if (street := street_of(words)) is None:
                if how == "corner" and not words:
                    streets.append(("corner", ""))
                continue
            name, number, kind = street
            if kind:
                types.setdefault(name, kind)
            if number and not house and how in ("", "cut"):
                house = (name, number)
            elif name:
                streets.append((how, name))
        if not house and not any(h in ("corner", "and") for h, _ in streets):  # "Grazumales; # 4024"
            lone = number_after(NUMBER_MARKS)
            if lone and streets and streets[0][0] in ("", "cut"):
                house = (streets[0][1], lone)
        out["crossings"] = sorted({n for _, n in streets if n and (not house or n != house[0])})
        if house:
            return out | {"kind": "house", "street": house[0], "number": house[1], "types": [types.get(house[0], ""), ""]}
        hows = [h for h, n in streets]
        names = [n for _, n in streets if n]
        if "between" in hows or "near" in hows or len(set(names)) != 2:
            return None
        if "corner" in hows or "and" in hows:
            a, b = sorted(set(names))
            return out | {"kind": "corner", "street": a, "other": b, "crossings": [], "types": [types.get(a, ""), types.get(b, "")]}
        return None


def street_of(words: list[str]) -> tuple[str, str | None, str] | None:
    """(street, number, type or '') of the tokens of one piece; None if there is no street in it.

    A name is all words up to the number or a separator. A single word of less than four letters is a name if a type
    stands before it or the number is marked; the letter behind a numbered street is part of its name.
    """
    number, marked = None, False
    rest: list[str] = []
    kind = ""
    i = 0
    while i < len(words):
        ahead = words[i + 1] if i + 1 < len(words) else ""
        if words[i] in NUMBER_MARKS and (n := number_of(ahead)):
            number, marked = number or n, True
            i += 2
            if i < len(words) and words[i] == "de":
                i += 1
        elif words[i].isdigit() and not rest and kind and len(ahead) == 1 and ahead.isalpha() and (i + 2 == len(words) or words[i + 2] in NUMBER_MARKS or not words[i + 2].isalpha()):
            rest.append(words[i] + ahead)
            i += 2
        elif words[i] in STREET_TYPES:
            kind = kind or STREET_TYPES[words[i]]
            i += 1
        else:
            rest.append(words[i])
            i += 1
    while rest and rest[0] in (",", ".", "de", "del", "la", "el", "los", "las"):
        rest = rest[1:]
    if not rest:
        return None
    end = next((k for k, w in enumerate(rest) if k and not w.isalpha()), len(rest))
    while end < len(rest) and rest[end] in (",", "."):
        rest.pop(end)
    name = number_of(rest[0]) or rest[0]
    if name[0].isdigit():
        end = 1
    elif name.isalpha() and name != "circuito":  # the code of a circuit is no name with a number
        name = " ".join(rest[:end])
    else:
        end = 1
    if number is None and end < len(rest):
        number = number_of(rest[end])
    if name.isalpha() and len(name) < 4 and not (kind or marked):
        return None
    return name, number, kind


#: Most corrected street names that are broadcast; more are joined by a shuffle.
MOST_CORRECTIONS = 100_000
#: A spelling is a mistake for another that is so many times as frequent.
RATIO = 3
#: Rows that a mistake has at most, if the right spelling is less than RATIO times as frequent.
RARE = 2
#: Share of a name's rows that a type has at least to be a street of its own.
TYPE_SHARE = 0.1


@lru_cache(64)
def parser_of(gazetteer: tuple[tuple[str, str], ...]) -> Parser:
    """One for each list in a Python worker, whatever the number of its tasks."""
    return Parser(list(gazetteer))


def components(records: DataFrame, gazetteer: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """records (id, direccion, town or null) parsed; only those that denote a location remain.

    Up to `most` entries of the gazetteer are handed to every task; beyond, each address is joined with the entries near
    its own words and parsed with those, with the same result.
    """
    rows = records.where("id IS NOT NULL AND direccion IS NOT NULL").select("id", "direccion", "town")
    listed = gazetteer.select("barrio_id", "nombre", "municipio").distinct().orderBy("barrio_id", "nombre", "municipio")
    few = within(listed, most)
    if few:
        shared = records.sparkSession.sparkContext.broadcast(tuple((r.nombre, r.municipio) for r in listed.collect()))
    else:
        texts = rows.select(F.concat_ws(" ", "direccion", "town").alias("t")).distinct().withColumn("n", F.xxhash64("t"))
        near = texts.join(attached(texts, "n", "t", listed, stem_of), "n").select("t", "entries")
        rows = rows.withColumn("t", F.concat_ws(" ", "direccion", "town")).join(near, "t", "left").select("id", "direccion", "town", "entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            lists = [shared.value] * len(b) if few else [tuple((e["nombre"], e["municipio"]) for e in es) if es is not None else () for es in b["entries"]]
            for key, text, hint, entries in zip(b["id"], b["direccion"], b["town"], lists):
                parser = parser_of(entries)
                if found := parser.parse(text):
                    hint = " ".join(WORD.findall(fold(hint))) if isinstance(hint, str) else None
                    if not found["town"] and hint in parser.known:
                        found["town"] = hint
                    out.append((key, *(found[c] for c in FIELDS)))
            yield pd.DataFrame(out, columns=["id", *FIELDS])

    return rows.mapInPandas(run, f"id long, {PARSED}").distinct()


def spelling(names: DataFrame) -> DataFrame:
    """(name, right): each street name, and the more frequent name one typing error away, if there is one.

    names: name, n (rows that use it). Candidates share a deletion; among those at most one insertion, deletion,
    substitution or swap of neighbours apart, and RATIO times as frequent (or more frequent than a spelling of at most RARE
    rows), the most frequent is right: two streets a letter apart that are both in use stay two. Two steps are followed, so
    a name with two errors reaches its original over a name with one. Names of less than five letters and numbers stay.
    """
    letters = names.where(F.length("name") >= 5)
    keyed = letters.select("name", "n", F.explode(F.array_distinct(F.expr("concat(array(name), transform(sequence(1, length(name)), i -> concat(left(name, i - 1), substring(name, i + 1))))"))).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    swap = (F.length("a.name") == F.length("b.name")) & (F.array_sort(F.split("a.name", "")) == F.array_sort(F.split("b.name", "")))
    distance = F.levenshtein("a.name", "b.name")
    first = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.name") < F.col("a.name")))
    better = (F.col("b.n") >= RATIO * F.col("a.n")) | ((F.col("a.n") <= RARE) & first)
    step = settled(
        a.join(b, (F.col("a.k") == F.col("b.k")) & better & (F.col("a.name") != F.col("b.name"))).where((distance <= 1) | ((distance == 2) & swap))
        .groupBy(F.col("a.name").alias("name")).agg(F.max_by(F.col("b.name"), F.struct(F.col("b.n"), F.col("b.name"))).alias("to"))
    )
    again = step.select(F.col("name").alias("to"), F.col("to").alias("then"))
    return step.join(again, "to", "left").select("name", F.coalesce("then", "to").alias("right"))


def typed(uses: DataFrame) -> DataFrame:
    """(name, types): the types of a name that are streets of their own, the most frequent first; only names with several.

    uses: name, kind ('' if not written).
    """
    n = uses.where("kind <> ''").groupBy("name", "kind").agg(F.count("*").alias("n"))
    by = n.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "kind")), False).alias("k"), F.sum("n").alias("total"))
    return by.select("name", F.transform(F.filter("k", lambda x: x["n"] >= TYPE_SHARE * F.col("total")), lambda x: x["kind"]).alias("types")).where("size(types) > 1")


def corrected(parts: DataFrame) -> DataFrame:
    """The components with every street name in its most frequent spelling, and its type where that tells streets apart.

    All names of a record go through one pass: they are spread to rows, looked up, and gathered again.
    """
    role = lambda r, name, kind: F.struct(F.lit(r).alias("role"), name.alias("name"), F.coalesce(kind, F.lit("")).alias("kind"))
    all_ = F.concat(
        F.array(role("a", F.col("street"), F.get("types", F.lit(0))), role("b", F.col("other"), F.get("types", F.lit(1)))),
        F.transform("crossings", lambda c: role("x", c, F.lit(""))),
    )
    uses = parts.withColumn("r", F.struct("id", "kind", "street", "number", "other", "barrio", "town")).select("r", F.explode(all_).alias("u")).select("r", "u.role", "u.name", F.col("u.kind").alias("type")).where("name IS NOT NULL")
    words = uses.where("r.kind <> 'building' AND name RLIKE '^[a-z]'")
    right = small(spelling(words.groupBy("name").agg(F.count("*").alias("n"))), MOST_CORRECTIONS)
    spelt = uses.join(right, "name", "left").select("r", "role", F.coalesce("right", "name").alias("name"), "type")
    several = small(typed(spelt.where("role <> 'x' AND r.kind <> 'building'").select("name", F.col("type").alias("kind"))), MOST_CORRECTIONS)
    kind = F.when(F.array_contains("types", F.col("type")), F.col("type")).otherwise(F.get("types", F.lit(0)))
    told = spelt.join(several, "name", "left").select("r", "role", F.when(F.col("types").isNotNull() & (F.col("role") != "x"), F.concat_ws(" ", kind, "name")).otherwise(F.col("name")).alias("name"))
    named = lambda r: F.max(F.when(F.col("role") == r, F.col("name")))
    out = told.groupBy("r").agg(named("a").alias("a"), named("b").alias("b"), F.sort_array(F.collect_set(F.when(F.col("role") == "x", F.col("name")))).alias("crossings"))
    swap = F.col("b") < F.col("a")
    return out.select("r.id", "r.kind", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("street"), "r.number", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"), "r.barrio", "r.town", "crossings")


PLACE = ["kind", "street", "number", "other"]


def locations(records: DataFrame, gazetteer: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(id, kind, street, number, other, area, crossings): the location of each record that denotes one.

    area is the municipality, for a building the neighbourhood, or '?' for a floating record whose municipality is open.
    """
    parts = settled(corrected(settled(components(records, gazetteer, most))))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in PLACE[2:]]
    parts = parts.select("id", "kind", "street", *blank, F.when(F.col("kind") == "building", F.col("barrio")).otherwise(F.col("town")).alias("area"), "crossings")
    fixed, floating = parts.where("area IS NOT NULL"), parts.where("area IS NULL AND kind <> 'building'")
    # what is known of each place: one row for each municipality that has it, with the cross streets named there
    wanted = floating.select(*PLACE).distinct()
    there = fixed.join(wanted, PLACE, "left_semi").select(*PLACE, "area", F.explode_outer("crossings").alias("x")).groupBy(*PLACE, F.col("area").alias("candidate")).agg(F.collect_set("x").alias("known"))
    tried = (
        floating.join(there, PLACE).select("id", "candidate", F.arrays_overlap("crossings", "known").alias("meets"), ((F.size("crossings") == 0) | (F.size("known") == 0)).alias("silent"))
        .groupBy("id").agg(F.count_if("meets").alias("n_meets"), F.max(F.when(F.col("meets"), F.col("candidate"))).alias("met"), F.count_if("silent").alias("n_silent"), F.max(F.when(F.col("silent"), F.col("candidate"))).alias("quiet"))
    )
    choice = F.when(F.col("n_meets") == 1, F.col("met")).when((F.col("n_meets") == 0) & (F.col("n_silent") == 1), F.col("quiet")).otherwise(F.lit("?"))
    landed = floating.drop("area").join(tried, "id", "left").withColumn("area", F.coalesce(choice, F.lit("?")))
    cols = ["id", *PLACE, "area", "crossings"]
    return fixed.select(*cols).unionByName(landed.select(*cols))


def same_location(records: DataFrame, gazetteer: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of records that denote the same location.

    Floating records that found no municipality are the same if place and a cross street agree, or one names none.
    """
    placed = locations(records, gazetteer, most).distinct()
    a, b = placed.alias("a"), placed.alias("b")
    same = F.col("a.id") < F.col("b.id")
    for c in [*PLACE, "area"]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    sure = (F.col("a.area") != "?") | F.arrays_overlap("a.crossings", "b.crossings") | (F.size("a.crossings") == 0) | (F.size("b.crossings") == 0)
    return a.join(b, same).where(sure).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
