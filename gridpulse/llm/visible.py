"""Texts that look the same but are stored as different characters (problem 2).

A mapping for widths, accents, spaces and look-alike letters is compiled once, checked for conflicts, and applied by a
longest-match transducer over grapheme clusters in one pass. Its keys are single characters and whole clusters: a letter, or
a letter that looks like it, with its accents in every order. Look-alikes come from the public confusables data that the
JVM carries, within the limits below, and from a short list of our own.

What counts as visible: case, accents, digits, punctuation and emoji. What does not: the width of letters, the kind of
space, invisible characters, whether an accent is stored apart, and letters of another script that look the same.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.plans.lineage import settled

# Letters of other scripts (first row) that look like the Latin letter below them (second row).
LOOKALIKES = [
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮ", "ABESIJKMHOPCTYXGQWY"),
    ("асԁеһіјӏорԛѕԝхуү", "acdehijlopqswxyy"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ονϳ", "ovj"),
    # Armenian
    ("օսհոցՕՍՏ", "ouhngOUS"),
    # Latin letters of phonetic alphabets
    ("ɑɡɩᴄᴏᴠᴡᴢ", "agicovwz"),
]
#: Confusable letters that show a difference (no dot, another arm), so they are not taken from the public data.
UNLIKE = "гᴦⲅꮁσιꭵ"
#: Scripts, by the first word of their letters' names, whose confusable letters are taken.
SCRIPTS = {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "ROMAN", "SMALL", "OLD", "DESERET"}
HYPHENS = "\u2010\u2011"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Format characters and fillers without a width of their own, beyond category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"

_CLUSTER = regex.compile(r"\X")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Regional_Indicator}\U0001F3FB-\U0001F3FF⃣]")
_PRESENTED = regex.compile(r"\p{Emoji_Presentation}")


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts that look like one plain letter of the same case, by the public data in the JVM.

    A letter whose prototype several plain letters share ("l" and "I" of letters without case) is a conflict and left out.
    Empty if this JVM carries no such data.
    """
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    except TypeError:
        return {}
    letters = [ch for code in range(0x80, 0x20000) if unicodedata.category(ch := chr(code)) in ("Lu", "Ll", "Lo", "Nl") and unicodedata.name(ch, "").split(" ")[0] in SCRIPTS and ch not in UNLIKE]
    plain = [chr(c) for c in range(0x80) if chr(c).isalpha()]
    shapes = dict(zip(letters + plain, checker.getSkeleton("\n".join(letters + plain)).split("\n"), strict=True))
    by_shape: dict[str, list[str]] = {}
    for ch in plain:
        by_shape.setdefault(shapes[ch], []).append(ch)
    found = {}
    for ch in letters:
        alike = [x for x in by_shape.get(shapes[ch], ()) if x.isupper() == ch.isupper() or not (ch.isupper() or ch.islower())]
        if len(alike) == 1:
            found[ch] = alike[0]
    return found


def compile_mapping(alike: dict[str, str] | None = None) -> dict[str, str]:
    """Characters and clusters to their form. A conflict (two forms, or a form that maps on) is an error.

    alike: look-alikes beyond our own list, which goes first where both name a letter.
    """
    table: dict[str, str] = {}

    def add(source: str, form: str) -> None:
        if source != form and table.setdefault(source, form) != form:
            raise ValueError(f"two forms for {source!a}")

    own = dict(pair for row in LOOKALIKES for pair in zip(*row, strict=True))
    accented: list[str] = []
    for code in range(0x110000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Co", "Cn"):
            continue
        apart = unicodedata.decomposition(ch)
        if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
            add(ch, " ")
        elif kind == "Cf" or ch in INVISIBLE or kind == "Cc":
            add(ch, "")
        elif apart.startswith(("<wide>", "<narrow>")) or ch == "µ" or (kind == "Nl" and apart.startswith("<compat>")):
            add(ch, unicodedata.normalize("NFKC", ch))
        elif apart and apart[0] != "<" and kind[0] == "L" and unicodedata.normalize("NFD", ch)[0].isascii():
            accented.append(ch)
    for ch in HYPHENS:
        add(ch, "-")
    for source, form in ((alike or {}) | own).items():
        if source not in table:
            add(source, form)
    for source, form in LIGATURES.items():
        add(source, form)
    # a wide letter of another script may have a look-alike form: follow to the end, then nothing maps on
    for source in list(table):
        table[source] = "".join(table.get(ch, ch) for ch in table[source])
    letters: dict[str, list[str]] = {}
    for source, form in table.items():
        letters.setdefault(form, []).append(source)
    for ch in accented:
        base, *marks = unicodedata.normalize("NFD", ch)
        for letter in [base, *letters.get(base, ())]:
            for order in itertools.permutations(marks):
                if unicodedata.normalize("NFC", base + "".join(order)) == ch:
                    add(letter + "".join(order), ch)
    # composed letters of other scripts go by their parts: a Cyrillic e with two dots is a Latin one
    for code in range(0x80, 0x20000):
        ch = chr(code)
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and apart in table and ch != table[apart]:
            add(ch, table[apart])
    if any(ch in table for form in table.values() for ch in form):
        raise ValueError("a form maps on to another one")
    return table


class Transducer:
    """Longest match: a whole grapheme cluster first, then its longest known parts."""

    def __init__(self, table: dict[str, str] | None = None) -> None:
        self.table = compile_mapping() if table is None else table
        self.widest = max(map(len, self.table))
        self.cluster = lru_cache(1 << 16)(self._cluster)
        self.text = lru_cache(1 << 14)(self._text)

    def _cluster(self, c: str) -> str:
        if (known := self.table.get(c)) is not None:
            return known
        if _PICTURE.search(c) and not c.isascii() and not c[0].isalnum():
            # joiners inside an emoji are part of the picture; at its end, and selectors that change nothing, are not
            c = c.rstrip("\u200d\u200b\u200c\u2060\ufeff")
            return "".join(ch for i, ch in enumerate(c) if not (ch == "\ufe0f" and _PRESENTED.match(c[i - 1] if i else "")) and ch not in "\u200b\u200c\u2060\ufeff\u00ad")
        if len(c) == 1 and (not unicodedata.decomposition(c) or unicodedata.decomposition(c)[0] == "<"):
            return c
        c = unicodedata.normalize("NFD", c)
        out, i = [], 0
        while i < len(c):
            n = next((n for n in range(min(self.widest, len(c) - i), 0, -1) if c[i : i + n] in self.table), 0)
            out.append(self.table[c[i : i + n]] if n else c[i])
            i += n or 1
        # clusters that no key holds whole (an accent after an invisible character) compose here
        return unicodedata.normalize("NFC", "".join(out))

    def _text(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return " ".join(text.split())
        form = "".join(map(self.cluster, _CLUSTER.findall(text)))
        return " ".join(unicodedata.normalize("NFC", form).split())

    def __call__(self, text: str | None) -> str | None:
        return None if text is None else self.text(text)


@lru_cache(2)
def transducer(table: tuple[tuple[str, str], ...]) -> Transducer:
    """One for each Python worker, whatever the number of its tasks."""
    return Transducer(dict(table))


_compiled: dict[str, tuple[tuple[str, str], ...]] = {}


def mapping(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """The compiled table, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _compiled:
        _compiled[app] = tuple(compile_mapping(confusables(spark)).items())
    return _compiled[app]


def canonical(texts: DataFrame, column: str, form: str = "form") -> DataFrame:
    """texts with the visible form of a column added; every other column stays.

    null stays null; a text without visible characters becomes an empty one; spaces at the ends vanish and a run of
    spaces counts as one; texts of any length are handled whole. A column named like form is replaced.
    """
    kept = [c for c in texts.columns if c != form]
    schema = texts.select(*kept).schema.add(form, "string")
    shared = texts.sparkSession.sparkContext.broadcast(mapping(texts.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = transducer(shared.value)
        for b in batches:
            b[form] = [convert(t) if isinstance(t, str) else None for t in b[column]]
            yield b

    return texts.select(*kept).mapInPandas(run, schema)


def look_same(messages: DataFrame, key: str, column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts are different strings but show the same.

    Forms are compared between distinct texts; only texts that have an equal-looking partner are joined back to their
    rows, so a text repeated a million times costs one comparison. Null keys and texts, and texts without visible
    characters, have no pair; repeated rows count once.
    """
    rows = messages.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("t")).distinct()
    distinct = settled(canonical(rows.select("t").distinct(), "t").where("form <> ''"))
    several = distinct.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    forms = distinct.join(several, "form", "left_semi")
    twins = forms.alias("a").join(forms.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.t") != F.col("b.t"))).select(F.col("a.t").alias("t"), F.col("b.t").alias("u"))
    found = twins.join(rows.select(F.col("id").alias("id_a"), "t"), "t").join(rows.select(F.col("id").alias("id_b"), F.col("t").alias("u")), "u")
    return found.where("id_a < id_b").select("id_a", "id_b").distinct()
