"""Visible forms: equal-looking texts agree, different-looking ones do not."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm.visible import LOOKALIKES, Transducer, canonical, compile_mapping, confusables, look_same, mapping, transducer

T = Transducer()


@pytest.mark.parametrize(
    "a, b",
    [("ｐｏｒ　ｑｕé？", "por qué?"), ("Señores, está", "Señores, está"), ("fíj‌ense en la", "fíjense en la"), ("Еn lа finса ѕerá", "En la finca será"), ("Μi repοrte", "Mi reporte"), ("Sen\u0303ores, esta\u0301", "Señores, está"), ("ﬁn", "fin"), ("a­b", "ab"), ("hօla", "hola"), ("😡​ ya", "😡 ya"), ("é‍", "é"), ("Ａ́", "Á"), ("А́", "Á"), ("​ x ﻿", "x")],
)
def test_same(a, b):
    assert T(a) == T(b)


@pytest.mark.parametrize("a, b", [("sí", "si"), ("Ya", "ya"), ("Nº", "No"), ("1", "l"), ("0", "O"), ("¿qué?", "qué?"), ("👨‍👩‍👧", "👨👩👧"), ("a b", "ab"), ("🙏", "🙏🙏"), ("б", "6"), ("ñ", "n")])
def test_different(a, b):
    assert T(a) != T(b)


@pytest.mark.parametrize("a, b", [("non\u2011stop", "non-stop"), ("a\u2010b", "a-b"), ("Ⅰ", "I"), ("ⅹ", "x"), ("Ⅻ", "XII"), ("\u00b5", "\u03bc"), ("ѵ", "v"), ("ᎪᏢ", "AP"), ("Ⲟ", "O"), ("ꓐꓳ", "BO"), ("е\u0308", "ë"), ("ё", "ë"), ("o\u0302\u0323", "ộ"), ("о\u0323\u0302", "ộ"), ("Ａ\u0301", "Á")])
def test_same_by_the_public_data(spark, a, b):
    t = transducer(mapping(spark))
    assert t(a) == t(b)


@pytest.mark.parametrize("a, b", [("Ⅰ", "l"), ("ꓲ", "l"), ("г", "r"), ("ι", "i"), ("–", "-"), ("’", "'"), ("٥", "o"), ("ë", "e"), ("Х", "x"), ("ı", "i"), ("𝐀", "A")])
def test_different_by_the_public_data(spark, a, b):
    t = transducer(mapping(spark))
    assert t(a) != t(b)


def test_public_data_makes_a_closed_table_with_whole_clusters(spark):
    table = dict(mapping(spark))
    assert not any(ch in table for form in table.values() for ch in form) and len(confusables(spark)) > 120
    assert sum(len(k) > 1 for k in table) > 2000 and table["о\u0301"] == table["ο\u0301"] == table["o\u0301"] == "ó"
    with pytest.raises(ValueError):
        compile_mapping({"ж": "щ", "щ": "ж"})  # a circle


def test_mapping_is_closed():
    table = compile_mapping()
    assert not any(ch in table for form in table.values() for ch in form) and all(len(a) == len(b) for a, b in LOOKALIKES)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_idempotent(text):
    assert T(T(text)) == T(text)


S = "message_id long, texto string, form string"


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    swaps = [lambda x: x.replace("o", "о"), lambda x: x.replace(" ", " "), lambda x: x.replace("a", "ａ"), lambda x: x + "\u200b", lambda x: x.replace("í", "í"), lambda x: x]
    base = ["sin luz aquí", "sin luz aqui", "otra vez", "", " ", "​"]
    data = [(i, rnd.choice(swaps)(rnd.choice(base)), "clash") for i in range(120)] + [(500, None, "c"), (None, "otra vez", "c"), (501, "x" * 200_000, "c"), (502, "x" * 200_000 + "​", "c")]
    T = transducer(mapping(spark))
    found = [tuple(r) for r in look_same(spark.createDataFrame(data + data[:10], S), "message_id", "texto").collect()]
    ok = [d for d in data if d[0] is not None and d[1] is not None and T(d[1])]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] != b[1] and T(a[1]) == T(b[1])}
    assert len(found) == len(set(found)) and set(found) == want and (501, 502) in want
    kept = canonical(spark.createDataFrame(data, S), "texto")
    assert kept.columns == ["message_id", "texto", "form"] and kept.count() == len(data)
    assert look_same(spark.createDataFrame([], S), "message_id", "texto").count() == 0
