"""Addresses: parsing, missing components, typing errors, and pairs against brute force."""

import random

import pytest

from gridpulse.llm.addresses import Parser, distance, same_location, spelling

BARRIOS = [(1, "Alturas de Levimino", "Villa Turmes"), (2, "Levimino", "Villa Turmes"), (3, "Barrio Fafirena", "San Odilo"), (4, "Trefirzerija Vieja", "Lagunera"), (5, "Trefirzerija", "Lagunera")]
PARSER = Parser([b[1:] for b in BARRIOS])
R = "id long, direccion string, town string, extra string, street string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Calle 141 #2153, Alturas de Levimino", ("house", "141", "2153", None, "villa turmes")),
        ("No. 8966 de C. Rusnisibosa, mun. San Odilo", ("house", "rusnisibosa", "8966", None, "san odilo")),
        ("C/ 48 NO495 CASI ESQ. CLL. 4 VILLA TURMES", ("house", "48", "495", None, "villa turmes")),
        ("Grazumales, # 4024, rpto Fafirenna", ("house", "grazumales", "4024", None, "san odilo")),
        ("Zondindente 3997, municipio Lagunera. Urgente", ("house", "zondindente", "3997", None, "lagunera")),
        ("esq. C. 23 con Callejón Borgamrena", ("corner", "23", None, "borgamrena", None)),
        ("CALLE 142 C/ CALLEJON BENMINTERA", ("corner", "142", None, "benmintera", None)),
        ("Brorjalazgo esq a 167 frente al parque", ("corner", "167", None, "brorjalazgo", None)),
        ("Edif. 64, Zna. 17; Trefirzerija Vja.", ("building", "zona 17", "64", None, "lagunera")),
        ("Ｃalle 12​ nº 7", ("house", "12", "7", None, None)),
    ],
)
def test_components(text, want):
    got = PARSER.parse(text)
    assert tuple(got[k] for k in ("kind", "street", "number", "other", "town")) == want


@pytest.mark.parametrize("text", [None, "", "  ", "aquí", "Calle 161", "C. 4 desde 8 hasta 10", "calle 4 entre 8 y 10", "Reparto Levimino", "San Odilo", "Circuito SA810", "edif 4 zona 5", "s/n", "urgente", ",;.#"])
def test_no_location(text):
    assert PARSER.parse(text) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("Calle Santa Clara # 12", ("house", "santa clara", "12")), ("Calle San Rafael # 12", ("house", "san rafael", "12")), ("Calle Luz # 5", ("house", "luz", "5")), ("Luz No. 5", ("house", "luz", "5")),
        ("Calle 5 # 12A", ("house", "5", "12a")), ("calle 5 no 12-B", ("house", "5", "12b")), ("Calle 5 A # 12", ("house", "5a", "12")), ("Calle 5a # 12", ("house", "5a", "12")), ("c/ 5 12c, San Odilo", ("house", "5", "12c")),
        ("San Rafael esq. Santa Rosa", ("corner", "san rafael", None)), ("calle 5 y A", None), ("calle 12 e/ 3 y 5", None),
    ],
)
def test_names_of_several_words_of_any_length_and_letters(text, want):
    got = PARSER.parse(text)
    assert (got and tuple(got[k] for k in ("kind", "street", "number"))) == want


def test_neighbourhoods_of_several_words():
    p = Parser([("Los Pinos Nuevos", "San Odilo"), ("Santos Suárez", "Lagunera")])
    a, b = p.parse("Edif. 4 zona 2, Los Pinos Nuevos"), p.parse("zona 2 edif 4 rpto los pinos nuebos")
    assert a == b and (a["kind"], a["barrio"], a["town"]) == ("building", "los pinos nuevos", "san odilo")


def test_same_barrio_stem_with_another_word_is_another_place():
    a, b = PARSER.parse("Edif 1 zona 2 Trefirzerija Vieja"), PARSER.parse("Edif 1 zona 2 Trefirzerija")
    assert a["barrio"] != b["barrio"]


def test_distance():
    assert [distance(*p) for p in (("abc", "abc"), ("abcd", "abdc"), ("abcd", "abxcd"), ("abcd", "axyd"), ("abcdef", "ab"))] == [0, 1, 1, 2, 3]


def test_spelling_prefers_the_frequent_name(spark):
    names = spark.createDataFrame([("borgamrena", 30), ("borgamrna", 2), ("borgmarena", 1), ("borgmarna", 1), ("zondindente", 4), ("abcd", 9), ("abce", 1)], "name string, n long")
    got = dict(tuple(r) for r in spelling(names).collect())
    assert got["borgamrna"] == got["borgmarena"] == got["borgmarna"] == "borgamrena" and set(got) == {"borgamrna", "borgmarena", "borgmarna"}


def test_streets_a_letter_apart_stay_two_if_both_are_in_use(spark):
    names = spark.createDataFrame([("rosales", 30), ("rosalez", 11), ("rosals", 10), ("mirasol", 8), ("mirasor", 7), ("nogales", 2), ("nogalez", 1)], "name string, n long")
    assert {tuple(r) for r in spelling(names).collect()} == {("rosals", "rosales"), ("nogalez", "nogales")}


def found(spark, records, most=50_000):
    g = spark.createDataFrame(BARRIOS, "barrio_id int, nombre string, municipio string")
    return [tuple(r) for r in same_location(spark.createDataFrame(records, R), g, most).collect()]


def test_a_type_tells_streets_apart_where_several_are_in_use(spark):
    texts = ["Calle 5 # 12", "C/ 5 no 12", "Avenida 5 # 12", "Ave. 5 num. 12", "5 # 12", "Calle 5 # 12", "Paseo Rusnisibosa 3", "Rusnisibosa 3", "Calle 5 # 12A", "Calle 5 # 12B", "Calle 5 A # 12", "Calle Santa Clara # 12", "Calle Santa Rosa # 12"]
    got = set(found(spark, [row(i, x + ", San Odilo") for i, x in enumerate(texts)]))
    calle = {0, 1, 4, 5}
    assert got == {(a, b) for a in calle for b in calle if a < b} | {(2, 3), (6, 7)}


def test_a_gazetteer_beyond_the_bound_gives_the_same(spark):
    texts = ["Edif 4 zona 2, Alturas de Levimino", "zona 2 ed. 4 rpto Alts. Levimno", "edif 4 zona 2 Levimino", "Calle 5 # 10, Barrio Fafirenna", "5 no 10 mun. San Odilo", "5 no 10 Lagunra", "Calle 5 # 10, Trefirzerija Vja", "Calle 9 # 4"]
    records = [row(i, x, "San Odilo" if i == 7 else None) for i, x in enumerate(texts)] + [row(8, "c. 9 #4", "san odilo")]
    assert sorted(found(spark, records, most=2)) == sorted(found(spark, records)) and len(found(spark, records)) == 4


def row(i, text, town=None):
    return (i, text, town, "x", "clash")


def test_missing_parts(spark):
    records = [
        row(1, "Calle 5 #10 e/ 7 y 9, mun. San Odilo"), row(2, "5 no. 10, Barrio Fafirena"), row(3, "Calle 5 # 10 Lagunera"),
        row(4, "Calle 5 #10 entre 7 y 9"), row(5, "c/ 5 10 entre 20 y 22"), row(6, "Calle 5 # 11 San Odilo"), row(7, "calle 5 #10", "San Odilo"),
        row(8, "Avenida Zondindente 3 entre 1 y 2"), row(9, "Zondindete # 3 e/1 y 2"), row(10, "Zondindente 3 e/ 50 y 52"),
        row(11, None), (None, "Calle 5 #10, San Odilo", None, "x", "c"), row(12, "x" * 100_000), row(1, "Calle 5 #10 e/ 7 y 9, mun. San Odilo"),
    ]
    got = found(spark, records)
    assert len(got) == len(set(got))
    # 4 shares a cross street with the one in San Odilo; 5 names others, so only the one in Lagunera is left
    assert set(got) == {(1, 2), (1, 4), (1, 7), (2, 4), (2, 7), (3, 5), (4, 7), (8, 9)}


def test_empty(spark):
    assert found(spark, []) == []


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(1)
    towns, types, marks = ["San Odilo", "Lagunera"], ["Calle", "C/", "cll.", ""], ["#", "No.", "núm.", "nº"]
    truth, records = {}, []
    for i in range(200):
        street, number, town = rnd.choice(["12", "14", "Rusnisibosa", "Grazumales"]), rnd.randrange(1, 9), rnd.choice(towns)
        parts = [f"{rnd.choice(types)} {street} {rnd.choice(marks)} {number}", f"{rnd.choice(['mun.', 'municipio', ''])} {town}"]
        rnd.shuffle(parts)
        text = rnd.choice([", ", "; ", ". "]).join(parts)
        records.append(row(i, text.upper() if rnd.random() < 0.3 else text))
        truth[i] = (street, number, town)
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert set(found(spark, records)) == want


def test_neighbourhood_of_several_words_with_a_typing_error():
    p = Parser([*(b[1:] for b in BARRIOS), ("Palma Soriana", "Lagunera")])
    for text in ("Edif 1 zona 2 Palma Soriana", "Edif 1 zona 2 Palma Sorianna", "Edif 1, zona 2, reparto Palmma Sorianna"):
        got = p.parse(text)
        assert (got["kind"], got["barrio"], got["town"]) == ("building", "palma soriana", "lagunera"), text


@pytest.mark.parametrize("text, street, number", [("General Lee 12", "general lee", "12"), ("San Rafael No 12", "san rafael", "12"), ("General Lee No 12", "general lee", "12"), ("Calle General Paz, No. 12, Villa Turmes", "general paz", "12"), ("Grazumales, 4024", "grazumales", "4024")])
def test_all_words_of_a_street_name_count(text, street, number):
    got = PARSER.parse(text)
    assert (got["kind"], got["street"], got["number"]) == ("house", street, number)
