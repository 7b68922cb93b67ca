"""Free-entered places against a reference list."""

import pytest

from gridpulse.llm.places import Places, mapped

ENTRIES = [(1, "Loma de Bicofalbón", "La Ondina"), (2, "Alturas de Bicofalbón", "La Ondina"), (3, "Villa Cojilrambre", "Bahía Corvina"), (4, "Trefirzerija", "Lagunera"), (5, "Trefirzerija Vieja", "Lagunera"), (6, "El Jorvomul", "Puerto Salvia"), (7, "Ampliación de Llutavedosa", "Lagunera"), (8, "Chotulbundo Viejo", None)]
P = Places(ENTRIES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Loma de Bicofalbón - La Ondina", 1), ("ALTS. BICOFALBON", 2), ("Bicofalbón", -1), ("Cojilrambre", 3), ("zona de Cojilramnre", 3), ("Alturas de Cojilrambre", -1),
        ("Trefirzerija Vja, Lagunera", 5), ("trefirzerija", 4), ("en Trefirzerrija", 4), ("el jorvomul (Puerto Salvia)", 6), ("El Jorvomul (La Ondina)", -1), ("Amp. de Lltavedosa", 7),
        ("rpto Loma de Bioffalbón", 1), ("Reparto Dicomnosa", -1), ("calle 58 y 138", -1), ("?", -1), ("la loma", -1), ("Chotulbundo", -1), ("  Ｌoma de Bicofalbon 😡", 1), ("x" * 50_000, -1),
    ],
)
def test_find(text, want):
    assert P.find(text) == want


def test_misspelt_values_of_entries_of_several_words_and_later_words():
    p = Places([*ENTRIES, (9, "Villa Palma Soriana", "Lagunera"), (11, "Soriana", "Lagunera")])
    assert p.find("zona de Palma Sorianna") == 9 and p.find("Palmas Sorianna, Lagunera") == 9 and p.find("Palma Sorianna (La Ondina)") == -1
    assert p.find("Alturas de Cojilramnre cerca de Trefirzerrija") == 4  # the first is not on the list, the second is


def test_token_sets_in_any_order_and_with_errors():
    p = Places([*ENTRIES, (20, "Los Pinos Nuevos", "Lagunera"), (21, "Santos Suárez", "La Ondina"), (22, "Alturas de Santos Suárez", "La Ondina"), (23, "Pinos Altos", "Lagunera")])
    for text in ("Los Pinos Nuebos", "Pinos Nuevos Los", "Pinos Nuevos", "nuevos pinos", "vivo en los pinos  nuevoz, Lagunera"):
        assert p.find(text) == 20, text
    for text in ("Santos Suares", "Suárez Santos", "por Suarez, Santos"):
        assert p.find(text) == 21, text
    assert p.find("Alturas de Santos Suares") == 22 and p.find("Pinos Altoz") == 23
    assert [p.find(x) for x in ("Pinos", "Santos", "Nuevos Santos", "Loma de Santos Suares", "Santos Suares, Lagunera")] == [-1] * 5
    assert p.scored(["nuevos", "pinoz"]) == [(-9, 0, 1, "los pinos nuevos")]


def test_a_list_beyond_the_bound_gives_the_same(spark, rows):
    entries = spark.createDataFrame([*ENTRIES, (20, "Los Pinos Nuevos", "Lagunera"), (21, "Santos Suárez", "La Ondina")], "barrio_id int, nombre string, municipio string")
    texts = ["Loma de Bicofalbón - La Ondina", "ALTS. BICOFALBON", "Bicofalbón", "zona de Cojilramnre", "El Jorvomul (La Ondina)", "en Trefirzerrija", "Trefirzerija Vja", "nadie", "Nuebos Pinos", "Suares Santos (Lagunera)", "Suares Santos"]
    v = spark.createDataFrame(list(enumerate(texts)) * 2, "message_id long, lugar string")
    assert rows(mapped(v, "message_id", "lugar", entries, most=2)) == rows(mapped(v, "message_id", "lugar", entries))


def test_mapped(spark, rows):
    entries = spark.createDataFrame(ENTRIES + ENTRIES[:1], "barrio_id int, nombre string, municipio string")
    data = [(1, "Cojilrambre", 9), (1, "Cojilrambre", 9), (2, None, 9), (3, "  ", 9), (4, "nadie sabe", 9), (None, "Cojilrambre", 9), (5, "nadie", 1), (5, "trefirzerija", 1)]
    v = spark.createDataFrame(data, "message_id long, lugar string, barrio_id int")
    assert rows(mapped(v, "message_id", "lugar", entries)) == [(1, 3), (4, -1), (5, 4)]
    assert rows(mapped(v, "message_id", "lugar", entries.limit(0))) == [(1, -1), (4, -1), (5, -1)]
    assert rows(mapped(v.limit(0), "message_id", "lugar", entries)) == []
