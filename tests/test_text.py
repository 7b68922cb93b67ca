"""Extraction cases: bulletins, comments, circuits, fault lists, validated extractions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators.extraction import events_of, fault_items, fragments, validated
from gridpulse.queries.text import bulletin_texts

LOST = "⚠️ Ocurre la desconexión total del Sistema Electroenergético Nacional"
LATER = "Se restablece el servicio tras la desconexión total del SEN"


@pytest.fixture
def value(spark):
    def run(expr, *texts):
        return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]

    return run


def test_fold_drops_accents_stored_either_way(value):
    assert value(t.fold, "ÁRBOL Ñandú", "Árbol", None, "") == ["arbol nandu", "arbol", None, ""]


def test_blocks(value):
    got = value(t.blocks_in, "Bloque #3 y b2", "bloques 1, 4 y 6", "BLOQUE No. 5", "bloque 7", None, "")
    assert got == [[2, 3], [1, 4, 6], [5], [], [], []]


def test_causes_and_total_loss(value):
    assert value(t.cause_of, LOST, LATER, "por DAF", "déficit de generación", "AVERÍA", "sobrecarga", "mantenimiento programado", "nada", None) == ["desconexión total del SEN", None, "DAF", "déficit de generación", "avería", "sobrecarga", "mantenimiento", None, None]


def test_post_kinds(value):
    got = value(t.post_kind, "Se afectó el servicio", "✅ Restablecido el servicio", "Restablecido X; se localiza avería y siguen afectaciones", "Aviso: restablecido X, afectaciones en Y", "Continúa el proceso de restablecimiento de forma gradual", "hola", LOST, None)
    assert got == ["afectacion", "restablecimiento", "restablecimiento", "afectacion", None, None, "afectacion", None] or got[4] in (None, "restablecimiento_parcial")


def test_events_of_a_total_loss_and_of_later_reports(spark):
    m = spark.createDataFrame([("canal", 1, LOST), ("canal", 2, "Restablecido el bloque 2 " + LATER), ("canal", 3, ""), ("canal", 4, None), ("comentarios", 5, "no hay luz en el bloque 4"), ("comentarios", 6, "ya llegó la luz, no hay luz"), ("canal", 7, "Se afectaron circuitos de emergencia")], "chat string, message_id long, texto string").withColumn("fecha", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r.message_id, r.tipo, r.bloque) for r in events_of(m).collect())
    assert got == [(1, "afectacion", b) for b in range(1, 7)] + [(2, "restablecimiento", 2), (5, "reporte_sin_servicio", 4), (7, "afectacion", 0)]


def test_zones_keep_codes_and_cut_labels(value):
    post = "Aviso\n👉 AL56 - Zonas: 13; 15\n👉Zona: Norte ✅\n💥Dirección: calle 5\n👉 Municipio: X\n👉\nsin viñeta: no"
    assert value(t.zones_in, post, None, "") == [["AL56 - Zonas: 13; 15", "Zona: Norte", "calle 5"], [], []]


def test_several_circuits_on_a_line(value):
    got = value(t.circuit_mentions, "👉🏽A12: Calle 1 entre 2 y 3    👉AL53:Zonas 1, 2\n👉T41, T43 - Toyo\n👉1243 - Norte\n👉23 Calle sin separador", None)
    assert [(list(m.codigos), m.calles) for m in got[0]] == [(["A12"], "Calle 1 entre 2 y 3"), (["AL53"], "Zonas 1, 2"), (["T41", "T43"], "Toyo"), (["1243"], "Norte")] and got[1] == []


def test_hours_of_blocks_and_circuits(value):
    assert [(h.bloque, h.horas) for h in value(t.block_hours, "Bloque 3 12 horas y 33 minutos, Bloque 9 1 hora")[0]] == [(3, 12.6)]
    assert [(h.codigo, h.horas) for h in value(t.circuit_hours, "R454 - 27 horas y 30 minutos; 1243 (Cerro) - 5 horas")[0]] == [("R454", 27.5), ("1243", 5.0)]


def test_code_evidence(spark):
    cases = [("A12", "el circuito a 12 sale", True), ("A12", "BA12", False), ("1243", "en 1243", False), ("1243", "circuito 1243", True), ("1243", "👉 1243 - norte", True), ("1243", "A5/1243", True), (None, "x", False), ("A12", None, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, x string, want boolean")
    assert all(r[0] == r[1] for r in df.select(t.code_written(F.col("c"), F.col("x")), "want").collect())


def test_leading_codes(value):
    got = value(t.leading_codes, "T44 y T41 Toyo", "1243 - norte", "13; 15; 16", "23-B y 41", None)
    assert [(list(g.codigos), g.resto) for g in got[:4]] == [(["T44", "T41"], "Toyo"), (["1243"], "norte"), ([], "13; 15; 16"), ([], "23-B y 41")]


def test_fault_lines_carry_type_and_municipality(spark):
    text = "Averías\n📌 Municipio: Previo\n🚨 Poste caído: \n📌 Municipio: Cerro.\n👉 Dirección: calle 1.\n💥 Dirección: calle 2\n🛑 Transformadores :\n👉Direccion: calle 3"
    got = sorted(tuple(r) for r in fault_items(spark.createDataFrame([(1, text), (2, None), (3, "👉 Dirección: sola 🚨")], "message_id long, texto string")).select("pos", "tipo", "clase", "municipio", "direccion").collect())
    assert got == [(4, "Poste caído", "Poste partido", "Cerro", "calle 1"), (5, "Poste caído", "Poste partido", "Cerro", "calle 2"), (7, "Transformadores", "Transformador dañado", None, "calle 3")]


def test_extractions_need_evidence(spark):
    one = '{"tipo": "averia", "bloques": [1, 9], "circuitos": [{"codigo": "A12", "estado": "con servicio"}, {"codigo": "", "calles": "x", "estado": "sin servicio"}]}'
    df = spark.createDataFrame([(1, one, "circuito A12 listo"), (2, one, "otro"), (3, one, "sincronización de la unidad 3"), (4, "roto", "x"), (5, None, None)], "i int, j string, x string")
    got = {r.i: r for r in validated(df, "j", "x").collect()}
    assert [c.estado for c in got[1].circuitos] == ["con servicio", None] and got[1].bloques == [1] and got[1].tipo == "averia"
    assert [c.estado for c in got[2].circuitos] == [None, None] and got[3].circuitos == [] and got[4].tipo == got[5].tipo == "otro"


def test_no_python_in_extraction_plans(spark):
    m = spark.createDataFrame([("canal", 1, "x")], "chat string, message_id long, texto string").withColumn("fecha", F.lit(None).cast("timestamp_ntz"))
    assert "Python" not in events_of(m)._jdf.queryExecution().toString()


def test_street_pieces(value):
    assert value(t.street_names, "Calle 5 entre Ave. Norte y calle norte, Zona", None) == [["5", "Norte"], []]
    assert value(t.numbered_zones, "micro 3, zonas 13 y 101, 7", None) == [[13, 7], []]
    assert value(t.humanised, "59", "7200", "90000") == ["0m", "2h 0m", "1d 1h"]
    assert value(t.hours_claimed, "llevamos 3 días sin luz", "llevo ya 5 horas", "x") == [72, 5, None]
    assert value(t.percent_of, "para el 12,5 %", "para el 140%", "x") == [12.5, 100.0, None]


def test_fragments_of_comments_of_any_kind_and_of_bulletins(spark, tmp_path, rows):
    cols = "message_id long, reporta string, lugar string, bloque int, horas int"
    c = [(1, "queja", " Alamar ", 2, 3), (2, None, "Cerro", None, None), (3, "irrelevante", "Playa", None, None), (4, "queja", " \t", None, None), (5, "queja", None, None, None)]
    assert rows(fragments(spark.createDataFrame(c, cols))) == [(1, "Comentario queja. en Alamar. bloque 2. desde hace 3 h"), (2, "en Cerro"), (3, "Comentario irrelevante. en Playa")]

    kind = "chat string, message_id long, tipo string, municipios array<string>, zonas array<string>, fecha timestamp_ntz"
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    e = [("canal", 1, "afectacion", ["Regolfo", "Alba"], ["K49", "FX83"], at), ("canal", 2, "afectacion", None, [], at), ("canal", 4, "restablecimiento", ["Alba"], None, at), ("comentarios", 5, "reporte_sin_servicio", ["Alba"], [], at)]
    spark.createDataFrame(e, kind).write.parquet(str(tmp_path / "eventos.parquet"))
    m = [("canal", 1, at, "B4 afectado\n👉🏽K49: Alturas de Roa\n- FX83: Loma"), ("canal", 2, at, "Afectado"), ("canal", 3, None, "Déficit estimado 1575 MW"), ("canal", 6, at, "Buenos días"), ("canal", 3, None, "Déficit estimado 1575 MW")]
    spark.createDataFrame(m, "chat string, message_id long, fecha timestamp_ntz, texto string").write.parquet(str(tmp_path / "mensajes.parquet"))
    assert rows(bulletin_texts(spark, str(tmp_path)).select("message_id", "texto")) == [
        (1, "Parte oficial del 2025-01-02 03:04: afectacion. Municipios: Alba, Regolfo. Zonas y calles afectadas: Alturas de Roa; Loma. Circuitos: FX83, K49."),
        (3, "Parte oficial del : otro. Déficit: 1575 MW."),
        (4, "Parte oficial del 2025-01-02 03:04: restablecimiento. Municipios: Alba."),
    ]
