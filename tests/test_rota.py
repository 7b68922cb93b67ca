"""Weekly rota and enrichment cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import enrich, rota
from gridpulse.queries import more, serving

M = "message_id long, fecha timestamp_ntz, texto string"
LEAD = "Los circuitos designados para DAF serán rotados cada viernes.\n"


def one(spark, posts, today):
    r = rota.current_rota(rota.weekly_rotas(spark.createDataFrame(posts, M)), today).collect()
    return (str(r[0].desde), str(r[0].hasta), list(r[0].circuitos), r[0].vigente) if r else None


def test_two_periods(spark):
    text = LEAD + "🛑DAF: desde el viernes 3 hasta el jueves 9 de abril.\n👉K55: Zona 1\n🛑DAF: desde el viernes 10 hasta el jueves 16 de abril.\n👉K52: Zona 2\n👉R46: Sur\nC8 : Norte y Oeste\n👉K52: otra vez"
    assert one(spark, [(1, dt.datetime(2026, 4, 10), text)], dt.date(2026, 4, 12)) == ("2026-04-10", "2026-04-16", ["K52", "R46", "C8"], True)
    assert one(spark, [(1, dt.datetime(2026, 4, 10), text)], dt.date(2026, 4, 4))[:2] == ("2026-04-03", "2026-04-09")
    assert one(spark, [(1, dt.datetime(2026, 4, 10), text)], dt.date(2026, 6, 1)) == ("2026-04-10", "2026-04-16", ["K52", "R46", "C8"], False)


def test_month_and_year_crossings(spark):
    post = lambda line: [(1, dt.datetime(2026, 1, 1), LEAD + line + "\n👉H34: Este")]
    assert one(spark, post("DAF: viernes 26 al jueves 1 de enero"), dt.date(2026, 1, 1))[:2] == ("2025-12-26", "2026-01-01")
    assert one(spark, post("DAF: hasta el jueves 8 de enero"), dt.date(2026, 1, 3))[:2] == ("2026-01-02", "2026-01-08")
    assert one(spark, post("DAF: viernes 26 de diciembre al jueves 1 de enero"), dt.date(2026, 1, 1))[:2] == ("2025-12-26", "2026-01-01")


def test_nothing(spark):
    assert one(spark, [(1, dt.datetime(2026, 1, 1), LEAD + "DAF: hasta el jueves 40 de enero\n👉H34: x"), (2, None, LEAD), (3, dt.datetime(2026, 1, 1), None)], dt.date(2026, 1, 1)) is None


def test_embedding_only_what_changed(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id long, texto string")
    stored = f.where("id = 1").select("id", F.sha1("texto").alias("hash"))
    assert [(r.id, list(r.embedding)) for r in enrich.embedded(f, stored, lambda xs: [[1.0, 2.0]] * len(xs), 2).collect()] == [(2, [1.0, 2.0])]
    with pytest.raises(Exception, match="another number or width"):
        enrich.embedded(f, stored, lambda xs: [[1.0]] * len(xs), 2).collect()


def test_every_document_without_its_current_vector_is_pending(spark, tmp_path, rows):
    """Stored as it is: 2 and 5; stored by another text: 3 and 4; not stored: 1 and 6; no text: 8; length unknown: 10."""
    docs = [(1, "aa", "x", 2), (2, "bb", "x", 2), (3, "cc", "parte_oficial", 9), (4, "dddd", "x", 2), (5, "ee", "parte_oficial", 2), (6, "ff", "parte_oficial", 2), (8, None, "x", 1), (10, "gg", "x", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0]) for i in (2, 3, 4, 5, 8, 10, 99)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = more.pending_embeddings(spark, str(tmp_path))
    assert rows(got.select("id", "ancho")) == sorted([(i, 5) for i in (1, 3, 4, 6, 10)], key=repr)
    assert got.where("id = 3").first().hash == "bdb480de655aa6ec75ca058c849c4faf3c0f75b1"


def test_upsert_merges_the_newest_half(spark, tmp_path, rows):
    at = lambda day: dt.datetime(2025, 1, day)
    data = [(2, at(1), "sin", "x"), (4, at(2), "sin", "x"), (3, at(3), "sin", "x"), (5, at(4), "sin", None), (5, at(4), "sin", None), (6, None, "sin", "x")]
    spark.createDataFrame(data, "id long, fecha timestamp_ntz, tipo string, direccion string").write.parquet(str(tmp_path / "reportes.parquet"))
    assert rows(serving.upsert(spark, str(tmp_path))) == [(2, "sin"), (3, "con"), (4, "sin"), (5, "con"), (6, "sin")]


def test_rerank_and_due(spark, rows):
    f = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "cc"), (4, "dddd")], "id long, x string")
    assert rows(enrich.reranked(f, lambda xs: [float(len(x)) for x in xs], "id", "x")) == [(1, 4, 4.0), (2, 1, 2.0), (3, 3, 2.0)]
    want, cache, tried = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string"), spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b", 3), ("c", 2)], "k string, n int")
    assert rows(enrich.due(want, cache, tried, "k")) == [("c",)]


def test_only_a_rota_in_force_marks_circuits(spark, rows):
    from gridpulse.operators.rota import flagged

    catalog = spark.createDataFrame([("AB1", 1), ("CD2", 2)], "codigo string, veces int")
    current = lambda live: spark.createDataFrame([(["AB1", "AB1", "XX9"], live)], "circuitos array<string>, vigente boolean")
    assert rows(flagged(catalog, current(True))) == [("AB1", 1, True), ("CD2", 2, False)]
    assert rows(flagged(catalog, current(False))) == rows(flagged(catalog, current(True).limit(0))) == [("AB1", 1, False), ("CD2", 2, False)]
