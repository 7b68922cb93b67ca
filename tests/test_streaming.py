"""Streams give the same in one batch as in many."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridpulse.queries import serving, text
from gridpulse.sources import ingest
from gridpulse.streaming import live


def test_one_batch_equals_many(spark, tmp_path, rows):
    data = [(i % 70, "ab"[i % 2], dt.datetime(2025, 1, 1) + dt.timedelta(minutes=3 * i)) for i in range(200)]
    spark.createDataFrame(data, "event_id long, event_type string, ts timestamp").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    want = {(i % 70, "ab"[i % 2]) for i in range(200)}
    tallies = []
    for files in (1, 100):
        s = live.stream_of(spark, str(tmp_path), "events", files)
        assert {tuple(r) for r in live.drained(live.deduplicated(s.select("event_id", "event_type"), "event_id")).collect()} == want
        tallies.append(rows(live.drained(live.hourly(live.stream_of(spark, str(tmp_path), "events", files), "ts", "event_type", "100 days"), "complete")))
    assert tallies[0] == tallies[1] and sum(r[2] for r in tallies[0]) == 200


def test_stream_extract_of_many_files_equals_batch(spark, tmp_path):
    """Files come newest first over years, so late batches hold old rows; some have no date, some come twice."""
    texts = ["Restablecido el servicio en el bloque 3", "Se afecta el bloque 2 por déficit", "No hay corriente en el bloque 1"]
    (tmp_path / "mensajes.parquet").mkdir()
    kind = pa.schema([("chat", pa.string()), ("message_id", pa.int64()), ("fecha", pa.timestamp("us")), ("texto", pa.string())])
    for n in range(40):
        ids = [*range(5 * n, 5 * n + 5), *([0, 5 * n - 1] if n else [])]
        found = [{"chat": "canal" if i % 3 < 2 else "comentarios", "message_id": i, "fecha": None if i % 5 == 4 else dt.datetime(2025, 1, 1) - dt.timedelta(days=9 * i), "texto": texts[i % 3]} for i in ids]
        path = str(tmp_path / f"mensajes.parquet/part-{n:05}.parquet")
        pq.write_table(pa.Table.from_pylist(found, kind), path)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    spark.createDataFrame([("Marianao",)], "municipio string").write.parquet(str(tmp_path / "barrios.parquet"))
    cut = lambda df: sorted(map(tuple, df.select("chat", "tipo", "bloque", "causa", "n").collect()), key=repr)
    got = cut(serving.stream_extract(spark, str(tmp_path)))
    assert got == cut(text.extract_events(spark, str(tmp_path))) and sum(r[4] for r in got) == 200


def test_stream_rate_limit(spark, tmp_path):
    for n, part in enumerate([[("a", 10), ("a", 20), ("b", 5)], [("a", 30), ("a", 40), ("a", 7300)]]):
        spark.createDataFrame(part, "k string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "posts.parquet"))
    s = live.rate_limited(live.stream_of(spark, str(tmp_path), "posts", 100), "k", "t", 7200, 3)
    assert sorted(map(tuple, live.drained(s).collect())) == [("a", 10), ("a", 20), ("a", 30), ("a", 7300), ("b", 5)]


def test_ingestion(spark, tmp_path, rows):
    m = spark.createDataFrame([("c", 1), ("c", 5), ("d", 2)], "chat string, message_id long")
    assert rows(ingest.pull_new(m, m.where("chat = 'c' AND message_id = 1"))) == [("c", 5), ("d", 2)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (2, "z"), (3, "w")], "k int, v string")
    assert rows(ingest.merged(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]
    path = str(tmp_path / "t")
    assert ingest.read_or_empty(spark, path, a.schema).count() == 0
    ingest.publish(a, path)
    ingest.publish(b, path)
    assert ingest.read_or_empty(spark, path, a.schema).count() == 3
    assert ingest.record(None, 3) == 3 and ingest.record(5, 3) == 5
    shapes = spark.createDataFrame([("z", [(1.0, 2.0), (3.0, 4.0)])], "name string, ring array<struct<lon double, lat double>>")
    (tmp_path / "g.json").write_text('{"features": [%s]}' % ingest.to_features(shapes, "name", "ring").first()[0])
    assert ingest.features(spark, str(tmp_path / "g.json"), "name").first().ring[1].lat == 4.0
    posts = spark.createDataFrame([(23.0, -82.0, "zz", "d" * 200), (1.0, 1.0, "sin", None)], "lat double, lon double, tipo string, direccion string")
    assert [(r.tipo, len(r.direccion)) for r in ingest.valid_reports(posts).collect()] == [("sin", 140)]
    assert ingest.valid_suggestions(spark.createDataFrame([("abc", "x"), ("abcdef", "y")], "titulo string, detalle string")).count() == 1
