"""Keyed writes, publication, post flow, quality checks and the stream limit on small made-up tables."""

import os

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import enrich
from gridpulse.operators import quality as q
from gridpulse.plans import lineage
from gridpulse.queries.analytics import people
from gridpulse.sources import ingest
from gridpulse.streaming import live


def test_registry_keeps_what_was_not_checked(spark, rows):
    stored = spark.createDataFrame([("a", 10, "x"), ("b", 10, "x"), ("c", 10, "x"), ("old", 1, "x"), ("none", None, "x")], "k string, t long, note string")
    checked = spark.createDataFrame([("a", 11, "y", True), ("b", 11, "y", False), ("new", 12, "y", True), ("fine", 12, "y", False), ("c", 9, "y", True), ("c", 12, "y", False)], "k string, t long, note string, wrong boolean")
    assert rows(ingest.registry(stored, checked, "k", "t", F.lit(5))) == [("a", 11, "y"), ("new", 12, "y")]
    assert rows(ingest.registry(stored, checked.limit(0), "k", "t", F.lit(5))) == [("a", 10, "x"), ("b", 10, "x"), ("c", 10, "x")]


def test_merge_takes_the_greatest_new_row(spark, rows):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 3), (3, "d", 1), (3, "d", 1)], "id int, v string, t int")
    assert rows(ingest.merged(stored, new, ["id"], ["t"])) == [(1, "a", 1), (2, "c", 3), (3, "d", 1)]
    assert rows(ingest.merged(stored, new, ["id"])) == [(1, "a", 1), (2, "z", 1), (3, "d", 1)]


def test_publish_replaces_and_recovers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    ingest.publish(spark.range(3), path)
    ingest.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    os.rename(tmp_path / "t", tmp_path / "t.old-1")  # a driver that died between the two renames
    assert ingest.recovered(spark, path) and spark.read.parquet(path).count() == 5 and not ingest.recovered(spark, path)


def test_accepted_posts(spark, rows):
    posts = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 10, 20, 30, 4000])] + [(None, 5, 9), ("b", 5, 8)], "ip string, t long, id int")
    got = ingest.accepted(posts, "ip", "t", "id", 3600, 3, "sal")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 4, 8] and all(len(r.ip) == 64 for r in got.collect())


def test_misplaced_points_and_far_lines(spark, rows):
    square = lambda y, x: [(x, y), (x + 0.01, y), (x + 0.01, y + 0.01), (x, y + 0.01)]
    regions = spark.createDataFrame([(1, "A", square(23.0, -82.0)), (2, "B", square(23.0, -81.9))], "zona_id long, municipio string, anillo array<struct<lon double, lat double>>")
    at = [(1, 23.005, -81.995, "A"), (2, 23.005, -81.895, "A"), (3, 23.0101, -81.995, "A"), (4, 22.5, -82.0, "Z"), (5, 22.5, -82.0, "B"), (6, 23.005, -81.995, "Z"), (7, 23.012, -81.99, None)]
    points = spark.createDataFrame(at, "id long, lat double, lon double, municipio string")
    assert rows(q.misplaced(points, regions, "anillo")) == [("fuera de la ciudad", 4), ("fuera de su municipio", 2), ("fuera de su municipio", 5)]
    lines = spark.createDataFrame([(1, 23.0, -82.0, square(23.0, -82.0)), (2, 23.0, -82.0, square(23.1, -82.0)), (3, 23.0, -82.0, [])], "id long, lat double, lon double, l array<struct<lon double, lat double>>")
    assert rows(q.far_lines(lines, "id", "l")) == [(2, 11.7)]


def test_ages_and_people(spark, rows):
    ages = spark.createDataFrame([(60,), (7201,), (93601,), (None,)], "a long")
    assert sorted(r[0] for r in ages.select(q.age_level(F.col("a"))).collect()) == ["alarma", "bien", "falta", "reparar"]
    assert rows(people(spark.createDataFrame([(51.0,)], "con_pct double"))) == [(51.0, 49.0, 892482, 857482)]


def test_rerank_is_bounded(spark, rows, monkeypatch):
    found = spark.createDataFrame([(i, "x" * i) for i in range(1, 6)], "id int, t string")
    assert [tuple(r) for r in enrich.reranked(found, lambda ts: [len(t) for t in ts], "id", "t", 2).collect()] == [(1, 5, 5.0), (2, 4, 4.0)]
    monkeypatch.setattr(enrich, "MOST_CANDIDATES", 3)
    with pytest.raises(ValueError):
        enrich.reranked(found, lambda ts: [0.0 for _ in ts], "id", "t")


def test_broadcasts_fall_back_and_blocks_are_whole(spark):
    df = spark.range(100).withColumn("s", F.lit("abc"))
    parts = lineage.blocks(df, F.length("s"), 50)
    assert len(parts) == 6 and sorted(r.id for p in parts for r in p.collect()) == list(range(100))
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(lineage.small(df, 100)).replace("UnresolvedHint", "ResolvedHint") and "Hint" not in plan(lineage.small(df, 2))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lineage, "is_local", lambda _: False)

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

        class sparkContext:
            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError):
        lineage.shared_folder(Unset)


def test_stream_limit_judges_a_sender_in_order_and_forgets_it(spark, tmp_path):
    posts = [(i, "a", 1_000_000 + 10 * i) for i in range(2000)] + [(5000 + i, "b", 1_000_000 + 5 * i) for i in range(10)]  # after 1970, where the watermark begins
    spark.createDataFrame(posts[::-1], "id long, ip string, t long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id long, ip string, t long").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = live.drained(live.rate_limited(s, "ip", "t", 600, 3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = set(), {}
    for i, ip, t in sorted(posts, key=lambda p: (p[2], p[0])):
        now = [h for h in held.get(ip, []) if h > t - 600]
        if len(now) < 3:
            want.add(i)
            now.append(t)
        held[ip] = now
    assert {r.id for r in got} == want and len(got) == len(want)
