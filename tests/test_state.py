"""Block state, overrides, status and rate limits against plain folds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridpulse.operators import state as s
from gridpulse.operators.history import first_seen, merged_runs, thinned
from gridpulse.operators.matching import contained_names, longest_name, token_matches

E = "id long, chat string, tipo string, bloque int, causa string, fecha timestamp_ntz"
NOW = dt.datetime(2025, 5, 5, 12)


def at(minutes):
    return NOW - dt.timedelta(minutes=minutes)


def test_block_state_equals_the_fold(spark):
    rnd = random.Random(4)
    kinds = ["afectacion", "restablecimiento", "restablecimiento_parcial", "reporte_sin_servicio"]
    for round_ in range(6):
        data = [(i, rnd.choice(["canal"] * 4 + ["comentarios"]), rnd.choice(kinds), rnd.choice([0, 1, 2, None]), rnd.choice(["x", "y", None]), at(rnd.randrange(0, 900, 5))) for i in range(rnd.randrange(0, 60))]
        found = {r.bloque: r for r in s.block_state(spark.createDataFrame(data, E), NOW).collect()}
        assert set(found) == set(range(7))
        for b in range(7):
            state = since = cause = out = partial = None
            for i, chat, kind, block, why, when in sorted(data, key=lambda r: (r[5], r[0])):
                if chat != "canal" or block != b or kind.startswith("reporte") or when < NOW - dt.timedelta(hours=12):
                    continue
                if kind == "restablecimiento_parcial":
                    if state is None:
                        state, since = "afectado", when
                    if state == "afectado":
                        partial = when
                    continue
                new = "afectado" if kind == "afectacion" else "restablecido"
                if new == "afectado":
                    out = when
                if state != new:
                    state, since = new, when
                cause, partial = why, None
            if partial is not None and partial < NOW - dt.timedelta(hours=5):
                partial = None
            e = lambda x: None if x is None else int(x.replace(tzinfo=dt.timezone.utc).timestamp())
            assert tuple(found[b]) == (b, state or "desconocido", e(since), cause, e(out), e(partial)), (round_, b)


def test_overrides(spark):
    st = spark.createDataFrame([(0, "afectado", 50, None, 50, None), (1, "restablecido", 10, None, None, None), (2, "afectado", 40, None, 40, None), (3, "restablecido", 200, None, None, None), (4, "afectado", 150, None, 150, None)], "bloque int, estado string, desde long, causa string, ult_afecta long, parcial long")
    told = spark.createDataFrame([(1, 0.01, 100), (3, 0.01, 100)], "bloque int, horas double, t long")
    got = {r.bloque: (r.estado, r.desde) for r in s.bulletin_override(st, told).collect()}
    assert got == {0: ("afectado", 50), 1: ("afectado", 64), 2: ("restablecido", 100), 3: ("restablecido", 200), 4: ("afectado", 150)}
    assert {r.bloque: (r.estado, r.desde) for r in s.bulletin_override(st, told.limit(0)).collect()}[2] == ("afectado", 40)
    nat = {r.bloque: (r.estado, r.desde) for r in s.national_override(st, 45).collect()}
    assert nat == {0: ("afectado", 50), 1: ("afectado", 45), 2: ("afectado", 40), 3: ("afectado", 45), 4: ("afectado", 45)}
    assert s.national_override(st, None) is st


def test_effective_status(spark):
    cases = [("con servicio", 100, "afectado", 200, "asum"), ("con servicio", 300, "afectado", 200, "con"), ("sin servicio", 100, None, None, "sin"), (None, None, "afectado", 1, "asum"), (None, None, None, None, "nd"), ("con servicio", -90000, None, None, "nd")]
    df = spark.createDataFrame(cases, "a string, t long, b string, d long, want string")
    got = df.select(s.effective_status(F.col("a"), F.col("t"), F.col("b"), F.col("d"), F.lit(400)).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_rejected_posts_do_not_count(spark):
    rnd = random.Random(1)
    data = sorted({(i, rnd.choice("ab"), rnd.randrange(0, 40_000, 13)) for i in range(200)})
    found = {r.id for r in thinned(spark.createDataFrame(data + [(999, None, 5)], "id long, k string, t long"), "k", "t", "id", 7200, 3).collect()}
    want = set()
    for key in "ab":
        held = []
        for i, _, t in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0])):
            held = [h for h in held if h > t - 7200]
            if len(held) < 3:
                held.append(t)
                want.add(i)
    assert found == want


def test_first_seen_and_runs(spark, rows):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 9), ("b", 1, 1)], "k string, t int, id int")
    assert rows(first_seen(df, ["k"], ["t", "id"])) == [("a", 1, 9), ("b", 1, 1)]
    cells = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 5), (1, 3)], "f int, c int")
    assert sorted(map(tuple, merged_runs(cells, "f", "c").select("f", "desde", "hasta").collect())) == [(0, 1, 2), (0, 5, 5), (1, 3, 3)]


def test_names_and_tokens(spark, rows):
    texts = spark.createDataFrame([(1, "En Alturas de Ñico, hoy"), (2, "alturas"), (3, None), (4, "ico nico")], "i long, x string")
    names = spark.createDataFrame([(10, "Alturas de Ñico"), (11, "Nico"), (12, "")], "b long, n string")
    found = contained_names(texts, "i", F.col("x"), names, "b", F.col("n"))
    assert rows(found.select("i", "b")) == [(1, 10), (1, 11), (4, 11)] and rows(longest_name(found, "i", "b")) == [(1, 10), (4, 11)]
    q = spark.createDataFrame([(1, "calle norte sur este"), (2, "norte"), (3, "norte sur")], "i long, x string")
    e = spark.createDataFrame([("A", "norte sur este"), ("B", "norte sur oeste alto bajo"), ("C", "")], "c string, y string")
    assert rows(token_matches(q, "i", F.col("x"), e, "c", F.col("y"))) == [(1, "A", 1.0), (3, "A", 1.0)]
    assert "Cartesian" not in token_matches(q, "i", F.col("x"), e, "c", F.col("y"))._jdf.queryExecution().toString()
