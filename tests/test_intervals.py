"""Running values, interval merging and outages against plain folds, with ties, nulls, repeats and empty tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridpulse.operators.history import declared_intervals, episodes, hours_by_day
from gridpulse.operators.intervals import outage_periods, periods_and_gaps
from gridpulse.operators.ordered import Running, bucket_of, running

EVENTS = "id long, chat string, message_id long, tipo string, bloque int, municipios array<string>, zonas array<string>, causa string, fecha timestamp_ntz, extra string, island long, open boolean"


def event(i, kind, minute, block=1, zones=("A1",), cause="DAF"):
    at = None if minute is None else dt.datetime(2025, 3, 1) + dt.timedelta(minutes=minute)
    return (i, "canal", i, kind, block, [], None if zones is None else list(zones), cause, at, "x", 7, True)


def seconds(minute):
    return int(dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc).timestamp()) + 60 * minute


def fold(events):
    """Outages, periods and gaps of a list of events, one after the other."""
    marks = {}
    for e in set((e[4], z, e[7], e[8], e[3]) for e in events if e[4] is not None and e[7] is not None and e[8] is not None for z in (e[6] or []) if z and z.strip()):
        marks.setdefault(e[:3], []).append((e[3], 0 if e[4] == "restablecimiento" else 1, e[4]))
    spans = {}
    for (block, circuit, _), ms in marks.items():
        start = None
        for at, _, kind in sorted(ms):
            if kind == "afectacion" and start is None:
                start = at
            elif kind == "restablecimiento" and start is not None and at > start:
                spans.setdefault((block, circuit), []).append((start, at))
                start = None
    out = set()
    for key, ss in spans.items():
        merged = []
        for a, b in sorted(ss):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        e = lambda x: int(x.replace(tzinfo=dt.timezone.utc).timestamp())
        out |= {(*key, "periodo", e(a), e(b)) for a, b in merged} | {(*key, "hueco", e(x[1]), e(y[0])) for x, y in zip(merged, merged[1:])}
    return out


def test_outages_equal_a_fold_on_random_events(spark, rows):
    rnd = random.Random(3)
    kinds = ["afectacion", "restablecimiento", "restablecimiento_parcial", "reporte_sin_servicio"]
    events = [event(i, rnd.choice(kinds), rnd.choice([None, *range(0, 9000, 7)]), rnd.choice([None, 0, 1]), rnd.choice([None, (), ("A1",), ("A1", "B2"), ("A1", "A1", " ")]), rnd.choice([None, "DAF", "avería"])) for i in range(1500)]
    found = rows(outage_periods(spark.createDataFrame(events + events[:50], EVENTS)))
    assert len(found) == len(set(found)) and set(found) == fold(events) and len(found) > 30


def test_touching_nested_and_single_outages(spark, rows):
    e = [event(1, "afectacion", 0), event(2, "restablecimiento", 10), event(3, "afectacion", 10, cause="avería"), event(4, "restablecimiento", 30, cause="avería"), event(5, "afectacion", 15, cause="x"), event(6, "restablecimiento", 20, cause="x"), event(7, "afectacion", 50), event(8, "restablecimiento", 60), event(9, "afectacion", 70)]
    assert rows(outage_periods(spark.createDataFrame(e, EVENTS))) == sorted([(1, "A1", "hueco", seconds(30), seconds(50)), (1, "A1", "periodo", seconds(0), seconds(30)), (1, "A1", "periodo", seconds(50), seconds(60))], key=repr)


def test_empty_events(spark, rows):
    assert rows(outage_periods(spark.createDataFrame([], EVENTS))) == []


def test_intervals_with_nulls_and_backward_ends(spark, rows):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 9, None), (1, 9, 3), (1, 3, 4), (1, 8, 9), (2, 1, 1)], "k int, desde long, hasta long")
    assert rows(periods_and_gaps(df, ["k"])) == [(1, "hueco", 5, 8), (1, "periodo", 0, 5), (1, "periodo", 8, 9), (2, "periodo", 1, 1)]


def test_running_values_equal_plain_windows(spark, rows):
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), i, rnd.randrange(400), rnd.choice([None, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame(data, "k string, id long, t long, v long").withColumn("b", bucket_of(F.col("t"), 37))
    for inclusive in (True, False):
        found = running(df, ["k"], "b", ["t", "id"], [Running("s", F.col("v"), "sum", inclusive), Running("m", F.col("v"), "max", inclusive), Running("l", F.col("v"), "last", inclusive)])
        want = set()
        for key in ("a", "b", None):
            seen = []
            for k, i, t, v in sorted((d for d in data if d[0] == key), key=lambda d: (d[2], d[1])):
                now = [x for x in (seen + [v] if inclusive else seen) if x is not None]
                want.add((k, i, t, v, sum(now), max(now) if now else None, now[-1] if now else None))
                seen.append(v)
        assert set(map(tuple, found.select("k", "id", "t", "v", "s", "m", "l").collect())) == want


def test_episodes_equal_a_fold(spark, rows):
    rnd = random.Random(8)
    data = sorted({(rnd.choice("ab"), rnd.randrange(500_000), rnd.randrange(20)) for _ in range(300)})
    want = set()
    for key in "ab":
        run, n = [], 0
        for _, t, v in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])):
            if run and v < run[-1][1]:
                want.add((key, n, run[0][0], run[-1][0], run[-1][1]))
                run, n = [], n + 1
            run.append((t, v))
        want.add((key, n, run[0][0], run[-1][0], run[-1][1]))
    found = episodes(spark.createDataFrame([*data, ("a", None, 3), ("b", 5, None)], "k string, t long, v int"), ["k"], "t", "v")
    assert set(rows(found)) == want


def test_declared_hours_over_the_end_of_summer_time(spark, rows):
    at = int(dt.datetime(2025, 11, 2, 12, tzinfo=dt.timezone.utc).timestamp())
    declared = spark.createDataFrame([(1, at, 10), (2, at + 3600, 1)], "bloque int, t long, horas long")
    days = {(b, str(day)): h for b, day, h in rows(hours_by_day(declared_intervals(declared, at + 7200)))}
    # block 1: eight hours before (no bulletin earlier), half an hour of tail; midnight of 2 November is 04:00 UTC
    assert days[(1, "2025-11-02")] == 8.5 and days[(2, "2025-11-02")] == 2.0
