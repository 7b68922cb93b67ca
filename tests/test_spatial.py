"""Point and region search against brute force, with odd coordinates, repeats and empty tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridpulse.operators import geo
from gridpulse.operators.spatial import cells_of, chord, contains, kd_pieces, kd_splits, near, unit_vectors

P = "id long, lat double, lon double, extra string, cell long"


def points(n, seed, base=0):
    rnd = random.Random(seed)
    out = [(base + i, 23 + rnd.random() * 0.01, -82 + rnd.random() * 0.01, "x", 1) for i in range(n)]
    out += [(base + n + i, -82.0 + rnd.random() * 0.001, 23.0, "x", 1) for i in range(20)]
    out += [(base + n + 100, None, -82.0, "x", 1), (base + n + 101, float("nan"), 1.0, "x", 1), (base + n + 102, float("inf"), 1.0, "x", 1), (None, 23.0, -82.0, "x", 1)]
    out += [(base + n + 200 + i, 23.005, -81.995, "x", 1) for i in range(60)]
    return out + out[:5]


def good(ps):
    return {(i, a, b) for i, a, b, *_ in ps if i is not None and a is not None and abs(a) < 1e6}


def test_near_equals_brute_force(spark):
    a, b = points(150, 1), points(300, 2, 10_000)
    found = [tuple(r) for r in near(spark.createDataFrame(a, P), "id", spark.createDataFrame(b, P), "id", 40.0).collect()]
    cut = [tuple(r) for r in near(spark.createDataFrame(a, P), "id", spark.createDataFrame(b, P), "id", 40.0, cell_points=2).collect()]
    assert sorted(cut) == sorted(found)  # more cells than either side has points
    want = {(i, j) for i, x, y in good(a) for j, u, v in good(b) if ((x - u) * 111000) ** 2 + ((y - v) * 102000) ** 2 <= 1600}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 3000


def test_a_dense_spot_leaves_its_cell_in_pieces():
    xyz = unit_vectors(23 + np.arange(300) * 1e-7, np.full(300, -82.0))
    pieces = list(kd_pieces(xyz, xyz[::2], chord(40.0), piece=1000))
    assert len(pieces) > 3 and sorted((i, j) for a, b in pieces for i, j in zip(a.tolist(), b.tolist())) == [(i, j) for i in range(300) for j in range(150)]


def test_near_without_points(spark):
    none, some = spark.createDataFrame([], P), spark.createDataFrame(points(5, 1), P)
    assert near(none, "id", some, "id", 40.0).count() == 0 and near(some, "id", none, "id", 40.0).count() == 0


def test_every_close_pair_meets_in_a_cell():
    a = points(800, 4)
    xyz = unit_vectors(*(__import__("numpy").array([p[k] for p in a if p[1] is not None and abs(p[1]) < 1e6]) for k in (1, 2)))
    tree = kd_splits(xyz, 7)
    own, halo = cells_of(xyz, tree, 0.0), cells_of(xyz, tree, chord(40.0))
    home = dict(zip(own[0].tolist(), own[1].tolist()))
    reach = set(zip(halo[0].tolist(), halo[1].tolist()))
    assert len(home) == len(xyz) and len(set(home.values())) == 7
    for i in range(len(xyz)):
        for j in range(i):
            if ((xyz[i] - xyz[j]) ** 2).sum() ** 0.5 <= chord(40.0):
                assert (i, home[j]) in reach


def ring(*ps):
    return [(x, y) for x, y in ps]


def test_contains_equals_the_even_odd_rule(spark):
    rnd = random.Random(9)
    zones = [(k, [(rnd.random(), rnd.random()) for _ in range(rnd.randrange(3, 12))]) for k in range(30)]
    zones += [(90, zones[0][1] + zones[0][1][:1]), (91, [(0.1, 0.1), (0.9, 0.9)]), (92, [])]
    ps = [(i, rnd.random(), rnd.random()) for i in range(300)] + [(900, None, 0.5), (901, float("nan"), 0.5)]
    z = spark.createDataFrame(zones + [(93, None)], "zona long, anillo array<struct<lon double, lat double>>")
    found = [tuple(r) for r in contains(spark.createDataFrame(ps + ps[:3], "id long, lat double, lon double"), "id", z, "zona", "anillo").collect()]
    cut = [tuple(r) for r in contains(spark.createDataFrame(ps + ps[:3], "id long, lat double, lon double"), "id", z, "zona", "anillo", most=40).collect()]
    assert sorted(cut) == sorted(found)  # in several blocks

    def inside(lat, lon, r):
        odd = False
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {(i, k) for i, a, b in ps[:300] for k, r in zones if len(r) > 2 and inside(a, b, r)}
    assert len(found) == len(set(found)) and set(found) == want
    by_expression = spark.createDataFrame([(i, k, a, b, r) for i, a, b in ps[:40] for k, r in zones if len(r) > 2], "i long, k long, lat double, lon double, r array<struct<lon double, lat double>>")
    assert {tuple(x) for x in by_expression.where(geo.in_ring(F.col("lat"), F.col("lon"), F.col("r"))).select("i", "k").collect()} == {w for w in want if w[0] < 40}


def test_hull_contains_all_points_and_is_convex(spark):
    rnd = random.Random(2)
    ps = [(k, rnd.gauss(0, 1), rnd.gauss(0, 1)) for k in (1, 2) for _ in range(200)] + [(3, 1.0, 1.0), (3, 1.0, 1.0), (4, None, 1.0)]
    h = {}
    for k, pos, x, y in sorted(tuple(r) for r in geo.hulls(spark.createDataFrame(ps, "k int, x double, y double").repartition(5), "k", "x", "y").collect()):
        h.setdefault(k, []).append((x, y))
    assert set(h) == {1, 2}
    for k, vs in h.items():
        for (x1, y1), (x2, y2) in zip(vs, vs[1:] + vs[:1]):
            assert all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > -1e-9 for kk, x, y in ps if kk == k)


def test_nearest_within(spark, rows):
    rnd = random.Random(6)
    a = [(i, 23 + rnd.random() / 50, -82 + rnd.random() / 50) for i in range(80)]
    b = [(100 + i, 23 + rnd.random() / 50, -82 + rnd.random() / 50) for i in range(40)]
    found = {r[0]: r[1] for r in geo.nearest_within(spark.createDataFrame(a, "id long, lat double, lon double"), "id", spark.createDataFrame(b, "bid long, lat double, lon double"), "bid", 300.0).collect()}
    for i, x, y in a:
        d, j = min((((x - u) * 111000) ** 2 + ((y - v) * 102000) ** 2, k) for k, u, v in b)
        assert found.get(i) == (j if d < 90000 else None)
