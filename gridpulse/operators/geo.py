"""Geometry as higher-order expressions over rings (array of lon, lat), and grid joins.

Rings hold dozens of vertices, so expressions over one ring stay in the JVM; tables of rings are bounded by a city.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M_LAT, M_LON = 111_000.0, 102_000.0


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over the outer ring."""

    def crosses(p: Column) -> Column:
        y1, y2, x1, x2 = p["0"]["lat"], p["1"]["lat"], p["0"]["lon"], p["1"]["lon"]
        return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)

    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    return F.size(F.filter(pairs, crosses)) % 2 == 1


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy, dx = (lat1 - lat2) * M_LAT, (lon1 - lon2) * M_LON
    return F.sqrt(dy * dy + dx * dx)


def in_boxes(points: DataFrame, shapes: DataFrame, box: str, cell: float = 0.02) -> DataFrame:
    """Points (lat, lon) with the shapes whose box (w, s, e, n) holds them: an equi-join on grid cells, then the exact test."""
    p = points.withColumns({"__cy": F.floor(F.col("lat") / cell), "__cx": F.floor(F.col("lon") / cell)})
    b = F.col(box)
    rows, cols = F.sequence(F.floor(b["s"] / cell), F.floor(b["n"] / cell)), F.sequence(F.floor(b["w"] / cell), F.floor(b["e"] / cell))
    s = shapes.where(b["s"].isNotNull() & b["w"].isNotNull()).withColumn("__cy", F.explode(rows)).withColumn("__cx", F.explode(cols))
    return p.join(s, ["__cy", "__cx"]).where(F.col("lon").between(b["w"], b["e"]) & F.col("lat").between(b["s"], b["n"])).drop("__cy", "__cx")


def border_distance(lat: Column, lon: Column, ring: Column, step: int = 3) -> Column:
    """Metres to the nearest of every third vertex."""
    some = F.filter(ring, lambda p, i: i % step == 0)
    return F.array_min(F.transform(some, lambda p: metres(lat, lon, p["lat"], p["lon"])))


def bbox(ring: Column, pad: float = 0.0) -> Column:
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.struct((F.array_min(lons) - pad).alias("w"), (F.array_min(lats) - pad).alias("s"), (F.array_max(lons) + pad).alias("e"), (F.array_max(lats) + pad).alias("n"))


def area_km2(ring: Column) -> Column:
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, shifted, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(twice) / 2 * (M_LAT / 1000) * (M_LON / 1000)


def interior_point(ring: Column) -> Column:
    """(lat, lon) in the middle of the widest inner span at the mean latitude; null for fewer than three vertices."""
    lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.nullif(F.size(ring), F.lit(0))
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def cut(a: Column, b: Column) -> Column:
        return F.when((a["lat"] > lat) != (b["lat"] > lat), (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    xs = F.array_sort(F.array_compact(F.zip_with(ring, shifted, cut)))
    spans = F.transform(F.filter(xs, lambda x, i: i % 2 == 0), lambda x, i: F.struct((F.get(xs, 2 * i + 1) - x).alias("width"), ((F.get(xs, 2 * i + 1) + x) / 2).alias("lon")))
    widest = F.array_max(F.filter(spans, lambda s: s["width"].isNotNull()))
    return F.when(F.size(ring) >= 3, F.struct(lat.alias("lat"), widest["lon"].alias("lon")))


def hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, pos, x, y): vertices of each group's convex hull, counter-clockwise; groups of fewer than three points none.

    The hull of hulls is the hull: every task first reduces its own points, so no group travels as a whole.
    """
    kind = points.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby(key):
                h = convex_hull(list(zip(g[x], g[y])), least=1)
                yield pd.DataFrame({key: [k] * len(h), x: [p[0] for p in h], y: [p[1] for p in h]})

    def final(g: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(list(zip(g[x], g[y])))
        return pd.DataFrame({key: [g[key].iloc[0]] * len(h), "pos": range(len(h)), x: [p[0] for p in h], y: [p[1] for p in h]})

    clean = points.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return clean.mapInPandas(partial, f"{key} {kind}, {x} double, {y} double").groupBy(key).applyInPandas(final, f"{key} {kind}, pos int, {x} double, {y} double")


def convex_hull(points: list[tuple[float, float]], least: int = 3) -> list[tuple[float, float]]:
    """Andrew's monotone chain without collinear vertices; fewer than `least` distinct points give none."""
    unique = sorted(set(points))
    if len(unique) < max(least, 1):
        return []
    if len(unique) < 3:
        return unique

    def chain(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(unique) + chain(unique[::-1])


def nearest_within(points: DataFrame, key: str, targets: DataFrame, target_key: str, reach: float, same: str | None = None) -> DataFrame:
    """(key, target_key, metros): the nearest target within reach of each point, ties to the smaller key.

    same: a column of points that must equal the target's key.

    Both sides carry the cell of a grid as wide as the reach; targets are copied to the nine cells around, so the join is
    an equi-join on cells.
    """
    size_y, size_x = reach / M_LAT, reach / M_LON
    p = points.select(key, *([F.col(same).alias("__same")] if same else []), F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.floor(F.col("lat") / size_y).alias("cy"), F.floor(F.col("lon") / size_x).alias("cx"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = targets.select(target_key, F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.explode(around).alias("o"))
    q = q.select(target_key, "qlat", "qlon", (F.floor(F.col("qlat") / size_y) + F.col("o.i")).alias("cy"), (F.floor(F.col("qlon") / size_x) + F.col("o.j")).alias("cx"))
    met = p.join(q, ["cy", "cx"])
    met = met.where(F.col("__same") == F.col(target_key)) if same else met
    far = met.withColumn("metros", metres(F.col("plat"), F.col("plon"), F.col("qlat"), F.col("qlon"))).where(F.col("metros") < reach)
    return far.groupBy(key).agg(F.min(F.struct("metros", target_key)).alias("m")).select(key, F.col(f"m.{target_key}").alias(target_key), F.col("m.metros").alias("metros"))


def empty_cells(box: tuple[float, float, float, float], cell: float, points: DataFrame, clear: float) -> DataFrame:
    """(fila, columna) of grid cells in the box (w, s, e, n) whose centre is farther than clear degrees from every point.

    Points are bucketed by their grid position and copied only to the cells around, so the anti-join is an equi-join.
    """
    w, s, e, n = box
    rows, cols = round((n - s) / cell), round((e - w) / cell)
    spark = points.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("fila"), (F.col("id") % cols).cast("int").alias("columna"))
    grid = grid.withColumn("gy", s + (F.col("fila") + 0.5) * cell).withColumn("gx", w + (F.col("columna") + 0.5) * cell)
    ring = int(clear / cell) + 1
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)])
    spread = points.select("lat", "lon").distinct().select("lat", "lon", F.explode(around).alias("o"))
    spread = spread.select("lat", "lon", (F.floor((F.col("lat") - s) / cell) + F.col("o.i")).cast("int").alias("fila"), (F.floor((F.col("lon") - w) / cell) + F.col("o.j")).cast("int").alias("columna"))
    dy, dx = F.col("lat") - F.col("gy"), F.col("lon") - F.col("gx")
    taken = grid.join(spread, ["fila", "columna"]).where(F.sqrt(dy * dy + dx * dx) <= clear).select("fila", "columna").distinct()
    return grid.join(taken, ["fila", "columna"], "left_anti").select("fila", "columna")
