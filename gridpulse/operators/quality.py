"""Data-quality checks (D1 to D11): each gives rows (control, clave, detalle) of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.geo import metres, nearest_within
from gridpulse.operators.spatial import contains

OWN_M, ANY_M, LINES_M = 800.0, 500.0, 3_000.0
REPAIR_S, ALARM_S = 2 * 3600, 26 * 3600


def finding(rows: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("control"), key.cast("string").alias("clave"), detail.cast("string").alias("detalle"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with the number of rows too many."""
    return finding(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "duplicado", F.col(key), F.col("n") - 1)


def unknown_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return finding(rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti"), "desconocido", F.col(key), F.lit("no está en el catálogo"))


def out_of_box(rows: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    w, s, e, n = box
    bad = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~(F.col("lat").between(s, n) & F.col("lon").between(w, e)))
    return finding(bad.select(key).distinct(), "fuera", F.col(key), F.lit("fuera de la ciudad"))


def invalid_values(rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    bad = rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(key, column).distinct()
    return finding(bad, "valor", F.col(key), F.concat(F.lit(f"{column}="), F.coalesce(F.col(column), F.lit("null"))))


def stale(rows: DataFrame, stamp: str, now: int, warn_s: int, what: str) -> DataFrame:
    """One row if the newest stamp (seconds) is older than the limit or missing."""
    age = rows.agg(F.max(stamp).alias("m")).where(F.col("m").isNull() | (F.lit(now) - F.col("m") > warn_s))
    return finding(age, "antiguo", F.lit(what), F.coalesce((F.lit(now) - F.col("m")).cast("string"), F.lit("sin datos")))


def repaired(cache: DataFrame, offending: DataFrame, key: str) -> DataFrame:
    """The cache without the keys of offending rows."""
    return cache.join(offending.select(key).distinct(), key, "left_anti")


def misplaced(points: DataFrame, regions: DataFrame, ring: str) -> DataFrame:
    """(control, id) of points outside their own municipality by more than OWN_M, or, without one, in none and more than ANY_M from all.

    points: id, lat, lon, municipio; regions: zona_id, municipio and a ring. The distance is that to the nearest vertex,
    looked up through grid cells as wide as the limit, so no point meets all vertices.
    """
    inside = contains(points, "id", regions, "zona_id", ring).join(regions.select(F.col("zona_id").alias("id_r"), "municipio"), "id_r").select(F.col("id_p").alias("id"), "municipio").distinct()
    vertices = regions.select("municipio", F.explode(ring).alias("v")).select("municipio", F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon")).distinct()
    known = regions.select("municipio").distinct()
    at_home = nearest_within(points, "id", vertices, "municipio", OWN_M, same="municipio").select("id").unionByName(inside.join(points.select("id", "municipio"), ["id", "municipio"]).select("id"))
    outside = points.join(known, "municipio", "left_semi").select("id").distinct().join(at_home, "id", "left_anti").select(F.lit("fuera de su municipio").alias("control"), "id")
    somewhere = nearest_within(points, "id", vertices, "municipio", ANY_M).select("id").unionByName(inside.select("id"))
    nowhere = points.join(known, "municipio", "left_anti").select("id").distinct().join(somewhere, "id", "left_anti").select(F.lit("fuera de la ciudad").alias("control"), "id")
    return outside.unionByName(nowhere)


def far_lines(rows: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, km) of rows whose lines' mean vertex is more than LINES_M from their point (lat, lon)."""
    n = F.nullif(F.size(lines), F.lit(0))
    mean = lambda f: F.aggregate(lines, F.lit(0.0), lambda s, p: s + p[f]) / n
    far = rows.where(n > 0).select(key, metres(mean("lat"), mean("lon"), F.col("lat"), F.col("lon")).alias("m")).where(F.col("m") > LINES_M)
    return far.select(key, F.round(F.col("m") / 1000, 1).alias("km")).distinct()


def age_level(age: Column) -> Column:
    return F.when(age.isNull(), "falta").when(age > ALARM_S, "alarma").when(age > REPAIR_S, "reparar").otherwise("bien")
