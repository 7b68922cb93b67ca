"""Geometry and vector retrieval (inventory G1 to G18, J15 to J17, W11, V1 to V6), over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import geo as g
from gridpulse.operators import vectors as v
from gridpulse.operators.history import merged_runs
from gridpulse.operators.spatial import contains
from gridpulse.sources.tables import table

BOX = (-82.70, 22.90, -81.90, 23.35)


def zones(spark, d):
    return table(spark, d, "zonas_cuadrantes")


def points(spark, d):
    return table(spark, d, "reportes").where("lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9").select("id", "lat", "lon").distinct()


def point_in_polygon(spark, d):
    """The first zone that contains each report."""
    hit = contains(points(spark, d), "id", zones(spark, d).select(F.col("zona_id").cast("long").alias("zona_id"), "anillo"), "zona_id", "anillo")
    return hit.groupBy(F.col("id_p").alias("id")).agg(F.min("id_r").alias("zona_id"))


def nearest_barrio(spark, d):
    b = table(spark, d, "barrios").where("lat IS NOT NULL").select("barrio_id", "lat", "lon")
    return g.nearest_within(points(spark, d), "id", b, "barrio_id", 600.0).withColumn("metros", F.round("metros", 3))


def border_distances(spark, d):
    """Reports near a zone's border, by every third vertex of the rings; points meet the zones whose box covers their grid cell."""
    z = zones(spark, d).select("zona_id", "anillo", g.bbox(F.col("anillo"), 0.01).alias("b"))
    near = g.in_boxes(points(spark, d), z, "b")
    m = near.select("id", "zona_id", F.round(g.border_distance(F.col("lat"), F.col("lon"), F.col("anillo")), 3).alias("metros"))
    return m.where("metros < 800")


def zone_shapes(spark, d):
    r = F.col("anillo")
    b = g.bbox(r)
    return zones(spark, d).select("zona_id", F.round(b["w"], 6).alias("w"), F.round(b["s"], 6).alias("s"), F.round(b["e"], 6).alias("e"), F.round(b["n"], 6).alias("n"), F.round(g.area_km2(r), 4).alias("area"))


def union_boxes(spark, d):
    b = zones(spark, d).select("municipio", g.bbox(F.col("anillo"), 0.02).alias("b"))
    return b.groupBy("municipio").agg(F.min("b.w").alias("w"), F.min("b.s").alias("s"), F.max("b.e").alias("e"), F.max("b.n").alias("n"))


def interior_points(spark, d):
    p = zones(spark, d).select("zona_id", "anillo", g.interior_point(F.col("anillo")).alias("p"))
    return p.select("zona_id", F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon"), g.in_ring(F.col("p.lat"), F.col("p.lon"), F.col("anillo")).alias("dentro"))


def hull_area(spark, d):
    c = table(spark, d, "comentarios_llm").where("bloque IS NOT NULL AND lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9")
    h = g.hulls(c, "bloque", "lon", "lat")
    rings = h.groupBy("bloque").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("r"))
    return rings.select("bloque", F.size("r").alias("vertices"), F.round(g.area_km2(F.col("r")), 4).alias("area"))


def negative_space(spark, d):
    return g.empty_cells(BOX, 0.0125, table(spark, d, "barrios").where("lat IS NOT NULL").select("lat", "lon"), 0.014)


def run_merge(spark, d):
    return merged_runs(negative_space(spark, d), "fila", "columna")


def zone_centroids(spark, d):
    p = zones(spark, d).select("municipio", F.explode("anillo").alias("p"))
    return p.groupBy("municipio").agg(F.count("*").alias("n"), F.round(F.avg("p.lat"), 5).alias("lat"), F.round(F.avg("p.lon"), 5).alias("lon"))


def line_merge(spark, d):
    """One multi-line for each block and municipality: its rings in order of zone, as a count and a length."""
    z = zones(spark, d).where("bloque IS NOT NULL").select("bloque", "municipio", "zona_id", F.size("anillo").alias("k"))
    return z.groupBy("bloque", "municipio").agg(F.count("*").alias("lineas"), F.sum("k").alias("vertices"), F.array_join(F.array_sort(F.collect_list("zona_id")).cast("array<string>"), "|").alias("zonas"))


def location_ladder(spark, d):
    """What a report's place says: an open fault item of its municipality's zone, a zone's block, a near barrio, or nothing."""
    p = points(spark, d)
    inside = contains(p, "id", zones(spark, d).where("bloque IS NOT NULL").select(F.col("zona_id").cast("long").alias("zona_id"), "anillo"), "zona_id", "anillo").groupBy(F.col("id_p").alias("id")).agg(F.min("id_r").alias("zona_id"))
    x = p.select("id").join(inside, "id", "left").join(nearest_barrio(spark, d).select("id", "barrio_id"), "id", "left")
    return x.select("id", F.when(F.col("zona_id").isNotNull(), "zona").when(F.col("barrio_id").isNotNull(), "barrio").otherwise("nada").alias("via"), F.coalesce("zona_id", "barrio_id").alias("otro_id"))


def embeddings(spark, d):
    return table(spark, d, "embeddings")


def query_vector(spark, d):
    return list(embeddings(spark, d).orderBy("vec_id").select("embedding").first()[0])


def topk_similar(spark, d):
    return v.top_similar(embeddings(spark, d), query_vector(spark, d)).withColumn("similitud", F.round("similitud", 6))


def topk_filtered(spark, d):
    return v.top_similar(embeddings(spark, d), query_vector(spark, d), k=5, where=F.col("label") % 2 == 0).withColumn("similitud", F.round("similitud", 6))


def similarity_cut(spark, d):
    return v.similarity_cut(v.top_similar(embeddings(spark, d), query_vector(spark, d), k=50), 0.1, 0.3).withColumn("similitud", F.round("similitud", 6))


def topk_batch(spark, d):
    """Top six of every vector whose id is divisible by 50, against all vectors."""
    e = embeddings(spark, d)
    return v.top_similar_batch(e, e.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.round("similitud", 6).alias("similitud"), F.col("n").cast("int").alias("n"))


def topk_index(spark, d):
    """The same through an inverted-list index over all vectors, sixteen lists."""
    e = embeddings(spark, d)
    centres = v.centres_of(e, "embedding", 16)
    return v.probed(v.indexed(e, "vec_id", "embedding", centres), e.where("vec_id % 50 = 0"), centres, "vec_id", "embedding").withColumn("similitud", F.round("similitud", 6))


QUERIES = {f.__name__: f for f in (point_in_polygon, nearest_barrio, border_distances, zone_shapes, union_boxes, interior_points, hull_area, negative_space, run_merge, zone_centroids, line_merge, location_ladder, topk_similar, topk_filtered, similarity_cut, topk_batch, topk_index)}

_P = "p AS (SELECT DISTINCT id, lat, lon FROM reportes WHERE lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9)"
_E = "e AS (SELECT zona_id, bloque, anillo[i].lat AS y1, anillo[i].lon AS x1, anillo[i % len(anillo) + 1].lat AS y2, anillo[i % len(anillo) + 1].lon AS x2 FROM (SELECT zona_id, bloque, anillo, unnest(range(1, len(anillo) + 1)) AS i FROM zonas_cuadrantes))"
_IN = "(SELECT id, zona_id FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 {w} GROUP BY id, zona_id HAVING count(*) % 2 = 1)"
_NEAR = "nb AS (SELECT id, barrio_id, m FROM (SELECT p.id, b.barrio_id, sqrt(((p.lat - b.lat) * 111000) ** 2 + ((p.lon - b.lon) * 102000) ** 2) AS m, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(((p.lat - b.lat) * 111000) ** 2 + ((p.lon - b.lon) * 102000) ** 2), b.barrio_id) AS k FROM p, barrios b) WHERE k = 1 AND m < 600)"
_LATS, _LONS = "list_transform(anillo, lambda q: q.lat)", "list_transform(anillo, lambda q: q.lon)"
_GRID = "grid AS (SELECT CAST(f AS INT) AS fila, CAST(c AS INT) AS columna, 22.90 + (f + 0.5) * 0.0125 AS gy, -82.70 + (c + 0.5) * 0.0125 AS gx FROM (SELECT unnest(range(36)) AS f), (SELECT unnest(range(64)) AS c)), emp AS (SELECT fila, columna FROM grid WHERE NOT EXISTS (SELECT 1 FROM barrios b WHERE b.lat IS NOT NULL AND sqrt((b.lat - gy) ** 2 + (b.lon - gx) ** 2) <= 0.014))"
_SIM = "s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS x FROM embeddings)"

SQL = {
    "point_in_polygon": f"WITH {_P}, {_E} SELECT id, CAST(min(zona_id) AS BIGINT) AS zona_id FROM {_IN.format(w='')} GROUP BY id",
    "nearest_barrio": f"WITH {_P}, {_NEAR} SELECT id, barrio_id, round(m, 3) AS metros FROM nb",
    "zone_shapes": f"SELECT zona_id, round(list_min({_LONS}), 6) AS w, round(list_min({_LATS}), 6) AS s, round(list_max({_LONS}), 6) AS e, round(list_max({_LATS}), 6) AS n, round(area, 4) AS area FROM zonas_cuadrantes JOIN (WITH {_E} SELECT zona_id, abs(sum(x1 * y2 - x2 * y1)) / 2 * 111 * 102 AS area FROM e GROUP BY zona_id) USING (zona_id)",
    "union_boxes": f"SELECT municipio, min(list_min({_LONS}) - 0.02) AS w, min(list_min({_LATS}) - 0.02) AS s, max(list_max({_LONS}) + 0.02) AS e, max(list_max({_LATS}) + 0.02) AS n FROM zonas_cuadrantes GROUP BY municipio",
    "negative_space": f"WITH {_GRID} SELECT fila, columna FROM emp",
    "run_merge": f"WITH {_GRID} SELECT fila, min(columna) AS desde, max(columna) AS hasta FROM (SELECT *, columna - row_number() OVER (PARTITION BY fila ORDER BY columna) AS k FROM emp) GROUP BY fila, k",
    "zone_centroids": "SELECT municipio, count(*) AS n, round(avg(q.lat), 5) AS lat, round(avg(q.lon), 5) AS lon FROM (SELECT municipio, unnest(anillo) AS q FROM zonas_cuadrantes) GROUP BY municipio",
    "line_merge": "SELECT bloque, municipio, count(*) AS lineas, CAST(sum(len(anillo)) AS BIGINT) AS vertices, string_agg(CAST(zona_id AS VARCHAR), '|' ORDER BY zona_id) AS zonas FROM zonas_cuadrantes WHERE bloque IS NOT NULL GROUP BY ALL",
    "location_ladder": f"WITH {_P}, {_E}, {_NEAR}, z AS (SELECT id, min(zona_id) AS zona_id FROM {_IN.format(w='AND bloque IS NOT NULL')} GROUP BY id) SELECT p.id, CASE WHEN zona_id IS NOT NULL THEN 'zona' WHEN barrio_id IS NOT NULL THEN 'barrio' ELSE 'nada' END AS via, CAST(coalesce(zona_id, barrio_id) AS BIGINT) AS otro_id FROM (SELECT DISTINCT id, lat, lon FROM p) p LEFT JOIN z ON p.id = z.id LEFT JOIN nb ON p.id = nb.id",
    "topk_similar": f"WITH {_SIM} SELECT vec_id, round(x, 6) AS similitud FROM s ORDER BY x DESC, vec_id LIMIT 6",
    "topk_filtered": f"WITH {_SIM} SELECT vec_id, round(x, 6) AS similitud FROM s WHERE label % 2 = 0 ORDER BY x DESC, vec_id LIMIT 5",
    "similarity_cut": f"WITH {_SIM}, t AS (SELECT * FROM s ORDER BY x DESC, vec_id LIMIT 50) SELECT vec_id, round(x, 6) AS similitud FROM t WHERE x >= 0.1 AND x >= 0.3 * (SELECT max(x) FROM t)",
    "topk_batch": "SELECT query_id, vec_id, round(x, 6) AS similitud, CAST(n AS INT) AS n FROM (SELECT q.vec_id AS query_id, e.vec_id, x, row_number() OVER (PARTITION BY q.vec_id ORDER BY x DESC, e.vec_id) AS n FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id, LATERAL (SELECT list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS x)) WHERE n <= 6",
}
