"""Queries of the general training-data problems (3 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.operators.intervals import outage_periods
from gridpulse.operators.spatial import contains, near
from gridpulse.sources.tables import table

METRES = 40.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return outage_periods(table(spark, d, "eventos"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reportes").select("id", "lat", "lon")
    comments = table(spark, d, "comentarios_llm").select("message_id", "lat", "lon")
    close = near(reports, "id", comments, "message_id", METRES).select(F.lit("cerca").alias("relacion"), F.col("id_q").alias("reporte_id"), F.col("id_p").alias("otro_id"))
    zones = table(spark, d, "zonas_cuadrantes").select(F.col("zona_id").cast("long").alias("zona_id"), "anillo")
    inside = contains(reports, "id", zones, "zona_id", "anillo").select(F.lit("dentro").alias("relacion"), F.col("id_p").alias("reporte_id"), F.col("id_r").alias("otro_id"))
    return close.unionByName(inside)


QUERIES = {"p3_found": p3_found, "p6_found": p6_found}

SQL = {
    "p3_found": """
WITH marks AS (
  SELECT bloque, circuito, causa, t, bool_or(tipo = 'afectacion') AS falls, bool_or(tipo = 'restablecimiento') AS returns
  FROM (SELECT bloque, causa, tipo, CAST(epoch(date_trunc('second', fecha)) AS BIGINT) AS t, unnest(list_distinct(zonas)) AS circuito FROM eventos
        WHERE bloque IS NOT NULL AND causa IS NOT NULL AND fecha IS NOT NULL AND tipo IN ('afectacion', 'restablecimiento'))
  WHERE trim(circuito) <> '' GROUP BY ALL),
state AS (SELECT *, coalesce(lag(falls) OVER k, false) AS open FROM marks WINDOW k AS (PARTITION BY bloque, circuito, causa ORDER BY t)),
turns AS (SELECT *, returns AND open AS ends, falls AND (returns OR NOT open) AS starts FROM state),
numbered AS (SELECT *, coalesce(sum(CAST(starts AS INT)) OVER (PARTITION BY bloque, circuito, causa ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM turns WHERE ends OR starts),
ended AS (
  SELECT s.bloque, s.circuito, s.t AS desde, e.t AS hasta FROM numbered s JOIN numbered e
  ON s.bloque = e.bloque AND s.circuito = e.circuito AND s.causa = e.causa AND s.starts AND e.ends AND s.begun + 1 = e.begun),
seen AS (SELECT *, max(hasta) OVER (PARTITION BY bloque, circuito ORDER BY desde, hasta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ended),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR desde > reach THEN 1 ELSE 0 END) OVER (PARTITION BY bloque, circuito ORDER BY desde, hasta ROWS UNBOUNDED PRECEDING) AS n FROM seen),
periods AS (SELECT bloque, circuito, n, min(desde) AS desde, max(hasta) AS hasta FROM islands GROUP BY ALL)
SELECT bloque, circuito, 'periodo' AS clase, desde, hasta FROM periods
UNION ALL
SELECT bloque, circuito, 'hueco' AS clase, hasta AS desde, siguiente AS hasta
FROM (SELECT *, lead(desde) OVER (PARTITION BY bloque, circuito ORDER BY n) AS siguiente FROM periods) WHERE siguiente IS NOT NULL
""",
    "p6_found": """
WITH r AS (SELECT DISTINCT id, lat, lon FROM reportes WHERE lat IS NOT NULL AND lon IS NOT NULL),
edges AS (
  SELECT zona_id, anillo[i].lat AS y1, anillo[i].lon AS x1, anillo[i % len(anillo) + 1].lat AS y2, anillo[i % len(anillo) + 1].lon AS x2
  FROM (SELECT zona_id, anillo, unnest(range(1, len(anillo) + 1)) AS i FROM zonas_cuadrantes))
SELECT DISTINCT 'cerca' AS relacion, r.id AS reporte_id, c.message_id AS otro_id
FROM r JOIN (SELECT DISTINCT message_id, lat, lon FROM comentarios_llm) c
ON sqrt(((r.lat - c.lat) * 111000) * ((r.lat - c.lat) * 111000) + ((r.lon - c.lon) * 102000) * ((r.lon - c.lon) * 102000)) <= 40
UNION ALL
SELECT DISTINCT 'dentro' AS relacion, id AS reporte_id, CAST(zona_id AS BIGINT) AS otro_id FROM (
  SELECT r.id, r.lat, r.lon, e.zona_id FROM r JOIN edges e ON (e.y1 > r.lat) <> (e.y2 > r.lat) AND r.lon < (e.x2 - e.x1) * (r.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)
""",
}
