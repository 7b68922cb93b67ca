"""Rota, enrichment and ranking queries (inventory W9, O3, V4, V6, G14, J4, T8, A21)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators import enrich, rota
from gridpulse.operators.history import latest_per_key
from gridpulse.operators.state import latest
from gridpulse.queries import history as _h
from gridpulse.queries.history import verdicts
from gridpulse.queries.text import _fold
from gridpulse.sources.tables import table


def weekly_rota(spark, d):
    m = table(spark, d, "mensajes").where("chat = 'canal'").select("message_id", "fecha", "texto").distinct()
    r = rota.current_rota(rota.weekly_rotas(m), date(2025, 12, 31))
    return r.select("message_id", F.col("desde").cast("string").alias("desde"), F.col("hasta").cast("string").alias("hasta"), F.array_join("circuitos", "|").alias("circuitos"), "vigente")


def longest_outages(spark, d):
    """The five longest current outages: the newest announcement is an outage not older than a day."""
    e = table(spark, d, "eventos").where("chat = 'canal'")
    now = F.unix_seconds(F.lit(latest(e)).cast("timestamp"))
    v = latest_per_key(verdicts(spark, d), ["codigo"], ["t", "id"]).where("estado = 'sin servicio'").withColumn("segundos", now - F.col("t"))
    return v.where("segundos <= 86400").orderBy(F.col("segundos").desc(), "codigo").limit(5).select("codigo", "segundos")


def pending_embeddings(spark, d):
    """Documents whose text is new or changed, with an injected embedder (here: letter counts).

    Stored are the documents that have a row of embeddings (vec_id is the doc_id), by the hash of a text of n_chars
    characters: the present text, or another one if n_chars is stale. Without n_chars nothing is known to be stored.
    """
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"), "n_chars")
    made = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"))
    stored = x.where("texto IS NOT NULL AND n_chars IS NOT NULL").join(made, "id", "left_semi").select("id", F.sha1(F.expr("rpad(texto, CAST(n_chars AS int), ' ')")).alias("hash"))
    docs = x.drop("n_chars")
    out = enrich.embedded(docs, stored, lambda texts: [[float(x.count(c)) for c in "aeiou"] for x in texts], 5)
    return out.select("id", "hash", F.size("embedding").alias("ancho"))


def zone_points(spark, d):
    """Points of zones from the neighbourhoods that bear their name; a manual point comes first."""
    z = table(spark, d, "zonas_cuadrantes").select("zona_id", t.canon_street(F.regexp_replace("zona", " (norte|sur|este|oeste)$", "")).alias("clave"))
    b = table(spark, d, "barrios").where("lat IS NOT NULL").select(t.canon_street(F.col("nombre")).alias("clave"), "lat", "lon")
    out = enrich.located(z, b, b.where("lat > 23.3"), "zona_id")
    return out.select("zona_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "via")


def due_geometry(spark, d):
    """Circuits still to be drawn: not cached (here: none of block 1) and tried (here: restored in block 4) fewer than three times."""
    v = verdicts(spark, d)
    tried = v.where("bloque = 4 AND estado = 'con servicio'").groupBy("codigo").agg(F.count("*").alias("n"))
    return enrich.due(v, v.where("bloque = 1").select("codigo"), tried, "codigo")


QUERIES = {f.__name__: f for f in (weekly_rota, longest_outages, pending_embeddings, zone_points, due_geometry)}

_KEY = lambda x: f"regexp_replace(regexp_replace(regexp_replace({_fold(x)}, '\\([^)]*\\)', '', 'g'), '^\\s*(calle|avenida|ave|av|calzada)\\b\\.?', ''), '[^a-z0-9]', '', 'g')"

SQL = {
    "longest_outages": f"WITH {_h._VERDICTS}, l AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY t DESC, id DESC) AS n FROM v) SELECT codigo, {_h._NOW} - t AS segundos FROM l WHERE n = 1 AND estado = 'sin servicio' AND {_h._NOW} - t <= 86400 ORDER BY segundos DESC, codigo LIMIT 5",
    "pending_embeddings": "SELECT DISTINCT doc_id AS id, sha1(text) AS hash, 5 AS ancho FROM documents WHERE text IS NOT NULL AND NOT coalesce(doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) AND rpad(text, n_chars::INT, ' ') = text, false)",
    "zone_points": f"""WITH z AS (SELECT zona_id, {_KEY("regexp_replace(zona, ' (norte|sur|este|oeste)$', '')")} AS clave FROM zonas_cuadrantes), b AS (SELECT {_KEY('nombre')} AS clave, lat, lon FROM barrios WHERE lat IS NOT NULL),
 f AS (SELECT zona_id, min((lat, lon)) AS p FROM z JOIN b USING (clave) WHERE lat > 23.3 GROUP BY zona_id), p AS (SELECT zona_id, lat, lon FROM z JOIN b USING (clave) WHERE zona_id NOT IN (SELECT zona_id FROM f)),
 m AS (SELECT zona_id, median(lat) AS a, median(lon) AS o FROM p GROUP BY zona_id)
 SELECT zona_id, round(p[1], 6) AS lat, round(p[2], 6) AS lon, 'manual' AS via FROM f UNION ALL SELECT zona_id, round(avg(lat), 6), round(avg(lon), 6), 'calles' FROM p JOIN m USING (zona_id) WHERE sqrt(((lat - a) * 111000) ** 2 + ((lon - o) * 102000) ** 2) < 2000 GROUP BY zona_id""",
    "due_geometry": f"WITH {_h._VERDICTS} SELECT DISTINCT codigo FROM v WHERE codigo NOT IN (SELECT codigo FROM v WHERE bloque = 1) AND codigo NOT IN (SELECT codigo FROM v WHERE bloque = 4 AND estado = 'con servicio' GROUP BY codigo HAVING count(*) >= 3)",
}
