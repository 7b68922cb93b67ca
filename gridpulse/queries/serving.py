"""Quality checks, tools, ingestion and streams (inventory D1 to D11, Q1 to Q10, S4, S5, K1, K5, T1 to T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse import api
from gridpulse.operators import quality as q
from gridpulse.operators.state import seconds
from gridpulse.queries import history as _h
from gridpulse.queries import rollups as _r
from gridpulse.queries.rollups import official
from gridpulse.queries.text import town_aliases
from gridpulse.sources import ingest
from gridpulse.sources.tables import table
from gridpulse.streaming import live

MARK = 3_000


def dq_report(spark, d):
    reports = table(spark, d, "reportes")
    events = table(spark, d, "eventos")
    early = official(spark, d).where(F.col("message_id") < MARK).select(F.explode("zonas").alias("codigo"))
    parts = [
        q.duplicates(reports, "id"),
        q.duplicates(events.select("id"), "id"),
        q.out_of_box(reports, "id", ingest.BOX),
        q.out_of_box(table(spark, d, "comentarios_llm"), "message_id", ingest.BOX),
        q.invalid_values(table(spark, d, "comentarios_llm"), "message_id", "reporta", ["sin_corriente", "con_corriente", "queja", "pregunta", "irrelevante"]),
        q.unknown_keys(official(spark, d).select(F.explode("zonas").alias("codigo")), early, "codigo"),
        q.stale(reports.select(seconds(F.col("fecha")).alias("t")), "t", 1_800_000_000, 7200, "reportes"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cache_repair(spark, d):
    """Structured comments without those whose point lies outside the city."""
    c = table(spark, d, "comentarios_llm").select("message_id", "lugar").distinct()
    w, s, e, n = ingest.BOX
    bad = table(spark, d, "comentarios_llm").where(F.col("lat").isNotNull() & ~(F.col("lat").between(s, n) & F.col("lon").between(w, e)))
    return q.repaired(c, bad, "message_id")


def find_zone(spark, d):
    return api.find_zone(spark, d, "Márvales")


def circuit(spark, d):
    return api.circuit(spark, d, "fx-83").select("codigo", "veces", "bloque")


def municipality(spark, d):
    return api.municipality(spark, d, "Municipio Regolfo")


def worst(spark, d):
    return api.worst(spark, d, 5)


def trend(spark, d):
    return api.trend(spark, d, 14)


def bot_state(spark, d):
    return api.bot_state(spark, d)


def incremental_pull(spark, d):
    """Messages above the stored mark of their chat."""
    m = table(spark, d, "mensajes").select("chat", "message_id", "texto").where("texto IS NOT NULL").distinct()
    return ingest.pull_new(m, m.where(F.col("message_id") <= MARK)).select("chat", "message_id")


def upsert(spark, d):
    """Stored reports with the newest half, by time, merged in."""
    dated = table(spark, d, "reportes").select("id", "tipo", "direccion", seconds(F.col("fecha")).alias("t")).distinct()
    r = dated.drop("t").distinct()
    new = dated.join(F.broadcast(dated.agg(F.median("t").alias("mitad"))), F.col("t") >= F.col("mitad")).select("id", F.lit("con").alias("tipo"), "direccion")
    return ingest.merged(r, new, ["id"]).select("id", "tipo")


def latest_versions(spark, d):
    m = table(spark, d, "mensajes").select("chat", "message_id", "texto", F.coalesce("procesado", F.lit(False)).alias("procesado"))
    return ingest.latest_version(m, ["chat", "message_id"], ["procesado", "texto"]).select("chat", "message_id", "procesado")


def retention(spark, d):
    r = table(spark, d, "reportes").select("id", seconds(F.col("fecha")).alias("t")).distinct()
    return ingest.retained(r, "t", F.lit(1_764_547_200))


def valid_reports(spark, d):
    r = ingest.valid_reports(table(spark, d, "reportes").select("id", "lat", "lon", "direccion", "tipo"))
    return r.select("id", "tipo", F.length("direccion").alias("largo")).distinct()


def stream_dedupe(spark, d):
    """The stamps of the table span a month, so the whole table is within the watermark."""
    e = live.stream_of(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return live.drained(live.deduplicated(e, "event_id", "ts", "800 days").select("event_id", "event_type"))


def stream_hourly(spark, d):
    e = live.stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return live.drained(live.hourly(e, "ts", "event_type"), "complete").select(F.col("hora").cast("long").alias("hora"), "event_type", "n")


def stream_extract(spark, d):
    m = live.stream_of(spark, d, "mensajes").select("chat", "message_id", F.col("fecha").cast("timestamp").alias("fecha"), "texto")
    e = live.drained(live.extracted(m, town_aliases(spark, d)).select("chat", "message_id", "tipo", "bloque", "causa"))
    return e.groupBy("chat", "tipo", "bloque", "causa").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dq_report, cache_repair, find_zone, circuit, municipality, worst, trend, bot_state, incremental_pull, upsert, latest_versions, retention, valid_reports, stream_dedupe, stream_hourly, stream_extract)}

SQL = {
    "dq_report": f"""WITH {_r._O}, z AS (SELECT message_id, unnest(zonas) AS codigo FROM o)
 SELECT 'duplicado' AS control, CAST(id AS VARCHAR) AS clave, CAST(count(*) - 1 AS VARCHAR) AS detalle FROM reportes GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'duplicado', CAST(id AS VARCHAR), CAST(count(*) - 1 AS VARCHAR) FROM eventos GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT 'fuera', CAST(id AS VARCHAR), 'fuera de la ciudad' FROM reportes WHERE NOT (lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9) AND lat IS NOT NULL AND lon IS NOT NULL
 UNION ALL SELECT DISTINCT 'fuera', CAST(message_id AS VARCHAR), 'fuera de la ciudad' FROM comentarios_llm WHERE NOT (lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9) AND lat IS NOT NULL AND lon IS NOT NULL
 UNION ALL SELECT DISTINCT 'valor', CAST(message_id AS VARCHAR), 'reporta=' || coalesce(reporta, 'null') FROM comentarios_llm WHERE reporta IS NULL OR reporta NOT IN ('sin_corriente', 'con_corriente', 'queja', 'pregunta', 'irrelevante')
 UNION ALL SELECT DISTINCT 'desconocido', codigo, 'no está en el catálogo' FROM z WHERE codigo IS NOT NULL AND codigo NOT IN (SELECT codigo FROM z WHERE message_id < 3000 AND codigo IS NOT NULL)
 UNION ALL SELECT 'antiguo', 'reportes', coalesce(CAST(1800000000 - max({_h._F}) AS VARCHAR), 'sin datos') FROM reportes HAVING max({_h._F}) IS NULL OR 1800000000 - max({_h._F}) > 7200""",
    "cache_repair": "SELECT DISTINCT message_id, lugar FROM comentarios_llm WHERE message_id NOT IN (SELECT message_id FROM comentarios_llm WHERE lat IS NOT NULL AND NOT (lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9))",
    "circuit": f"SELECT codigo, veces, bloque FROM ({_r.SQL['catalog_fold']}) WHERE regexp_replace(lower(codigo), '[^a-z0-9]', '', 'g') = 'fx83'",
    "municipality": f"SELECT * FROM ({_r.SQL['town_month']}) WHERE contains('municipio regolfo', lower(strip_accents(municipio))) OR contains(lower(strip_accents(municipio)), 'municipio regolfo')",
    "worst": f"SELECT * FROM ({_r.SQL['top_circuits']}) ORDER BY n DESC, codigo LIMIT 5",
    "trend": f"SELECT * FROM ({_r.SQL['daily_summary']}) ORDER BY dia DESC LIMIT 14",
    "bot_state": f"WITH n AS (SELECT id, {_h._F} AS t, tipo, bloque FROM eventos WHERE fecha IS NOT NULL ORDER BY t DESC, id DESC LIMIT 20) SELECT bloque, tipo, t, id FROM (SELECT *, row_number() OVER (PARTITION BY bloque ORDER BY t DESC, id DESC, tipo DESC) AS k FROM n) WHERE k = 1",
    "incremental_pull": f"SELECT DISTINCT chat, message_id FROM mensajes m WHERE texto IS NOT NULL AND message_id > coalesce((SELECT max(message_id) FROM mensajes s WHERE s.chat = m.chat AND s.texto IS NOT NULL AND s.message_id <= {MARK}), -1)",
    "upsert": f"WITH d AS (SELECT DISTINCT id, tipo, direccion, {_h._F} AS t FROM reportes), n AS (SELECT DISTINCT id FROM d WHERE t >= (SELECT median(t) FROM d)) SELECT id, tipo FROM (SELECT DISTINCT id, tipo, direccion FROM d) WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'con' FROM n",
    "latest_versions": "SELECT chat, message_id, max(coalesce(procesado, false)) AS procesado FROM mensajes GROUP BY ALL",
    "retention": f"SELECT DISTINCT id, {_h._F} AS t FROM reportes WHERE {_h._F} >= 1764547200",
    "valid_reports": "SELECT DISTINCT id, CASE WHEN tipo IN ('sin', 'con') THEN tipo ELSE 'sin' END AS tipo, CASE WHEN direccion IS NOT NULL THEN least(length(trim(direccion)), 140) END AS largo FROM reportes WHERE lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_hourly": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hora, event_type, count(*) AS n FROM events GROUP BY ALL",
}
