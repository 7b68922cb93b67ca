"""Ordered state and history (inventory W1 to W13, T3 to T6, O2, A8), over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpulse.operators import history as h
from gridpulse.operators import state as s
from gridpulse.operators.ordered import Running, bucket_of, running
from gridpulse.sources.tables import table


def events(spark, d):
    return table(spark, d, "eventos")


def declared(spark, d):
    """Hours that comments declare for a block, at minute precision."""
    return table(spark, d, "comentarios_llm").where("bloque BETWEEN 1 AND 6 AND horas IS NOT NULL AND fecha IS NOT NULL").select("bloque", F.col("horas").cast("long").alias("horas"), s.seconds(F.date_trunc("minute", "fecha")).alias("t")).distinct()


def verdicts(spark, d):
    """Each circuit's announcements with the state they imply."""
    e = events(spark, d).where("chat = 'canal' AND fecha IS NOT NULL AND tipo IN ('afectacion', 'restablecimiento')")
    return e.select(F.explode(F.array_distinct("zonas")).alias("codigo"), "id", s.seconds(F.col("fecha")).alias("t"), F.when(F.col("tipo") == "afectacion", "sin servicio").otherwise("con servicio").alias("estado"), "causa", "bloque")


def block_state(spark, d):
    e = events(spark, d).where("chat = 'canal'")
    return s.block_state(e, s.latest(e))


def block_state_override(spark, d):
    e = events(spark, d).where("chat = 'canal'")
    now = s.latest(e)
    rows = declared(spark, d).where(F.col("t") <= F.unix_seconds(F.lit(now).cast("timestamp")))
    newest = rows.agg(F.max("t")).first()[0]
    return s.national_override(s.bulletin_override(s.block_state(e, now), rows.where(F.col("t") == newest)), None)


def daf_state(spark, d):
    e = events(spark, d).where("chat = 'canal' AND causa = 'DAF' AND bloque IS NOT NULL AND fecha IS NOT NULL").select("bloque", "id", "tipo", s.seconds(F.col("fecha")).alias("t")).distinct()
    return s.run_start(e, "bloque", ["t", "id"], F.when(F.col("tipo") == "afectacion", "afectado").otherwise("restablecido")).select("bloque", F.col("value").alias("estado"), "desde")


def outage_episodes(spark, d):
    return h.episodes(declared(spark, d), ["bloque"], "t", "horas").select("bloque", F.col("episode").cast("long").alias("episode"), "desde", "hasta", "horas")


def episode_stats(spark, d):
    return h.episode_stats(h.episodes(declared(spark, d), ["bloque"], "t", "horas"), ["bloque"], "horas").orderBy(F.col("total").desc(), "bloque").limit(40)


def declared_hours_by_day(spark, d, zone="UTC"):
    rows = declared(spark, d)
    last = rows.agg(F.max("t")).first()[0] or 0
    return h.hours_by_day(h.declared_intervals(rows, last + 6 * 3600), zone).withColumn("dia", F.col("dia").cast("string"))


def declared_hours_local(spark, d):
    """The same by days of Havana; the midnight that occurs twice when summer time ends is taken the first time."""
    return declared_hours_by_day(spark, d, "America/Havana")


def first_fault_seen(spark, d):
    e = table(spark, d, "estado").where("seccion = 'averias' AND direccion IS NOT NULL AND fecha IS NOT NULL").select("item_id", s.seconds(F.col("fecha")).alias("t"), F.coalesce("tipo", F.lit("")).alias("tipo"), F.left(F.lower("direccion"), F.lit(40)).alias("lugar")).distinct()
    return h.first_seen(e, ["tipo", "lugar"], ["t", "item_id"])


def latest_verdict(spark, d):
    return h.latest_per_key(verdicts(spark, d), ["codigo"], ["t", "id"]).select("codigo", "t", "id", "estado")


def catalog_coherence(spark, d):
    """Circuits whose stored state is older than, and differs from, the newest announcement."""
    v = verdicts(spark, d)
    stored = h.first_seen(v, ["codigo"], ["t", "id"]).select("codigo", F.col("estado").alias("anterior"), F.col("t").alias("anterior_t"))
    newest = h.latest_per_key(v, ["codigo"], ["t", "id"]).select("codigo", "estado", "t")
    return stored.join(newest, "codigo").where((F.floor(F.col("t") / 60) > F.floor(F.col("anterior_t") / 60)) & (F.col("estado") != F.col("anterior")))


def latest_matching(spark, d):
    m = table(spark, d, "mensajes").where("chat = 'canal' AND texto ILIKE '%déficit%' AND fecha IS NOT NULL").select("message_id", s.seconds(F.col("fecha")).alias("t"), "texto").distinct()
    return m.orderBy(F.col("t").desc(), F.col("message_id").desc()).limit(1)


def day_headers(spark, d):
    """Newest first; the first post of each day carries the day's header."""
    m = table(spark, d, "mensajes").where("chat = 'canal' AND fecha IS NOT NULL").select("message_id", s.seconds(F.col("fecha")).alias("t")).distinct().withColumn("dia", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"))
    tops = m.groupBy("dia").agg(F.max(F.struct("t", "message_id")).alias("m"))
    return tops.select("dia", F.col("m.message_id").alias("message_id"))


def rate_limit_window(spark, d):
    """Reports that found three or more of their sender in the two hours before, counting all."""
    r = table(spark, d, "reportes").where("ip_hash IS NOT NULL AND fecha IS NOT NULL").select("id", "ip_hash", s.seconds(F.col("fecha")).alias("t")).distinct()
    w = Window.partitionBy("ip_hash", "__slot").orderBy("t").rangeBetween(-7199, -1)
    # a slot and its successor hold every report of the window: no sender is sorted as a whole
    slots = r.withColumn("__own", F.floor(F.col("t") / 7200)).withColumn("__slot", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    return slots.withColumn("n", F.count("*").over(w)).where((F.col("__slot") == F.col("__own")) & (F.col("n") >= 3)).select("id", "ip_hash", "t", "n")


def rate_limit_stored(spark, d):
    r = table(spark, d, "reportes").where("ip_hash IS NOT NULL AND fecha IS NOT NULL").select("id", "ip_hash", s.seconds(F.col("fecha")).alias("t")).distinct()
    return h.thinned(r, "ip_hash", "t", "id", 7200, 3)


def circuit_status(spark, d):
    """Effective status of each circuit: its newest announcement against its block's state."""
    e = events(spark, d).where("chat = 'canal'")
    now = s.latest(e)
    blocks = s.block_state(e, now).select("bloque", F.col("estado").alias("b_estado"), F.col("desde").alias("b_desde"))
    v = h.latest_per_key(verdicts(spark, d), ["codigo"], ["t", "id"])
    x = v.join(F.broadcast(blocks), "bloque", "left")
    clock = F.unix_seconds(F.lit(now).cast("timestamp"))
    return x.select("codigo", "bloque", s.effective_status(F.col("estado"), F.col("t"), F.col("b_estado"), F.col("b_desde"), clock).alias("estado"))


def status_breakdown(spark, d):
    return circuit_status(spark, d).groupBy("bloque", "estado").agg(F.count("*").alias("n"))


def simultaneous_record(spark, d):
    """The instant with most circuits out at once: +1 and -1 at the turns of each circuit, summed over time."""
    v = verdicts(spark, d).select("codigo", "t", "id", (F.col("estado") == "sin servicio").cast("int").alias("out")).distinct().withColumn("__bucket", bucket_of(F.col("t"), h.DAY))
    seen = running(v, ["codigo"], "__bucket", ["t", "id"], [Running("before", F.col("out"), "last", inclusive=False)])
    turns = seen.select("t", (F.col("out") - F.coalesce("before", F.lit(0))).alias("delta")).where("delta <> 0").groupBy("t").agg(F.sum("delta").alias("delta")).withColumn("__bucket", bucket_of(F.col("t"), h.DAY)).withColumn("__all", F.lit(0))
    level = running(turns, ["__all"], "__bucket", ["t"], [Running("n", F.col("delta"), "sum")])
    return level.agg(F.max("n").alias("n"), F.max_by("t", F.struct("n", -F.col("t"))).alias("t"))


QUERIES = {f.__name__: f for f in (block_state, block_state_override, daf_state, outage_episodes, episode_stats, declared_hours_by_day, declared_hours_local, first_fault_seen, latest_verdict, catalog_coherence, latest_matching, day_headers, rate_limit_window, rate_limit_stored, circuit_status, status_breakdown, simultaneous_record)}

_T = "CAST(floor(epoch({})) AS BIGINT)"
_F = _T.format("fecha")
_NOW = f"(SELECT max({_F}) FROM eventos WHERE chat = 'canal')"
_BLOCK_STATE = f"""recent AS (SELECT DISTINCT id, bloque, tipo, causa, {_F} AS t FROM eventos WHERE chat = 'canal' AND bloque IS NOT NULL AND tipo IN ('afectacion', 'restablecimiento', 'restablecimiento_parcial') AND {_F} >= {_NOW} - 43200),
 f AS (SELECT *, CASE tipo WHEN 'afectacion' THEN 'afectado' WHEN 'restablecimiento' THEN 'restablecido' END AS whole FROM recent),
 g AS (SELECT *, coalesce(last_value(whole IGNORE NULLS) OVER (PARTITION BY bloque ORDER BY t, id ROWS UNBOUNDED PRECEDING), 'afectado') AS eff FROM f),
 k AS (SELECT *, coalesce(eff <> lag(eff) OVER (PARTITION BY bloque ORDER BY t, id), true) AS turn FROM g),
 st AS (SELECT bloque, arg_max(eff, t * 1000000000 + id) AS estado, max(CASE WHEN turn THEN t END) AS desde, arg_max_null(causa, CASE WHEN whole IS NOT NULL THEN t * 1000000000 + id END) AS causa, max(CASE WHEN tipo = 'afectacion' THEN t END) AS ult_afecta,
   max(CASE WHEN tipo = 'restablecimiento_parcial' THEN t * 1000000000 + id END) AS p, max(CASE WHEN whole IS NOT NULL THEN t * 1000000000 + id END) AS w FROM k GROUP BY bloque),
 block_state AS (SELECT b.bloque, coalesce(estado, 'desconocido') AS estado, desde, causa, ult_afecta, CASE WHEN estado = 'afectado' AND p // 1000000000 >= {_NOW} - 18000 AND (w IS NULL OR p > w) THEN CAST(p // 1000000000 AS BIGINT) END AS parcial
  FROM (SELECT CAST(unnest(range(7)) AS INT) AS bloque) b LEFT JOIN st ON b.bloque = st.bloque)"""
_VERDICTS = f"v AS (SELECT DISTINCT unnest(list_distinct(zonas)) AS codigo, id, {_F} AS t, CASE WHEN tipo = 'afectacion' THEN 'sin servicio' ELSE 'con servicio' END AS estado, bloque FROM eventos WHERE chat = 'canal' AND fecha IS NOT NULL AND tipo IN ('afectacion', 'restablecimiento'))"
_DECLARED = f"dec AS (SELECT DISTINCT bloque, CAST(horas AS BIGINT) AS horas, CAST(epoch(fecha) AS BIGINT) // 60 * 60 AS t FROM comentarios_llm WHERE bloque BETWEEN 1 AND 6 AND horas IS NOT NULL AND fecha IS NOT NULL)"
_EPISODES = f"{_DECLARED}, a AS (SELECT *, CASE WHEN horas < lag(horas) OVER (PARTITION BY bloque ORDER BY t, horas) THEN 1 ELSE 0 END AS nw FROM dec), b AS (SELECT *, sum(nw) OVER (PARTITION BY bloque ORDER BY t, horas ROWS UNBOUNDED PRECEDING) AS episode FROM a), ep AS (SELECT bloque, CAST(episode AS BIGINT) AS episode, min(t) AS desde, max(t) AS hasta, max(horas) AS horas FROM b GROUP BY ALL)"

SQL = {
    "block_state": f"WITH {_BLOCK_STATE} SELECT * FROM block_state",
    "daf_state": f"""WITH e AS (SELECT DISTINCT bloque, id, {_F} AS t, CASE WHEN tipo = 'afectacion' THEN 'afectado' ELSE 'restablecido' END AS v FROM eventos WHERE chat = 'canal' AND causa = 'DAF' AND bloque IS NOT NULL AND fecha IS NOT NULL),
 k AS (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY bloque ORDER BY t, id), true) AS turn FROM e)
 SELECT bloque, arg_max(v, t * 1000000000 + id) AS estado, max(CASE WHEN turn THEN t END) AS desde FROM k GROUP BY bloque""",
    "outage_episodes": f"WITH {_EPISODES} SELECT * FROM ep",
    "episode_stats": f"WITH {_EPISODES} SELECT bloque, count(*) AS n, max(horas) AS maximo, CAST(sum(horas) AS BIGINT) AS total, arg_max(horas, hasta * 1000000 + episode) AS ultimo FROM ep GROUP BY bloque ORDER BY total DESC, bloque LIMIT 40",
    "declared_hours_by_day": f"""WITH {_DECLARED}, told AS (SELECT t, bloque, max(horas) AS h FROM dec GROUP BY ALL), lim AS (SELECT max(t) AS last, max(t) + 21600 AS now FROM dec),
 grid AS (SELECT t, b.bloque FROM (SELECT DISTINCT t FROM told) CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INT) AS bloque) b),
 r AS (SELECT g.t, g.bloque, CAST(h AS DOUBLE) AS h FROM grid g LEFT JOIN told USING (t, bloque)),
 k AS (SELECT *, lag(t) OVER w AS pt, lag(h) OVER w AS ph FROM r WINDOW w AS (PARTITION BY bloque ORDER BY t)),
 i AS (SELECT bloque, t - least(h * 3600, coalesce(CAST(t - pt AS DOUBLE), 28800.0), 86400.0) AS ini, CAST(t AS DOUBLE) AS fin FROM k WHERE h IS NOT NULL
   UNION ALL SELECT bloque, CAST(pt AS DOUBLE), pt + least((t - pt) / 2.0, 28800.0) FROM k WHERE h IS NULL AND ph IS NOT NULL
   UNION ALL SELECT bloque, CAST(t AS DOUBLE), least(CAST(now AS DOUBLE), t + 28800.0) FROM k, lim WHERE h IS NOT NULL AND t = last),
 dd AS (SELECT bloque, ini, fin, unnest(generate_series(CAST(to_timestamp(ini) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, CAST(to_timestamp(fin) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS dia FROM i WHERE fin > ini),
 p AS (SELECT bloque, dia, least(fin, epoch((dia + INTERVAL 1 DAY) AT TIME ZONE 'UTC')) - greatest(ini, epoch(dia AT TIME ZONE 'UTC')) AS s FROM dd)
 SELECT bloque, strftime(dia, '%Y-%m-%d') AS dia, least(round(sum(s) / 3600, 1), 24.0::DOUBLE) AS horas FROM p WHERE s > 0 GROUP BY ALL""",
    "first_fault_seen": f"WITH e AS (SELECT DISTINCT item_id, {_F} AS t, coalesce(tipo, '') AS tipo, left(lower(direccion), 40) AS lugar FROM estado WHERE seccion = 'averias' AND direccion IS NOT NULL AND fecha IS NOT NULL) SELECT item_id, t, tipo, lugar FROM (SELECT *, row_number() OVER (PARTITION BY tipo, lugar ORDER BY t, item_id) AS n FROM e) WHERE n = 1",
    "latest_verdict": f"WITH {_VERDICTS} SELECT codigo, t, id, estado FROM (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY t DESC, id DESC) AS n FROM v) WHERE n = 1",
    "catalog_coherence": f"WITH {_VERDICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY t, id) AS a, row_number() OVER (PARTITION BY codigo ORDER BY t DESC, id DESC) AS z FROM v) SELECT x.codigo, x.estado AS anterior, x.t AS anterior_t, y.estado, y.t FROM r x JOIN r y ON x.codigo = y.codigo AND x.a = 1 AND y.z = 1 WHERE y.t // 60 > x.t // 60 AND x.estado <> y.estado",
    "latest_matching": f"SELECT message_id, t, texto FROM (SELECT DISTINCT message_id, {_F} AS t, texto FROM mensajes WHERE chat = 'canal' AND texto ILIKE '%déficit%' AND fecha IS NOT NULL) ORDER BY t DESC, message_id DESC LIMIT 1",
    "day_headers": f"SELECT dia, message_id FROM (SELECT *, row_number() OVER (PARTITION BY dia ORDER BY t DESC, message_id DESC) AS n FROM (SELECT DISTINCT message_id, {_F} AS t, strftime(fecha, '%Y-%m-%d') AS dia FROM mensajes WHERE chat = 'canal' AND fecha IS NOT NULL)) WHERE n = 1",
    "rate_limit_window": f"SELECT * FROM (SELECT id, ip_hash, t, count(*) OVER (PARTITION BY ip_hash ORDER BY t RANGE BETWEEN 7199 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT DISTINCT id, ip_hash, {_F} AS t FROM reportes WHERE ip_hash IS NOT NULL AND fecha IS NOT NULL)) WHERE n >= 3",
    "circuit_status": f"""WITH {_BLOCK_STATE}, {_VERDICTS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY t DESC, id DESC) AS n FROM v) WHERE n = 1)
 SELECT codigo, l.bloque, CASE WHEN {_NOW} - t > 86400 THEN CASE WHEN b.estado = 'afectado' THEN 'asum' ELSE 'nd' END WHEN l.estado = 'con servicio' AND b.estado = 'afectado' AND b.desde > t THEN 'asum' WHEN l.estado = 'con servicio' THEN 'con' ELSE 'sin' END AS estado FROM l LEFT JOIN block_state b ON l.bloque = b.bloque""",
    "simultaneous_record": f"""WITH {_VERDICTS}, o AS (SELECT codigo, t, id, CASE WHEN estado = 'sin servicio' THEN 1 ELSE 0 END AS o FROM v),
 k AS (SELECT t, o - coalesce(lag(o) OVER (PARTITION BY codigo ORDER BY t, id), 0) AS delta FROM o), x AS (SELECT t, sum(delta) AS delta FROM k WHERE delta <> 0 GROUP BY t),
 l AS (SELECT t, CAST(sum(delta) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM x) SELECT n, t FROM l ORDER BY n DESC, t LIMIT 1""",
}
SQL["status_breakdown"] = f"SELECT bloque, estado, count(*) AS n FROM ({SQL['circuit_status']}) GROUP BY ALL"
