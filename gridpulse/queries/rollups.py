"""Aggregations, rankings and set operations (inventory A1 to A30, O1 to O8, U1 to U6), over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators.state import seconds
from gridpulse.sources.tables import table


def official(spark, d):
    e = table(spark, d, "eventos").where("chat = 'canal' AND fecha IS NOT NULL")
    return e.select("id", "message_id", "tipo", "bloque", "causa", "municipios", "zonas", "fecha", seconds(F.col("fecha")).alias("t"))


def day(c="fecha"):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def report_counts(spark, d):
    e = table(spark, d, "eventos").where("tipo LIKE 'reporte%'")
    return e.groupBy("bloque").agg(F.count_if(F.col("tipo") == "reporte_sin_servicio").alias("sin"), F.count_if(F.col("tipo") == "reporte_con_servicio").alias("con"))


def cause_counts(spark, d):
    return official(spark, d).where("causa IS NOT NULL").groupBy("causa").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "causa")


def robust_hours(spark, d):
    c = table(spark, d, "comentarios_llm").where("bloque IS NOT NULL AND horas > 0 AND horas <= 96").select("message_id", "bloque", "horas").distinct()
    return c.groupBy("bloque").agg(F.bround(F.median("horas"), 0).cast("long").alias("horas"), F.count("*").alias("n")).where("n >= 2")


def town_rollup(spark, d):
    """Events by municipality and kind; a town's newest eight are kept by a bounded heap, not by sorting the town."""
    e = official(spark, d).select("id", "t", "tipo", F.explode(F.array_distinct("municipios")).alias("municipio"))
    # eight of each day suffice to hold the newest eight of all days
    newest = e.withColumn("n", F.row_number().over(Window.partitionBy("municipio", F.floor(F.col("t") / 86400)).orderBy(F.col("t").desc(), F.col("id").desc()))).where("n <= 8")
    newest = newest.withColumn("n", F.row_number().over(Window.partitionBy("municipio").orderBy(F.col("t").desc(), F.col("id").desc()))).where("n <= 8").select("municipio", "n", "id", "tipo")
    counts = e.groupBy("municipio").agg(F.count("*").alias("total"), F.count_if(F.col("tipo") == "afectacion").alias("afectaciones"))
    return newest.join(counts, "municipio")


def town_month(spark, d, compat=True):
    """Monthly tallies; compat counts every other type as a restoration."""
    e = table(spark, d, "eventos").where("fecha IS NOT NULL").select("tipo", F.date_format("fecha", "yyyy-MM").alias("mes"), seconds(F.col("fecha")).alias("t"), F.explode(F.array_distinct("municipios")).alias("municipio"))
    back = F.col("tipo") != "afectacion" if compat else F.col("tipo").startswith("restablecimiento")
    return e.groupBy("municipio", "mes").agg(F.count_if(F.col("tipo") == "afectacion").alias("afectaciones"), F.count_if(back).alias("restablecimientos"), F.max(F.when(F.col("tipo") == "afectacion", F.col("t"))).alias("ultima"))


def town_focus(spark, d):
    """Only events that name one to four municipalities."""
    e = official(spark, d).where(F.size("municipios").between(1, 4))
    return e.select(F.explode("municipios").alias("municipio")).groupBy("municipio").agg(F.count("*").alias("n"))


def catalog_fold(spark, d):
    """One record for each circuit out of all its mentions; associative, so partial results are merged."""
    m = official(spark, d).select("id", "message_id", "t", "tipo", "bloque", "causa", F.get("municipios", F.lit(0)).alias("municipio"), F.explode("zonas").alias("codigo")).where("codigo IS NOT NULL").distinct()
    at = F.struct("t", "message_id", "id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    state = F.when(F.col("tipo") == "afectacion", F.lit("sin servicio")).when(F.col("tipo") == "restablecimiento", F.lit("con servicio"))
    m = m.withColumn("estado", state)
    return m.groupBy("codigo").agg(F.count("*").alias("veces"), F.min("t").alias("primera"), F.max("t").alias("ultima"), F.max_by("message_id", at).alias("ultima_message_id"), last("bloque").alias("bloque"), last("causa").alias("causa"), last("municipio").alias("municipio"), last("estado").alias("estado"), t.code_prefix(F.col("codigo")).alias("prefijo")).orderBy(F.col("ultima").desc(), "codigo")


def top_circuits(spark, d):
    z = official(spark, d).where("tipo = 'afectacion'").select(F.explode("zonas").alias("codigo"), "t")
    return z.groupBy("codigo").agg(F.count("*").alias("n"), F.max("t").alias("ultima")).orderBy(F.col("n").desc(), "codigo").limit(15)


def mw_stats(spark, d):
    m = table(spark, d, "mensajes").where("chat = 'canal'").select("message_id", "texto").distinct().select(t.megawatts(F.col("texto")).alias("mw")).where("mw IS NOT NULL")
    return m.agg(F.count("*").alias("n"), F.min("mw").alias("minimo"), F.max("mw").alias("maximo"), F.bround(F.avg("mw"), 0).cast("long").alias("media"))


def daily_circuits(spark, d):
    z = official(spark, d).where("tipo = 'afectacion'").select(day().alias("dia"), F.explode("zonas").alias("codigo"))
    return z.groupBy("dia").agg(F.count_distinct("codigo").alias("circuitos"))


def iso_week_trend(spark, d):
    o = table(spark, d, "orders")
    week = F.format_string("%d-%02d", F.extract(F.lit("yearofweek"), F.col("o_orderdate")), F.weekofyear("o_orderdate"))
    return o.groupBy(week.alias("semana")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def kpis(spark, d):
    e = official(spark, d)
    codes = e.where("tipo = 'afectacion'").agg(F.count_distinct("message_id").alias("partes"), F.count_if(F.col("causa") == "DAF").alias("daf"), F.count_if(F.col("causa") == "avería").alias("averias"))
    circuits = e.select(F.explode("zonas").alias("codigo")).agg(F.count_distinct("codigo").alias("circuitos"))
    reports = table(spark, d, "reportes").agg(F.count_distinct("id").alias("reportes"))
    return codes.join(circuits, F.lit(True)).join(reports, F.lit(True))


def hour_histogram(spark, d):
    hours = official(spark, d).groupBy(F.hour("fecha").alias("hora")).agg(F.count("*").alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hora")).join(hours, "hora", "left").select("hora", F.coalesce("n", F.lit(0)).alias("n"))


def records(spark, d):
    e = official(spark, d).where("tipo = 'afectacion'").groupBy(day().alias("dia")).agg(F.count("*").alias("n"), F.count_if(F.col("causa") == "avería").alias("averias"))
    return e.agg(F.max_by("dia", F.struct("n", "dia")).alias("peor_dia"), F.max("n").alias("peor_n"), F.max_by("dia", F.struct("averias", "dia")).alias("dia_averias"), F.max("averias").alias("max_averias"))


def report_cells(spark, d):
    """Reports in cells of three decimals: distinct senders of each kind, majority kind (tie: sin), newest address."""
    r = table(spark, d, "reportes").where("lat IS NOT NULL AND lon IS NOT NULL AND ip_hash IS NOT NULL").select("id", seconds(F.col("fecha")).alias("t"), F.concat_ws(",", F.floor(F.col("lat") * 1000 + 0.5), F.floor(F.col("lon") * 1000 + 0.5)).alias("celda"), "tipo", "ip_hash", F.nullif(F.btrim("direccion"), F.lit("")).alias("direccion")).distinct()
    at = F.struct("t", "id")
    people = r.groupBy("celda").agg(F.count_distinct(F.when(F.col("tipo") == "sin", F.col("ip_hash"))).alias("sin"), F.count_distinct(F.when(F.col("tipo") == "con", F.col("ip_hash"))).alias("con"), F.max("t").alias("ultima"), F.max_by("direccion", F.when(F.col("direccion").isNotNull() & F.col("t").isNotNull(), at)).alias("direccion"))
    return people.withColumn("tipo", F.when(F.col("con") > F.col("sin"), "con").otherwise("sin")).withColumn("confirmado", F.greatest("sin", "con") >= 10)


def population_estimate(spark, d):
    """Weighted share of circuits out, by municipality with two known circuits, else by the city's share."""
    e = official(spark, d).select("id", "t", "tipo", F.explode("zonas").alias("codigo"), F.get("municipios", F.lit(0)).alias("municipio")).where("tipo IN ('afectacion', 'restablecimiento')")
    at = F.struct("t", "id", "tipo")
    c = e.groupBy("codigo").agg(F.max_by("tipo", at).alias("tipo"), F.max_by("municipio", F.when(F.col("municipio").isNotNull(), at)).alias("municipio"))
    share = c.groupBy("municipio").agg(F.count("*").alias("n"), F.count_if(F.col("tipo") == "afectacion").alias("fuera"))
    city = c.agg(F.count("*").alias("cn"), F.count_if(F.col("tipo") == "afectacion").alias("cf"))
    people = table(spark, d, "barrios").where("municipio IS NOT NULL").groupBy("municipio").agg((F.count("*") * 1000).alias("poblacion"))
    x = people.join(share, "municipio", "left").join(F.broadcast(city), F.lit(True))
    out = F.when(F.col("n") >= 2, F.col("poblacion") * F.col("fuera") / F.col("n")).otherwise(F.col("poblacion") * F.col("cf") / F.col("cn"))
    return x.select("municipio", "poblacion", F.floor(out + 0.5).cast("long").alias("sin_servicio"))


def alerts(spark, d):
    """Blocks by number of outage bulletins: three and more media, five and more alta; with few bulletins none."""
    e = official(spark, d).where("tipo = 'afectacion' AND bloque IS NOT NULL").groupBy(day().alias("dia"), "bloque").agg(F.count_distinct("message_id").alias("n"))
    return e.where("n >= 3").select("dia", "bloque", "n", F.when(F.col("n") >= 5, "alta").otherwise("media").alias("nivel"))


def block_patterns(spark, d):
    c = table(spark, d, "comentarios_llm").where("bloque IS NOT NULL AND horas IS NOT NULL").select("message_id", "bloque", "horas").distinct()
    return c.groupBy("bloque").agg(F.count("*").alias("n"), F.sum("horas").cast("long").alias("total"), F.max("horas").alias("maximo")).where("n >= 3")


def learned_blocks(spark, d):
    """Majority vote of comments for each neighbourhood's block; ties go to the smaller block."""
    c = table(spark, d, "comentarios_llm").where("bloque BETWEEN 1 AND 6 AND lugar IS NOT NULL").select("message_id", "bloque", t.squash(F.col("lugar")).alias("clave")).distinct()
    b = table(spark, d, "barrios").select("barrio_id", t.squash(F.col("nombre")).alias("clave"))
    votes = c.join(b, "clave").groupBy("barrio_id", "bloque").agg(F.count("*").alias("n"))
    return votes.groupBy("barrio_id").agg(F.max_by("bloque", F.struct(F.col("n"), -F.col("bloque"))).alias("bloque"), F.sum("n").alias("votos"))


def recurring_codes(spark, d):
    """Codes in comments that no official event knows, seen three times or more."""
    found = t.code_words(F.col("texto"))
    c = table(spark, d, "mensajes").where("chat = 'comentarios'").select("message_id", F.explode(F.array_distinct(found)).alias("codigo")).distinct()
    known = official(spark, d).select(F.explode("zonas").alias("codigo")).distinct()
    return c.join(known, "codigo", "left_anti").groupBy("codigo").agg(F.count("*").alias("n")).where("n >= 3")


def group_text(spark, d):
    z = table(spark, d, "zonas_cuadrantes").where("zona IS NOT NULL").select("municipio", "zona").distinct()
    return z.groupBy("municipio").agg(F.array_join(F.array_sort(F.collect_list("zona")), "; ").alias("zonas"))


def block_pivot(spark, d):
    z = table(spark, d, "zonas_cuadrantes")
    return z.groupBy("municipio").pivot("bloque", [1, 2, 3, 4, 5, 6]).agg(F.count(F.lit(1))).na.fill(0).select("municipio", *[F.col(str(b)).alias(f"b{b}") for b in range(1, 7)])


def robust_centre(spark, d):
    """The mean of a block's points within twenty kilometres of their median point."""
    c = table(spark, d, "comentarios_llm").where("bloque IS NOT NULL AND lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9").select("message_id", "bloque", "lat", "lon").distinct()
    mid = c.groupBy("bloque").agg(F.median("lat").alias("mlat"), F.median("lon").alias("mlon"))
    near = c.join(F.broadcast(mid), "bloque").where(F.hypot((F.col("lat") - F.col("mlat")) * 111000, (F.col("lon") - F.col("mlon")) * 102000) < 20000)
    return near.groupBy("bloque").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"))


def daily_summary(spark, d):
    e = official(spark, d).withColumn("dia", day())
    return e.groupBy("dia").agg(F.count_if(F.col("tipo") == "afectacion").alias("afectaciones"), F.count_if(F.col("tipo") == "restablecimiento").alias("restablecimientos"), F.count_if(F.col("tipo") == "restablecimiento_parcial").alias("parciales"), F.count_distinct("bloque").alias("bloques"))


def last_days(spark, d):
    return daily_summary(spark, d).orderBy(F.col("dia").desc()).limit(31)


def feed(spark, d):
    """The newest 250 posts, and the pinned ones an event refers to beyond them, without repeats."""
    m = table(spark, d, "mensajes").where("chat = 'canal' AND fecha IS NOT NULL AND texto IS NOT NULL").select("message_id", seconds(F.col("fecha")).alias("t")).distinct()
    newest = m.orderBy(F.col("t").desc(), F.col("message_id").desc()).limit(250)
    pinned = m.join(official(spark, d).where("causa = 'sobrecarga' AND bloque = 0").select("message_id"), "message_id", "left_semi")
    return newest.unionByName(pinned).distinct()


def source_union(spark, d):
    """First source wins: official codes, then codes of comments that are not among them."""
    a = official(spark, d).select(F.explode("zonas").alias("codigo"), F.lit(1).alias("fuente"))
    found = t.code_words(F.col("texto"))
    b = table(spark, d, "mensajes").where("chat = 'comentarios'").select(F.explode(found).alias("codigo"), F.lit(2).alias("fuente"))
    return a.unionByName(b).groupBy("codigo").agg(F.min("fuente").alias("fuente"))


def replaced_subset(spark, d):
    """Old rows of re-resolved keys drop out, new ones come in."""
    old = table(spark, d, "etiquetas").select("doc_id", "area").distinct()
    new = table(spark, d, "documents").where("source = 'parte_oficial'").select("doc_id", F.lit("generacion").alias("area"))
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


QUERIES = {f.__name__: f for f in (report_counts, cause_counts, robust_hours, town_rollup, town_month, town_focus, catalog_fold, top_circuits, mw_stats, daily_circuits, iso_week_trend, kpis, hour_histogram, records, report_cells, population_estimate, alerts, block_patterns, learned_blocks, recurring_codes, group_text, block_pivot, robust_centre, daily_summary, last_days, feed, source_union, replaced_subset)}

_F = "CAST(floor(epoch(fecha)) AS BIGINT)"
_O = f"o AS (SELECT id, message_id, tipo, bloque, causa, municipios, zonas, fecha, {_F} AS t, strftime(fecha, '%Y-%m-%d') AS dia FROM eventos WHERE chat = 'canal' AND fecha IS NOT NULL)"


def _squash(x):
    return f"trim(regexp_replace(translate(regexp_replace(lower({x}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '{t.ACCENTED}', '{t.PLAIN}'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


_DAILY = "SELECT dia, count(*) FILTER (tipo = 'afectacion') AS afectaciones, count(*) FILTER (tipo = 'restablecimiento') AS restablecimientos, count(*) FILTER (tipo = 'restablecimiento_parcial') AS parciales, count(DISTINCT bloque) AS bloques FROM o GROUP BY dia"
_CODES = "unnest(list_filter(string_split_regex(coalesce(texto, ''), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z]{1,3}[0-9]{1,4}$')))"

SQL = {
    "report_counts": "SELECT bloque, count(*) FILTER (tipo = 'reporte_sin_servicio') AS sin, count(*) FILTER (tipo = 'reporte_con_servicio') AS con FROM eventos WHERE tipo LIKE 'reporte%' GROUP BY bloque",
    "cause_counts": f"WITH {_O} SELECT causa, count(*) AS n FROM o WHERE causa IS NOT NULL GROUP BY causa",
    "robust_hours": "SELECT bloque, CAST(round_even(median(horas), 0) AS BIGINT) AS horas, count(*) AS n FROM (SELECT DISTINCT message_id, bloque, horas FROM comentarios_llm WHERE bloque IS NOT NULL AND horas > 0 AND horas <= 96) GROUP BY bloque HAVING count(*) >= 2",
    "town_rollup": f"WITH {_O}, e AS (SELECT id, t, tipo, unnest(list_distinct(municipios)) AS municipio FROM o), c AS (SELECT municipio, count(*) AS total, count(*) FILTER (tipo = 'afectacion') AS afectaciones FROM e GROUP BY ALL) SELECT municipio, CAST(n AS INT) AS n, id, tipo, total, afectaciones FROM (SELECT *, row_number() OVER (PARTITION BY municipio ORDER BY t DESC, id DESC) AS n FROM e) JOIN c USING (municipio) WHERE n <= 8",
    "town_month": f"SELECT municipio, mes, count(*) FILTER (tipo = 'afectacion') AS afectaciones, count(*) FILTER (tipo <> 'afectacion') AS restablecimientos, max(CASE WHEN tipo = 'afectacion' THEN t END) AS ultima FROM (SELECT tipo, strftime(fecha, '%Y-%m') AS mes, {_F} AS t, unnest(list_distinct(municipios)) AS municipio FROM eventos WHERE fecha IS NOT NULL) GROUP BY ALL",
    "town_focus": f"WITH {_O} SELECT municipio, count(*) AS n FROM (SELECT unnest(municipios) AS municipio FROM o WHERE len(municipios) BETWEEN 1 AND 4) GROUP BY ALL",
    "catalog_fold": f"""WITH {_O}, m AS (SELECT DISTINCT id, message_id, t, tipo, bloque, causa, municipios[1] AS municipio, unnest(zonas) AS codigo FROM o),
 k AS (SELECT *, (t, message_id, id) AS a, CASE tipo WHEN 'afectacion' THEN 'sin servicio' WHEN 'restablecimiento' THEN 'con servicio' END AS estado FROM m WHERE codigo IS NOT NULL)
 SELECT codigo, count(*) AS veces, min(t) AS primera, max(t) AS ultima, arg_max(message_id, a) AS ultima_message_id, arg_max(bloque, a) FILTER (bloque IS NOT NULL) AS bloque, arg_max(causa, a) FILTER (causa IS NOT NULL) AS causa, arg_max(municipio, a) FILTER (municipio IS NOT NULL) AS municipio, arg_max(estado, a) FILTER (estado IS NOT NULL) AS estado, regexp_extract(upper(codigo), '^([A-Z]+)', 1) AS prefijo FROM k GROUP BY codigo""",
    "top_circuits": f"WITH {_O} SELECT codigo, count(*) AS n, max(t) AS ultima FROM (SELECT unnest(zonas) AS codigo, t FROM o WHERE tipo = 'afectacion') GROUP BY codigo ORDER BY n DESC, codigo LIMIT 15",
    "mw_stats": "SELECT count(*) AS n, min(mw) AS minimo, max(mw) AS maximo, CAST(round_even(avg(mw), 0) AS BIGINT) AS media FROM (SELECT CAST(nullif(regexp_extract(texto, '(\\d{2,4})\\s*MW', 1), '') AS INT) AS mw FROM (SELECT DISTINCT message_id, texto FROM mensajes WHERE chat = 'canal')) WHERE mw IS NOT NULL",
    "daily_circuits": f"WITH {_O} SELECT dia, count(DISTINCT codigo) AS circuitos FROM (SELECT dia, unnest(zonas) AS codigo FROM o WHERE tipo = 'afectacion') GROUP BY dia",
    "iso_week_trend": "SELECT strftime(o_orderdate, '%G-%V') AS semana, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL",
    "kpis": f"WITH {_O} SELECT (SELECT count(DISTINCT message_id) FROM o WHERE tipo = 'afectacion') AS partes, (SELECT count(*) FROM o WHERE tipo = 'afectacion' AND causa = 'DAF') AS daf, (SELECT count(*) FROM o WHERE tipo = 'afectacion' AND causa = 'avería') AS averias, (SELECT count(DISTINCT codigo) FROM (SELECT unnest(zonas) AS codigo FROM o)) AS circuitos, (SELECT count(DISTINCT id) FROM reportes) AS reportes",
    "hour_histogram": f"WITH {_O} SELECT CAST(h AS INT) AS hora, count(id) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN o ON hour(fecha) = h GROUP BY h",
    "records": f"WITH {_O}, k AS (SELECT dia, count(*) AS n, count(*) FILTER (causa = 'avería') AS averias FROM o WHERE tipo = 'afectacion' GROUP BY dia) SELECT (SELECT dia FROM k ORDER BY n DESC, dia DESC LIMIT 1) AS peor_dia, (SELECT max(n) FROM k) AS peor_n, (SELECT dia FROM k ORDER BY averias DESC, dia DESC LIMIT 1) AS dia_averias, (SELECT max(averias) FROM k) AS max_averias",
    "report_cells": f"""WITH r AS (SELECT DISTINCT id, {_F} AS t, concat_ws(',', CAST(floor(lat * 1000 + 0.5) AS BIGINT), CAST(floor(lon * 1000 + 0.5) AS BIGINT)) AS celda, tipo, ip_hash, nullif(trim(direccion), '') AS direccion FROM reportes WHERE lat IS NOT NULL AND lon IS NOT NULL AND ip_hash IS NOT NULL)
 SELECT celda, count(DISTINCT CASE WHEN tipo = 'sin' THEN ip_hash END) AS sin, count(DISTINCT CASE WHEN tipo = 'con' THEN ip_hash END) AS con, max(t) AS ultima, arg_max(direccion, (t, id)) FILTER (direccion IS NOT NULL AND t IS NOT NULL) AS direccion,
 CASE WHEN count(DISTINCT CASE WHEN tipo = 'con' THEN ip_hash END) > count(DISTINCT CASE WHEN tipo = 'sin' THEN ip_hash END) THEN 'con' ELSE 'sin' END AS tipo, greatest(count(DISTINCT CASE WHEN tipo = 'con' THEN ip_hash END), count(DISTINCT CASE WHEN tipo = 'sin' THEN ip_hash END)) >= 10 AS confirmado FROM r GROUP BY celda""",
    "population_estimate": f"""WITH {_O}, e AS (SELECT id, t, tipo, municipios[1] AS municipio, unnest(zonas) AS codigo FROM o WHERE tipo IN ('afectacion', 'restablecimiento')),
 c AS (SELECT codigo, arg_max(tipo, (t, id, tipo)) AS tipo, arg_max(municipio, (t, id, tipo)) FILTER (municipio IS NOT NULL) AS municipio FROM e GROUP BY codigo),
 s AS (SELECT municipio, count(*) AS n, count(*) FILTER (tipo = 'afectacion') AS fuera FROM c GROUP BY municipio), x AS (SELECT count(*) AS cn, count(*) FILTER (tipo = 'afectacion') AS cf FROM c),
 p AS (SELECT municipio, count(*) * 1000 AS poblacion FROM barrios WHERE municipio IS NOT NULL GROUP BY ALL)
 SELECT p.municipio, poblacion, CAST(floor(CASE WHEN n >= 2 THEN poblacion * fuera / n ELSE poblacion * cf / cn END + 0.5) AS BIGINT) AS sin_servicio FROM p LEFT JOIN s ON p.municipio = s.municipio CROSS JOIN x""",
    "alerts": f"WITH {_O} SELECT dia, bloque, count(DISTINCT message_id) AS n, CASE WHEN count(DISTINCT message_id) >= 5 THEN 'alta' ELSE 'media' END AS nivel FROM o WHERE tipo = 'afectacion' AND bloque IS NOT NULL GROUP BY dia, bloque HAVING count(DISTINCT message_id) >= 3",
    "block_patterns": "SELECT bloque, count(*) AS n, CAST(sum(horas) AS BIGINT) AS total, max(horas) AS maximo FROM (SELECT DISTINCT message_id, bloque, horas FROM comentarios_llm WHERE bloque IS NOT NULL AND horas IS NOT NULL) GROUP BY bloque HAVING count(*) >= 3",
    "learned_blocks": f"WITH c AS (SELECT DISTINCT message_id, bloque, {_squash('lugar')} AS clave FROM comentarios_llm WHERE bloque BETWEEN 1 AND 6 AND lugar IS NOT NULL), v AS (SELECT barrio_id, bloque, count(*) AS n FROM c JOIN (SELECT barrio_id, {_squash('nombre')} AS clave FROM barrios) USING (clave) GROUP BY ALL) SELECT barrio_id, bloque, votos FROM (SELECT *, row_number() OVER (PARTITION BY barrio_id ORDER BY n DESC, bloque) AS k, CAST(sum(n) OVER (PARTITION BY barrio_id) AS BIGINT) AS votos FROM v) WHERE k = 1",
    "recurring_codes": f"WITH {_O}, c AS (SELECT DISTINCT message_id, {_CODES} AS codigo FROM mensajes WHERE chat = 'comentarios') SELECT codigo, count(*) AS n FROM c WHERE codigo NOT IN (SELECT codigo FROM (SELECT unnest(zonas) AS codigo FROM o) WHERE codigo IS NOT NULL) GROUP BY codigo HAVING count(*) >= 3",
    "group_text": "SELECT municipio, array_to_string(list_sort(list(zona)), '; ') AS zonas FROM (SELECT DISTINCT municipio, zona FROM zonas_cuadrantes WHERE zona IS NOT NULL) GROUP BY municipio",
    "block_pivot": "SELECT municipio, " + ", ".join(f"count(*) FILTER (bloque = {b}) AS b{b}" for b in range(1, 7)) + " FROM zonas_cuadrantes GROUP BY municipio",
    "robust_centre": "WITH c AS (SELECT DISTINCT message_id, bloque, lat, lon FROM comentarios_llm WHERE bloque IS NOT NULL AND lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9), m AS (SELECT bloque, median(lat) AS mlat, median(lon) AS mlon FROM c GROUP BY ALL) SELECT c.bloque, count(*) AS n, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM c JOIN m ON c.bloque = m.bloque WHERE sqrt(((lat - mlat) * 111000) ** 2 + ((lon - mlon) * 102000) ** 2) < 20000 GROUP BY c.bloque",
    "daily_summary": f"WITH {_O} {_DAILY}",
    "last_days": f"WITH {_O} {_DAILY} ORDER BY dia DESC LIMIT 31",
    "feed": f"WITH {_O}, m AS (SELECT DISTINCT message_id, {_F} AS t FROM mensajes WHERE chat = 'canal' AND fecha IS NOT NULL AND texto IS NOT NULL), top AS (SELECT * FROM m ORDER BY t DESC, message_id DESC LIMIT 250) SELECT * FROM top UNION SELECT * FROM m WHERE message_id IN (SELECT message_id FROM o WHERE causa = 'sobrecarga' AND bloque = 0)",
    "source_union": f"WITH {_O} SELECT codigo, min(fuente) AS fuente FROM (SELECT unnest(zonas) AS codigo, 1 AS fuente FROM o UNION ALL SELECT {_CODES}, 2 FROM mensajes WHERE chat = 'comentarios') GROUP BY codigo",
    "replaced_subset": "SELECT DISTINCT doc_id, area FROM etiquetas WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'parte_oficial') UNION ALL SELECT doc_id, 'generacion' AS area FROM documents WHERE source = 'parte_oficial'",
}
