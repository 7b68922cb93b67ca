"""Circuit hours, peaks and trends, people, grid and catalogue checks (inventory A8, A10 to A12, A16, A17, A21, J17, K6, G9, G10, D1 to D3, D6 to D8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators import geo as g
from gridpulse.operators import quality as q
from gridpulse.operators.intervals import outages
from gridpulse.operators.spatial import contains
from gridpulse.operators.state import latest, seconds
from gridpulse.queries import training
from gridpulse.queries.geo import BOX, points, zones
from gridpulse.queries.history import block_state, verdicts
from gridpulse.queries.history import _VERDICTS, _BLOCK_STATE, _NOW
from gridpulse.queries.rollups import _F, _O, day, official
from gridpulse.sources import ingest
from gridpulse.sources.tables import table

#: Fixed value: inhabitants of the city.
PEOPLE = 1_749_964
CELL, CLEAR = 0.0025, 0.0028


def ended(spark, d):
    return outages(table(spark, d, "eventos")).select("circuito", "desde", ((F.col("hasta") - F.col("desde")) / 3600.0).alias("h"))


def circuit_hours(spark, d):
    """Ended outages of each circuit: number, longest, mean, sum and last, in hours of one decimal."""
    return ended(spark, d).groupBy("circuito").agg(F.count("*").alias("n"), F.round(F.max("h"), 1).alias("maximo"), F.round(F.avg("h"), 1).alias("media"), F.round(F.sum("h"), 1).alias("total"), F.round(F.max_by("h", F.struct("desde", "h")), 1).alias("ultimo"))


def longest_circuits(spark, d):
    """The fifteen circuits with the longest outage, and how often each was out."""
    return circuit_hours(spark, d).orderBy(F.col("maximo").desc(), "circuito").limit(15).select("circuito", "maximo", "n")


def circuit_peaks(spark, d):
    """Most different circuits out in a day, an ISO week and a bulletin, and the first time it was so."""
    z = official(spark, d).where("tipo = 'afectacion'").select(day().alias("dia"), F.format_string("%d-%02d", F.extract(F.lit("yearofweek"), F.col("fecha")), F.weekofyear("fecha")).alias("semana"), F.col("message_id").cast("string").alias("parte"), F.explode("zonas").alias("codigo"))
    kinds = F.array(*[F.struct(F.lit(k).alias("alcance"), F.col(k).alias("cuando")) for k in ("dia", "semana", "parte")])
    n = z.select("codigo", F.explode(kinds).alias("k")).groupBy("k.alcance", "k.cuando").agg(F.count_distinct("codigo").alias("circuitos"))
    return n.groupBy("alcance").agg(F.min(F.struct(-F.col("circuitos"), F.col("cuando"))).alias("m")).select("alcance", F.col("m.cuando").alias("cuando"), (-F.col("m.col1")).alias("circuitos"))


def megawatt_points(spark, d):
    m = table(spark, d, "mensajes").where("chat = 'canal' AND fecha IS NOT NULL").select("message_id", F.col("fecha").cast("timestamp").alias("fecha"), t.megawatts(F.col("texto")).alias("mw")).where("mw IS NOT NULL").distinct()
    return m.select("message_id", "fecha", seconds(F.col("fecha")).alias("t"), "mw")


def recent_megawatts(spark, d):
    """The last sixty published figures."""
    return megawatt_points(spark, d).orderBy(F.col("t").desc(), F.col("message_id").desc()).limit(60).select("message_id", "t", "mw")


def week_trend(spark, d):
    """By ISO week: different circuits out, and the mean deficit."""
    week = F.format_string("%d-%02d", F.extract(F.lit("yearofweek"), F.col("fecha")), F.weekofyear("fecha")).alias("semana")
    c = official(spark, d).where("tipo = 'afectacion'").select(week, F.explode("zonas").alias("codigo")).groupBy("semana").agg(F.count_distinct("codigo").alias("circuitos"))
    m = megawatt_points(spark, d).select(week, "mw").groupBy("semana").agg(F.floor(F.avg("mw") + 0.5).cast("long").alias("mw"))
    return c.join(m, "semana", "full")


def all_records(spark, d):
    """Greatest deficit, longest outage, day of most circuits and day of most faults; of equal ones the first."""
    first = lambda df, name, value, what: df.agg(F.min(F.struct((-F.col(value).cast("double")).alias("v"), F.col(what).cast("string").alias("w"))).alias("m")).select(F.lit(name).alias("registro"), (-F.col("m.v")).alias("valor"), F.col("m.w").alias("detalle")).where("valor IS NOT NULL")
    days = official(spark, d).where("tipo = 'afectacion'")
    n = days.select(day().alias("dia"), F.explode("zonas").alias("codigo")).groupBy("dia").agg(F.count_distinct("codigo").alias("n"))
    faults = days.where("causa = 'avería'").groupBy(day().alias("dia")).agg(F.count("*").alias("n"))
    return first(megawatt_points(spark, d), "deficit", "mw", "message_id").unionByName(first(circuit_hours(spark, d), "corte", "maximo", "circuito")).unionByName(first(n, "peor_dia", "n", "dia")).unionByName(first(faults, "averias", "n", "dia"))


def people_share(spark, d):
    """People with and without service by the newest official share; here any bulletin with a share counts as official."""
    m = table(spark, d, "mensajes").where("chat = 'canal' AND fecha IS NOT NULL").select("message_id", t.percent_of(F.col("texto")).alias("con_pct")).where("con_pct IS NOT NULL")
    top = m.agg(F.max_by("con_pct", F.struct("message_id", "con_pct")).alias("con_pct")).where("con_pct IS NOT NULL")
    return people(top)


def people(share):
    """(con_pct, sin_pct, con_personas, sin_personas) of a share in percent."""
    return share.select(F.round("con_pct", 1).alias("con_pct"), F.round(100 - F.col("con_pct"), 1).alias("sin_pct"), F.bround(PEOPLE * F.col("con_pct") / 100, 0).cast("long").alias("con_personas"), F.bround(PEOPLE * (100 - F.col("con_pct")) / 100, 0).cast("long").alias("sin_personas"))


def registry(spark, d):
    """Mismatches of event and text codes by message: stored ones stay unless checked again, agreeing ones go, old ones expire.

    Stored: every announcement before the year's middle, without a mismatch of its own; checked: the restorations.
    """
    o = official(spark, d)
    stored = o.where("t < 1751328000").groupBy(F.col("message_id").alias("clave")).agg(F.max("t").alias("t"), F.lit("antes").alias("nota"))
    codes = o.where("tipo = 'restablecimiento'").groupBy("message_id").agg(F.max("t").alias("t"), F.array_distinct(F.flatten(F.collect_list("zonas"))).alias("a"))
    x = codes.join(table(spark, d, "mensajes").where("chat = 'canal'").select("message_id", t.code_words(F.col("texto")).alias("b")).distinct(), "message_id")
    differ = (F.size(F.array_except("a", "b")) > 0) | (F.size(F.array_except("b", "a")) > 0)
    checked = x.select(F.col("message_id").alias("clave"), "t", F.lit("ahora").alias("nota"), differ.alias("wrong"))
    return ingest.registry(stored, checked, "clave", "t", F.lit(1738368000))


def quadrants(spark, d):
    """Groups of zones that are filled as an area, by block, municipality and name without its direction: size of the hull's ground.

    Zones named for a direction are the quadrants here; a hull below 0.01 or above 4 square kilometres is left out.
    """
    z = zones(spark, d).where("bloque IS NOT NULL AND zona RLIKE ' (norte|sur|este|oeste|centro)$'").select(F.concat_ws("|", "bloque", "municipio", F.regexp_replace("zona", " (norte|sur|este|oeste|centro)$", "")).alias("grupo"), F.explode("anillo").alias("p")).select("grupo", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    rings = g.hulls(z, "grupo", "lon", "lat").groupBy("grupo").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("r"))
    return rings.select("grupo", F.size("r").alias("vertices"), F.round(g.area_km2(F.col("r")), 4).alias("area")).where("area BETWEEN 0.01 AND 4")


def fine_negative_space(spark, d):
    """Cells of the 0.0025 degree grid away from every neighbourhood's point and every zone's vertices, outside all zones with a block.

    The municipalities' own polygons are not among the tables, so the box of the city stands for them.
    """
    v = zones(spark, d).select(F.explode("anillo").alias("p")).select(F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    b = table(spark, d, "barrios").where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon")
    free = g.empty_cells(BOX, CELL, v.unionByName(b), CLEAR)
    w, s, *_ = BOX
    cells = free.select((F.col("fila") * F.lit(100_000) + F.col("columna")).cast("long").alias("id"), (s + (F.col("fila") + 0.5) * CELL).alias("lat"), (w + (F.col("columna") + 0.5) * CELL).alias("lon"))
    filled = contains(cells, "id", zones(spark, d).where("bloque IS NOT NULL").select(F.col("zona_id").cast("long").alias("zona_id"), "anillo"), "zona_id", "anillo")
    return cells.join(filled.select(F.col("id_p").alias("id")), "id", "left_anti").select(F.expr("CAST(id DIV 100000 AS int)").alias("fila"), F.expr("CAST(id % 100000 AS int)").alias("columna"))


def misplaced_barrios(spark, d):
    """Neighbourhoods outside their own municipality by more than 800 m, or in none and more than 500 m from all (D1, D2).

    A municipality is the zones that bear its name; the distance to it is that to the nearest of its vertices.
    """
    b = table(spark, d, "barrios").where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("barrio_id").cast("long").alias("id"), "lat", "lon", "municipio").distinct()
    z = zones(spark, d).select(F.col("zona_id").cast("long").alias("zona_id"), "municipio", "anillo")
    return q.misplaced(b, z, "anillo")


def far_lines(spark, d):
    """Zones whose vertices' mean lies more than three kilometres from the neighbourhood that bears their name (D3)."""
    z = zones(spark, d).select(F.col("zona_id").cast("long").alias("id"), F.regexp_replace("zona", " (norte|sur|este|oeste|centro)$", "").alias("nombre"), F.col("anillo").alias("lineas"))
    b = table(spark, d, "barrios").where("lat IS NOT NULL AND lon IS NOT NULL").select("nombre", "lat", "lon")
    return q.far_lines(z.join(b, "nombre"), "id", "lineas")


def freshness(spark, d):
    """Tables by age of their newest row: fine, to be repaired (over two hours), alarming (over 26 hours) or missing (D6)."""
    now = F.lit(1_767_225_600)
    out = None
    for name in ("mensajes", "eventos", "reportes", "estado", "comentarios_llm"):
        one = table(spark, d, name).agg((now - F.max(seconds(F.col("fecha")))).alias("edad")).select(F.lit(name).alias("tabla"), "edad", q.age_level(F.col("edad")).alias("nivel"))
        out = one if out is None else out.unionByName(one)
    return out


def recent_mismatches(spark, d):
    """Messages of the last 24 hours (by the newest event) whose event and text name other codes (D8), and rows without a usable state or date (D7)."""
    o = official(spark, d)
    since = int(o.agg(F.max("t")).first()[0] or 0) - 86_400
    e = o.where(F.col("t") >= since).groupBy("message_id").agg(F.array_distinct(F.flatten(F.collect_list("zonas"))).alias("a"))
    m = table(spark, d, "mensajes").where("chat = 'canal'").select("message_id", t.code_words(F.col("texto")).alias("b")).distinct()
    x = e.join(m, "message_id").where((F.size(F.array_except("a", "b")) > 0) | (F.size(F.array_except("b", "a")) > 0)).select(F.lit("códigos").alias("control"), F.col("message_id").alias("clave")).distinct()
    bad = table(spark, d, "eventos").where("fecha IS NULL OR tipo IS NULL OR tipo NOT IN ('afectacion', 'restablecimiento', 'restablecimiento_parcial', 'reporte_sin_servicio', 'reporte_con_servicio')").select(F.lit("estado o fecha").alias("control"), F.col("id").alias("clave")).distinct()
    return x.unionByName(bad)


def diagnosis(spark, d):
    """What is known at a report's place, the first that holds: a fault within 250 m, a partial restoration within 350 m in a block that is out, a block within 350 m, one within 900 m, nothing.

    Faults and partial restorations are comments of those kinds with a point; a block's sample points are its zones' vertices.
    """
    p = points(spark, d)
    c = table(spark, d, "comentarios_llm").where("lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9")
    out = block_state(spark, d).where("estado = 'afectado'").select("bloque")
    fault = g.nearest_within(p, "id", c.where("reporta = 'queja'").groupBy("lat", "lon").agg(F.min("message_id").alias("a")), "a", 250.0).select("id", "a")
    part = g.nearest_within(p, "id", c.where("reporta = 'con_corriente'").join(F.broadcast(out), "bloque", "left_semi").groupBy("lat", "lon").agg(F.min("message_id").alias("b")), "b", 350.0).select("id", "b")
    vertices = zones(spark, d).where("bloque IS NOT NULL").select("bloque", F.explode("anillo").alias("v")).groupBy(F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon")).agg(F.min("bloque").alias("c"))
    block = g.nearest_within(p, "id", vertices, "c", 900.0)
    x = p.select("id").distinct().join(fault, "id", "left").join(part, "id", "left").join(block.select("id", "c", "metros"), "id", "left")
    via = F.when(F.col("a").isNotNull(), "averia").when(F.col("b").isNotNull(), "parcial").when(F.col("metros") <= 350, "bloque").when(F.col("c").isNotNull(), "cerca").otherwise("nada")
    return x.select("id", via.alias("via"), F.when(F.col("a").isNotNull(), F.col("a")).when(F.col("b").isNotNull(), F.col("b")).otherwise(F.col("c").cast("long")).alias("otro_id"))


QUERIES = {f.__name__: f for f in (circuit_hours, longest_circuits, circuit_peaks, recent_megawatts, week_trend, all_records, people_share, registry, quadrants, fine_negative_space, misplaced_barrios, far_lines, freshness, recent_mismatches, diagnosis)}

_ENDED = training.SQL["p3_found"].split("seen AS")[0].strip().rstrip(",")
_HOURS = "SELECT circuito, count(*) AS n, round(max(h), 1) AS maximo, round(avg(h), 1) AS media, round(sum(h), 1) AS total, round(arg_max(h, (desde, h)), 1) AS ultimo FROM (SELECT circuito, desde, (hasta - desde) / 3600.0 AS h FROM ended) GROUP BY circuito"
_MW = f"mw AS (SELECT DISTINCT message_id, fecha, {_F} AS t, CAST(regexp_extract(texto, '(\\d{{2,4}})\\s*MW', 1) AS INT) AS mw FROM mensajes WHERE chat = 'canal' AND fecha IS NOT NULL AND regexp_extract(texto, '(\\d{{2,4}})\\s*MW', 1) <> '')"
_PCT = "(?i)para el\\s*(\\d{1,3}(?:[.,]\\d+)?)\\s*%"
_OUT = "(SELECT strftime(fecha, '%Y-%m-%d') AS dia, strftime(fecha, '%G-%V') AS semana, CAST(message_id AS VARCHAR) AS parte, unnest(zonas) AS codigo FROM o WHERE tipo = 'afectacion')"
_WORDS = "list_distinct(list_filter(string_split_regex(coalesce(texto, ''), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z]{1,3}[0-9]{1,4}$')))"
_DIFFER = "(len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0)"
_P = "p AS (SELECT DISTINCT id, lat, lon FROM reportes WHERE lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9)"
_DIST = "sqrt((({a}.lat - {b}.lat) * 111000) ** 2 + (({a}.lon - {b}.lon) * 102000) ** 2)"
_EDGES = "e AS (SELECT zona_id, bloque, municipio, anillo[i].lat AS y1, anillo[i].lon AS x1, anillo[i % len(anillo) + 1].lat AS y2, anillo[i % len(anillo) + 1].lon AS x2 FROM (SELECT zona_id, bloque, municipio, anillo, unnest(range(1, len(anillo) + 1)) AS i FROM zonas_cuadrantes))"


def _nearest(name, source, key, reach):
    dist = _DIST.format(a="p", b="s")
    return f"{name} AS (SELECT id, {key}, m FROM (SELECT p.id, s.{key}, {dist} AS m, row_number() OVER (PARTITION BY p.id ORDER BY {dist}, s.{key}) AS k FROM p, {source} s WHERE {dist} < {reach}) WHERE k = 1)"


SQL = {
    "circuit_hours": f"{_ENDED} {_HOURS}",
    "longest_circuits": f"{_ENDED} SELECT circuito, maximo, n FROM ({_HOURS}) ORDER BY maximo DESC, circuito LIMIT 15",
    "circuit_peaks": f"WITH {_O}, z AS {_OUT}, n AS (SELECT 'dia' AS alcance, dia AS cuando, count(DISTINCT codigo) AS c FROM z GROUP BY dia UNION ALL SELECT 'semana', semana, count(DISTINCT codigo) FROM z GROUP BY semana UNION ALL SELECT 'parte', parte, count(DISTINCT codigo) FROM z GROUP BY parte) SELECT alcance, cuando, c AS circuitos FROM (SELECT *, row_number() OVER (PARTITION BY alcance ORDER BY c DESC, cuando) AS k FROM n) WHERE k = 1",
    "recent_megawatts": f"WITH {_MW} SELECT message_id, t, mw FROM mw ORDER BY t DESC, message_id DESC LIMIT 60",
    "week_trend": f"WITH {_O}, {_MW}, z AS {_OUT}, c AS (SELECT semana, count(DISTINCT codigo) AS circuitos FROM z GROUP BY semana), m AS (SELECT strftime(fecha, '%G-%V') AS semana, CAST(floor(avg(mw) + 0.5) AS BIGINT) AS mw FROM mw GROUP BY ALL) SELECT semana, circuitos, mw FROM c FULL JOIN m USING (semana)",
    "all_records": f"""{_ENDED}, {_O}, {_MW}, h AS ({_HOURS}), z AS {_OUT}
 SELECT * FROM (SELECT 'deficit' AS registro, CAST(mw AS DOUBLE) AS valor, CAST(message_id AS VARCHAR) AS detalle FROM mw ORDER BY mw DESC, CAST(message_id AS VARCHAR) LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'corte', maximo, circuito FROM h ORDER BY maximo DESC, circuito LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'peor_dia', CAST(count(DISTINCT codigo) AS DOUBLE) AS n, dia FROM z GROUP BY dia ORDER BY n DESC, dia LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'averias', CAST(count(*) AS DOUBLE) AS n, dia FROM o WHERE tipo = 'afectacion' AND causa = 'avería' GROUP BY dia ORDER BY n DESC, dia LIMIT 1)""",
    "people_share": f"""WITH x AS (SELECT message_id, least(100.0::DOUBLE, CAST(replace(regexp_extract(texto, '{_PCT}', 1), ',', '.') AS DOUBLE)) AS p FROM mensajes WHERE chat = 'canal' AND fecha IS NOT NULL AND regexp_extract(texto, '{_PCT}', 1) <> ''), y AS (SELECT p FROM x ORDER BY message_id DESC, p DESC LIMIT 1)
 SELECT round(p, 1) AS con_pct, round(100 - p, 1) AS sin_pct, CAST(round_even({PEOPLE} * p / 100, 0) AS BIGINT) AS con_personas, CAST(round_even({PEOPLE} * (100 - p) / 100, 0) AS BIGINT) AS sin_personas FROM y""",
    "registry": f"""WITH {_O}, s AS (SELECT message_id AS clave, max(t) AS t FROM o WHERE t < 1751328000 GROUP BY ALL), e AS (SELECT message_id, max(t) AS t, list_distinct(flatten(list(zonas))) AS a FROM o WHERE tipo = 'restablecimiento' GROUP BY message_id),
 m AS (SELECT DISTINCT message_id, {_WORDS} AS b FROM mensajes WHERE chat = 'canal'), c AS (SELECT message_id AS clave, max(t) AS t, bool_or({_DIFFER}) AS wrong FROM e JOIN m USING (message_id) GROUP BY ALL)
 SELECT clave, t, 'antes' AS nota FROM s WHERE t >= 1738368000 AND clave NOT IN (SELECT clave FROM c) UNION ALL SELECT clave, t, 'ahora' FROM c WHERE wrong AND t >= 1738368000""",
    "misplaced_barrios": f"""WITH {_EDGES}, b AS (SELECT DISTINCT barrio_id AS id, lat, lon, municipio FROM barrios WHERE lat IS NOT NULL AND lon IS NOT NULL),
 i AS (SELECT id, b.municipio AS own, e.municipio, zona_id FROM b JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
 v AS (SELECT municipio, q.lat AS lat, q.lon AS lon FROM (SELECT municipio, unnest(anillo) AS q FROM zonas_cuadrantes)),
 dm AS (SELECT b.id, min({_DIST.format(a='b', b='v')}) FILTER (v.municipio = b.municipio) AS own, min({_DIST.format(a='b', b='v')}) AS any FROM b, v GROUP BY b.id)
 SELECT CASE WHEN b.municipio IN (SELECT municipio FROM v) AND NOT EXISTS (SELECT 1 FROM i WHERE i.id = b.id AND i.municipio = b.municipio) AND dm.own > 800 THEN 'fuera de su municipio' ELSE 'fuera de la ciudad' END AS control, CAST(b.id AS BIGINT) AS id
 FROM b JOIN dm ON b.id = dm.id WHERE (b.municipio IN (SELECT municipio FROM v) AND NOT EXISTS (SELECT 1 FROM i WHERE i.id = b.id AND i.municipio = b.municipio) AND dm.own > 800)
 OR (NOT coalesce(b.municipio IN (SELECT municipio FROM v), false) AND NOT EXISTS (SELECT 1 FROM i WHERE i.id = b.id) AND dm.any > 500)""",
    "far_lines": """SELECT DISTINCT CAST(zona_id AS BIGINT) AS id, round(m / 1000, 1) AS km FROM (SELECT zona_id, sqrt(((clat - lat) * 111000) ** 2 + ((clon - lon) * 102000) ** 2) AS m FROM
 (SELECT zona_id, regexp_replace(zona, ' (norte|sur|este|oeste|centro)$', '') AS nombre, list_avg(list_transform(anillo, lambda q: q.lat)) AS clat, list_avg(list_transform(anillo, lambda q: q.lon)) AS clon FROM zonas_cuadrantes) z JOIN barrios USING (nombre) WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE m > 3000""",
    "freshness": " UNION ALL ".join(f"SELECT '{n}' AS tabla, 1767225600 - max({_F}) AS edad, CASE WHEN max({_F}) IS NULL THEN 'falta' WHEN 1767225600 - max({_F}) > 93600 THEN 'alarma' WHEN 1767225600 - max({_F}) > 7200 THEN 'reparar' ELSE 'bien' END AS nivel FROM {n}" for n in ("mensajes", "eventos", "reportes", "estado", "comentarios_llm")),
    "recent_mismatches": f"""WITH {_O}, e AS (SELECT message_id, list_distinct(flatten(list(zonas))) AS a FROM o WHERE t >= (SELECT max(t) - 86400 FROM o) GROUP BY message_id), m AS (SELECT DISTINCT message_id, {_WORDS} AS b FROM mensajes WHERE chat = 'canal')
 SELECT DISTINCT 'códigos' AS control, message_id AS clave FROM e JOIN m USING (message_id) WHERE {_DIFFER}
 UNION ALL SELECT DISTINCT 'estado o fecha', id FROM eventos WHERE fecha IS NULL OR tipo IS NULL OR tipo NOT IN ('afectacion', 'restablecimiento', 'restablecimiento_parcial', 'reporte_sin_servicio', 'reporte_con_servicio')""",
    "fine_negative_space": f"""WITH {_EDGES}, grid AS (SELECT CAST(f AS INT) AS fila, CAST(c AS INT) AS columna, 22.90 + (f + 0.5) * 0.0025 AS gy, -82.70 + (c + 0.5) * 0.0025 AS gx FROM (SELECT unnest(range(180)) AS f), (SELECT unnest(range(320)) AS c)),
 v AS (SELECT q.lat AS lat, q.lon AS lon FROM (SELECT unnest(anillo) AS q FROM zonas_cuadrantes) UNION SELECT lat, lon FROM barrios WHERE lat IS NOT NULL AND lon IS NOT NULL),
 near AS (SELECT DISTINCT fila, columna FROM grid JOIN v ON lat BETWEEN gy - 0.0028 AND gy + 0.0028 AND lon BETWEEN gx - 0.0028 AND gx + 0.0028 AND sqrt((lat - gy) ** 2 + (lon - gx) ** 2) <= 0.0028),
 free AS (SELECT * FROM grid ANTI JOIN near USING (fila, columna)),
 filled AS (SELECT fila, columna FROM free JOIN e ON bloque IS NOT NULL AND (y1 > gy) <> (y2 > gy) AND gx < (x2 - x1) * (gy - y1) / (y2 - y1) + x1 GROUP BY fila, columna, zona_id HAVING count(*) % 2 = 1)
 SELECT fila, columna FROM free ANTI JOIN filled USING (fila, columna)""",
    "diagnosis": f"""WITH {_BLOCK_STATE}, {_P}, c AS (SELECT * FROM comentarios_llm WHERE lat BETWEEN 22.9 AND 23.35 AND lon BETWEEN -82.7 AND -81.9),
 qa AS (SELECT lat, lon, min(message_id) AS a FROM c WHERE reporta = 'queja' GROUP BY ALL), qb AS (SELECT lat, lon, min(message_id) AS b FROM c WHERE reporta = 'con_corriente' AND bloque IN (SELECT bloque FROM block_state WHERE estado = 'afectado') GROUP BY ALL),
 qc AS (SELECT v.lat AS lat, v.lon AS lon, min(bloque) AS c FROM (SELECT bloque, unnest(anillo) AS v FROM zonas_cuadrantes WHERE bloque IS NOT NULL) GROUP BY ALL),
 {_nearest('na', 'qa', 'a', 250)}, {_nearest('nb', 'qb', 'b', 350)}, {_nearest('nc', 'qc', 'c', 900)}
 SELECT id, CASE WHEN a IS NOT NULL THEN 'averia' WHEN b IS NOT NULL THEN 'parcial' WHEN nc.m <= 350 THEN 'bloque' WHEN c IS NOT NULL THEN 'cerca' ELSE 'nada' END AS via, coalesce(a, b, CAST(c AS BIGINT)) AS otro_id
 FROM (SELECT DISTINCT id FROM p) LEFT JOIN na USING (id) LEFT JOIN nb USING (id) LEFT JOIN nc USING (id)""",
}
