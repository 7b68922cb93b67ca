"""Projections, predicates and extraction from texts (inventory P1 to P43), over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators.extraction import bulletin_fragments, events_of, fault_items, fragments, validated
from gridpulse.plans.lineage import bounded_rows
from gridpulse.sources.tables import table

MOST_TOWNS = 1_000


def messages(spark: SparkSession, d: str, chat: str | None = None) -> DataFrame:
    """Messages without repeated rows."""
    rows = table(spark, d, "mensajes").select("chat", "message_id", "fecha", "texto")
    return (rows if chat is None else rows.where(F.col("chat") == chat)).distinct()


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "|")


def town_aliases(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    names = bounded_rows(table(spark, d, "barrios").where("municipio IS NOT NULL").select("municipio", t.fold(F.col("municipio")).alias("alias")).distinct().orderBy("municipio"), MOST_TOWNS, "the municipalities")
    return [(r.alias, r.municipio) for r in names]


def fold_text(spark, d):
    c = table(spark, d, "comentarios_llm").where("lugar IS NOT NULL").select("message_id", "lugar").distinct()
    return c.select("message_id", t.fold(F.col("lugar")).alias("folded"), t.squash(F.col("lugar")).alias("squashed"), t.fold_toponym(F.col("lugar")).alias("toponym"), t.fold_toponym(F.col("lugar"), r"el|la|alturas|de", "keep").alias("toponym_core"))


def street_forms(spark, d):
    e = table(spark, d, "estado").where("direccion IS NOT NULL").select("item_id", "direccion").distinct()
    return e.select("item_id", t.fold_street(F.col("direccion")).alias("street"), t.canon_street(F.col("direccion")).alias("street_key"))


def towns_in(spark, d):
    aliases = town_aliases(spark, d)
    return messages(spark, d).select("chat", "message_id", F.explode(t.towns_in(F.col("texto"), aliases)).alias("municipio"))


def cause_of(spark, d):
    x = F.col("texto")
    return messages(spark, d, "canal").select("message_id", "fecha", t.cause_of(x).alias("causa"), t.is_total_loss(x).alias("total_loss")).groupBy("causa", "total_loss").agg(F.count("*").alias("n"), F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"))


def blocks_in(spark, d):
    return messages(spark, d).select("chat", "message_id", F.explode(t.blocks_in(F.col("texto"))).alias("bloque"))


def zones_in(spark, d):
    return messages(spark, d, "canal").select("message_id", F.posexplode(t.zones_in(F.col("texto"))).alias("pos", "zona"))


def classify_post(spark, d):
    x = F.col("texto")
    return messages(spark, d, "canal").where("texto IS NOT NULL").select("message_id", t.post_kind(x).alias("tipo"), t.service_state(x).alias("estado"), t.feed_tag(x).alias("etiqueta"), t.relevant_post(x).alias("relevante"))


def extract_events(spark, d):
    e = events_of(messages(spark, d), town_aliases(spark, d))
    return e.groupBy("chat", "tipo", "bloque", "causa").agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("messages"), F.sum(F.size("zonas")).alias("zones"), F.sum(F.size("municipios")).alias("towns"))


def event_rows(spark, d):
    """The events themselves, with zones and municipalities in order."""
    e = events_of(messages(spark, d), town_aliases(spark, d))
    return e.select("chat", "message_id", "tipo", "bloque", "causa", joined(F.col("zonas")).alias("zonas"), joined(F.col("municipios")).alias("municipios"))


def classify_comment(spark, d):
    x = F.col("texto")
    kinds = messages(spark, d, "comentarios").select("message_id", t.comment_kind(x).alias("tipo"), t.only_block(x).alias("bloque"), t.hours_claimed(x).alias("horas"), t.promising_comment(x).alias("promising"))
    return kinds.where("tipo IS NOT NULL OR horas IS NOT NULL OR promising")


def bulletin_hours(spark, d):
    m = messages(spark, d, "canal")
    by_block = m.select("message_id", F.explode(t.block_hours(F.col("texto"))).alias("h")).select("message_id", F.col("h.bloque").cast("string").alias("clave"), F.col("h.horas").alias("horas"), F.lit("bloque").alias("por"))
    by_circuit = m.select("message_id", F.explode(t.circuit_hours(F.col("texto"))).alias("h")).select("message_id", F.col("h.codigo").alias("clave"), F.col("h.horas").alias("horas"), F.lit("circuito").alias("por"))
    return by_block.unionByName(by_circuit).distinct()


def megawatts(spark, d):
    x = F.col("texto")
    return messages(spark, d, "canal").select("message_id", t.megawatts(x).alias("mw"), t.percent_of(x).alias("pct")).where("mw IS NOT NULL OR pct IS NOT NULL")


def circuit_mentions(spark, d):
    found = messages(spark, d, "canal").select("message_id", F.posexplode(t.circuit_mentions(F.col("texto"))).alias("pos", "m"))
    return found.select("message_id", "pos", F.explode("m.codigos").alias("codigo"), F.col("m.calles").alias("calles")).withColumn("prefijo", t.code_prefix(F.col("codigo")))


def leading_codes(spark, d):
    z = messages(spark, d, "canal").select("message_id", F.posexplode(F.split(F.coalesce("texto", F.lit("")), "\n")).alias("pos", "line"))
    found = z.select("message_id", "pos", t.leading_codes(F.regexp_replace(F.col("line"), "^[^\\p{L}\\p{N}]+", "")).alias("l")).where(F.size("l.codigos") > 0)
    return found.select("message_id", "pos", joined(F.col("l.codigos")).alias("codigos"), F.col("l.resto").alias("resto"))


def code_evidence(spark, d):
    e = table(spark, d, "eventos").where("chat = 'canal'").select("message_id", F.explode("zonas").alias("codigo")).distinct()
    seen = e.join(messages(spark, d, "canal"), "message_id").select("message_id", "codigo", t.code_written(F.col("codigo"), F.col("texto")).alias("written"))
    return seen.groupBy("codigo").agg(F.count_if("written").alias("n_written"), F.count("*").alias("n"))


def validate_extraction(spark, d):
    e = table(spark, d, "eventos").where("chat = 'canal'").groupBy("message_id").agg(F.min("tipo").alias("tipo"), F.array_sort(F.collect_set("bloque")).alias("bloques"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("zonas")))).alias("zonas"))
    raw = e.select("message_id", F.to_json(F.struct("tipo", "bloques", F.transform("zonas", lambda z: F.struct(z.alias("codigo"), F.lit("sin servicio").alias("estado"))).alias("circuitos"))).alias("json"))
    out = validated(raw.join(messages(spark, d, "canal"), "message_id"), "json", "texto")
    return out.select("message_id", "tipo", joined(F.col("bloques")).alias("bloques"), F.size("circuitos").alias("n"), F.size(F.filter("circuitos", lambda c: c["estado"].isNotNull())).alias("n_with_state"))


def place_pieces(spark, d):
    x = F.col("direccion")
    e = table(spark, d, "estado").where("direccion IS NOT NULL").select("item_id", "direccion").distinct()
    return e.select("item_id", F.size(t.street_names(x)).alias("n_streets"), F.size(t.toponym_pieces(x)).alias("n_pieces"), F.size(t.geocode_candidates(x)).alias("n_candidates"), joined(t.numbered_zones(x)).alias("zones"), t.locality_of(x).alias("locality"))


def numbered_zones(spark, d):
    e = table(spark, d, "estado").where("direccion IS NOT NULL").select("item_id", "direccion").distinct()
    return e.select("item_id", F.explode(t.numbered_zones(F.col("direccion"))).alias("zona")).groupBy("zona").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


def clean_streets(spark, d):
    e = messages(spark, d, "canal").where("texto IS NOT NULL").select("message_id", F.posexplode(F.split("texto", "\n")).alias("pos", "line"))
    return e.select("message_id", "pos", t.clean_streets(F.col("line")).alias("calles"))


def fault_lines(spark, d):
    return fault_items(messages(spark, d, "canal"))


def fragment_texts(spark, d):
    f = fragments(table(spark, d, "comentarios_llm"))
    return f.select("message_id", "texto", F.sha1("texto").alias("hash"))


def bulletin_texts(spark, d):
    """Bulletins with an event or a figure in MW, as prose; the streets are those written after a circuit of the event."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    e = table(spark, d, "eventos").where("chat = 'canal'").groupBy("message_id").agg(F.min("tipo").alias("tipo"), F.min("fecha").alias("e_fecha"), flat("municipios").alias("municipios"), flat("zonas").alias("codigos"))
    m = messages(spark, d, "canal").groupBy("message_id").agg(F.max(F.struct("fecha", "texto")).alias("m")).select("message_id", F.col("m.fecha").alias("fecha"), F.col("m.texto").alias("texto"))
    lines = F.transform(F.split("texto", "\n"), lambda line: t.leading_codes(F.regexp_replace(line, "^[^\\p{L}\\p{N}]+", "")))
    streets = F.transform(F.filter(lines, lambda x: F.arrays_overlap(x["codigos"], F.col("codigos"))), lambda x: t.clean_streets(x["resto"]))
    x = e.join(m, "message_id", "full").select("message_id", F.coalesce("e_fecha", "fecha").alias("fecha"), "tipo", "municipios", streets.alias("calles"), "codigos", t.megawatts(F.col("texto")).alias("mw_deficit"))
    return bulletin_fragments(x).select("message_id", "texto", F.sha1("texto").alias("hash"))


def content_hash(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha1("text").alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def ip_hashes(spark, d):
    return table(spark, d, "reportes").where("ip_hash IS NOT NULL").select(t.ip_hash(F.col("ip_hash"), "sal").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


def durations(spark, d):
    e = table(spark, d, "estado").where("generado IS NOT NULL AND fecha IS NOT NULL").select("item_id", (F.unix_seconds(F.col("generado").cast("timestamp")) - F.unix_seconds(F.col("fecha").cast("timestamp"))).alias("s")).where("s >= 0").distinct()
    return e.select("item_id", "s", t.humanised(F.col("s")).alias("duracion"))


def search_text(spark, d):
    """Catalogue rows whose folded text contains the folded query, the first eight."""
    z = table(spark, d, "zonas_cuadrantes").select("zona_id", "zona", "municipio")
    hit = t.fold(F.concat_ws(" ", "zona", "municipio")).contains("alturas")
    return z.where(hit).orderBy("zona_id").limit(8)


def code_lookup(spark, d):
    """Circuits by code without regard to case and punctuation."""
    e = table(spark, d, "eventos").select(F.explode("zonas").alias("codigo")).where("codigo IS NOT NULL")
    return e.groupBy(t.code_key(F.col("codigo")).alias("clave")).agg(F.max("codigo").alias("codigo"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fold_text, street_forms, towns_in, cause_of, blocks_in, zones_in, classify_post, extract_events, event_rows, classify_comment, bulletin_hours, megawatts, circuit_mentions, leading_codes, code_evidence, validate_extraction, place_pieces, numbered_zones, clean_streets, fault_lines, fragment_texts, bulletin_texts, content_hash, ip_hashes, durations, search_text, code_lookup)}


def _fold(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '{t.ACCENTED}', '{t.PLAIN}')"


def _has(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, '{pattern}', 'i'), false)"


_MSG = "(SELECT DISTINCT chat, message_id, fecha, texto FROM mensajes)"
_CANAL = "(SELECT DISTINCT message_id, fecha, texto FROM mensajes WHERE chat = 'canal')"
_COMMENTS = "(SELECT DISTINCT message_id, fecha, texto FROM mensajes WHERE chat = 'comentarios')"
_TOTAL = f"({_has('texto', t.TOTAL_LOSS)} AND NOT coalesce(contains({_fold('texto')}, 'restablec') AND regexp_matches({_fold('texto')}, '\\btras (?:la )?desconexion total\\b'), false))"
_CAUSE = f"CASE WHEN {_TOTAL} THEN 'desconexión total del SEN' " + " ".join(f"WHEN {_has('texto', p)} THEN '{n}'" for p, n in t.CAUSES) + " END"
_BLOCKS = f"list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(texto, ''), '(?i){t.BLOCK}', 1), flatten(list_transform(regexp_extract_all(coalesce(texto, ''), '(?i){t.BLOCK_LIST}', 1), lambda x: regexp_extract_all(x, '([1-6])', 1))))))"
_BACK, _OFF = f"coalesce(regexp_matches({_fold('texto')}, '{t.RESTORES}'), false)", f"coalesce(regexp_matches({_fold('texto')}, '{t.AFFECTS}'), false)"
_RESTORED = f"({_BACK} AND (NOT {_OFF} OR regexp_matches(lower(texto), '^[^\\p{{L}}\\p{{N}}_]*(✅|restableci|queda reparada)')))"
_POST = f"CASE WHEN {_TOTAL} THEN 'afectacion' WHEN {_RESTORED} AND regexp_matches({_fold('texto')}, '{t.PARTIAL}') THEN 'restablecimiento_parcial' WHEN {_RESTORED} THEN 'restablecimiento' WHEN {_BACK} OR {_OFF} THEN 'afectacion' END"
_STATE = f"CASE WHEN regexp_matches({_fold('texto')}, '{t.STATE_WITH}') THEN 'con servicio' WHEN regexp_matches({_fold('texto')}, '{t.STATE_WITHOUT}') THEN 'sin servicio' END"
_TAG = "CASE " + " ".join(f"WHEN {_has('texto', p)} THEN '{n}'" for p, n in t.FEED_TAGS) + f" ELSE '{t.OTHER_TAG}' END"
_COMMENT = f"CASE WHEN length(texto) > 600 OR {_has('texto', t.WITHOUT_SERVICE)} = {_has('texto', t.WITH_SERVICE)} THEN NULL WHEN {_has('texto', t.WITHOUT_SERVICE)} THEN 'reporte_sin_servicio' ELSE 'reporte_con_servicio' END"
_TOWNS = f"(SELECT DISTINCT municipio, {_fold('municipio')} AS alias FROM barrios WHERE municipio IS NOT NULL)"
_BODY = f"trim(regexp_replace(trim(regexp_replace(trim(line), '^[{t.BULLETS}\\x{{1F3FB}}-\\x{{1F3FF}}]+', '')), '{t.TAIL_SIGNS}', ''))"
_ZONES = f"""(SELECT message_id, i, CASE WHEN NOT contains(body, ':') THEN body WHEN {_fold("trim(split_part(body, ':', 1))")} = 'municipio' THEN ''
   WHEN starts_with({_fold("trim(split_part(body, ':', 1))")}, 'zona') OR regexp_matches({_fold("trim(split_part(body, ':', 1))")}, '^(?:[a-z]{{1,3}}\\d{{1,4}}|\\d{{2,4}})\\b') THEN body
   ELSE trim(regexp_replace(body, '^[^:]*:', '')) END AS zona
 FROM (SELECT message_id, i, {_BODY} AS body FROM (SELECT message_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS i FROM {_CANAL}) WHERE regexp_matches(trim(line), '^[{t.BULLETS}]')))"""
_HOURS = "round_even(CAST(regexp_extract(m, '{p}', {h}) AS DOUBLE) + coalesce(CAST(nullif(regexp_extract(m, '{p}', {k}), '') AS DOUBLE), 0) / 60, 1)"

SQL = {
    "fold_text": f"""SELECT DISTINCT message_id, {_fold("lugar")} AS folded, trim(regexp_replace({_fold("lugar")}, '[\\s\\x{{00A0}}]+', ' ', 'g')) AS squashed,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_fold("lugar")}, '\\([^)]*\\)', ' ', 'g'), '\\b(reparto|barrio|zona|municipio)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS toponym,
 trim(regexp_replace(regexp_replace(regexp_replace({_fold("lugar")}, '\\b(el|la|alturas|de)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS toponym_core FROM comentarios_llm WHERE lugar IS NOT NULL""",
    "towns_in": f"SELECT m.chat, m.message_id, t.municipio FROM {_MSG} m JOIN {_TOWNS} t ON regexp_matches({_fold('m.texto')}, '(^|[^a-z0-9_])' || t.alias || '($|[^a-z0-9_])')",
    "cause_of": f"SELECT causa, total_loss, count(*) AS n, min(message_id) AS first_id, max(message_id) AS last_id FROM (SELECT message_id, {_CAUSE} AS causa, {_TOTAL} AS total_loss FROM {_CANAL}) GROUP BY ALL",
    "blocks_in": f"SELECT chat, message_id, CAST(unnest({_BLOCKS}) AS INT) AS bloque FROM {_MSG}",
    "zones_in": f"SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id, g ORDER BY i) - 1 AS INT) AS pos, zona FROM (SELECT *, 0 AS g FROM {_ZONES}) WHERE zona <> ''",
    "classify_post": f"SELECT message_id, {_POST} AS tipo, {_STATE} AS estado, {_TAG} AS etiqueta, {_has('texto', t.RELEVANT)} AS relevante FROM {_CANAL} WHERE texto IS NOT NULL",
    "classify_comment": f"""SELECT * FROM (SELECT message_id, {_COMMENT} AS tipo, CASE WHEN len({_BLOCKS}) = 1 THEN CAST({_BLOCKS}[1] AS INT) END AS bloque,
 CASE WHEN regexp_extract(texto, '(?i){t.CLAIMED}', 1) <> '' THEN CAST(regexp_extract(texto, '(?i){t.CLAIMED}', 1) AS INT) * CASE WHEN starts_with(lower(regexp_extract(texto, '(?i){t.CLAIMED}', 2)), 'd') THEN 24 ELSE 1 END END AS horas,
 coalesce(length(regexp_replace(texto, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) >= 12 AND NOT regexp_matches(regexp_replace(texto, '^[\\s\\p{{Z}}]+', ''), '^@|configura tu @username|bienvenid|para evitar ser silenciad', 'i'), false) AS promising FROM {_COMMENTS}) WHERE tipo IS NOT NULL OR horas IS NOT NULL OR promising""",
    "bulletin_hours": f"""SELECT DISTINCT message_id, clave, horas, por FROM (
 SELECT message_id, regexp_extract(m, '{t.BLOCK_HOURS}', 1) AS clave, {_HOURS.format(p=t.BLOCK_HOURS, h=2, k=3)} AS horas, 'bloque' AS por FROM (SELECT message_id, unnest(regexp_extract_all(texto, '{t.BLOCK_HOURS}')) AS m FROM {_CANAL}) WHERE CAST(regexp_extract(m, '{t.BLOCK_HOURS}', 1) AS INT) BETWEEN 1 AND 6
 UNION ALL
 SELECT message_id, upper(regexp_extract(m, '{t.CIRCUIT_HOURS}', 1)), {_HOURS.format(p=t.CIRCUIT_HOURS, h=2, k=3)}, 'circuito' FROM (SELECT message_id, unnest(regexp_extract_all(texto, '{t.CIRCUIT_HOURS}')) AS m FROM {_CANAL}))""",
    "megawatts": f"""SELECT * FROM (SELECT message_id, CASE WHEN regexp_extract(texto, '(\\d{{2,4}})\\s*MW', 1) <> '' THEN CAST(regexp_extract(texto, '(\\d{{2,4}})\\s*MW', 1) AS INT) END AS mw,
 CASE WHEN regexp_extract(texto, '(?i)para el (\\d{{1,3}}(?:[.,]\\d+)?)\\s*%', 1) <> '' THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, CAST(replace(regexp_extract(texto, '(?i)para el (\\d{{1,3}}(?:[.,]\\d+)?)\\s*%', 1), ',', '.') AS DOUBLE))) END AS pct FROM {_CANAL}) WHERE mw IS NOT NULL OR pct IS NOT NULL""",
    "numbered_zones": """WITH e AS (SELECT DISTINCT item_id, regexp_replace(direccion, '(?i)micro\\s*\\d+', ' ', 'g') AS x FROM estado WHERE direccion IS NOT NULL)
SELECT zona, count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT item_id, CAST(x AS INT) AS zona FROM (SELECT item_id, unnest(regexp_extract_all(x, '\\d+')) AS x FROM e) WHERE length(x) <= 2) GROUP BY zona""",
    "clean_streets": f"SELECT message_id, CAST(i - 1 AS INT) AS pos, trim(regexp_replace(line, '[📉🚧✅📣📌🔔‼️⚡️👉💥📈🔹]+', '', 'g'), ' .-–') AS calles FROM (SELECT message_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS i FROM {_CANAL} WHERE texto IS NOT NULL)",
    "content_hash": "SELECT sha1(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "ip_hashes": "SELECT sha256(ip_hash || 'sal') AS hash, count(*) AS n FROM reportes WHERE ip_hash IS NOT NULL GROUP BY ALL",
    "durations": """SELECT DISTINCT item_id, s, CASE WHEN s // 60 < 60 THEN (s // 60) || 'm' WHEN s // 3600 < 24 THEN (s // 3600) || 'h ' || (s // 60) % 60 || 'm' ELSE (s // 86400) || 'd ' || (s // 3600) % 24 || 'h' END AS duracion
 FROM (SELECT item_id, CAST(floor(epoch(generado)) - floor(epoch(fecha)) AS BIGINT) AS s FROM estado WHERE generado IS NOT NULL AND fecha IS NOT NULL) WHERE s >= 0""",
    "search_text": f"SELECT zona_id, zona, municipio FROM zonas_cuadrantes WHERE contains({_fold('concat_ws(chr(32), zona, municipio)')}, 'alturas') ORDER BY zona_id LIMIT 8",
    "code_lookup": f"SELECT regexp_replace({_fold('codigo')}, '[^a-z0-9]', '', 'g') AS clave, max(codigo) AS codigo, count(*) AS n FROM (SELECT unnest(zonas) AS codigo FROM eventos) WHERE codigo IS NOT NULL GROUP BY ALL",
    "fragment_texts": """SELECT message_id, texto, sha1(texto) AS hash FROM (SELECT DISTINCT message_id, concat_ws('. ', 'Comentario ' || reporta, 'en ' || trim(lugar), 'bloque ' || bloque, 'desde hace ' || horas || ' h') AS texto
 FROM comentarios_llm WHERE regexp_replace(lugar, '[\\s\\p{Z}]+', '', 'g') <> '')""",
}
