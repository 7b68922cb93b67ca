"""The catalogue out of its three sources (inventory A5 to A7, J7), and the mentions it rests on."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators import catalog as c
from gridpulse.operators.state import seconds
from gridpulse.queries.rollups import _F
from gridpulse.queries.text import _BLOCKS, _CAUSE, _STATE, _TOWNS, _fold, messages, town_aliases
from gridpulse.sources.tables import table


def extractions(spark, d):
    """Extractions as a model would leave them, out of the events: without a block they come from rules and bear no evidence."""
    e = table(spark, d, "eventos").where("chat = 'canal' AND fecha IS NOT NULL").groupBy("message_id").agg(F.max(seconds(F.col("fecha"))).alias("t"), F.min("tipo").alias("tipo"), F.max("bloque").alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("zonas")))).alias("codigos"), F.array_min(F.flatten(F.collect_list("municipios"))).alias("municipio"))
    m = table(spark, d, "mensajes").where("chat = 'canal'").groupBy("message_id").agg(F.max("texto").alias("texto"))
    x = e.join(m, "message_id").withColumn("escritos", F.filter("codigos", lambda k: t.code_written(k, F.col("texto"))))
    state = F.when(F.col("tipo") == "afectacion", "sin servicio").otherwise("con servicio")
    one = F.struct("codigos", F.col("escritos").alias("codigos_estado"), F.lit(None).cast("string").alias("calles"), "municipio", state.alias("estado"))
    return x.select("message_id", "t", F.when(F.col("b").isNull(), "reglas").otherwise("llm").alias("via"), F.lit(3).alias("validador_version"), F.array(F.lit("B87")).alias("por_confirmar"), F.array(one).alias("circuitos"))


def catalog_sources(spark, d):
    m = messages(spark, d, "canal").where("fecha IS NOT NULL").select("message_id", seconds(F.col("fecha")).alias("t"), "texto")
    aliases = town_aliases(spark, d)
    return c.folded(c.post_mentions(m, aliases).unionByName(c.deficit_mentions(m, aliases)).unionByName(c.model_mentions(extractions(spark, d))))


QUERIES = {"catalog_sources": catalog_sources}

_CODE_LIST = f"{t.CODE}(?:{t.CODE_GAP}{t.CODE})*"
_MENTION = f"👉[\\x{{1F3FB}}-\\x{{1F3FF}}]?\\s*({_CODE_LIST})\\s*([-–:])?\\s*([^\\n👉]+)"
_CLEAN = lambda x: f"trim(regexp_replace({x}, '[📉🚧✅📣📌🔔‼️⚡️👉💥📈🔹]+', '', 'g'), ' .-–')"
_GROUP = lambda i: f"regexp_extract(m, '{_MENTION}', {i})"
_RAW = f"""raw AS (SELECT *, list_filter(list_transform(string_split_regex({_GROUP(1)}, '{t.CODE_GAP}'), lambda k: upper(regexp_replace(k, '\\s', '', 'g'))), lambda k: regexp_matches(k, '^(?:[A-Z]{{1,3}}\\d{{1,4}}|\\d{{2,4}})$') AND (regexp_matches(k, '^[A-Z]') OR {_GROUP(2)} <> '')) AS codigos, {_CLEAN("regexp_replace(" + _GROUP(3) + ", '\\s+$', '')")} AS calles
  FROM (SELECT message_id, fecha, texto, unnest(regexp_extract_all(texto, '{_MENTION}')) AS m, generate_subscripts(regexp_extract_all(texto, '{_MENTION}'), 1) AS i FROM (SELECT DISTINCT message_id, fecha, texto FROM mensajes WHERE chat = 'canal'))),
 men AS (SELECT message_id, fecha, texto, codigos, calles, CAST(row_number() OVER (PARTITION BY message_id, fecha, texto ORDER BY i) - 1 AS INT) AS pos FROM raw WHERE len(codigos) > 0)"""
_TOWN_LIST = f"(SELECT list(t.municipio) FROM {_TOWNS} t WHERE regexp_matches({_fold('texto')}, '(^|[^a-z0-9_])' || t.alias || '($|[^a-z0-9_])'))"
_BULLETIN = "([A-Za-z]{1,3}\\d{1,4}|\\d{3,4})\\s*(?:\\(([^)]{2,30})\\))?\\s*-?\\s*\\d+\\s*horas?"

SQL = {
    "circuit_mentions": f"WITH {_RAW} SELECT message_id, pos, codigo, calles, regexp_extract(codigo, '^([A-Z]+)', 1) AS prefijo FROM (SELECT message_id, pos, calles, unnest(codigos) AS codigo FROM men)",
    "catalog_sources": f"""WITH {_RAW},
 a AS (SELECT unnest(codigos) AS codigo, 1 AS via, {_F} AS t, message_id, pos, calles, CASE WHEN len({_BLOCKS}) = 1 THEN CAST({_BLOCKS}[1] AS INT) END AS bloque, CASE WHEN len({_TOWN_LIST}) = 1 THEN {_TOWN_LIST}[1] END AS municipio, {_CAUSE} AS causa, {_STATE} AS estado FROM men WHERE length(calles) >= 3 AND fecha IS NOT NULL),
 b0 AS (SELECT message_id, {_F} AS t, unnest(regexp_extract_all(texto, '{_BULLETIN}')) AS m, generate_subscripts(regexp_extract_all(texto, '{_BULLETIN}'), 1) - 1 AS pos FROM (SELECT DISTINCT message_id, fecha, texto FROM mensajes WHERE chat = 'canal' AND fecha IS NOT NULL) WHERE contains({_fold('texto')}, 'actualizaci') AND contains({_fold('texto')}, 'afectaciones')),
 b AS (SELECT upper(regexp_extract(m, '{_BULLETIN}', 1)) AS codigo, 2 AS via, t, message_id, pos, NULL AS calles, NULL AS bloque, (SELECT min(x.municipio) FROM {_TOWNS} x WHERE regexp_matches({_fold(f"regexp_extract(m, '{_BULLETIN}', 2)")}, '(^|[^a-z0-9_])' || x.alias || '($|[^a-z0-9_])')) AS municipio, NULL AS causa, 'sin servicio' AS estado FROM b0),
 e AS (SELECT message_id, max({_F}) AS t, min(tipo) AS tipo, max(bloque) AS bl, list_distinct(flatten(list(zonas))) AS codigos, list_min(flatten(list(municipios))) AS municipio FROM eventos WHERE chat = 'canal' AND fecha IS NOT NULL GROUP BY message_id),
 l AS (SELECT unnest(codigos) AS codigo, e.*, texto FROM e JOIN (SELECT message_id, max(texto) AS texto FROM mensajes WHERE chat = 'canal' GROUP BY message_id) USING (message_id) WHERE bl IS NOT NULL),
 c AS (SELECT codigo, 3 AS via, t, message_id, 0 AS pos, NULL AS calles, NULL AS bloque, nullif(municipio, '') AS municipio, NULL AS causa, CASE WHEN coalesce(regexp_matches(texto, '(?i)(^|[^A-Za-z0-9])' || regexp_extract(codigo, '^([A-Z]{{1,3}})', 1) || '\\s*' || regexp_extract(codigo, '(\\d{{1,4}})$', 1) || '($|[^A-Za-z0-9])'), false) THEN CASE WHEN tipo = 'afectacion' THEN 'sin servicio' ELSE 'con servicio' END END AS estado FROM l WHERE codigo <> 'B87' AND regexp_matches(codigo, '^[A-Z]{{1,3}}\\d{{1,4}}$')),
 k AS (SELECT *, (t, message_id, via, pos) AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c))
 SELECT codigo, count(*) FILTER (via <> 3) AS veces, min(t) AS primera, max(t) AS ultima, arg_max(message_id, o) AS ultima_message_id, coalesce(arg_min(calles, (-length(calles), t, message_id, via, pos)) FILTER (length(calles) > 0), '') AS calles,
 arg_max(bloque, o) FILTER (via = 1 AND bloque IS NOT NULL) AS bloque, coalesce(arg_max(municipio, o) FILTER (via = 1 AND municipio IS NOT NULL), arg_min(municipio, o) FILTER (via > 1 AND municipio IS NOT NULL)) AS municipio,
 coalesce(arg_max(causa, o) FILTER (via = 1 AND causa IS NOT NULL), CASE WHEN arg_min(via, o) = 2 THEN '{c.DEFICIT_CAUSE}' END) AS causa, arg_max(estado, o) FILTER (estado IS NOT NULL) AS estado FROM k GROUP BY codigo""",
}
