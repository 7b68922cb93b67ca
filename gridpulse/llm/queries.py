"""Queries of the text problems, over whole tables and whole texts, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.addresses import same_location
from gridpulse.llm.conversations import conversations
from gridpulse.llm.leakage import leaks
from gridpulse.llm.places import mapped
from gridpulse.llm.subjects import subjects
from gridpulse.llm.tokens import encoded
from gridpulse.llm.visible import look_same
from gridpulse.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reportes").select("id", "direccion", F.lit(None).cast("string").alias("town"))
    items = table(spark, d, "estado").select(F.col("item_id").alias("id"), "direccion", F.col("municipio").alias("town"))
    return same_location(reports.unionByName(items), table(spark, d, "barrios"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    comments = table(spark, d, "mensajes").where("chat = 'comentarios'").select("message_id", "texto")
    return look_same(comments, "message_id", "texto").select(F.col("id_a").alias("message_id_a"), F.col("id_b").alias("message_id_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "comentarios_llm").select("message_id", "lugar"), "message_id", "lugar", table(spark, d, "barrios"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "mensajes").select("chat", "message_id", "fecha", "texto", "reply_to", "autor"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "pruebas"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects(*(table(spark, d, name) for name in ("documents", "etiquetas", "areas", "pruebas")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}

SQL = {
    "p5_found": r"""
WITH RECURSIVE m AS (
  SELECT message_id, min(reply_to) AS parent, min(fecha) AS fecha,
         min(CASE WHEN regexp_full_match(autor, 'operadora_[0-9]+') THEN 'operador' WHEN autor = 'bot_guardia' THEN 'bot' ELSE 'vecino' END) AS rol,
         bool_or(coalesce(regexp_replace(texto, '[\s\p{Z}\p{Cf}\p{Cc}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{034F}]+', '', 'g') <> '', false)) AS seen
  FROM mensajes WHERE chat = 'comentarios' GROUP BY message_id),
t AS (
  SELECT message_id AS root_id, message_id, fecha, rol, seen, fecha IS NULL AS wrong FROM m WHERE parent IS NULL
  UNION ALL
  SELECT t.root_id, m.message_id, m.fecha, m.rol, m.seen, m.fecha IS NULL OR t.fecha IS NULL OR m.fecha < t.fecha FROM m JOIN t ON m.parent = t.message_id),
kept AS (
  SELECT root_id FROM t GROUP BY root_id
  HAVING NOT bool_or(wrong) AND max(CASE WHEN rol = 'operador' AND seen THEN fecha END) > min(CASE WHEN rol = 'vecino' AND seen THEN fecha END))
SELECT root_id, message_id, CAST(row_number() OVER (PARTITION BY root_id ORDER BY fecha, message_id) AS INT) AS turno, rol
FROM t WHERE root_id IN (SELECT root_id FROM kept)
""",
}
