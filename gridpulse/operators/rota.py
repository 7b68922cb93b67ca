"""The weekly rota of circuits protected against under-frequency trips (W9), read out of official posts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import text as t

# Months of the rota's headers, and the patterns of headers and unmarked circuits.
MONTHS = [
    ("enero", 1), ("febrero", 2), ("marzo", 3), ("abril", 4), ("mayo", 5), ("junio", 6), ("julio", 7), ("agosto", 8),
    ("septiembre", 9), ("setiembre", 9), ("octubre", 10), ("noviembre", 11), ("diciembre", 12),
]
HEADER = r"(?i)\bDAF\s*:"
ENDS = r"(?i)jueves\s+(\d{1,2})\s+de\s+([a-záéíóúñ]+)"
BEGINS = r"(?i)viernes\s+(\d{1,2})(?:\s+de\s+([a-záéíóúñ]+))?"
UNMARKED = r"^\s*([A-Za-z]{1,3}\d{1,4}(?:(?:\s*[,/]\s*|\s+[yeYE]\s+)[A-Za-z]{1,3}\d{1,4})*)\s*[-–:]\s*\S"


def month_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS for x in pair])
    return F.try_element_at(table, t.fold(name))


def day_near(day: Column, month: Column, near: Column) -> Column:
    """The date with that day and month nearest to a date: of the year before, the same or the next."""
    tried = F.array(*[F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.year(near) + k, month, day), F.lit("yyyy-MM-dd")).cast("date") for k in (-1, 0, 1)])
    ranked = F.transform(F.array_compact(tried), lambda d: F.struct(F.abs(F.datediff(d, near)).alias("far"), d.alias("d")))
    return F.array_min(ranked)["d"]


def weekly_rotas(messages: DataFrame) -> DataFrame:
    """(message_id, publicado, desde, hasta, circuitos) of every period that a rota post announces.

    messages: message_id, fecha, texto. A post counts if it speaks of rotation, a Friday and designated or protected
    circuits. The end is required; without a start it lies six days before. A start without a month whose day is
    greater than the end's is of the month before. Codes stand between this header and the next, in order, once each.
    Lines are ordered within their post only; null texts and dates give nothing.
    """
    plain = t.fold(F.col("texto"))
    told = messages.where(plain.contains("rotad") & plain.contains("viernes") & (plain.contains("circuitos designados") | plain.contains("circuitos protegidos")) & F.col("fecha").isNotNull())
    lines = told.select("message_id", "fecha", F.to_date("fecha").alias("publicada"), F.posexplode(F.split("texto", "\n")).alias("pos", "line"))
    w = Window.partitionBy("message_id", "fecha").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.col("line").rlike(HEADER)).withColumn("n", F.sum(F.col("head").cast("int")).over(w)).where("n > 0")
    g = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    heads = lines.where("head").select("message_id", "fecha", "n", "publicada", g(ENDS, 1).cast("int").alias("d2"), month_of(g(ENDS, 2)).alias("m2"), g(BEGINS, 1).cast("int").alias("d1"), g(BEGINS, 2).alias("n1"))
    heads = heads.where("d2 IS NOT NULL AND m2 IS NOT NULL").withColumn("hasta", day_near(F.col("d2"), F.col("m2"), F.col("publicada"))).where("hasta IS NOT NULL")
    before = F.when(F.col("d1") > F.dayofmonth("hasta"), F.when(F.col("m2") == 1, 12).otherwise(F.col("m2") - 1)).otherwise(F.col("m2"))
    m1 = F.when(F.col("n1").isNotNull(), month_of(F.col("n1"))).otherwise(before)
    start = day_near(F.col("d1"), m1, F.col("hasta"))
    heads = heads.withColumn("desde", F.when(F.col("d1").isNull(), F.date_sub("hasta", 6)).otherwise(F.when(start > F.col("hasta"), F.add_months(start, -12)).otherwise(start))).where("desde IS NOT NULL")
    marked = F.flatten(F.transform(t.circuit_mentions(F.col("line")), lambda m: m["codigos"]))
    bare = F.when(F.col("line").rlike(UNMARKED), t.codes_of(F.regexp_extract("line", UNMARKED, 1), r"\d{2,4}")).otherwise(F.array().cast("array<string>"))
    codes = lines.where("NOT head").select("message_id", "fecha", "n", F.struct("pos", F.concat(marked, bare).alias("c")).alias("x"))
    listed = codes.groupBy("message_id", "fecha", "n").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]))).alias("circuitos"))
    return heads.join(listed, ["message_id", "fecha", "n"]).where(F.size("circuitos") > 0).select("message_id", F.col("fecha").alias("publicado"), "desde", "hasta", "circuitos")


def current_rota(rotas: DataFrame, today: date) -> DataFrame:
    """The rota in force, else the latest one, with a mark whether it is in force; none gives no row."""
    live = F.lit(today).between(F.col("desde"), F.col("hasta"))
    rank = F.struct(live.alias("v"), F.col("hasta"), F.col("publicado"), F.col("message_id"))
    best = rotas.agg(F.max_by(F.struct(*rotas.columns, live.alias("vigente")), rank).alias("r")).where("r IS NOT NULL")
    return best.select("r.*")


def flagged(catalog: DataFrame, current: DataFrame) -> DataFrame:
    """The catalogue with daf: the circuit stands in the rota in force; a rota that is over marks nothing."""
    listed = current.where("vigente").select(F.explode("circuitos").alias("codigo")).distinct().withColumn("daf", F.lit(True))
    return catalog.join(listed, "codigo", "left").withColumn("daf", F.coalesce("daf", F.lit(False)))
