"""The question-answering tools as functions over a directory of tables; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators import vectors
from gridpulse.queries import history, rollups
from gridpulse.sources.tables import table

SHOWN, MOST_RANKED, MOST_DAYS = 25, 40, 31


def find_zone(spark: SparkSession, d: str, query: str) -> DataFrame:
    """Circuits whose code, municipality or block names hold the query, with status; the full count is in every row."""
    c = rollups.catalog_fold(spark, d).join(history.circuit_status(spark, d).withColumnRenamed("estado", "vigente").drop("bloque"), "codigo", "left")
    hit = t.fold(F.concat_ws(" ", "codigo", "municipio")).contains(t.fold(F.lit(query)))
    found = c.where(hit).select("codigo", "municipio", "bloque", "vigente")
    total = found.agg(F.count("*").alias("total"))
    return found.join(F.broadcast(total), F.lit(True)).orderBy("codigo").limit(SHOWN)


def circuit(spark: SparkSession, d: str, code: str) -> DataFrame:
    """One circuit by its code, without regard to case and punctuation."""
    return rollups.catalog_fold(spark, d).where(t.code_key(F.col("codigo")) == t.code_key(F.lit(code)))


def municipality(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Monthly tallies of municipalities whose name holds the query or the other way round."""
    a, b = t.fold(F.col("municipio")), t.fold(F.lit(name))
    return rollups.town_month(spark, d).where(a.contains(b) | b.contains(a))


def worst(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    return rollups.top_circuits(spark, d).orderBy(F.col("n").desc(), "codigo").limit(max(1, min(n, MOST_RANKED)))


def trend(spark: SparkSession, d: str, days: int = 7) -> DataFrame:
    """The last days in ascending order."""
    return rollups.daily_summary(spark, d).orderBy(F.col("dia").desc()).limit(max(1, min(days, MOST_DAYS))).orderBy("dia")


def search(spark: SparkSession, d: str, query: list[float], k: int = vectors.K, where=None) -> DataFrame:
    return vectors.similarity_cut(vectors.top_similar(table(spark, d, "embeddings"), query, k=k, where=where))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return rollups.report_cells(spark, d)


def bot_state(spark: SparkSession, d: str, last: int = 20) -> DataFrame:
    """Of the newest events the first of each block, user reports and events without a block included."""
    e = table(spark, d, "eventos").where("fecha IS NOT NULL").select("id", F.unix_seconds(F.col("fecha").cast("timestamp")).alias("t"), "tipo", "bloque")
    newest = e.orderBy(F.col("t").desc(), F.col("id").desc()).limit(last)
    return newest.groupBy("bloque").agg(F.max(F.struct("t", "id", "tipo")).alias("e")).select("bloque", "e.tipo", "e.t", "e.id")
