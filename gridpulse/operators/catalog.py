"""The circuit catalogue out of three sources: posts, deficit bulletins and extractions by a language model (A5 to A7).

Every source gives mentions of one shape; the fold over them is associative, so partial results are merged in each task and
no circuit is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import text as t

POST, DEFICIT, MODEL = 1, 2, 3
#: A bulletin's circuits with their hours, and the cause they begin with.
BULLETIN = r"([A-Za-z]{1,3}\d{1,4}|\d{3,4})\s*(?:\(([^)]{2,30})\))?\s*-?\s*\d+\s*horas?"
DEFICIT_CAUSE = "déficit de generación"
COLUMNS = ["codigo", "via", "t", "message_id", "pos", "calles", "bloque", "municipio", "causa", "estado"]


def post_mentions(messages: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Mentions in posts (message_id, t, texto): streets of three characters or more; block and town only if the post has one."""
    x = F.col("texto")
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    m = messages.select("message_id", "t", F.posexplode(t.circuit_mentions(x)).alias("pos", "m"), only(t.blocks_in(x)).alias("bloque"), only(t.towns_in(x, aliases)).alias("municipio"), t.cause_of(x).alias("causa"), t.service_state(x).alias("estado"))
    m = m.where(F.length("m.calles") >= 3)
    return m.select(F.explode("m.codigos").alias("codigo"), F.lit(POST).alias("via"), "t", "message_id", "pos", F.col("m.calles").alias("calles"), "bloque", "municipio", "causa", "estado").select(*COLUMNS)


def deficit_mentions(messages: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Circuits of deficit bulletins: without streets, out of service, with the municipality in brackets if one is there."""
    plain = t.fold(F.col("texto"))
    told = messages.where(plain.contains("actualizaci") & plain.contains("afectaciones"))
    found = told.select("message_id", "t", F.posexplode(F.arrays_zip(F.regexp_extract_all("texto", F.lit(BULLETIN), F.lit(1)).alias("c"), F.regexp_extract_all("texto", F.lit(BULLETIN), F.lit(2)).alias("m"))).alias("pos", "x"))
    none = lambda kind: F.lit(None).cast(kind)
    return found.select(F.upper("x.c").alias("codigo"), F.lit(DEFICIT).alias("via"), "t", "message_id", "pos", none("string").alias("calles"), none("int").alias("bloque"), F.get(t.towns_in(F.col("x.m"), aliases), F.lit(0)).alias("municipio"), none("string").alias("causa"), F.lit("sin servicio").alias("estado")).select(*COLUMNS)


def model_mentions(extractions: DataFrame) -> DataFrame:
    """Circuits of extractions that bear evidence: by the model, of a validator from the second version on, every circuit with its written codes.

    extractions: message_id, t, via, validador_version, por_confirmar, circuitos (codigos, codigos_estado, calles, municipio,
    estado). Doubtful codes are left out; a state counts only for a code written in the post.
    """
    sure = (F.col("via") == "llm") & (F.coalesce("validador_version", F.lit(0)) >= 2) & F.forall(F.coalesce("circuitos", F.array()), lambda c: c["codigos_estado"].isNotNull())
    rows = extractions.where(sure).select("message_id", "t", F.coalesce("por_confirmar", F.array().cast("array<string>")).alias("doubt"), F.posexplode("circuitos").alias("pos", "c"))
    rows = rows.select("message_id", "t", "pos", "c", "doubt", F.explode("c.codigos").alias("codigo")).where(F.col("codigo").rlike(r"^(?:[A-Z]{1,3}\d{1,4}|\d{3,4})$") & ~F.array_contains("doubt", F.col("codigo")))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("codigo", F.lit(MODEL).alias("via"), "t", "message_id", "pos", F.nullif(F.col("c.calles"), F.lit("")).alias("calles"), none("int").alias("bloque"), F.nullif(F.col("c.municipio"), F.lit("")).alias("municipio"), none("string").alias("causa"), F.when(F.array_contains("c.codigos_estado", F.col("codigo")), F.col("c.estado")).alias("estado")).select(*COLUMNS)


def folded(mentions: DataFrame) -> DataFrame:
    """One record for each circuit. In order of time, post, source and place in the post:

    veces counts posts and bulletins only; the longest streets stay (of equal ones the first); a post's last block, town and
    cause win; bulletin and model fill a town only where no post gives one, the first of them; a circuit that a bulletin
    named first begins with the deficit as its cause; the last state wins.
    """
    at = F.struct("t", "message_id", "via", "pos")
    post = F.col("via") == POST
    last = lambda c, when: F.max_by(c, F.when(when & F.col(c).isNotNull(), at))
    streets = F.struct(-F.length("calles"), F.col("t"), F.col("message_id"), F.col("via"), F.col("pos"))
    fill = F.min_by("municipio", F.when(~post & F.col("municipio").isNotNull(), at))
    return mentions.where("codigo IS NOT NULL AND t IS NOT NULL").groupBy("codigo").agg(
        F.count_if(F.col("via") != MODEL).alias("veces"), F.min("t").alias("primera"), F.max("t").alias("ultima"), F.max_by("message_id", at).alias("ultima_message_id"),
        F.coalesce(F.min_by("calles", F.when(F.length("calles") > 0, streets)), F.lit("")).alias("calles"), last("bloque", post).alias("bloque"), F.coalesce(last("municipio", post), fill).alias("municipio"),
        F.coalesce(last("causa", post), F.when(F.min_by("via", at) == DEFICIT, F.lit(DEFICIT_CAUSE))).alias("causa"), last("estado", F.lit(True)).alias("estado"),
    )
