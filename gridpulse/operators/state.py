"""Current state out of ordered events: blocks, runs, overrides, effective status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WINDOW_H, PARTIAL_WINDOW_H, TOWN_WINDOW_H = 12, 5, 6
BULLETIN_FRESH_H, CIRCUIT_STALE_H = 4, 24
BLOCKS = list(range(7))


def latest(df: DataFrame, column: str = "fecha") -> datetime | None:
    """The 'now' of a table: reproducible, unlike a clock."""
    return df.agg(F.max(column)).first()[0]


def seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def block_state(events: DataFrame, as_of: datetime, hours: int = BLOCK_WINDOW_H) -> DataFrame:
    """(bloque, estado, desde, causa, ult_afecta, parcial), one row for each block 0 to 6; times in seconds.

    A fold over the events of the last hours, written as windows: a full event (afectacion, restablecimiento) sets the
    state; a partial restoration before any full event shows that the block is out, and does not change it later. desde
    is where the current run began; causa is that of the last full event; parcial is the newest partial one after it,
    if not older than five hours. A block without events is 'desconocido'. Only the look-back window is ordered.
    """
    now = F.lit(as_of).cast("timestamp")
    recent = events.where((F.col("chat") == "canal") & F.col("bloque").isNotNull() & F.col("tipo").isin("afectacion", "restablecimiento", "restablecimiento_parcial"))
    recent = recent.where((F.col("fecha").cast("timestamp") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("fecha").cast("timestamp") <= now)).select("id", "bloque", "tipo", "causa", seconds(F.col("fecha")).alias("t")).distinct()
    order = Window.partitionBy("bloque").orderBy("t", "id")
    whole = F.when(F.col("tipo") == "afectacion", "afectado").when(F.col("tipo") == "restablecimiento", "restablecido")
    rows = recent.withColumn("full", whole).withColumn("eff", F.coalesce(F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("afectado")))
    rows = rows.withColumn("turn", F.coalesce(F.col("eff") != F.lag("eff").over(order), F.lit(True)))
    at = F.struct("t", "id")
    state = rows.groupBy("bloque").agg(
        F.max_by("eff", at).alias("estado"),
        F.max(F.when(F.col("turn"), F.col("t"))).alias("desde"),
        F.max_by("causa", F.when(F.col("full").isNotNull(), at)).alias("causa"),
        F.max(F.when(F.col("tipo") == "afectacion", F.col("t"))).alias("ult_afecta"),
        F.max(F.when(F.col("tipo") == "restablecimiento_parcial", at)).alias("__p"),
        F.max(F.when(F.col("full").isNotNull(), at)).alias("__f"),
    )
    fresh = F.col("__p.t") >= F.unix_seconds(now) - PARTIAL_WINDOW_H * 3600
    after = F.col("__f").isNull() | (F.col("__p") > F.col("__f"))
    state = state.select("bloque", "estado", "desde", "causa", "ult_afecta", F.when((F.col("estado") == "afectado") & fresh & after, F.col("__p.t")).alias("parcial"))
    blocks = events.sparkSession.createDataFrame([(b,) for b in BLOCKS], "bloque int")
    return blocks.join(state, "bloque", "left").withColumn("estado", F.coalesce("estado", F.lit("desconocido")))


def bulletin_override(state: DataFrame, declared: DataFrame) -> DataFrame:
    """The state corrected by the newest by-block bulletin: declared (bloque, horas, t), t the same in all rows.

    Listed blocks are out since t less the declared hours, unless restored at or after t; unlisted blocks 1 to 6 are out
    since their last outage if that is newer, else restored at t. Block 0 is never discarded. No bulletin, no change.
    """
    told = declared.agg(F.max("t").alias("__t"))
    listed = declared.groupBy("bloque").agg(F.max("horas").alias("__h"))
    x = state.join(listed, "bloque", "left").join(F.broadcast(told), F.lit(True), "left")
    since = F.col("__t") - F.round(F.col("__h") * 3600).cast("long")
    newer = (F.col("estado") == "restablecido") & (F.col("desde") >= F.col("__t"))
    listed_now, unlisted = F.col("__h").isNotNull() & ~F.coalesce(newer, F.lit(False)), F.col("__h").isNull() & F.col("bloque").between(1, 6) & F.col("__t").isNotNull()
    again = F.coalesce(F.col("ult_afecta") > F.col("__t"), F.lit(False))
    return x.select(
        "bloque",
        F.when(listed_now | (unlisted & again), "afectado").when(unlisted, "restablecido").otherwise(F.col("estado")).alias("estado"),
        F.when(listed_now, since).when(unlisted & again, F.col("ult_afecta")).when(unlisted, F.col("__t")).otherwise(F.col("desde")).alias("desde"),
        "causa",
        "ult_afecta",
        F.when(listed_now | (F.col("estado") == "afectado"), F.col("parcial")).alias("parcial"),
    )


def national_override(state: DataFrame, since: int | None) -> DataFrame:
    """During a national event since that second blocks 1 to 6 are out; an earlier outage keeps its start."""
    if since is None:
        return state
    hit = F.col("bloque").between(1, 6)
    keeps = (F.col("estado") == "afectado") & (F.col("desde") <= since)
    return state.withColumn("desde", F.when(hit & ~F.coalesce(keeps, F.lit(False)), F.lit(since)).otherwise(F.col("desde"))).withColumn("estado", F.when(hit, "afectado").otherwise(F.col("estado")))


def run_start(events: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(key, value, desde): the last value and where its current run began; value is never null and takes few values.

    The run begins at the first row of the last value behind the last row of any other one. Both are plain aggregates, so a
    key with a third of all rows is never sorted.
    """
    rows = events.select(key, value.alias("__v"), F.struct(*order).alias("__at"))
    last = rows.groupBy(key, "__v").agg(F.max("__at").alias("__m")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__m", "__v")), False).alias("__l"))
    top = last.select(key, F.get("__l", F.lit(0))["__v"].alias("value"), F.get("__l", F.lit(1))["__m"].alias("__other"))
    run = rows.join(top, key).where((F.col("__v") == F.col("value")) & (F.col("__other").isNull() | (F.col("__at") > F.col("__other"))))
    return run.groupBy(key, "value").agg(F.min("__at").alias("__b")).select(key, "value", F.col("__b")[order[0]].alias("desde"))


def effective_status(state: Column, state_at: Column, block_state_: Column, block_since: Column, now: Column) -> Column:
    """con, sin, nd or asum of a circuit: its own state, overruled by a newer outage of its block; stale states are nd.

    A restored circuit whose block went out later is assumed out (asum), as is one of unknown state in an outage.
    """
    stale = state_at.isNull() | (now - state_at > CIRCUIT_STALE_H * 3600)
    later = F.coalesce((block_state_ == "afectado") & (block_since > state_at), F.lit(False))
    out = block_state_ == "afectado"
    return F.when(state.isNull() | stale, F.when(F.coalesce(out, F.lit(False)), "asum").otherwise("nd")).when((state == "con servicio") & later, "asum").when(state == "con servicio", "con").otherwise("sin")
