"""Overlapping and gapped time intervals (problem 3).

Per entity the intervals are taken by start; each start is compared with the running maximum of the earlier ends, the
islands are labelled cumulatively and aggregated to periods, and gaps follow from neighbouring labels. Running values come
from operators.ordered, so an entity that holds a third of all rows is spread over its time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.ordered import PIECE, Running, bucket_of, pieces, running

DAY = 86_400


def outages(events: DataFrame, width: int = DAY) -> DataFrame:
    """(bloque, circuito, causa, desde, hasta) of each ended outage; times are seconds since 1970.

    Only rows with bloque, causa and fecha not null and a circuit in zonas count, once for each circuit. Null or blank
    circuits, null or empty zonas and other kinds of tipo are left out; repeated rows and one event under two ids count
    once. At one instant a restablecimiento is taken before an afectacion, as it ends only what began earlier.
    """
    keys = ["bloque", "circuito", "causa"]
    marks = (
        events.where(F.col("bloque").isNotNull() & F.col("causa").isNotNull() & F.col("fecha").isNotNull())
        .where(F.col("tipo").isin("afectacion", "restablecimiento"))
        .select("bloque", "causa", F.unix_seconds(F.col("fecha").cast("timestamp")).alias("t"), (F.col("tipo") == "afectacion").alias("falls"), F.explode(F.array_distinct("zonas")).alias("circuito"))
        .where(F.trim("circuito") != "")
        .withColumn("__bucket", bucket_of(F.col("t"), width))
    )
    marks = pieces(marks, keys, "__bucket").groupBy(PIECE, *keys, "__bucket", "t").agg(F.max("falls").alias("falls"), F.max(~F.col("falls")).alias("returns"))
    # marks between two returns are one round: its first fall is the outage's start, the return at its end closes it
    rounds = running(marks, keys, "__bucket", ["t"], [Running("n", F.col("returns").cast("long"), "sum", inclusive=False)], placed=True)
    returns, falls = F.col("returns"), F.col("falls")
    sides = rounds.select(*keys, "t", F.explode(F.array_compact(F.array(
        F.when(returns, F.struct("n", F.lit(True).alias("is_end"))),
        F.when(falls, F.struct((F.col("n") + returns.cast("long")).alias("n"), F.lit(False).alias("is_end"))),
    ))).alias("s"))
    ended = sides.groupBy(*keys, F.col("s.n").alias("n")).agg(F.min(F.when(~F.col("s.is_end"), F.col("t"))).alias("desde"), F.max(F.when(F.col("s.is_end"), F.col("t"))).alias("hasta"))
    return ended.where(F.col("desde").isNotNull() & F.col("hasta").isNotNull()).select(*keys, "desde", "hasta")


def periods_and_gaps(intervals: DataFrame, keys: list[str], width: int = DAY) -> DataFrame:
    """(keys, clase, desde, hasta): continuous periods of intervals that overlap or touch, and the gaps between them.

    intervals: keys, desde, hasta as long. Intervals with a null end, or that end before they start, are left out;
    repeated intervals count once; an entity with one period has no gap; nested intervals vanish in the outer one.
    """
    clean = intervals.where(F.col("hasta") >= F.col("desde")).withColumn("__bucket", bucket_of(F.col("desde"), width))
    clean = pieces(clean, keys, "__bucket").groupBy(PIECE, *keys, "__bucket", "desde").agg(F.max("hasta").alias("hasta"))
    seen = running(clean, keys, "__bucket", ["desde"], [Running("reach", F.col("hasta"), "max", inclusive=False)], placed=True)
    flagged = seen.withColumn("new", (F.col("reach").isNull() | (F.col("desde") > F.col("reach"))).cast("long"))
    labelled = running(flagged, keys, "__bucket", ["desde"], [Running("island", F.col("new"), "sum")], placed=True)
    # the first interval of an island also tells the gap before it: from the reach of what came earlier
    periods = labelled.groupBy(*keys, "island").agg(F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.max(F.when(F.col("new") == 1, F.col("reach"))).alias("before"))
    parts = F.array_compact(F.array(
        F.struct(F.lit("periodo").alias("clase"), F.col("desde").alias("a"), F.col("hasta").alias("b")),
        F.when(F.col("before").isNotNull(), F.struct(F.lit("hueco").alias("clase"), F.col("before").alias("a"), F.col("desde").alias("b"))),
    ))
    return periods.select(*keys, F.explode(parts).alias("p")).select(*keys, F.col("p.clase").alias("clase"), F.col("p.a").alias("desde"), F.col("p.b").alias("hasta"))


def outage_periods(events: DataFrame, width: int = DAY) -> DataFrame:
    """Each circuit's continuous outage periods over all causes (clase periodo) and the gaps between them (hueco)."""
    return periods_and_gaps(outages(events, width), ["bloque", "circuito"], width)
