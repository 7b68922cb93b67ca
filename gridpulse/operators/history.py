"""Ordered analytics over the whole history: episodes, declared outage hours, first occurrences, runs.

Entities may be few and large (six blocks hold everything), so running values come from operators.ordered, which spreads
an entity over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.operators.ordered import Running, bucket_of, running

DAY = 86_400
MAX_GAP_H, BULLETIN_CAP_H = 8, 24


def episodes(readings: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """(keys, episode, desde, hasta, value): runs of a cumulative counter; a fall of the value begins a new episode.

    Readings are taken by (time, value); null times or values are left out, repeated readings count once. An episode
    counts its last value, which is its largest.
    """
    clean = readings.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*keys, t, value).distinct().withColumn("__bucket", bucket_of(F.col(t), DAY))
    seen = running(clean, keys, "__bucket", [t, value], [Running("__before", F.struct(F.col(value).alias("v")), "last", inclusive=False)])
    cut = seen.select(*keys, t, value, "__bucket", (F.col("__before").isNotNull() & (F.col(value) < F.col("__before.v"))).cast("long").alias("__new"))
    told = running(cut, keys, "__bucket", [t, value], [Running("episode", F.col("__new"), "sum")])
    return told.groupBy(*keys, "episode").agg(F.min(t).alias("desde"), F.max(t).alias("hasta"), F.max(value).alias(value))


def episode_stats(found: DataFrame, keys: list[str], value: str) -> DataFrame:
    at = F.struct("hasta", "episode")
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("maximo"), F.sum(value).alias("total"), F.max_by(value, at).alias("ultimo"))


def declared_intervals(declared: DataFrame, as_of: int) -> DataFrame:
    """(bloque, ini, fin) in seconds of the outages that bulletins declare; declared: bloque, t (minute), horas.

    At each bulletin a listed block was out for the least of the declared hours, the time since the bulletin before (or
    eight hours) and a day; a block listed before and missing now was out for half the gap, eight hours at most; a
    block listed by the last bulletin stays out until now, eight hours at most. Two bulletins of a minute: the most hours.
    """
    told = declared.where(F.col("bloque").between(1, 6) & F.col("horas").isNotNull() & F.col("t").isNotNull()).groupBy("t", "bloque").agg(F.max("horas").alias("h"))
    grid = told.select("t").distinct().select("t", F.explode(F.array(*[F.lit(b) for b in range(1, 7)])).alias("bloque"))
    rows = grid.join(told, ["t", "bloque"], "left").withColumn("__bucket", bucket_of(F.col("t"), DAY))
    seen = running(rows, ["bloque"], "__bucket", ["t"], [Running("p", F.struct("t", "h"), "last", inclusive=False)])
    last = told.agg(F.max("t").alias("__last"))
    seen = seen.join(F.broadcast(last), F.lit(True))
    gap = (F.col("t") - F.col("p.t")).cast("double")
    span = F.least(F.col("h").cast("double") * 3600, F.coalesce(gap, F.lit(MAX_GAP_H * 3600.0)), F.lit(BULLETIN_CAP_H * 3600.0))
    made = F.array_compact(F.array(
        F.when(F.col("h").isNotNull(), F.struct((F.col("t") - span).alias("ini"), F.col("t").cast("double").alias("fin"))),
        F.when(F.col("h").isNull() & F.col("p.h").isNotNull(), F.struct(F.col("p.t").cast("double").alias("ini"), (F.col("p.t") + F.least(gap / 2, F.lit(MAX_GAP_H * 3600.0))).alias("fin"))),
        F.when(F.col("h").isNotNull() & (F.col("t") == F.col("__last")), F.struct(F.col("t").cast("double").alias("ini"), F.least(F.lit(float(as_of)), F.col("t") + MAX_GAP_H * 3600.0).alias("fin"))),
    ))
    return seen.select("bloque", F.explode(made).alias("i")).select("bloque", "i.ini", "i.fin").where("fin > ini")


def hours_by_day(intervals: DataFrame, zone: str = "America/Havana") -> DataFrame:
    """(bloque, dia, horas): outage hours cut at local midnights, at most 24 a day, one decimal."""
    start, end = F.timestamp_seconds("ini"), F.timestamp_seconds("fin")
    days = intervals.select("bloque", "ini", "fin", F.explode(F.sequence(F.to_date(F.from_utc_timestamp(start, zone)), F.to_date(F.from_utc_timestamp(end, zone)))).alias("dia"))
    opens = F.to_utc_timestamp(F.col("dia").cast("timestamp"), zone).cast("double")
    closes = F.to_utc_timestamp(F.date_add("dia", 1).cast("timestamp"), zone).cast("double")
    part = days.withColumn("s", F.least(F.col("fin"), closes) - F.greatest(F.col("ini"), opens)).where("s > 0")
    return part.groupBy("bloque", "dia").agg(F.least(F.round(F.sum("s") / 3600, 1), F.lit(24.0)).alias("horas"))


def first_seen(rows: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key; partial results are kept in each task, so no key is sorted as a whole."""
    at = F.struct(*order)
    named = [k if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return rows.withColumn("__row", F.struct(*rows.columns)).groupBy(*named).agg(F.min_by("__row", at).alias("r")).select("r.*")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    at = F.struct(*order)
    return rows.withColumn("__row", F.struct(*rows.columns)).groupBy(*keys).agg(F.max_by("__row", at).alias("r")).select("r.*")


def merged_runs(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, desde, hasta): contiguous columns of each grid row as one run; a grid row is small by nature."""
    w = Window.partitionBy(row).orderBy(col)
    return cells.select(row, col).distinct().withColumn("__g", F.col(col) - F.row_number().over(w)).groupBy(row, "__g").agg(F.min(col).alias("desde"), F.max(col).alias("hasta")).drop("__g")


def thinned(rows: DataFrame, key: str, t: str, tie: str, window: int, most: int) -> DataFrame:
    """Rows accepted under a rate limit that counts stored rows only: fewer than `most` accepted ones in the window before.

    A rejected row is not stored and does not count, so acceptance depends on earlier acceptance and no window function
    expresses it. The fold runs in Python over each key's rows, piece by piece: Arrow hands a key's rows over in batches
    in order, and only the last `most` accepted times are carried along.
    """
    import pandas as pd

    schema = rows.schema

    def fold(batches):
        key_now, held = None, []
        for b in batches:
            keep = []
            for k, s in zip(b[key], b[t]):
                if k != key_now:
                    key_now, held = k, []
                held = [h for h in held if h > s - window]
                ok = len(held) < most
                if ok:
                    held.append(s)
                keep.append(ok)
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    return rows.where(F.col(key).isNotNull() & F.col(t).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, t, tie).mapInPandas(fold, schema)
