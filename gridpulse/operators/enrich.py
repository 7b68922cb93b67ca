"""External extractors, embedders, geocoders and rerankers behind injected callables; only what is new is worked on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.plans.lineage import bounded_rows

BATCH, RETRIES, MOST_CANDIDATES = 32, 3, 1_000
NEAR_M = 2_000.0


def embedded(fragments: DataFrame, stored: DataFrame, embed: Callable[[list[str]], list[list[float]]], width: int, batch: int = BATCH) -> DataFrame:
    """(id, hash, embedding) of fragments (id, texto) whose text's hash is not stored (id, hash).

    The callable gets at most `batch` texts and must return as many vectors of that width, else the job fails.
    """
    new = fragments.where("id IS NOT NULL AND texto IS NOT NULL").select("id", "texto", F.sha1("texto").alias("hash")).distinct().join(stored.select("id", "hash"), ["id", "hash"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made: list[list[float]] = []
            for at in range(0, len(b), batch):
                some = b["texto"].iloc[at : at + batch].tolist()
                got = embed(some)
                if len(got) != len(some) or any(len(v) != width for v in got):
                    raise ValueError("the embedder returned another number or width of vectors")
                made += got
            yield pd.DataFrame({"id": b["id"], "hash": b["hash"], "embedding": made})

    kind = fragments.schema["id"].dataType.simpleString()
    return new.select("id", "hash", "texto").mapInPandas(run, f"id {kind}, hash string, embedding array<float>")


def due(wanted: DataFrame, cache: DataFrame, attempts: DataFrame, key: str, most: int = RETRIES) -> DataFrame:
    """Keys to work on: not cached, and tried fewer than `most` times. Cached results are always used."""
    tried = attempts.where(F.col("n") >= most).select(key)
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti").join(tried, key, "left_anti")


def reranked(found: DataFrame, score: Callable[[list[str]], list[float]], key: str, text: str, k: int = 3) -> DataFrame:
    """The k best of a short candidate list by an injected scorer; ties keep the smaller key.

    The list is what a search found: more than MOST_CANDIDATES of it are an error, as a scorer reads them one by one.
    """
    rows = sorted(bounded_rows(found.select(key, text), MOST_CANDIDATES, "the list to rerank"), key=lambda r: r[0])
    ranked = sorted(zip(score([r[1] for r in rows]), [r[0] for r in rows]), key=lambda x: (-x[0], x[1]))[:k]
    kind = found.schema[key].dataType.simpleString()
    return found.sparkSession.createDataFrame([(n + 1, i, float(s)) for n, (s, i) in enumerate(ranked)], f"puesto int, {key} {kind}, puntos double")


def located(items: DataFrame, gazetteer: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon, via): a manual point, else the robust centre of the item's named streets or places, else nothing.

    items: key, clave (one row for each named place); gazetteer and manual: clave, lat, lon. The centre is the median of
    the points found, then the mean of those within two kilometres of it.
    """
    fixed = items.join(manual, "clave").groupBy(key).agg(F.min(F.struct("lat", "lon")).alias("p")).select(key, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.lit("manual").alias("via"))
    points = items.join(fixed.select(key), key, "left_anti").join(gazetteer, "clave").select(key, "lat", "lon")
    middle = points.groupBy(key).agg(F.median("lat").alias("mlat"), F.median("lon").alias("mlon"))
    near = points.join(middle, key).where(F.hypot((F.col("lat") - F.col("mlat")) * 111000, (F.col("lon") - F.col("mlon")) * 102000) < NEAR_M)
    centre = near.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumn("via", F.lit("calles"))
    return fixed.unionByName(centre)
