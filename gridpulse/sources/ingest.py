"""Incremental ingestion and keyed writes: high-water mark, latest version, merge, retention, registry, validated posts.

Tables are Parquet directories on any file system; a write goes to a new directory beside the old one and is renamed, so
readers never see half a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridpulse.operators.history import thinned

BOX = (-82.70, 22.90, -81.90, 23.35)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path, or an empty one with the schema if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def pull_new(source: DataFrame, stored: DataFrame, keys: tuple[str, str] = ("chat", "message_id")) -> DataFrame:
    """Rows whose id is above the highest stored one of their chat; every row of a chat that is new."""
    group, key = keys
    mark = stored.groupBy(group).agg(F.max(key).alias("__mark"))
    return source.join(F.broadcast(mark), group, "left").where(F.col("__mark").isNull() | (F.col(key) > F.col("__mark"))).drop("__mark")


def latest_version(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by order. Merged in each task first; no window over a key."""
    return rows.withColumn("__r", F.struct(*rows.columns)).groupBy(*keys).agg(F.max_by("__r", F.struct(*order)).alias("__r")).select("__r.*")


def merged(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Upsert: new rows replace stored ones of the same key; of several new rows of a key the greatest by order stands.

    Without an order the greatest by all columns stands, so the result is the same in every run.
    """
    fresh = latest_version(new, keys, order or [c for c in new.columns if c not in keys] or keys).select(*new.columns)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def registry(stored: DataFrame, checked: DataFrame, key: str, stamp: str, oldest: Column, wrong: str = "wrong") -> DataFrame:
    """Keyed registry: checked rows that are wrong are added or replaced, checked ones that agree are resolved and go.

    Stored rows that were not checked this time stay; rows older than the limit, or without a stamp, expire. checked has the
    columns of stored and a boolean; of several rows of a key the newest stands.
    """
    seen = latest_version(checked, [key], [stamp, wrong])
    kept = stored.join(seen.select(key), key, "left_anti")
    return kept.unionByName(seen.where(F.col(wrong)).select(*stored.columns)).where(F.col(stamp) >= oldest)


def retained(rows: DataFrame, stamp: str, oldest: Column) -> DataFrame:
    return rows.where(F.col(stamp) >= oldest)


def record(stored: int | None, current: int) -> int:
    """A record only ever rises."""
    return current if stored is None else max(stored, current)


def publish(df: DataFrame, path: str) -> None:
    """Replaces the table at a path of any file system by df, by renames of that file system.

    If the second rename fails the old table is put back. A driver that dies between the two leaves the old table under
    path.old-*, which recovered() puts back before the next read or write.
    """
    spark = df.sparkSession
    recovered(spark, path)
    name = uuid.uuid4().hex
    at, old, here = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{name}", f"{path}.old-{name}", path))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(at.toString())
    there = fs.exists(here)
    if there and not fs.rename(here, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(at, here):
        if there:
            fs.rename(old, here)
        raise OSError(f"can't publish {path}")
    if there:
        fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a publication moved away and did not replace; True if there was one."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        return False
    left = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*")) or []
    newest = max(left, key=lambda f: f.getModificationTime(), default=None)
    return newest is not None and fs.rename(newest.getPath(), here)


def features(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, ring) of a GeoJSON feature collection; of a multi-polygon the first outer ring."""
    schema = "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    ring = F.when(F.col("f.geometry.type") == "MultiPolygon", F.get(F.get(F.from_json("f.geometry.coordinates", many), F.lit(0)), F.lit(0))).otherwise(F.get(F.from_json("f.geometry.coordinates", one), F.lit(0)))
    return f.select(F.col("f.properties")[name].alias("name"), F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("ring"))


def to_features(shapes: DataFrame, name: str, ring: str) -> DataFrame:
    """One JSON text for each shape, a GeoJSON feature."""
    coordinates = F.array(F.transform(F.col(ring), lambda p: F.array(p["lon"], p["lat"])))
    return shapes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col(name).alias(name)).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("value"))


def valid_reports(posts: DataFrame) -> DataFrame:
    """Posts with a place in the city, a known kind (default sin) and an address of at most 140 characters."""
    w, s, e, n = BOX
    kind = F.when(F.col("tipo").isin("sin", "con"), F.col("tipo")).otherwise("sin")
    return posts.where(F.col("lat").between(s, n) & F.col("lon").between(w, e)).withColumn("tipo", kind).withColumn("direccion", F.left(F.btrim("direccion"), F.lit(140)))


def accepted(posts: DataFrame, key: str, t: str, tie: str, window: int, most: int, salt: str) -> DataFrame:
    """Valid posts under the rate limit, with the sender's address salted and hashed: the whole flow of a post.

    A post without a sender can't be counted and is refused, as the reference does when its store does not answer.
    """
    known = posts.where(F.col(key).isNotNull()).withColumn(key, F.sha2(F.concat(F.col(key), F.lit(salt)), 256))
    return thinned(known, key, t, tie, window, most)


def valid_suggestions(posts: DataFrame) -> DataFrame:
    """Suggestions with a title of at least five characters; title and detail are cut at 120 and 2000."""
    return posts.where(F.length(F.btrim("titulo")) >= 5).withColumn("titulo", F.left(F.btrim("titulo"), F.lit(120))).withColumn("detalle", F.left(F.btrim("detalle"), F.lit(2000)))
