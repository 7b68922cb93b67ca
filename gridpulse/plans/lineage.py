"""Cutting lineage through storage that every executor shares, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset a folder of our own, on one machine only.

    A cluster that names none is refused: a machine-local folder would be lost with its machine. Our own folder is removed
    when the driver ends.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if known is None and current.isDefined():
        known = current.get()
    if known is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="gridpulse-")
        remove_at_exit(spark, known)
    if not current.isDefined():
        context.setCheckpointDir(known)
    return known


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes the path, on whatever file system, when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: a lost executor costs nothing, later uses recompute nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like settled, as a compressed Parquet table: for wide rows that are read several times. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table whose size is bounded by its nature; one row more than the bound is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound or use a distributed join")
    return rows


def within(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; else as it is, so that its join shuffles by key."""
    return F.broadcast(df) if within(df, most) else df


def blocks(df: DataFrame, size: Column, most: int) -> list[DataFrame]:
    """df in as many blocks as its total size (bytes or characters, say) asks for; each row is in exactly one, by its hash.

    A block may be handed to every task; what a block can't hold goes into the next, so nothing is refused or cut.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // most))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == b) for b in range(n)]
