"""Structured Streaming forms: extraction with exactly-once effect, dedupe, hourly tallies, rate limit, state ageing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridpulse.operators.extraction import events_of
from gridpulse.plans.lineage import shared_folder


def stream_of(spark: SparkSession, directory: str, name: str, files: int = 16) -> DataFrame:
    """A table as a file stream; a glob, as the table may be one file or a directory."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{directory}/{name[:-1]}[{name[-1]}].parquet")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the source holds now, through a checkpointed query into the shared folder.

    Append: a Parquet sink, whose log makes each batch count once. Complete: every batch writes the whole result anew.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def extracted(messages: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Events of a message stream; repeated messages count once, however far apart they come.

    No watermark: a message of any age or without a date counts. State is the key of each message seen, never dropped.
    """
    return events_of(messages.dropDuplicates(["chat", "message_id"]), aliases)


def deduplicated(events: DataFrame, key: str, stamp: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once. With a stamp a key is kept until `late` has passed since it, so state is bounded.

    late must cover the greatest lateness of a source, as rows behind it are left out. Without a stamp keys are kept for
    ever, for sources whose rows may be of any age.
    """
    if stamp is None:
        return events.dropDuplicates([key])
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, stamp: str, kind: str, late: str = "2 days") -> DataFrame:
    """Tumbling hours by kind; rows later than the watermark are left out of the state."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hora"), kind, "n")


#: Posts of one sender that a trigger judges in order; a trigger with more of them fails rather than judging out of order.
MOST_IN_TRIGGER = 1_000_000


def rate_limited(posts: DataFrame, key: str, seconds: str, window: int, most: int, late: str = "1 hour") -> DataFrame:
    """Accepted posts of a stream: fewer than `most` accepted ones of the key in the window before.

    All posts of a key in a trigger are judged in order of time, whatever the number of Arrow batches they come in. State is
    the accepted times of the last window, at most `most` of them; it is removed when the watermark passes the window
    after the last post. Posts behind the watermark are left out, as their turn is over.
    """
    schema = posts.schema
    stamped = posts.withColumn("__at", F.timestamp_seconds(seconds)).withWatermark("__at", late)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += len(b)
            if n > MOST_IN_TRIGGER:
                raise ValueError("one sender has too many posts in a trigger; take fewer files at a time")
        rows = pd.concat(parts).drop(columns="__at")
        rows = rows.sort_values([seconds, *(c for c in rows.columns if c not in (seconds, key))], kind="stable")
        keep = []
        for s in rows[seconds]:
            held = [h for h in held if h > s - window]
            ok = len(held) < most
            if ok:
                held.append(int(s))
            keep.append(ok)
        yield rows[keep]
        state.update((held,))
        last = max(held, default=0) * 1000
        state.setTimeoutTimestamp(max(last + window * 1000, state.getCurrentWatermarkMs() + 1))

    return stamped.groupBy(key).applyInPandasWithState(step, schema, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
