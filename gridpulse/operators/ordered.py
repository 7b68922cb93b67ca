"""Running values over time-ordered rows of an entity, without putting an entity into one task.

A plain window over an entity sorts all its rows in one task, so one entity with a third of the rows stops scaling. Here
each entity is cut into time buckets: a local window runs within (entity, bucket), one summary row per bucket carries the
bucket's total, and a window over the few summaries gives each bucket what came before it. Every function used is
associative, so the result equals that of the plain window.

The rows move once, to their piece (entity and bucket as one struct, which is never null): summary, local windows and the
join with the summaries read that one exchange, and a following call over the same pieces moves no row again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """name: the new column; value: what runs; how: sum, max or last (the latest value that is not null)."""

    name: str
    value: Column
    how: str
    inclusive: bool = True


def bucket_of(seconds: Column, width: int) -> Column:
    return F.floor(seconds / F.lit(width))


PIECE = "__piece"


def pieces(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """df with its piece as a column, every piece in one partition."""
    return df.withColumn(PIECE, F.struct(*keys, bucket)).repartition(PIECE)


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], what: list[Running], placed: bool = False) -> DataFrame:
    """df with the running values added. bucket must not decrease along order, and order must be total.

    An empty table gives an empty one; null keys form an entity of their own; a null value adds nothing to any function.
    placed: df comes from pieces() of the same keys and bucket, and keeps the piece for the next call.
    """
    rank = F.struct(*[F.col(c) for c in order])
    valued = (df if placed else pieces(df, keys, bucket)).withColumns({f"__v{i}": r.value for i, r in enumerate(what)})
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}

    def total(i: int, how: str) -> Column:
        c = F.col(f"__v{i}")
        return F.max_by(c, F.when(c.isNotNull(), rank)) if how == "last" else fold[how](c)

    summary = valued.groupBy(PIECE).agg(*[total(i, r.how).alias(f"__t{i}") for i, r in enumerate(what)])
    entity = F.struct(*[F.col(PIECE)[k] for k in keys])
    before = Window.partitionBy(entity).orderBy(F.col(PIECE)[bucket]).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(F.col(PIECE).alias("__p"), *[fold[r.how](F.col(f"__t{i}")).over(before).alias(f"__o{i}") for i, r in enumerate(what)])
    within = Window.partitionBy(PIECE).orderBy(*order)
    local = {}
    for i, r in enumerate(what):
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        local[f"__l{i}"] = fold[r.how](F.col(f"__v{i}")).over(frame)
    joined = valued.withColumns(local).join(summary, F.col(PIECE) == F.col("__p"), "left")

    def merged(i: int, how: str) -> Column:
        here, ahead = F.col(f"__l{i}"), F.col(f"__o{i}")
        if how == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(ahead, F.lit(0))
        return F.greatest(here, ahead) if how == "max" else F.coalesce(here, ahead)

    kept = [c for c in df.columns if c != PIECE] + [PIECE] * placed
    return joined.select(*[F.col(c) for c in kept], *[merged(i, r.how).alias(r.name) for i, r in enumerate(what)])
