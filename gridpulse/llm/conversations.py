"""Rebuilding conversations from message rows (problem 5).

Rows are cut into runs of consecutive message ids. Inside a run every chain of answers is walked up to its first message
there: these chains are the fragments, each with the hash of the message before its first one. Two fragments overlap where
that hash is one of the other's messages: the prefix of the lower is a suffix of the upper one. The overlaps form a graph
of fragments, far smaller than the messages; as a message answers at most one other, every path upwards is unambiguous
and is merged by doubling. Paths that lead nowhere, or round in a circle, are gaps and are dropped with all that hangs on
them. A conversation is kept only if it is whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.ordered import Running, bucket_of, running
from gridpulse.plans.lineage import settled

HOUR = 3_600_000_000
#: Ids in a run: a fragment is walked up within one task, so this bounds a task's rows.
RUN = 1 << 16
NEVER = -(1 << 63)


def role(author: Column) -> Column:
    return F.when(author.rlike("^operadora_[0-9]+$"), F.lit("operador")).when(author == "bot_guardia", F.lit("bot")).otherwise(F.lit("vecino"))


def visible(text: Column) -> Column:
    """True if the text holds a character other than spaces, controls and invisible format characters."""
    return F.coalesce(F.regexp_replace(text, "[\\s\\p{Z}\\p{Cf}\\p{Cc}\\x{115F}\\x{1160}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}\\x{034F}]+", "") != "", F.lit(False))


FRAGMENTS = "id long, parent long, fecha long, rol string, seen boolean, head long, above long, wrong boolean"


def walked(rows: pd.DataFrame) -> pd.DataFrame:
    """One run's messages with the first message of their fragment (head) and the message that one answers (above).

    Messages that go round in a circle within the run are left out. wrong: without a date, or dated before the message of
    the run it answers. NEVER stands for a missing parent or date.
    """
    rows = rows.sort_values("id", ignore_index=True)
    ids, parent, fecha = (rows[c].to_numpy("int64") for c in ("id", "parent", "fecha"))
    slot = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
    inside = (parent != NEVER) & (ids[slot] == parent)
    up = np.where(inside, slot, np.arange(len(ids)))
    wrong = (fecha == NEVER) | (inside & ((fecha[slot] == NEVER) | (fecha < fecha[slot])))
    head = up
    for _ in range(len(ids).bit_length()):
        head = head[head]
    first = ~inside
    out = rows[["id", "parent", "fecha", "rol", "seen"]].assign(head=ids[head], above=np.where(first, parent, NEVER), wrong=wrong)
    return out[first[head]]


def fragments(messages: DataFrame, run: int = RUN) -> DataFrame:
    """The messages (id, parent, fecha in microseconds, rol, seen; one row an id) with head, above and wrong."""
    known = messages.withColumns({"parent": F.coalesce("parent", F.lit(NEVER)), "fecha": F.coalesce("fecha", F.lit(NEVER))})
    return known.groupBy(F.floor(F.col("id") / run).alias("__run")).applyInPandas(lambda _, g: walked(g), FRAGMENTS)


def merged(found: DataFrame) -> DataFrame:
    """(head, root, late) of each fragment whose path upwards ends at a message that answers none.

    late: the fragment's first message is dated before the one it answers in another fragment, or that one has no date.
    Round k merges paths of 2^k fragments. A fragment at depth d has one above at every smaller depth, so the first round
    that reaches no new root shows that what remains leads nowhere or in circles.
    """
    first = found.where("id = head")
    roots = first.where(F.col("above") == NEVER).select("head", F.col("head").alias("root"), F.lit(False).alias("late"))
    lower = first.where(F.col("above") != NEVER).select("head", "above", "fecha", F.xxhash64("above").alias("prefix"))
    upper = found.select(F.col("id").alias("above"), F.col("head").alias("next"), F.col("fecha").alias("asked"), F.xxhash64("id").alias("prefix"))
    late = (F.col("asked") == NEVER) | (F.col("fecha") < F.col("asked"))
    open_ = settled(lower.join(upper, ["prefix", "above"]).select("head", "next", late.alias("late")))
    ends, done = open_.select("head", "late"), [roots]
    reached = roots.select("head", "root")
    paths = open_.select("head", "next")
    while not paths.isEmpty():
        met = settled(paths.join(reached.select(F.col("head").alias("next"), "root"), "next", "left").select("head", "next", "root"))
        arrived, rest = met.where("root IS NOT NULL").select("head", "root"), met.where("root IS NULL").select("head", "next")
        if arrived.isEmpty():
            break
        done.append(arrived.join(ends, "head"))
        # merge: the suffix of the upper path is the prefix of the lower one
        paths = settled(rest.join(paths.select(F.col("head").alias("next"), F.col("next").alias("then")), "next").select("head", F.col("then").alias("next")))
        reached = reached.unionByName(arrived)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def conversations(messages: DataFrame, chat: str = "comentarios", run: int = RUN) -> DataFrame:
    """(root_id, message_id, turno, rol) of every message of every kept conversation.

    A conversation is kept if every member has a fecha, none is dated before the message it answers, and a visible
    message of an operator is dated later than the first visible one of a neighbour. Repeated rows count once (of a key
    with different rows the smallest row by text and date stands); null ids are dropped; an answer that points to
    itself, in a circle or to nothing is dropped with its answers. Verdicts are summed by fragment before they meet, and
    rows join by fragment, never by conversation; turno is counted over (conversation, hour) pieces, so a conversation with
    a third of all rows is never in one task.
    """
    rows = (
        messages.where((F.col("chat") == chat) & F.col("message_id").isNotNull())
        .select(F.col("message_id").alias("id"), F.col("reply_to").alias("parent"), F.unix_micros(F.col("fecha").cast("timestamp")).alias("fecha"), role(F.col("autor")).alias("rol"), visible(F.col("texto")).alias("seen"))
        .groupBy("id").agg(F.min(F.struct("parent", "fecha", "rol", "seen")).alias("m")).select("id", "m.*")
    )
    found = settled(fragments(rows, run))
    sums = found.groupBy("head").agg(
        F.max("wrong").alias("wrong"),
        F.min(F.when((F.col("rol") == "vecino") & F.col("seen"), F.col("fecha"))).alias("asked"),
        F.max(F.when((F.col("rol") == "operador") & F.col("seen"), F.col("fecha"))).alias("told"),
    )
    placed = settled(sums.join(merged(found), "head"))
    verdict = placed.groupBy("root").agg(F.max(F.col("wrong") | F.col("late")).alias("broken"), F.min("asked").alias("asked"), F.max("told").alias("told"))
    whole = placed.select("head", "root").join(verdict.where("NOT broken AND told > asked").select("root"), "root", "left_semi")
    kept = found.join(whole, "head").select(F.col("root").alias("root_id"), "fecha", F.col("id").alias("message_id"), "rol", bucket_of(F.col("fecha"), HOUR).alias("__hour"))
    turns = running(kept, ["root_id"], "__hour", ["fecha", "message_id"], [Running("turno", F.lit(1).cast("long"), "sum")])
    return turns.select("root_id", "message_id", F.col("turno").cast("int").alias("turno"), "rol")
