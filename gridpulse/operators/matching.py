"""Joins on contained names and on token overlap, as equi-joins on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import text as t


def contained_names(rows: DataFrame, key: str, text: Column, names: DataFrame, name_key: str, name: Column) -> DataFrame:
    """(key, name_key, clave): every name that stands as whole words in the folded text.

    A text meets only the names whose rarest word (among all names) it holds, then the whole name is looked for, so a word
    that many names share ("alturas", "villa") brings nobody together.
    """
    clean = lambda c: F.btrim(F.regexp_replace(t.fold(c), "[^a-z0-9]+", " "))
    texts = rows.select(F.col(key), clean(text).alias("__t")).where("__t <> ''").distinct()
    lists = names.select(F.col(name_key), clean(name).alias("clave")).where("clave <> ''")
    each = lists.select(name_key, "clave", F.explode(F.array_distinct(F.split("clave", " "))).alias("__w"))
    used = each.groupBy("__w").agg(F.count("*").alias("__n"))
    lists = each.join(used, "__w").groupBy(name_key, "clave").agg(F.min_by("__w", F.struct("__n", F.length("__w") * -1, "__w")).alias("__w"))
    words = texts.select(key, "__t", F.explode(F.array_distinct(F.split("__t", " "))).alias("__w"))
    hit = F.concat(F.lit(" "), "__t", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("clave"), F.lit(" ")))
    return words.join(lists, "__w").where(hit).select(key, name_key, "clave").distinct()


def longest_name(found: DataFrame, key: str, name_key: str) -> DataFrame:
    """The longest contained name of each text; ties go to the smaller key."""
    return found.groupBy(key).agg(F.min_by(F.col(name_key), F.struct(-F.length("clave"), F.col(name_key))).alias(name_key))


def token_matches(queries: DataFrame, q_key: str, q_text: Column, entries: DataFrame, e_key: str, e_text: Column, least: float = 0.6, dominance: float = 1.5) -> DataFrame:
    """(q_key, e_key, s1): the entry whose street tokens cover the query's, if it clearly beats the runner-up.

    s1 is the shared tokens over the smaller set, s2 over both sets. Accepted if s1 is at least `least` and s1 is
    `dominance` times the second's, or s1 ties and s2 dominates. Fewer than two tokens match nothing.
    """
    q = queries.select(F.col(q_key), t.street_tokens(q_text).alias("__a")).where(F.size("__a") >= 2).withColumn("__na", F.size("__a"))
    e = entries.select(F.col(e_key), t.street_tokens(e_text).alias("__b")).where(F.size("__b") >= 1).withColumn("__nb", F.size("__b"))
    shared = q.select(q_key, "__na", F.explode("__a").alias("__w")).join(e.select(e_key, "__nb", F.explode("__b").alias("__w")), "__w").groupBy(q_key, e_key, "__na", "__nb").agg(F.count("*").alias("__i"))
    scored = shared.select(q_key, e_key, (F.col("__i") / F.least("__na", "__nb")).alias("s1"), (F.col("__i") / (F.col("__na") + F.col("__nb") - F.col("__i"))).alias("s2"))
    rank = F.row_number().over(Window.partitionBy(q_key).orderBy(F.col("s1").desc(), F.col("s2").desc(), F.col(e_key).desc()))
    top = scored.withColumn("__n", rank).where("__n <= 2").groupBy(q_key).agg(
        F.max(F.when(F.col("__n") == 1, F.col(e_key))).alias(e_key),
        *[F.coalesce(F.max(F.when(F.col("__n") == n, F.col(s))), F.lit(0.0)).alias(f"{s}_{n}") for n in (1, 2) for s in ("s1", "s2")],
    )
    clear = (F.col("s1_1") / F.greatest("s1_2", F.lit(1e-9)) >= dominance) | ((F.col("s1_1") == F.col("s1_2")) & (F.col("s2_1") / F.greatest("s2_2", F.lit(1e-9)) >= dominance))
    return top.where((F.col("s1_1") >= least) & clear).select(q_key, e_key, F.round("s1_1", 2).alias("s1"))
