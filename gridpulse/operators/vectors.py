"""Vector retrieval: exact cosine top-k with filters, cuts, and batches of queries in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE, RELATIVE, K = 0.25, 0.75, 6


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if a vector is empty, null or zero, or the lengths differ."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm)


def top_similar(vectors: DataFrame, query: list[float], key: str = "vec_id", column: str = "embedding", k: int = K, where: Column | None = None) -> DataFrame:
    """(key, similitud): the k most similar vectors among those that pass the filter; ties go to the smaller key."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, cosine(F.col(column), q).alias("similitud")).where("similitud IS NOT NULL").orderBy(F.col("similitud").desc(), key).limit(k)


def similarity_cut(found: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """Rows at least `absolute` similar and at least `relative` of the best."""
    best = found.agg(F.max("similitud").alias("__best"))
    return found.where(F.col("similitud") >= absolute).join(F.broadcast(best), F.col("similitud") >= relative * F.col("__best")).drop("__best")


def top_similar_batch(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = K, block: int = 4096) -> DataFrame:
    """(query_id, key, similitud, n): exact top k of every query against all vectors, without the query itself.

    Queries are taken in blocks of bounded size; each task keeps only k rows a query of what it reads, so what is
    shuffled is k rows a query and task. Zero, null and short vectors match nothing; ties go to the smaller key.
    """
    listed = queries.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("q"), column).distinct()
    n_blocks = max(1, -(-listed.count() // block))
    numbered = listed.withColumn("__b", F.pmod(F.xxhash64("q"), F.lit(n_blocks)))
    spark, parts = vectors.sparkSession, None
    # repeated rows go before any cut, as their copies would take places of others
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), column).distinct()
    for b in range(n_blocks):
        some = numbered.where(F.col("__b") == b).collect()
        shared = spark.sparkContext.broadcast(([r.q for r in some], [list(r[column]) for r in some]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, lists = shared.value
            width = max((len(x) for x in lists), default=0)
            ok = [i for i, x in enumerate(lists) if len(x) == width and any(x)]
            if not ok:
                return
            q = np.array([lists[i] for i in ok], float)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            names = np.array([ids[i] for i in ok])
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                good = [i for i, v in enumerate(batch[column]) if len(v) == width and np.any(v)]
                if not good:
                    continue
                keys = batch[key].to_numpy()[good]
                m = np.array([batch[column].iloc[i] for i in good], float)
                sims = q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
                for i, name in enumerate(names):
                    others = np.nonzero(keys != name)[0]
                    order = others[np.lexsort((keys[others], -sims[i, others]))[:k]]
                    mine = best.get(i, []) + [(-sims[i, j], int(keys[j])) for j in order]
                    best[i] = sorted(mine)[:k]
            out = [(int(names[i]), n, -s) for i, rows_ in best.items() for s, n in rows_]
            yield pd.DataFrame(out, columns=["query_id", key, "similitud"])

        found = rows.mapInPandas(search, f"query_id long, {key} long, similitud double")
        parts = found if parts is None else parts.unionByName(found)
    top = parts.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similitud")).alias("s"), F.col(key)))), 1, k).alias("r"))
    return top.select("query_id", F.posexplode("r").alias("n", "x")).select("query_id", F.col(f"x.{key}").alias(key), (-F.col("x.s")).alias("similitud"), (F.col("n") + 1).alias("n"))


#: Vectors the centres are fitted on at most, chosen by hash; every vector is indexed. Rows aimed at in a piece of a list.
CENTRE_SAMPLE, PIECE_ROWS = 20_000, 20_000
PROBED = 0.8


def unit_rows(vectors: pd.Series, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be compared, their unit vectors): neither null, of another width, nor zero."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == (width or len(v)) and np.any(v)]
    if not good:
        return np.empty(0, int), np.empty((0, width or 1))
    m = np.array([vectors.iloc[i] for i in good], float)
    return np.array(good, int), m / np.linalg.norm(m, axis=1, keepdims=True)


def centres_of(vectors: DataFrame, column: str, lists: int, sample: int = CENTRE_SAMPLE, rounds: int = 10) -> np.ndarray:
    """Centres of so many lists, by k-means of unit vectors on a bounded sample."""
    rows = vectors.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(sample).toPandas()
    width = rows[column].map(len).mode().max() if len(rows) else 0
    _, m = unit_rows(rows[column], width)
    if not len(m):
        return np.empty((0, 0))
    centres = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)]
    for _ in range(rounds):
        near = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def indexed(vectors: DataFrame, key: str, column: str, centres: np.ndarray) -> DataFrame:
    """(key, column, lista): each vector that can be compared in the list of its nearest centre; repeated rows once."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema[column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, m = unit_rows(b[column], shared.value.shape[1])
            near = (m @ shared.value.T).argmax(1) if len(good) else np.empty(0, int)
            yield b.iloc[good].assign(lista=near)

    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), column).distinct()
    return rows.mapInPandas(run, f"{key} long, {column} {kind}, lista int")


def probed(index: DataFrame, queries: DataFrame, centres: np.ndarray, key: str, column: str, k: int = K, probes: int | None = None) -> DataFrame:
    """(query_id, key, similitud): the k nearest of each query in the lists of its nearest centres, without the query itself.

    Lists beyond PIECE_ROWS are cut in pieces by hash, to each of which the query goes, so a list with a third of all rows
    is spread; what leaves a piece is k rows a query. By default PROBED of the lists are searched: vectors without clusters,
    as those of the test tables, need that many for a recall of 0.9; clustered ones reach it with far fewer.
    """
    probes = probes or max(1, math.ceil(PROBED * len(centres)))
    shared = index.sparkSession.sparkContext.broadcast(centres)
    sizes = index.groupBy("lista").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PIECE_ROWS)).cast("int").alias("pieces"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, m = unit_rows(b[column], shared.value.shape[1])
            if len(good):
                near = np.argsort(-(m @ shared.value.T), axis=1)[:, :probes]
                yield pd.DataFrame({"q": np.repeat(b["q"].to_numpy()[good], near.shape[1]), column: [v for i in good for v in [b[column].iloc[i]] * near.shape[1]], "lista": near.ravel()})

    kind = queries.schema[column].dataType.simpleString()
    asked = queries.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("q"), column).distinct().mapInPandas(ask, f"q long, {column} {kind}, lista int")
    small_sizes = F.broadcast(sizes)  # one row a list: as many as there are centres
    asked = asked.join(small_sizes, "lista").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    rows = index.join(small_sizes, "lista").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int")).drop("pieces")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        _, q = unit_rows(a[column])
        _, m = unit_rows(b[column])
        keys, out = b[key].to_numpy(), []
        for at in range(0, len(q) if len(m) else 0, 512):
            sims = q[at : at + 512] @ m.T
            for name, s in zip(a["q"].iloc[at : at + 512], sims):
                top = np.lexsort((keys, -s))[: k + 1]
                out += [(name, keys[j], s[j]) for j in top if keys[j] != name][:k]
        return pd.DataFrame(out, columns=["query_id", key, "similitud"]).astype({"query_id": "int64", key: "int64", "similitud": float})

    found = asked.groupBy("lista", "piece").cogroup(rows.groupBy("lista", "piece")).applyInPandas(search, f"query_id long, {key} long, similitud double")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similitud")).alias("s"), F.col(key)))), 1, k).alias("r"))
    return top.select("query_id", F.explode("r").alias("x")).select("query_id", F.col(f"x.{key}").alias(key), (-F.col("x.s")).alias("similitud"))
