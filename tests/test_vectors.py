"""Vector retrieval over repeated rows."""

from gridpulse.operators import vectors
from gridpulse.operators.vectors import top_similar_batch


def test_copies_take_no_places(spark):
    """Nine copies of the nearest vector and of the query's own row in one task."""
    v = [(0, [1.0, 0.0])] * 9 + [(1, [1.0, 0.1])] * 9 + [(i, [1.0, 0.1 * i]) for i in range(2, 6)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").coalesce(1)
    got = top_similar_batch(df, df.where("vec_id = 0"), k=4).orderBy("n").collect()
    assert [(r.vec_id, r.n) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_the_index_holds_every_vector_and_reaches_its_recall(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    data = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 3), (None, [1.0] * 16), (5, data[5][1])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    centres = vectors.centres_of(df, "embedding", 8)
    index = vectors.indexed(df, "vec_id", "embedding", centres)
    assert sorted(r.vec_id for r in index.collect()) == list(range(600))
    queries = df.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.top_similar_batch(df, queries).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.probed(index, queries, centres, "vec_id", "embedding").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    monkeypatch.setattr(vectors, "PIECE_ROWS", 20)  # lists in pieces; all lists probed is exact
    every = {(r.query_id, r.vec_id) for r in vectors.probed(index, queries, centres, "vec_id", "embedding", probes=8).collect()}
    assert every == exact
    assert vectors.probed(index, queries.limit(0), centres, "vec_id", "embedding").count() == 0
