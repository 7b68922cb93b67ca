"""Leaked passages against every window of every item."""

import random

from gridpulse.llm.leakage import leaks
from gridpulse.llm.words import words

D, I = "doc_id long, text string, item_id int", "item_id int, texto string, doc_id long"


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Árbol", "ñu"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(8, 40))), 1) for i in range(15)] + [(90, None, 1), (91, "", 1), (92, "a " * 15, 1)]
    docs = []
    for n in range(150):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.6:
            part = words(items[rnd.randrange(15)][1])
            k = rnd.randrange(9, 16)
            at = rnd.randrange(0, max(1, len(part) - k))
            ws[5:5] = part[at : at + k]
        text = "".join(w + rnd.choice([" ", ", ", "\n", "</b> <i>", " ", "** "]) for w in ws)
        docs.append((n, text.upper() if rnd.random() < 0.3 else text, 3))
    docs += [(900, None, 3), (901, "", 3), (902, "a " * 40_000, 3), (None, items[0][1], 3)]
    got = [tuple(r) for r in leaks(spark.createDataFrame(docs + docs[:5], D), spark.createDataFrame(items + items[:2], I)).collect()]
    cut = leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), most=300).collect()
    assert sorted(map(tuple, cut)) == sorted(got)  # items in blocks
    want = set()
    for d, text, _ in docs:
        w = words(text)
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        want |= {(d, i) for i, t, _ in items for v in [words(t)] if d is not None and any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20 and (902, 92) in want


def test_empty(spark):
    none_d, none_i = spark.createDataFrame([], D), spark.createDataFrame([], I)
    assert leaks(none_d, spark.createDataFrame([(1, "x " * 20, 1)], I)).count() == 0 and leaks(spark.createDataFrame([(1, "x " * 20, 1)], D), none_i).count() == 0
