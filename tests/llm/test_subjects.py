"""Subject areas: planted sentences, general remarks, quoted items, and held-out accuracy on the test tables."""

import os
import random

import numpy as np
import pytest

from gridpulse.llm.subjects import Model, decided, features, fitted, passages, sentences, subject_shares, subjects

AREAS = {"agua": (["la cisterna", "el pozo", "la motobomba"], ["perdió el cebado", "derramó por una junta", "quedó vacía"]), "deporte": (["el torneo", "la selección", "el lanzador"], ["empató en la novena", "cayó en semifinales", "ganó por dos carreras"]), "salud": (["la enfermera", "la consulta", "el quirófano"], ["repartió sueros", "tomó la presión", "aplazó operaciones"])}
GENERAL = ["No hubo más detalles al cierre.", "Somos jueces y parte.", "Se informará por los canales habituales."]
D, L = "doc_id long, text string, area string", "doc_id long, area string"


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rnd.sample(sorted(AREAS), rnd.choice([1, 1, 2]))
        lines = [f"{rnd.choice(AREAS[a][0])} {rnd.choice(AREAS[a][1])}.".capitalize() for a in own for _ in range(3)] + rnd.sample(GENERAL, 2)
        rnd.shuffle(lines)
        docs.append((i, rnd.choice([" ", "\n", "\r\n[12:01] vecino: ", "\n👉 "]).join(lines), "clash"))
        truth[i] = set(own)
    return docs, truth


def test_sentences_drop_marks():
    assert sentences("[12:16] vecino: Hola, Ñico.\n1. Dos tres! 👉 cuatro\r\n\r\n") == [["hola", "nico"], ["dos", "tres"], ["cuatro"]]
    assert sentences(None) == sentences("") == []


def test_quoted_sentences_do_not_count():
    known = passages(["La motobomba de Gritrodosa entró fuera de su turno."])
    assert known.plain("La motobomba de Gritrodosa entró fuera.") == [] and known.plain("La motobomba entró fuera de su turno.")


def test_features_at_once_equal_those_of_each_sentence():
    rnd = random.Random(4)
    items = "El pozo de Gritrodosa entró fuera de su turno."
    docs = [d[1] for d in corpus(40, 3)[0]] + [None, "", "\n\n", "7", "[12:16] vecino: el pozo de Gritrodosa entró fuera. La cisterna 5 quedó; vacía!", "fin. fin\rfin. ", "el 3 pozo", items, "x" * 9]
    known = passages([items])
    all_ = sorted({f for t in docs for ws in sentences(t) for f in features(ws)})
    vocabulary = {f: i for i, f in enumerate(rnd.sample(all_, len(all_) * 2 // 3))}
    ids, starts, owner = Model([], vocabulary, None, None, None).known(docs, known)
    got = [(int(o), sorted(ids[a:b].tolist())) for o, a, b in zip(owner, starts, [*starts[1:], len(ids)])]
    want = [(n, f) for n, t in enumerate(docs) for ws in known.plain(t) if (f := sorted(vocabulary[x] for x in features(ws) if x in vocabulary))]
    assert got == want and len(want) > 100


def test_quotes_marked_by_a_number_alone_do_not_count():
    known = passages(["El pozo tiene 640 metros de tubo y 7 bombas."])
    texts = ["pozo tiene 640 metros de tubo. La cisterna quedó vacía.", "El pozo tiene metros de tubo.", "[12:16] vecino: el pozo tiene 640 metros"]
    assert not any(w.isalpha() for w in known.marks) and [known.plain(t) for t in texts] == [[["la", "cisterna", "quedo", "vacia"]], [["el", "pozo", "tiene", "metros", "de", "tubo"]], []]
    vocabulary = {f: i for i, f in enumerate(sorted({f for t in texts for ws in sentences(t) for f in features(ws)}))}
    ids, starts, owner = Model([], vocabulary, None, None, None).known(texts, known)
    assert owner.tolist() == [0, 1] and sorted(ids[: starts[1]].tolist()) == sorted(vocabulary[f] for f in features(["la", "cisterna", "quedo", "vacia"]))


def test_planted_areas_are_found(spark):
    docs, truth = corpus(120, 1)
    docs += [(900, None, "c"), (901, "", "c"), (902, "🙂🙂", "c"), (903, GENERAL[0], "c"), (None, docs[0][1], "c")]
    labels = [(i, a) for i in range(60) for a in truth[i]] + [(0, "agua"), (1, "inventada"), (None, "agua"), (2, None)]
    areas = spark.createDataFrame([(a, "x") for a in AREAS], "area string, descripcion string")
    items = spark.createDataFrame([(1, "nada de esto figura en los textos de Prueba 7")], "item_id int, texto string")
    args = spark.createDataFrame(docs, D), spark.createDataFrame(labels, L), areas, items
    got = [tuple(r) for r in subjects(*args).collect()]
    assert len(got) == len(set(got))
    found = {}
    for d, a in got:
        found.setdefault(d, set()).add(a)
    right = sum(found.get(i, set()) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth) and not {900, 901, 902, 903, None} & set(found)
    assert all(0 < r.share <= 1 for r in subject_shares(*args).collect())
    none = spark.createDataFrame([], L)
    assert subjects(args[0], none, areas, items).count() == 0 and subjects(args[0].limit(0), *args[1:]).count() == 0


def test_areas_of_a_sentence_are_judged_one_by_one():
    p = np.array([[0.9, 0.6, 0.1], [0.2, 0.5, 0.1], [0.1, 0.1, 0.1], [0.1, 0.1, 0.7]])
    got = {(int(d), int(a), int(n), int(m)) for d, a, n, m in zip(*decided(p, np.array([0, 0, 0, 2])))}
    assert got == {(0, 0, 1, 2), (0, 1, 2, 2), (2, 2, 1, 1)}


def test_items_in_blocks_give_the_same_as_at_once(spark):
    docs, truth = corpus(60, 5)
    quotes = [f"La motobomba de Gritrodosa {n} entró fuera de su turno con Farlenca." for n in range(8)]
    docs += [(700 + n, f"El pozo quedó vacío. {q} {q}\n{q}", "c") for n, q in enumerate(quotes)]
    args = [spark.createDataFrame(docs, D), spark.createDataFrame([(i, a) for i in range(30) for a in truth[i]], L), spark.createDataFrame([(a, "x") for a in AREAS], "area string, descripcion string"), spark.createDataFrame(list(enumerate(quotes)), "item_id int, texto string")]
    once, cut = (sorted(map(tuple, subject_shares(*args, **how).collect())) for how in ({}, {"most_chars": 130}))
    assert once == cut and len(once) > 60 and {r[1] for r in once if r[0] >= 700} <= {"agua"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels, areas, items = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "etiquetas", "areas", "pruebas"))
    model, known, _ = fitted(docs, labels.where("doc_id % 2 = 0"), areas, items, "doc_id", "text")
    truth = {}
    for r in labels.where("doc_id % 2 = 1").collect():
        truth.setdefault(r.doc_id, set()).add(r.area)
    hits = made = have = 0
    for r in docs.where("doc_id % 2 = 1 AND text IS NOT NULL").select("doc_id", "text").collect():
        if r.doc_id in truth:
            p = model.posteriors(model.scores([r.text], known)[0])
            _, area, n, total = decided(p, np.zeros(len(p), int))
            got = {model.areas[c] for c, k, m in zip(area, n, total) if k / m >= 0.25}
            hits, made, have = hits + len(got & truth[r.doc_id]), made + len(got), have + len(truth[r.doc_id])
    # the labels themselves are not all right
    assert hits / made > 0.9 and hits / have > 0.93
