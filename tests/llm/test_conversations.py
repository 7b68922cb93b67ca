"""Conversations against a plain walk up the answers, with circles, dead ends, ties, repeats and deep chains."""

import datetime as dt
import random

import pandas as pd

from gridpulse.llm.conversations import NEVER, conversations, walked

M = "chat string, message_id long, fecha timestamp_ntz, texto string, reply_to long, autor string, root_id long, turno int"
T0 = dt.datetime(2025, 1, 1)


def msg(i, parent, minute, text="hola", author="u1", chat="comentarios"):
    return (chat, i, None if minute is None else T0 + dt.timedelta(minutes=minute), text, parent, author, 1, 1)


def brute(messages):
    rows = {m[1]: m for m in messages if m[0] == "comentarios" and m[1] is not None}
    groups = {}
    for i, m in rows.items():
        seen, at = set(), m
        while at is not None and at[4] is not None and at[1] not in seen:
            seen.add(at[1])
            at = rows.get(at[4])
        if at is not None and at[4] is None:
            groups.setdefault(at[1], []).append(m)
    out = set()
    role = lambda a: "operador" if a and a.startswith("operadora_") else "bot" if a == "bot_guardia" else "vecino"
    for root, ms in groups.items():
        if any(m[2] is None or (m[4] is not None and (rows[m[4]][2] is None or m[2] < rows[m[4]][2])) for m in ms):
            continue
        shown = [m for m in ms if m[3] and m[3].strip(" ​ \n")]
        asked = [m[2] for m in shown if role(m[5]) == "vecino"]
        if asked and any(role(m[5]) == "operador" and m[2] > min(asked) for m in shown):
            out |= {(root, m[1], n + 1, role(m[5])) for n, m in enumerate(sorted(ms, key=lambda m: (m[2], m[1])))}
    return out


def found(spark, messages, runs=(1 << 16, 8)):
    """The result, the same for runs that hold all messages and for ones that cut every conversation into fragments."""
    results = []
    for run in runs:
        got = [tuple(r) for r in conversations(spark.createDataFrame(messages, M), run=run).collect()]
        assert len(got) == len(set(got))
        results.append(set(got))
    assert all(r == results[0] for r in results)
    return results[0]


def test_random_threads(spark):
    rnd = random.Random(7)
    messages = []
    for i in range(1, 900):
        parent = None if rnd.random() < 0.35 else rnd.choice([rnd.randrange(max(1, i - 15), i + 1), 5000 + i])
        messages.append(msg(i, parent, None if rnd.random() < 0.01 else i * 10 + rnd.randrange(-5, 30), rnd.choice(["hola", "hola", "​", None, " "]), rnd.choice(["u1", None, "operadora_2", "bot_guardia"]), rnd.choice(["comentarios"] * 9 + ["canal"])))
    want = brute(messages)
    assert found(spark, messages + messages[:40]) == want and len(want) > 8


def test_deep_chain_circles_and_answers_at_the_same_time(spark):
    deep = [msg(i, i - 1 if i > 1 else None, i, author="operadora_1" if i == 70 else "u") for i in range(1, 71)]
    circle = [msg(100, 101, 1), msg(101, 100, 2), msg(102, 101, 3), msg(103, 103, 4)]
    tie = [msg(200, None, 5), msg(201, 200, 5, author="operadora_1")]
    assert found(spark, deep + circle + tie) == {(1, i, i, "operador" if i == 70 else "vecino") for i in range(1, 71)}


def test_fragments_overlap_in_the_message_before_their_first():
    rows = pd.DataFrame({"id": [12, 10, 11, 13, 14, 15], "parent": [11, 3, 10, NEVER, 15, 14], "fecha": [7, 5, 6, NEVER, 1, 1], "rol": "vecino", "seen": True})
    got = walked(rows)
    assert [tuple(r) for r in got[["id", "head", "above", "wrong"]].to_numpy()] == [(10, 10, 3, False), (11, 10, NEVER, False), (12, 10, NEVER, False), (13, 13, NEVER, True)]


def test_a_broken_link_between_fragments(spark):
    early = [msg(1, None, 10), msg(20, 1, 5), msg(21, 20, 30, author="operadora_1")]
    undated = [msg(2, None, None), msg(30, 2, 5), msg(31, 30, 30, author="operadora_1")]
    good = [msg(3, None, 10), msg(40, 3, 15), msg(41, 40, 30, author="operadora_1")]
    assert found(spark, early + undated + good) == {(3, 3, 1, "vecino"), (3, 40, 2, "vecino"), (3, 41, 3, "operador")}


def test_empty(spark):
    assert found(spark, []) == set()
