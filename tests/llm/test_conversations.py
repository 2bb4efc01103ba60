import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.llm import conversations as C

SCHEMA = "id bigint, session_id bigint, message_key string, role string, message_type string, content string, created_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_pointers(spark):
    chain = {i: i - 1 if i else None for i in range(70)}
    other = {100: 999, 101: 100, 200: 201, 201: 200, 202: 201, 300: 300}
    nodes = spark.createDataFrame([(i, p, 2) for i, p in (chain | other).items()], "id bigint, parent bigint, w int")
    got = {r.id: (r.root, r.distance, r.state) for r in C.resolve_pointers(nodes, weight_col="w").collect()}
    assert all(got[i] == (0, 2 * i, "ok") for i in chain)
    assert got[100] == (100, 0, "orphan") and got[101] == (100, 2, "orphan")
    assert all(got[i] == (None, None, "cycle") for i in (200, 201, 202, 300)) and len(got) == 76
    assert C.resolve_pointers(nodes.limit(0)).count() == 0


def test_roles_and_visibility(spark):
    roles = {"USER": "USER", " Human ": "USER", "用户": "USER", "ai": "ASSISTANT", "Bot": "ASSISTANT", "助手": "ASSISTANT", "System": "SYSTEM", "tool": "OTHER", "?": None, "-": None, "n/a": None, "": None, None: None, "Unknown": None, "  ": None}
    df = spark.createDataFrame([(k, v) for k, v in roles.items()], "r string, want string")
    assert df.filter(~C.role_of(F.col("r")).eqNullSafe(F.col("want"))).count() == 0
    texts = [("x", True), ("。", True), (None, False), ("", False), (" \t\r\n", False), ("​", False), ("﻿", False), ("　 ", False), ("⁠", False), ("​a", True), ("👍", True), ("ㅤ", False)]
    got = [r.v for r in spark.createDataFrame(texts, "t string, w boolean").select(C.visible(F.col("t")).alias("v")).collect()]
    assert got == [w for _, w in texts]


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None:
            first.setdefault((r[1], r[2] if r[2] is not None else ("id", r[0])), r)
    sessions = {r[1]: [] for r in rows if r[1] is not None}
    for r in first.values():
        if (r[4] or "").upper() == "CHAT" and r[5] and r[5].strip():
            sessions[r[1]].append(r)
    out = {}
    for s, own in sessions.items():
        who = {"user": "U", "ai": "A", "system": "S"}
        two = sorted((r for r in own if who.get(r[3]) in ("U", "A")), key=lambda r: (r[6] is None, r[6] or T0, r[0]))
        if not two:
            out[s] = "empty"
        elif any(r[3] not in who for r in own) or any(r[6] is None for r in two) or two[0][3] == "ai":
            out[s] = "broken"
        elif any(r[3] == "user" and (i + 1 == len(two) or two[i + 1][3] != "ai") for i, r in enumerate(two)):
            out[s] = "missing_reply"
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        s = rnd.choice([1, 1, *range(2, 60), None])
        late = rnd.random() < 0.03
        rows.append((i, s, None if rnd.random() < 0.02 else f"k{rnd.randint(0, 400)}", rnd.choice(["user", "ai"] * 20 + ["system", "?"]), rnd.choice(["CHAT"] * 9 + ["status", "chat", None]), rnd.choice(["hi"] * 9 + ["", None]), None if late else T0 + timedelta(minutes=rnd.randint(0, 99))))
    for s in (500, 501, 502):
        rows += [(1000 + 10 * s + k, s, f"x{k}", "user" if k % 2 == 0 else "ai", "CHAT", "t", T0 + timedelta(minutes=k)) for k in range(8)]
    df = frame(spark, rows).withColumn("turn_no", F.lit("clash"))
    for run in (3, 4096):
        got = {r.session_id: r.reason for r in C.judge(df, run)[1].filter("reason is not null").collect()}
        assert got == brute(rows)
    kept = C.conversations(df).collect()
    assert {500, 501, 502} <= {r.session_id for r in kept} and not {r.session_id for r in kept} & set(brute(rows))
    own = sorted((r for r in kept if r.session_id == 500), key=lambda r: r.turn_no)
    assert [r.turn_no for r in own] == list(range(8)) and [r.role for r in own] == ["USER", "ASSISTANT"] * 4


def test_empty_table(spark):
    df = frame(spark, [(1, None, "k", "user", "CHAT", "x", T0)])
    assert C.dropped_conversations(df).count() == 0 and C.conversations(df.limit(0)).count() == 0


def test_the_outcome_of_the_jumping_decides(spark, monkeypatch):
    rows = [(10 * s + k, s, f"x{k}", "user" if k % 2 == 0 else "ai", "CHAT", "t", T0 + timedelta(minutes=k)) for s in (1, 2) for k in range(4)]
    assert C.dropped_conversations(frame(spark, rows)).count() == 0
    real = C.resolve_pointers
    for junk in ({"state": F.lit("cycle")}, {"root": F.lit(None).cast("bigint")}, {"distance": F.col("distance") + 1}):
        monkeypatch.setattr(C, "resolve_pointers", lambda *a, j=junk: real(*a).withColumns(j))
        assert {r.reason for r in C.dropped_conversations(frame(spark, rows)).collect()} == {"broken"}
