"""Sequences of saves, updates, deletions and imports."""

import random

from citewright.operators import history

SCHEMA = "owner string, at int, op string, session_id string, saved_at string, bytes long"


def left(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {}
    for r in history.replay(df, **limits).collect():
        out.setdefault(r.owner, []).append((r.session_id, r.saved_at, r.written))
    return {k: sorted(v, key=lambda x: (x[1], x[0]), reverse=True) for k, v in out.items()}


def test_sequences(spark):
    rows = [
        ("a", 1, "save", "s1", "01", 10), ("a", 2, "save", "s2", "02", 10), ("a", 3, "update", "s1", "03", 20), ("a", 4, "delete", "s2", None, None), ("a", 5, "update", "s2", "05", 10), ("a", 6, "save", "s3", "06", 10),
        ("b", 1, "save", "s1", "01", 10), ("b", 2, "clear", None, None, None), ("b", 3, "update", "s1", "03", 10), ("b", 4, "save", "s1", "04", 10), ("b", 5, "save", None, "05", 10), ("b", 6, "unknown", "s1", "06", 1),
        ("c", 1, "save", "s1", "01", 10), ("c", 2, "import", "s1", "00", 10), ("c", 2, "import", "s9", "09", 10), ("c", 2, "import", None, "09", 10), ("d", 1, "delete", "s1", None, None), (None, 1, "save", "s1", "01", None),
    ]
    got = left(spark, rows)
    assert got["a"] == [("s3", "06", 6), ("s1", "01", 3)] and got["b"] == [("s1", "04", 4)] and got["c"] == [("s9", "09", 2), ("s1", "00", 2)] and "d" not in got and got[None] == [("s1", "01", 1)]


def test_limits(spark):
    rows = [("n", k, "save", f"s{k:02}", f"{k:02}", 10) for k in range(60)]
    rows += [("big", 1, "save", "s1", "01", 90), ("big", 2, "save", "s2", "02", 40), ("big", 3, "save", "s3", "03", 500), ("big", 4, "update", "s3", "09", 20)]
    rows += [("refused", 1, "save", "s1", "01", 10), *[("refused", 2, "import", f"i{k}", "05", 1) for k in range(51)], ("full", 1, "save", "s1", "01", 60), ("full", 2, "import", "i1", "02", 60)]
    got = left(spark, rows, most=50, room=700)
    assert len(got["n"]) == 50 and got["n"][-1][0] == "s10" and got["refused"] == [("s1", "01", 1)]
    got = left(spark, rows, room=100)
    assert got["big"] == [("s3", "03", 4)] and got["full"] == [("s1", "01", 1)] and len(got["n"]) == 9


def test_random_sequences_equal_a_plain_list(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for owner in map(str, range(12)):
        held = {}
        for at in range(120):
            op, s, n = rng.choice(["save", "save", "update", "delete", "clear" if rng.random() < 0.1 else "save"]), f"s{rng.randrange(20)}", rng.randrange(1, 60)
            rows.append((owner, at, op, s, f"{at:04}", n))
            if op == "clear":
                held = {}
            elif op == "delete":
                held.pop(s, None)
            elif op == "save" or s in held:
                held[s] = (held[s][0] if s in held else f"{at:04}", n, at)
            while len(held) > 7 or (len(held) > 1 and sum(v[1] for v in held.values()) + len(held) + 1 > 200):
                held.pop(min(held, key=lambda k: held[k][0]))
        want[owner] = sorted([(k, v[0], v[2]) for k, v in held.items()], key=lambda x: (x[1], x[0]), reverse=True)
    assert left(spark, rows, most=7, room=200) == {k: v for k, v in want.items() if v}
