"""Conversation repair against a plain dynamic program that carries whole audits."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citewright.llm import conversations as conv
from citewright.llm import queries

WS = " \t\n\x0b\x0c\r"
ROLE_AFTER = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def best_edits(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault): all edits from every last initial ("" at the start)."""

    def closed(ways):
        """Up to two inserts at one place."""
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                role = ROLE_AFTER[state]
                way = (cost + 3, audit + "I", [*lines, role + ":"])
                if role[0] not in ways or way < ways[role[0]]:
                    ways[role[0]] = way
        return ways

    ways = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in closed(ways).items():
            moves = [(state, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in legal:
                    moves.append((role[0], more, "K", [f"{role}:{text}"]))
                new = ROLE_AFTER[state]
                moves.append((new[0], 3 + more, "R", [f"{new}:{text}"]))
            for to, price, edit, line in moves:
                way = (cost + price, audit + edit, lines + line)
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        ways = after
    return min(closed(ways)[s] for s in ("", "a") if s in closed(ways))


def plain(rows):
    """The fields of one conversation's rows (turn, role, text), already damaged."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(WS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = best_edits([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }, lines


@pytest.mark.parametrize("seed", range(6))
def test_search_and_fold(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0, 0, 0, 2])) for _ in range(rng.randrange(1, 14))]
        plain_rows = []
        for r, f, more in rows:
            plain_rows += [(r, "x", ["", "blank", "duplicate", "truncated"][f])] + [(r, "x", "blank" if f == 1 else "duplicate")] * more
        cost, audit, _ = best_edits(plain_rows)
        ((got, way),) = conv.cheapest(rows, 0, {0, 3}, True).values()
        assert (got, way) == (cost, audit)
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(4))))
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        states = conv.fold([conv.table(p) for p in parts])
        ways = [conv.cheapest(p, a, {b}, False)[b] for p, a, b in zip(parts, states, states[1:])]
        end = conv.REST[states[-1]]
        assert (sum(w[0] for w in ways) + 3 * len(end), "".join(w[1] for w in ways) + end) == (cost, audit)


def conversations(seed):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "No!", "Why?", "cut off", "", "  \n", "Same.", "é. ", "long " * rng.randrange(1, 90) + "."]) if rng.random() < 0.7 else f"Nr {rng.randrange(10**6)}."
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.randrange(1, 12) if c != 7 else 300):
            rows.append((c, None if rng.random() < 0.05 else t + (t > 4), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), None if rng.random() < 0.05 else say()))
    rows += [(3, 2, "user", "Same row.")] * 40 + [(4, 1, "assistant", "")] * 5 + [(99, None, None, None), (100, 5, "", "x."), (101, 1, "system", "S."), (102, 1, "uncle", "U."), (102, 2, "aunt", "A.")]
    return rows


@pytest.mark.parametrize(("segment", "held"), [(2048, 1 << 22), (3, 40), (1, 1)])
def test_against_plain(spark, monkeypatch, segment, held):
    """Whole conversations and ones cut anywhere give the same; nulls, ties, repeated rows and roles of any kind included."""
    monkeypatch.setattr(conv, "SEGMENT", segment)
    monkeypatch.setattr(conv, "HELD", held)
    rows = conversations(segment)
    data = [(*r, "x", 1) for r in rows]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, key string, seg int").repartition(4)
    ids = df.select("conv_id").distinct().union(spark.createDataFrame([(555,)], "conv_id long"))
    got = {r.conv_id: r.asDict() for r in conv.repair(df, ids).collect()}
    assert set(got) == {r[0] for r in rows} | {555}
    empty = {"blank": 0, "gaps": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    lines = {}
    for c in got:
        want = empty
        if c != 555:
            want, lines[c] = plain([r[1:] for r in rows if r[0] == c])
        assert got[c] == {"conv_id": c, **want}, c
    keyed = conv.keyed(df)
    out = conv.repaired_rows(keyed, conv.solve(keyed)).orderBy("conv_id", "turn", "old_role", "key", "place").groupBy("conv_id").agg(F.collect_list(F.concat("role", F.lit(":"), "text")).alias("lines"))
    assert {r.conv_id: sorted(r.lines) for r in out.collect()} == {c: sorted(x) for c, x in lines.items() if x}


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(none, none.select("conv_id")).count() == 0
    assert [r.audit for r in conv.repair(none, spark.range(2).withColumnRenamed("id", "conv_id")).collect()] == ["", ""]


def test_damage(spark, tmp_path):
    import zlib

    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {c} of {t}. Good!") for c in range(40) for t in range(5)] + [(None, None, None, None), (1, None, "user", "x.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = {}
    for c, t, role, text in rows:
        damaged.setdefault(c, [])
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        damaged[c] += [] if k == 0 else [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect():
        if damaged[r.conv_id]:
            assert r.asDict() == {"conv_id": r.conv_id, **plain(damaged[r.conv_id])[0]}
        else:
            assert (r.cost, r.audit) == (0, "")
