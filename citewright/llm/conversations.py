"""Conversation structure repair: A* on the edit lattice of each conversation's rows and the states of the role
grammar ``(s?(ua)+)?``.

Rows go by turn (nulls first), then role, then SHA-256 of the text. A row's first fault counts: blank, a repeat of role and
text seen earlier, truncated. Edits: Keep 0, Rerole 3, Delete 4 (required for blank and repeated rows), Insert of an
empty text 3; a truncated row that stays adds 3. The heuristic is the suffix sum of what no path avoids: 4 for a row that
must go, 3 for a truncated one. It never exceeds the true rest, so the first goal taken from a queue keyed
(cost + heuristic, audit) is the cheapest, and among equals the ASCII-least.

Texts stay where they are until the end: the search runs over one short row for each distinct (conversation, turn, role,
text), equal ones counted before they are shuffled. Those rows are range-sorted, so a conversation of any length spreads over
tasks, and cut into segments of at most ``SEGMENT`` rows. A conversation that lies inside one is searched whole. Of others each
segment yields its cheapest way from every state to every state; a fold over these tables - a row of 32 numbers for
SEGMENT rows - tells the states between segments, and each segment is searched again between its two. No segment's
way ends with an insert (it begins the next one), so of two ways through a segment none is the other's beginning and the
order of the audits is decided segment by segment.

The repaired rows come from one range shuffle of texts and edits together, streamed in order; repeated rows are dropped
before it. Digests are made in that stream; a conversation that touches the end of a partition is dealt by conv_id once
more and streamed, as a SHA-256 can't be put together from parts.

A null role or text is one space. Null conv_ids are one conversation. A null turn comes first and leaves no gap. Repeated rows
are repeats of their first. A conversation without rows has zeros, an empty audit and the hash of the empty string. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage

SEGMENT = 2048
HELD = 1 << 22  # characters of a conversation that wait for its end
SPACES = " \t\n\u000b\u000c\r"
SOUND, BLANK, REPEAT, CUT = range(4)
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
# States: nothing yet, after s, after u, after a. NEXT has what an edit that is free to choose puts, and where that leads.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
REST = {0: "", 3: "", 2: "I", 1: "II"}  # inserts that end a conversation
LEGAL = {"su", "ua", "au"}
PLACE = ["conv_id", "turn", "role", "key"]


def cheapest(rows: list[tuple[str, int, int]], entry: int, exits: set[int], trailing: bool) -> dict[int, tuple[int, str]]:
    """Exit state to (cost, audit), from ``entry``, over rows (role initial, fault, copies beyond the first, which all go).

    With ``trailing``, inserts may follow the last row and the first exit reached is the only one."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, fault, more = rows[i]
        ahead[i] = ahead[i + 1] + DELETE * more + (DELETE if fault in (BLANK, REPEAT) else UNFINISHED if fault == CUT else 0)
    queue = [(ahead[0], "", 0, entry)]
    done, found = set(), {}
    while queue:
        f, audit, i, s = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n:
            if s in exits:
                found[s] = (f, audit)
                if trailing or len(found) == len(exits):
                    break
            if trailing:
                heapq.heappush(queue, (f + INSERT, audit + "I", n, NEXT[s][1]))
            continue
        initial, fault, more = rows[i]
        spent, rest, gone = f - ahead[i] + DELETE * more, ahead[i + 1], "D" * more
        heapq.heappush(queue, (spent + DELETE + rest, audit + "D" + gone, i + 1, s))
        if fault not in (BLANK, REPEAT):
            stay = spent + rest + (UNFINISHED if fault == CUT else 0)
            if initial in KEEP[s]:
                heapq.heappush(queue, (stay, audit + "K" + gone, i + 1, KEEP[s][initial]))
            heapq.heappush(queue, (stay + REROLE, audit + "R" + gone, i + 1, NEXT[s][1]))
        heapq.heappush(queue, (f + INSERT, audit + "I", i, NEXT[s][1]))
    return found


def replay(rows: list[tuple[str, int, int]], entry: int, audit: str) -> list[tuple[str, list[str], str | None, list[str]]]:
    """For each row its edit, the roles inserted before it, its new role where it has one, and the roles inserted behind all rows."""
    out, s, k, before = [], entry, 0, []
    for initial, _, more in rows:
        while audit[k] == "I":
            role, s = NEXT[s]
            before.append(role)
            k += 1
        edit, role = audit[k], None
        if edit == "K":
            s = KEEP[s][initial]
        elif edit == "R":
            role, s = NEXT[s]
        out.append((edit, before, role, []))
        k += 1 + more
        before = []
    for _ in audit[k:]:
        role, s = NEXT[s]
        out[-1][3].append(role)
    return out


def table(rows: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Costs (-1: no way) and ranks of the audits of the cheapest ways from each state (four a row) to each state."""
    costs, ranks = [], []
    for entry in range(4):
        ways = cheapest(rows, entry, {0, 1, 2, 3}, False)
        order = sorted(a for _, a in ways.values())
        costs += [ways[x][0] if x in ways else -1 for x in range(4)]
        ranks += [order.index(ways[x][1]) if x in ways else -1 for x in range(4)]
    return costs, ranks


def fold(tables: list[tuple[list[int], list[int]]]) -> list[int]:
    """States before each segment and behind the last, of the cheapest way through all, ASCII-least among equals."""
    best, back = {0: (0, 0)}, []  # state to (cost, rank of the audit so far)
    for costs, ranks in tables:
        ways: dict[int, tuple] = {}
        for e, (cost, rank) in best.items():
            for x in range(4):
                c = costs[4 * e + x]
                if c >= 0 and (x not in ways or (cost + c, rank, ranks[4 * e + x]) < ways[x][:3]):
                    ways[x] = (cost + c, rank, ranks[4 * e + x], e)
        order = sorted(w[1:3] for w in ways.values())
        best = {x: (w[0], order.index(w[1:3])) for x, w in ways.items()}
        back.append({x: w[3] for x, w in ways.items()})
    s = min(best, key=lambda x: (best[x][0] + INSERT * len(REST[x]), best[x][1]))
    out = [s]
    for ways in reversed(back):
        s = ways[s]
        out.append(s)
    return out[::-1]


def _facts(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conv_id, turn, role, key): fault of the text, copies, and whether the role and text came earlier."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    facts = stage(rows.select(*PLACE, fault.alias("fault")).groupBy(*PLACE, "fault").agg(F.count("*").alias("copies")), "facts")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = facts.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    repeat = F.coalesce(F.col("first") < place, F.lit(False))
    out = facts.join(again, same, "left").select(*PLACE, F.when((F.col("fault") != BLANK) & repeat, REPEAT).otherwise(F.col("fault")).cast("int").alias("fault"), "copies")
    return stage(out, "marked")


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE, *more)


_SEGMENT = "seg long, conv_id long, whole boolean, turns array<bigint>, roles array<string>, keys array<binary>, faults array<int>, copies array<bigint>, costs array<int>, ranks array<int>"


def _initials(roles: list[str], faults: list[int], copies: list[int]) -> list[tuple[str, int, int]]:
    return [(r[:1], f, n - 1) for r, f, n in zip(roles, faults, copies, strict=True)]


def _segments(facts: DataFrame) -> DataFrame:
    """Runs of a conversation's rows in a partition, cut at SEGMENT; whole where none of it can lie elsewhere."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        first, cut = True, False

        def emit(whole):
            nonlocal number
            conv, turns, roles, keys, faults, copies = zip(*held, strict=True)
            costs, ranks = ([], []) if whole else table(_initials(roles, faults, copies))
            number += 1
            return {"seg": number, "conv_id": conv[0], "whole": whole, "turns": turns, "roles": roles, "keys": keys, "faults": faults, "copies": copies, "costs": costs, "ranks": ranks}

        out, size = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and row[0] != held[0][0]:
                    out.append(emit(not first and not cut))
                    size += len(held)
                    held, first, cut = [], False, False
                elif len(held) == SEGMENT:
                    out.append(emit(False))
                    size += len(held)
                    held, cut = [], True
                held.append(row)
                if size > 4 * SEGMENT:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, size = [], 0
        if held:
            out.append(emit(False))
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return stage(_in_order(facts).mapInArrow(run, _SEGMENT), "segments")


_ARROW = pa.schema([
    ("seg", pa.int64()), ("conv_id", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("keys", pa.list_(pa.binary())),
    ("faults", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())),
])


def _plan(segments: DataFrame) -> DataFrame:
    """For the segments of conversations that have several, or may: number, states before and behind, what the one before
    ends with."""
    edge = segments.where("not whole").select(
        "conv_id", "seg", F.element_at("turns", 1).alias("turn"), F.element_at("roles", 1).alias("role"), F.element_at("keys", 1).alias("key"),
        F.element_at("turns", -1).alias("last_turn"), F.left(F.element_at("roles", -1), F.lit(1)).alias("last"), "costs", "ranks",
    )

    def one(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["key"]))
        states = fold([(r["costs"], r["ranks"]) for r in rows])
        back = [None, *rows[:-1]]
        return pa.table({
            "plan_seg": [r["seg"] for r in rows], "number": pa.array(range(len(rows)), pa.int32()), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()),
            "final": [k == len(rows) - 1 for k in range(len(rows))], "before": pa.array([b and b["last"] for b in back], pa.string()), "before_turn": pa.array([b and b["last_turn"] for b in back], pa.int64()),
        })

    return edge.groupBy("conv_id").applyInArrow(one, "plan_seg long, number int, entry int, leave int, final boolean, before string, before_turn long")


_SOLVED = """conv_id long, number int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, least long, most long, distinct long,
    turns array<bigint>, roles array<string>, keys array<binary>, edits array<string>, befores array<array<string>>, news array<string>, behinds array<array<string>>"""


def _solve(r: dict) -> dict:
    rows = _initials(r["roles"], r["faults"], r["copies"])
    if r["whole"]:
        entry, number = 0, 0
        (cost, audit), = cheapest(rows, 0, {0, 3}, True).values()
    else:
        entry, number = r["entry"], r["number"]
        cost, audit = cheapest(rows, entry, {r["leave"]}, False)[r["leave"]]
        if r["final"]:
            audit += REST[r["leave"]]
            cost += INSERT * len(REST[r["leave"]])
    edits, befores, news, behinds = zip(*replay(rows, entry, audit), strict=True)
    count = lambda kind: sum(1 + more for _, f, more in rows if f == kind)
    initials = ([] if r["before"] is None else [r["before"]]) + [x[0] for x in rows]
    turns = r["turns"]
    known = [t for t in turns if t is not None]
    return {
        "conv_id": r["conv_id"], "number": number, "audit": audit, "cost": cost, "blank": count(BLANK),
        "duplicate": count(REPEAT) + sum(more for _, f, more in rows if f in (SOUND, CUT)), "truncated": sum(f == CUT for _, f, _ in rows),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(more for _, _, more in rows),
        "least": min(known, default=None), "most": max(known, default=None), "distinct": len(set(known)) - (bool(known) and r["before_turn"] == known[0]),
        "turns": turns, "roles": r["roles"], "keys": r["keys"], "edits": edits, "befores": befores, "news": news, "behinds": behinds,
    }


def solve(rows: DataFrame) -> DataFrame:
    """Segments of conversations with their audits, counts and edits, from rows with PLACE and text."""
    segments = _segments(_facts(rows))

    def run(batches):
        kinds = _arrow_of(_SOLVED)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_pylist([_solve(r) for r in b.slice(i, 64).to_pylist()], kinds)

    known = segments.drop("costs", "ranks").join(_plan(segments), F.col("seg") == F.col("plan_seg"), "left").drop("plan_seg")
    return stage(known.mapInArrow(run, _SOLVED), "repairs")


def _arrow_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kind = lambda t: pa.list_(kind(t[6:-1])) if t.startswith("array<") else kinds[t]
    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.replace("\n", " ").split(",")])


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, key, text, nulls read as said above."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))


def _once(rows: DataFrame) -> DataFrame:
    """The rows, without those that a task has lately seen: copies of one row don't meet in one task."""

    def run(batches):
        seen: set = set()
        for b in batches:
            keep = []
            for i, place in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                if place not in seen:
                    seen.add(place)
                    keep.append(i)
            if len(seen) > 1 << 16:
                seen = set()
            yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "conv_id long, turn long, role string, key binary, text string")


def _stream(batches):
    """(place, role, text, edit) of every repaired row in order, and (place, None, None, None) for every row there was, from rows
    sorted by place: each edit row, which has edit, new role, and inserts, lies before its texts."""
    edit = None
    for b in batches:
        cols = [b.column(k) for k in range(b.num_columns)]
        small = zip(*(c.to_pylist() for k, c in enumerate(cols) if k != 4), strict=True)
        for i, (conv, turn, role, key, kind, new, before, behind) in enumerate(small):
            place = (conv, turn, role, key)
            if kind is not None:
                edit = None
                yield place, None, None, None
                for r in before:
                    yield place, r, "", "I"
                if kind == "D":
                    for r in behind:
                        yield place, r, "", "I"
                else:
                    edit = (kind, new, behind, place)
            elif edit and edit[3] == place:  # further copies have no edit any more
                yield place, edit[1] or role, cols[4][i].as_py(), edit[0]
                for r in edit[2]:
                    yield place, r, "", "I"
                edit = None


def _merged(rows: DataFrame, solved: DataFrame) -> DataFrame:
    each = solved.select("conv_id", F.explode(F.arrays_zip("turns", "roles", "keys", "edits", "news", "befores", "behinds")).alias("e"))
    each = each.select("conv_id", "e.turns", "e.roles", "e.keys", F.lit(None).cast("string").alias("text"), "e.edits", "e.news", "e.befores", "e.behinds").toDF(*PLACE, "text", "edit", "new", "before", "behind")
    none = F.lit(None).cast("array<string>")
    texts = _once(rows).select(*PLACE, "text", F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("new"), none.alias("before"), none.alias("behind"))
    # an edit, not null, comes before the texts of its place
    both = each.union(texts).withColumn("late", F.col("edit").isNull())
    return _in_order(both, "late").drop("late")


def repaired_rows(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, turn (of the row that it is, or stands beside), role, text, edit (K, R or I) of the repaired conversations,
    in order inside each partition; ``place`` numbers the rows of one turn, role and key."""

    def run(batches):
        out, size, last, nth = [], 0, None, 0
        for place, role, text, edit in _stream(batches):
            nth = nth + 1 if place == last else 0
            last = place
            if edit is None:
                continue
            out.append((*place[:2], role, text, edit, *place[2:], nth))
            size += len(text) + 100
            if size > HELD:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    names = ["conv_id", "turn", "role", "text", "edit", "old_role", "key", "place"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32()]
    _rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return _merged(rows, solved).mapInArrow(run, "conv_id long, turn long, role string, text string, edit string, old_role string, key binary, place int")


_LINE = "conv_id long, digest string, turn long, role string, key binary, place int, line string"


def digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, digest: SHA-256 of the repaired ``role:text`` lines of each conversation that has any."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in _LINE.split(",")]
    _rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        out, held, size, inside, now, seen = [], [], 0, False, (), None
        nth = 0
        for place, role, text, edit in _stream(batches):
            if now != (place[0],):
                if inside and held:
                    out.append((place_of[0], hashlib.sha256("\n".join(x[-1] for x in held).encode()).hexdigest(), None, None, None, None, None))
                else:
                    out += held
                inside, now, held = now != (), (place[0],), []
            place_of = place
            nth = nth + 1 if place == seen else 0
            seen = place
            if edit is None:
                continue
            line = f"{role}:{text}"
            held.append((place[0], None, *place[1:], nth, line))
            size += len(line) + 64
            if size > HELD:
                if sum(len(x[-1]) for x in held) > HELD // 2:  # too long to wait for its end
                    out, held, inside = out + held, [], False
                if out:
                    yield _rows(out)
                out, size = [], sum(len(x[-1]) for x in held)
        out += held
        if out:
            yield _rows(out)

    def whole(batches):
        now, digest = (), None
        for b in batches:
            lines = b.column(6)
            for i, conv in enumerate(b.column(0).to_pylist()):
                if now != (conv,):
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "digest"])
                    now, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(lines[i].as_py().encode())
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "digest"])

    lines = stage(_merged(rows, solved).mapInArrow(run, _LINE), "lines")
    rest = lines.where("digest is null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key", "place")
    return lines.where("digest is not null").select("conv_id", "digest").union(rest.mapInArrow(whole, "conv_id long, digest string"))


def repair(conversations: DataFrame, originals: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of ``originals``,
    for the rows of ``conversations`` (conv_id, turn, role, text)."""
    bound_batches(conversations.sparkSession)
    rows = keyed(conversations)
    solved = solve(rows)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "audit"))), lambda x: x["audit"]), "")
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("distinct"), F.lit(0))
    of_all = solved.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
    fields = ["gaps", *counts, "audit"]
    none = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in fields]
    parts = of_all.select("conv_id", *fields, F.lit(None).cast("string").alias("digest"))
    parts = parts.union(digests(rows, solved).select("conv_id", *none, "digest")).union(originals.select(F.col("conv_id").cast("long"), *none, F.lit(None).cast("string")))
    out = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*fields, "digest"]])
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in fields[:-1]], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
