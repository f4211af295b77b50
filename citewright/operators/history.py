"""Saved sessions as the outcome of their operations: what was saved, updated, deleted, cleared and imported, in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.folds import fold_groups

#: Sessions and bytes that an owner keeps, and sessions and bytes of one import.
MOST, ROOM, MOST_IMPORTED, IMPORT_ROOM = 50, 8 << 20, 50, 16 << 20


def _bytes(held: list[tuple]) -> int:
    """Of the sessions as one JSON list: brackets and commas count."""
    return sum(r[2] for r in held) + len(held) + 1


def replay(operations: DataFrame, most: int = MOST, room: int = ROOM) -> DataFrame:
    """(owner, at, op, session_id, saved_at, bytes) to the sessions that are left: (owner, session_id, saved_at, bytes, written).

    ``at`` orders an owner's operations. "save" writes a session; one that is there keeps its saved_at. "update" does so only if it
    is there: what was deleted stays deleted. "delete" and "clear" take away. After each, the newest ``most`` stay and the oldest go
    until they fit in ``room``; one stays at least. The rows of an "import" with one ``at`` are one operation: they replace
    sessions of their ids with their own saved_at, or, where they are too many or too large, or what would be held is, nothing
    changes. Rows of other operations, and of no session where one is needed, are passed over. ``written`` is the ``at`` of the last
    write. The fold streams and holds what the owner keeps; a null size is 0."""
    out = T.StructType().add("session_id", "string").add("saved_at", "string").add("bytes", "long").add("written", "long")
    rows = operations.selectExpr("owner", "cast(at as bigint) at", "cast(session_id as string) session_id", "op", "cast(saved_at as string) saved_at", "coalesce(cast(bytes as bigint), 0) bytes")
    return fold_groups(rows, ["owner"], ["at", "session_id"], ["op", "saved_at", "bytes"], lambda ops: _replay(ops, most, room), out)


def _replay(ops: Iterator[tuple], most: int, room: int) -> list[tuple]:
    held: list[tuple] = []  # (session_id, saved_at, bytes, written), newest first
    for at, group in itertools.groupby(ops, key=lambda r: r[0]):
        imported: list[tuple] | None = []
        size = 1
        for _, session, op, saved, n in group:
            if op == "import":
                size += n + 1
                if imported is not None and session is not None and saved is not None:
                    imported.append((session, saved, n, at))
                imported = None if imported is None or len(imported) > MOST_IMPORTED or size > IMPORT_ROOM else imported
            elif op == "clear":
                held = []
            elif session is not None and op == "delete":
                held = [r for r in held if r[0] != session]
            elif session is not None and op in ("save", "update"):
                before = next((r for r in held if r[0] == session), None)
                if before or op == "save":
                    held = _kept([(session, before[1] if before else saved or "", n, at), *[r for r in held if r[0] != session]], most, room)
        if imported:
            named = {r[0]: r for r in held} | {r[0]: r for r in imported}
            if len(named) <= most and _bytes(list(named.values())) <= room:
                held = _kept(list(named.values()), most, room)
    return held


def _kept(held: list[tuple], most: int, room: int) -> list[tuple]:
    held = sorted(held, key=lambda r: r[1], reverse=True)[:most]  # equal times keep their order
    while len(held) > 1 and _bytes(held) > room:
        held.pop()
    return held
