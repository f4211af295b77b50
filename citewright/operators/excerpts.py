"""Long sources cut to a room: blocks ranked by what is asked, taken greedily, and put together in their order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import fold_groups
from ..functions.tokens import once

#: Characters of a block, from where it may end; of a source; words of sections, and words that ask nothing.
LARGEST, EARLIEST, ROOM = 800, 400, 6_000
SECTIONS = ("abstract", "conclusion", "conclusions", "result", "results", "limitation", "limitations", "method", "methods", "methodology", "discussion")
ASK_NOTHING = (
    "what", "which", "how", "this", "that", "with", "from", "paper", "research", "does", "have", "were", "about", "their", "these", "there", "please", "explain",
    "the", "and", "for", "are", "was", "is", "of", "to", "in", "on", "as", "by",
)
OMITTED = "\n[...]\n"
HIT = 10  # least score of a block that holds an asked word


def blocks_of(text: str) -> list[str]:
    """Paragraphs, those over LARGEST characters cut at the last line end or blank behind EARLIEST, where there is one."""
    out = []
    for part in re.split(r"\n\s*\n", text):
        part = part.strip()
        while len(part) > LARGEST:
            end = max(part.rfind(s, EARLIEST, LARGEST) for s in "\n ")
            end = end if end > 0 else LARGEST
            out.append(part[:end].strip())
            part = part[end:].strip()
        out += [part] if part else []
    return out


def blocks(texts: DataFrame) -> DataFrame:
    """(source_id, text) to (source_id, position, text)."""

    def run(batches):
        for b in batches:
            at, place, text = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = blocks_of(t or "")
                at += [i] * len(found)
                place += range(len(found))
                text += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(text, pa.string())], names=["source_id", "position", "text"])

    return texts.select("source_id", F.col("text").cast("string")).mapInArrow(run, T.StructType([texts.schema["source_id"]]).add("position", "integer").add("text", "string"))


def asked_words(question: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*ASK_NOTHING))


def block_score(text: Column, words: Column) -> Column:
    """Ten for each of up to three occurrences of a word, inside words too; three for a section's word among the first 140 characters."""
    heading = F.left(text, F.lit(140)).rlike(rf"(?iU)\b({'|'.join(SECTIONS)})\b")
    count = lambda low, w: F.floor((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")
    hits = once(F.lower(text), lambda low: F.aggregate(words, F.lit(0), lambda acc, w: acc + F.least(F.lit(3), count(low, w))))
    return hits * 10 + F.when(heading, 3).otherwise(0)


def _taken(rows: Iterator[tuple]) -> Iterator[tuple]:
    used = len(OMITTED)
    for *_, position, size, room in rows:
        cost = size + len(OMITTED) + 1
        if used + cost <= room:
            used += cost
            yield (position,)


def compact_sources(sources: DataFrame, room: int = ROOM) -> DataFrame:
    """(source_id, text[, question][, room]) to (source_id, text, cut): a text that fits stays; of another the blocks that fit are taken
    in this order: those that hold asked words, best and latest first, each followed by its neighbours; the first, the last, the
    second; the others, best and latest first. A block that doesn't fit is passed over. They stand in their order in the text,
    with a mark for what is left out. The fold over a source's blocks streams their sizes only. A null text is empty."""
    asked = F.col("question") if "question" in sources.columns else F.lit("")
    rows = sources.select("source_id", F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), asked.alias("question"), (F.col("room") if "room" in sources.columns else F.lit(room)).cast("int").alias("room"))
    short = rows.where("length(text) <= room").select("source_id", "text", F.lit(False).alias("cut"))
    long = rows.where("length(text) > room")
    parts = blocks(long.select("source_id", "text"))
    scored = parts.join(long.select("source_id", "room", asked_words(F.col("question")).alias("words")), "source_id")
    scored = scored.select("source_id", "position", "room", F.length("text").alias("size"), block_score(F.col("text"), F.col("words")).alias("score"), (F.size("words") > 0).alias("asked"))
    last = scored.groupBy("source_id").agg(F.max("position").alias("last"))
    place, end = F.col("position"), F.col("last")
    key = lambda a, b, c, d: F.struct(F.lit(a).alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"), F.lit(d).alias("d"))
    try_ = lambda at, k: F.struct(at.cast("int").alias("position"), k.alias("key"))
    hit = [try_(place, key(0, -F.col("score"), -place, 0)), try_(F.greatest(F.lit(0), place - 1), key(0, -F.col("score"), -place, 1)), try_(F.least(end, place + 1), key(0, -F.col("score"), -place, 2))]
    none = F.expr("cast(array() as array<struct<position:int,key:struct<a:int,b:int,c:int,d:int>>>)")
    tries = F.concat(
        F.array(try_(place, key(2, -F.col("score"), -place, 0))), F.when(F.col("asked") & (F.col("score") >= HIT), F.array(*hit)).otherwise(none),
        F.when(place == 0, F.array(try_(F.lit(0), key(1, F.lit(0), F.lit(0), 0)))).otherwise(none), F.when(place == end, F.array(try_(place, key(1, F.lit(1), F.lit(0), 0)))).otherwise(none),
        F.when(place == 1, F.array(try_(F.lit(1), key(1, F.lit(2), F.lit(0), 0)))).otherwise(none),
    )
    tried = scored.join(last, "source_id").select("source_id", F.explode(tries).alias("t")).groupBy("source_id", "t.position").agg(F.min("t.key").alias("key"))
    tried = tried.join(scored.select("source_id", "position", "size", "room"), ["source_id", "position"]).select("source_id", "key.*", "position", "size", "room")
    taken = fold_groups(tried, ["source_id"], ["a", "b", "c", "d"], ["position", "size", "room"], _taken, T.StructType().add("position", "integer"))
    kept = F.array_sort(F.collect_list(F.struct("position", "text")))
    gap = lambda x, i: F.when((i == 0) | (F.get(F.col("kept"), i - 1)["position"] != x["position"] - 1), F.lit(OMITTED)).otherwise("")
    whole = parts.join(taken, ["source_id", "position"]).groupBy("source_id").agg(kept.alias("kept"))
    whole = whole.select("source_id", F.concat(F.array_join(F.transform("kept", lambda x, i: F.concat(gap(x, i), x["text"], F.lit("\n"))), ""), F.lit(OMITTED)).alias("text"), F.lit(True).alias("cut"))
    bare = long.join(whole, "source_id", "left_anti").select("source_id", F.lit(OMITTED).alias("text"), F.lit(True).alias("cut"))
    return short.union(whole).union(bare)
