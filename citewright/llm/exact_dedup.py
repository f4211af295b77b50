"""Exact deduplication against a minimal perfect hash of historical digests.

The rows are dealt into a historical part and new arrivals. The distinct digests of the
history, each with its winner (largest doc_id) and its number of rows, are sharded by digest;
every shard becomes a minimal perfect hash whose slots hold the full 32-byte digest,
the winner's id and the row count. Arrivals, first reduced to distinct digests by a
map-side combined aggregation, probe the shard: a slot whose 32 bytes agree takes the repeat in,
and passes the win on to a larger id; nonmembers form groups of their own. What the slots hold then, and the
nonmembers, are the groups. There are as many shards as keep about SHARD_KEYS digests, old and new, in each.

Defined cases: null text counts as empty; rows that repeat both doc_id and text are one
document, counted as often as they occur; a null doc_id loses against any other; a history of none or all of the rows
gives the same groups; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, stage

SHARD_KEYS = 1 << 12
_SLOTS = "shard long, levels array<binary>, digests binary, winners binary, sizes binary"


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bit arrays over (n, 4) uint64 digests, and each key's slot in 0..n-1.

    In every level, keys that are alone at their position are settled there; the others go
    on. A key's slot is the rank of its bit."""
    levels, slot, left, base = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = max(64, -(-len(left) * 3 // 2 // 8) * 8)
        pos = _position(keys[left], len(levels), size)
        alone = np.bincount(pos, minlength=size) == 1
        settled = alone[pos]
        slot[left[settled]] = base + np.cumsum(alone)[pos[settled]] - 1
        base += int(alone.sum())
        levels.append(np.packbits(alone))
        left = left[~settled]
    return levels, slot


def probe_mph(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slots of the keys, -1 where no level has a bit; a stranger may get any slot."""
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        bits = np.unpackbits(bits).astype(bool)
        pos = _position(keys[left], k, len(bits))
        here = bits[pos]
        slot[left[here]] = base + np.cumsum(bits)[pos[here]] - 1
        base += int(bits.sum())
        left = left[~here]
    return slot


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(keys[:, level % 4] ^ seed) % np.uint64(size)).astype(np.int64)


def _digests(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), np.uint64).reshape(-1, 4)


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _digests(pdf["digest"])
    levels, slot = build_mph(keys)
    order = np.argsort(slot)
    winner = pdf["winner"].fillna(-(1 << 63)).to_numpy(np.int64) if pdf["winner"].isna().any() else pdf["winner"].to_numpy(np.int64)
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])], "levels": [[x.tobytes() for x in levels]],
        "digests": [keys[order].tobytes()], "winners": [winner[order].tobytes()],
        "sizes": [pdf["size"].to_numpy(np.int64)[order].tobytes()],
    })


def _probe_shard(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard: its slots after the members among the arrivals, and the nonmembers."""
    held, winner, size = np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.zeros(len(new), bool)
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        winner, size = (np.frombuffer(row[k], np.int64).copy() for k in ("winners", "sizes"))
        if len(new):
            keys = _digests(new["digest"])
            slot = probe_mph([np.frombuffer(x, np.uint8) for x in row["levels"]], keys)
            member = slot >= 0
            member[member] = (held[slot[member]] == keys[member]).all(axis=1)
            at = slot[member]  # arrivals are distinct: one a slot
            winner[at] = np.maximum(winner[at], new["winner"].to_numpy(np.int64)[member])
            size[at] += new["size"].to_numpy(np.int64)[member]
    own = pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": winner, "size": size})
    return pd.concat([own, new.loc[~member, ["digest", "winner", "size"]]], ignore_index=True)


def digest_groups(keyed: DataFrame) -> DataFrame:
    """Distinct digests of (doc_id, digest, copies) with winner and number of rows."""
    return keyed.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(1 << 63))).alias("winner"), F.sum("copies").alias("size"))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the historical digests: the hash's levels and its slots."""
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_index_shard, _SLOTS)


def look_up(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, size) of history and arrivals: one row per distinct digest."""
    new = groups.withColumn("shard", _shard(shards))
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe_shard, "digest binary, winner long, size long")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def exact_dedup(docs: DataFrame, history: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (doc_id, digest, copies, keep_id, group_size, kept, historical).

    ``history`` marks the historical rows; by default, half of the ids by hash."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"))
    historical = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if history is None else F.coalesce(history, F.lit(False))
    keyed = stage(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).withColumn("historical", historical), "digests")
    old = digest_groups(keyed.where("historical"))
    new = digest_groups(keyed.where("not historical"))
    shards = max(1, keyed.count() // SHARD_KEYS)
    groups = stage(look_up(new, build_index(old, shards), shards).withColumnRenamed("size", "group_size"), "groups")
    out = keyed.join(groups, "digest")  # of two tables, so that a digest of many rows can be split
    keep = F.when(F.col("winner") > -(1 << 63), F.col("winner"))
    return out.select("doc_id", "digest", "copies", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "historical")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each distinct text, with all their columns."""
    found = stage(exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("kept_digest"), "copies"), "kept")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    out = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    if not found.where("copies > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "digest"])
    return out.select("row.*")
