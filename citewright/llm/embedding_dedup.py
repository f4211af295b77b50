"""Near-duplicate vectors by collision counting over sorted projections.

A window over one projection of all rows holds a fixed share of them, so counting windows of
the whole table is quadratic. Rows therefore first meet where projections are extreme: of the many Gaussian projections of a
table, a row's code names the one it stands farthest out in, and on which side; where such codes would leave more
than about BLOCK_ROWS strangers together, several make the code. There are as many tables as find a
pair at the threshold with the probability RECALL, which is calibrated by simulation. Within blocks, every row of PROJECTIONS
Gaussian projections is sorted, the rows in a window centred on each query collide with it, and pairs
whose collisions reach the count that RECALL_COUNT of the pairs at the threshold reach are
verified by their cosine in double precision. A pair is looked at in the first table
in which it meets only, so links are counted once and no pair leaves a task: a block gives
a row for each linked vector, with its number of links and one neighbour.

Equal vectors are one row with a weight; vectors travel as they are stored. Blocks beyond TILE rows are cut into tiles, whose pairs
of parts are tasks of their own, so a group of near copies of any size is spread.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component; vectors of unequal length link with nothing of each
other; a null vec_id links with nothing (component null, kept false); rows that repeat a
vec_id share its links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, min_labels, stage

COSINE = 0.9
RECALL = 0.97
RECALL_COUNT = 0.995
PROJECTIONS = 16
BLOCK_ROWS = 8
MOST_EXTREMES = 256  # projections of a code
TILE = 1024
PAIRS_AT_ONCE = 1 << 21


@cache
def same_extreme(k: int, cosine: float) -> float:
    """How often two unit vectors at this cosine stand farthest out in the same one of k projections, on the same side."""
    rng = np.random.default_rng(5)
    hits, tries = 0, 0
    while tries < 8192:
        x = rng.standard_normal((1024, k))
        y = cosine * x + sqrt(1 - cosine * cosine) * rng.standard_normal((1024, k))
        i, j = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
        rows = np.arange(1024)
        hits += int(((i == j) & (x[rows, i] * y[rows, j] > 0)).sum())
        tries += 1024
    return hits / tries


def plan(rows: int, cosine: float = COSINE) -> tuple[int, int, int]:
    """Codes per table, projections per code, and number of tables for so many rows."""
    cells = max(2.0, rows / BLOCK_ROWS)
    codes = max(1, ceil(log(cells) / log(2 * MOST_EXTREMES)))
    k = max(2, round(cells ** (1 / codes) / 2))
    same = same_extreme(k, cosine) ** codes
    return codes, k, ceil(log(1 - RECALL) / log(1 - same))


def least_collisions(cosine: float = COSINE, m: int = PROJECTIONS) -> tuple[float, int]:
    """Half width of a window, and the count that RECALL_COUNT of the pairs at ``cosine`` reach.

    Projections of unit vectors at this cosine differ by a normal of variance 2 - 2 cosine."""
    sigma = sqrt(2 - 2 * cosine)
    width = 1.6 * sigma
    q = erf(width / sigma / sqrt(2))
    reach, count = 0.0, m + 1
    while reach < RECALL_COUNT:
        count -= 1
        reach += comb(m, count) * q**count * (1 - q) ** (m - count)
    return width, count


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _coded(groups: DataFrame, codes: int, k: int, tables: int) -> DataFrame:
    """The rows with the code of every table, one long each."""

    def run(batches):
        drawn: dict[int, np.ndarray] = {}
        weights = np.int64(2 * k) ** np.arange(codes, dtype=np.int64)
        step = max(1, (1 << 22) // (tables * codes * k))
        for b in batches:
            lists, dims = b.column(2), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            own = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in drawn:
                    drawn[dim] = np.random.default_rng(7 + dim).standard_normal((dim, tables * codes * k)).astype(np.float32)
                at = np.flatnonzero(dims == dim)
                x = _unit(lists.take(pa.array(at)), dim).astype(np.float32)
                for lo in range(0, len(at), step):
                    out = (x[lo : lo + step] @ drawn[dim]).reshape(-1, tables, codes, k)
                    far = np.abs(out).argmax(axis=3)
                    side = np.take_along_axis(out, far[..., None], axis=3)[..., 0] > 0
                    own[at[lo : lo + step]] = (2 * far + side) @ weights
            offsets = pa.array(np.arange(0, tables * b.num_rows + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))], names=["vec_id", "weight", "vector", "codes"])

    kind = groups.schema["vector"].dataType.simpleString()
    return groups.mapInArrow(run, f"vec_id long, weight long, vector {kind}, codes array<long>")


def _linked(tiles: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, links, peer): for each vector that links within its tile."""
    width, least = least_collisions(cosine)

    def pairs(dim: int, x: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one tile whose windows collide often enough."""
        n = len(x)
        shift = tile * 1000.0  # projections of unit vectors stay far below: windows end with their tile
        drawn = np.random.default_rng(11 + dim).standard_normal((dim, PROJECTIONS))
        met = []
        for k in range(PROJECTIONS):
            value = x @ drawn[:, k] + shift
            order = np.argsort(value)
            value = value[order]
            reach = np.searchsorted(value, value + width, "right") - np.arange(n) - 1
            lo = np.repeat(np.arange(n), reach)
            hi = lo + 1 + np.arange(len(lo)) - np.repeat(np.cumsum(reach) - reach, reach)
            a, b = order[lo], order[hi]
            met.append(np.minimum(a, b) * np.int64(n) + np.maximum(a, b))
        met = np.concatenate(met)
        met.sort()
        end = np.append(met[1:] != met[:-1], True)[: len(met)]
        count = np.diff(np.append(-1, np.flatnonzero(end)))
        found = met[end][count >= least]
        return found // n, found % n

    def run(batches):
        from .suffix_dedup import _groups

        for t in _groups(batches, 0):
            block = t.column("block").to_numpy()
            _, tile = np.unique(block, return_inverse=True)
            size = np.bincount(tile)
            starts = np.append(0, np.cumsum(size))
            lo = 0
            while lo < len(size):
                hi, cost = lo, 0
                while hi < len(size) and (hi == lo or cost + int(size[hi]) ** 2 <= PAIRS_AT_ONCE):
                    cost += int(size[hi]) ** 2
                    hi += 1
                part = t.slice(int(starts[lo]), int(starts[hi] - starts[lo])).combine_chunks()
                lo = hi
                if part.num_rows < 2:
                    continue
                yield from linked(part)

    def linked(part: pa.Table):
        get = lambda k: part.column(k).combine_chunks()
        lists = get("vector")
        dim = len(lists[0])
        ids, weight, table, side, cell = (get(k).to_numpy(zero_copy_only=False) for k in ("vec_id", "weight", "table", "side", "block"))
        codes = get("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        dims = lists.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = _unit(lists.take(pa.array(at)), dim)
            _, tile = np.unique(cell[at], return_inverse=True)
            i, j = pairs(dim, x, tile)
            ok = (side[at[i]] != side[at[j]]) | (side[at[i]] == 2)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            before = np.arange(codes.shape[1])[None, :] < table[at[i]][:, None]
            keep = ~((codes[at[i]] == codes[at[j]]) & before).any(axis=1)
            i, j = i[keep], j[keep]
            close = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[close], j[close]
            if not len(i):
                continue
            links = np.bincount(i, weight[at[j]], len(x)) + np.bincount(j, weight[at[i]], len(x))
            peer = min_labels(len(x), i, j)
            hit = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[hit]]), pa.array(links[hit].astype(np.int64)), pa.array(ids[at[peer[hit]]])], names=["vec_id", "links", "peer"])

    rows = tiles.repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "vec_id long, links long, peer long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    bound_batches(vectors.sparkSession)
    stored = vectors.schema["embedding"].dataType.simpleString()
    kind = stored if stored == "array<float>" else "array<double>"  # floats are widened where they are compared
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    valid = rows.where("vec_id is not null and vector is not null").where(finite)
    groups = stage(valid.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).select("vec_id", "weight", "vector"), "vectors")
    coded = stage(_coded(groups, *plan(groups.count(), cosine)), "codes")
    cells = coded.select("vec_id", "weight", "vector", "codes", F.posexplode("codes").alias("table", "code")).withColumn("cell", F.xxhash64("table", "code", F.size("vector")))
    large = cells.groupBy("cell").count().where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    cells = cells.join(stage(large, "cells"), "cell", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    # a part meets every other part and itself; side tells the two apart, 2 is a part with itself
    tiles = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    block = F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))
    tiles = tiles.select(block.alias("block"), "vec_id", "weight", "vector", "codes", F.col("table").cast("long").alias("table"), side.alias("side"))
    found = stage(_linked(tiles, cosine), "links")
    labels = components(found.select(F.col("vec_id").alias("u"), F.col("peer").alias("v"))).withColumnRenamed("id", "vec_id")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    # every vector of a group of equal ones has the links of the group's first, and the others of the group
    groups = groups.join(counts, "vec_id", "left").join(labels, "vec_id", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    # of two tables, so that a vector of many rows can be split
    groups = stage(groups.select("vector", links.alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "groups")
    keyed = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & finite, F.col("vector")))
    out = keyed.join(groups, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
