"""Hard-negative mining by dual-tree search: a tree over the anchors, trees over the candidates, and inner-product
intervals of node pairs that pass whole groups of anchors over at once; pairs of leaves are scored exactly.

Anchors are a stated query set (ids divisible by ``EVERY``), searched against all rows in blocks: a block of anchors of at
most about ``ANCHOR_BYTES`` is broadcast as trees, one for each label; every task builds trees over chunks of its own rows,
keeps the best few for each anchor, and sends those only. Bounds that the anchors of a block give one another
start the pruning; they are scores of real rows, so no result is lost. A second search takes each positive's score as the
top of its negatives' range.

Components are floor(256 * x) and scores their integer inner products, computed in doubles where they are exact and in
64-bit integers elsewhere. Rows take no part with a null id, label or vector, with a null or non-finite component, or with
components so large that a score might leave 64 bits (over 2^62). Vectors of unequal lengths aren't compared; empty ones
score 0. A row with the anchor's own id is neither its positive nor its negative; repeated rows each count, as anchors and
as candidates. Ties go to the smaller vec_id. A positive of a negative score has no negatives, as its range is empty.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stage

EVERY = 100
BEST = 5
SPARE = 5  # a negative lies at most this part, a fifth, below the positive's score
LEAF = 128
ANCHOR_BYTES = 1 << 23  # of the components of a broadcast block of anchors
CHUNK_BYTES = 1 << 24  # of the components of candidates under trees at a time
NONE = -(1 << 63)


class Tree:
    """Nodes over the rows of one matrix: each halves along the line between two far points, down to LEAF rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        lo, hi, kids, centers, radii = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            i, j, parent = todo.pop()
            part = x[order[i:j]]
            center = part.mean(axis=0)
            far = ((part - center) ** 2).sum(axis=1)
            me = len(lo)
            lo.append(i)
            hi.append(j)
            kids.append([])
            centers.append(center)
            radii.append(float(np.sqrt(far.max())))
            if parent >= 0:
                kids[parent].append(me)
            if j - i > LEAF:
                p = part[int(far.argmax())]
                q = part[int(((part - p) ** 2).sum(axis=1).argmax())]
                mid = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(part @ (q - p), mid)]
                todo += [(i, i + mid, me), (i + mid, j, me)]
        self.order, self.ids, self.x = order, ids[order], x[order]
        self.lo, self.hi, self.kids = lo, hi, kids
        self.center, self.radius = np.array(centers), np.array(radii)
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        self.most = float(np.abs(x).max()) if x.size else 0.0


def interval(a: Tree, i: list[int], b: Tree, j: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of rows of nodes i of ``a`` with rows of nodes j of ``b``, pair by pair."""
    middle = np.einsum("ij,ij->i", a.center[i], b.center[j])
    reach = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    reach = reach + 1 + 1e-9 * (reach + a.norm[i] * b.norm[j])  # for rounding
    return middle - reach, middle + reach


def scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best few of each slot of a tree's anchors, a slot being a range of scores: all of [low, high] or None."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high  # anchors x slots
        self.score = np.full((*low.shape, BEST), NONE, np.int64)
        self.id = np.zeros((*low.shape, BEST), np.int64)

    def need(self, i: int, j: int) -> np.ndarray:
        return np.maximum(self.low[i:j], self.score[i:j, :, -1])

    def wants(self, i: int, j: int, least: float, most: float) -> bool:
        return bool(((self.need(i, j) <= most) & (self.high[i:j] >= least)).any())

    def add(self, i: int, j: int, own: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores s of the anchors i to j with the candidates ids; the anchors' own ids don't count."""
        s = np.where(own[:, None] == ids[None, :], NONE, s)[:, None, :]
        fits = (s >= self.need(i, j)[:, :, None]) & (s <= self.high[i:j][:, :, None]) & (s > NONE)
        some = fits.any(axis=(0, 1))
        if not some.any():
            return
        s = np.where(fits[:, :, some], s[:, :, some], NONE)
        got = np.concatenate([self.score[i:j], s], axis=2)
        of = np.concatenate([self.id[i:j], np.broadcast_to(ids[some], s.shape)], axis=2)
        first = np.lexsort((of, -np.maximum(got, NONE + 1)), axis=2)[:, :, :BEST]
        self.score[i:j], self.id[i:j] = np.take_along_axis(got, first, 2), np.take_along_axis(of, first, 2)


def search(anchors: Tree, rows: Tree, best: Best) -> None:
    """Dual traversal: the pair of the greatest bound first, the wider node is opened, pairs that no anchor wants are dropped."""
    most = max(anchors.x.shape[1], 1) * anchors.most * rows.most
    low, high = interval(anchors, [0], rows, [0])
    todo = [(0, 0, low[0], high[0])]
    while todo:
        a, b, low, high = todo.pop()
        i, j = anchors.lo[a], anchors.hi[a]
        if not best.wants(i, j, low, high):
            continue
        ka, kb = anchors.kids[a], rows.kids[b]
        if not ka and not kb:
            k, n = rows.lo[b], rows.hi[b]
            best.add(i, j, anchors.ids[i:j], scores(anchors.x[i:j], rows.x[k:n], most), rows.ids[k:n])
            continue
        open_a = ka and (not kb or anchors.radius[a] > rows.radius[b])
        left, right = (ka, [b] * len(ka)) if open_a else ([a] * len(kb), kb)
        lows, highs = interval(anchors, left, rows, right)
        todo += sorted(zip(left, right, lows, highs, strict=True), key=lambda p: p[3])


def _trees(t: pa.Table) -> dict[tuple[int, int], tuple[Tree, np.ndarray]]:
    """(label, length) to the tree of its rows, and their places in ``t``."""
    lists = t.column("vector").combine_chunks()
    label, ids = (t.column(c).to_numpy() for c in ("label", "vec_id"))
    dims = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(dims).tolist():
        for own in np.unique(label[dims == dim]).tolist():
            at = np.flatnonzero((dims == dim) & (label == own))
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            out[own, dim] = (Tree(ids[at], np.floor(256 * x)), at)
    return out


def _start(trees: dict, slots: np.ndarray | None) -> dict:
    """A Best for each tree of anchors: one open slot, or the ranges below the positives' scores. What the anchors of a
    block find among themselves is a first bound of what each needs."""
    out = {}
    for key, (tree, at) in trees.items():
        if slots is None:
            high = np.full((len(at), 1), (1 << 63) - 1, np.int64)
            low = np.full_like(high, NONE)
        else:
            high = slots[at][tree.order]
            low = np.where(high < 0, (1 << 63) - 1, high - high // SPARE)  # none can lie below a negative score
        out[key] = Best(low, high)
    return out


def _rival(key: tuple, other: tuple, negatives: bool) -> bool:
    return key[1] == other[1] and (key[0] != other[0]) == negatives


def _bounds(trees: dict, slots: np.ndarray | None) -> dict:
    start = _start(trees, slots)
    for key, (tree, _) in trees.items():
        for other, (rows, _) in trees.items():
            if _rival(key, other, slots is not None):
                search(tree, rows, start[key])
        start[key] = Best(start[key].need(0, len(tree.x)), start[key].high)
    return start


def _search(rows: DataFrame, block: pa.Table, slots: np.ndarray | None) -> DataFrame:
    """(aid, slot, vec_id, score): the best of each slot of the block's anchors over all ``rows``."""
    trees = _trees(block)
    sent = rows.sparkSession.sparkContext.broadcast((trees, _bounds(trees, slots), block.column("aid").to_numpy()))
    negatives = slots is not None
    names = ["aid", "slot", "vec_id", "score"]

    def run(batches):
        trees, start, aid = sent.value
        best = {k: Best(b.low, b.high) for k, b in start.items()}

        def take(held):
            for other, (tree, _) in _trees(pa.Table.from_batches(held)).items():
                for key, (anchors, _) in trees.items():
                    if _rival(key, other, negatives):
                        search(anchors, tree, best[key])

        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 14):
                part = b.slice(lo, 1 << 14)
                held.append(part)
                size += 8 * len(part.column(2).flatten())
                if size > CHUNK_BYTES:
                    take(held)
                    held, size = [], 0
        if held:
            take(held)
        for key, (anchors, at) in trees.items():
            i, slot, k = np.nonzero(best[key].score > NONE)
            if len(i):
                out = [aid[at[anchors.order[i]]], slot.astype(np.int32), best[key].id[i, slot, k], best[key].score[i, slot, k]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    found = rows.mapInArrow(run, "aid long, slot int, vec_id long, score long")
    order = W.partitionBy("aid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    stored = vectors.schema["embedding"].dataType.simpleString()
    kind = stored if stored == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("double") * 256).cast("double")))), F.lit(0.0))
    rows = rows.where("vec_id is not null and label is not null and vector is not null").where(finite)
    return rows.where(largest * largest * F.size("vector") < 2.0**62)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, where ``vectors`` has vec_id, embedding, label.

    An anchor's positives are its BEST best other rows of the same label; the negatives of a pair the BEST best rows of other
    labels that reach four fifths of the positive's score (1 - 1 / SPARE) and don't exceed it."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable_rows(vectors)
    anchors = stage(rows.where(F.col("vec_id") % EVERY == 0).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.sum(F.size("vector").cast("long") * 8 + 8)).first()[0] or 0
    blocks = max(1, -(-size // ANCHOR_BYTES))
    parts = []
    for k in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("aid"), F.lit(blocks)) == k).toArrow()  # within the bound, by the count above
        if not block.num_rows:
            continue
        found = _search(rows, block, None).toArrow()  # BEST rows an anchor
        place = {a: i for i, a in enumerate(block.column("aid").to_pylist())}
        slots = np.full((block.num_rows, BEST), -1, np.int64)
        of = np.array([place[a] for a in found.column("aid").to_pylist()], np.int64)
        slots[of, found.column("rank").to_numpy() - 1] = found.column("score").to_numpy()
        pairs = pa.table({
            "aid": found.column("aid"), "slot": pa.array(found.column("rank").to_numpy() - 1, pa.int32()), "positive_id": found.column("vec_id"), "positive_score": found.column("score"),
            "anchor_id": pa.array(block.column("vec_id").to_numpy()[of], pa.int64()),
        })
        if not pairs.num_rows:
            continue
        near = _search(rows, block, slots).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        out = near.join(spark.createDataFrame(pairs), ["aid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        parts.append(stage(out, "negatives") if blocks > 1 else out)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.union, parts)
