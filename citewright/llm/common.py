"""Shared helpers of the training-data operators: staging in the shared folder,
whole-batch text hashing with numpy, and connected components.

Nothing here sees more than one Arrow batch at a time, and batches are cut into
chunks of about ``CHUNK`` bytes of text before any array is widened to 64 bits.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 21
BATCH_BYTES = 1 << 22  # of an Arrow batch, whatever the length of its rows
SHARES = 4096  # parts of a bin of counts
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a session without a cluster, where driver and executors are one process, gets a temporary one if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that workers get by bytes, not by rows only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage,
    survives lost executors, and gives the planner true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """All columns of ``docs`` as one struct, and where in it the text is. A text that isn't a string goes along as
    a second column, -1."""
    names = [c.lower() for c in docs.columns]
    at = names.index(text.lower())
    if docs.schema[at].dataType.typeName() == "string":
        return docs.select(F.struct("*").alias("row")), at
    return docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")), -1


def carried_text(b: pa.RecordBatch, at: int) -> pa.Array:
    return b.column(1) if at < 0 else b.column(0).field(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the len + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK):
    """Ranges [i, j) of texts that hold about ``size`` bytes, one text at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = 0x9E6C63D0876A9A47 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n (at least), modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """S with S[j] = sum of value(b_i) * BASE**i for i < j."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal bytes give equal values anywhere."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and per-text counts of words, runs of bytes that are not white space."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    gap = space[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, gap[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = True
    start = np.flatnonzero(before & ~gap)
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = offs[1:] - 1
    after[ends[ends >= 0]] = True
    end = np.flatnonzero(after & ~gap) + 1
    return start, end, np.diff(np.searchsorted(start, offs))


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) in order, and their count per text."""
    buf = lower(buf)
    start, end, counts = word_spans(buf, offs)
    return span_hashes(prefix_hashes(buf), start, end), counts


def most_frequent(counts: DataFrame, most: int, *more: str) -> DataFrame:
    """The rows (code, n, and the columns ``more``) of the greatest n, at most ``most`` of them. Counts are binned by sixteenths of
    powers of two, so no task sorts or gathers the candidates. Whole bins are taken from the top; of the first that has
    no room, the rows of the smallest hashes of their codes."""
    bin_ = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    share = F.pmod(F.xxhash64("code", F.lit(23)), F.lit(SHARES)).cast("int")
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows")).orderBy(F.desc("bin")).collect()  # some 16 rows a power of two
    room, whole = most, None
    for at, rows in bins:
        if rows > room:
            shares = counts.where(bin_ == at).groupBy(share.alias("share")).agg(F.count("*").alias("rows")).orderBy("share").collect()
            upto = -1
            for k, n in shares:
                room -= n
                if room < 0:
                    break
                upto = k
            keep = (bin_ > at) | ((bin_ == at) & (share <= upto))
            return counts.where(keep).select("code", "n", *more)
        room, whole = room - rows, at
    return counts.where(F.lit(False) if whole is None else bin_ >= whole).select("code", "n", *more)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (id, component): the smallest id
    reachable. Alternates large-star and small-star steps; each step aggregates by key with
    map-side combine and joins back, so a hub of any degree is one aggregated row and its
    edges can be split. Null ends and loops are ignored. Every round is a staged table."""
    spark = edges.sparkSession
    e = _contract(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    e = stage(e.distinct(), "edges")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("id"), "component").distinct())


def _contract(edges: DataFrame) -> DataFrame:
    """Per batch, replace edges by the stars of a local union-find; fewer rows, same components."""

    def run(batches):
        for b in batches:
            u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = min_labels(len(ids), at[: len(u)], at[len(u) :])
            own = label != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def min_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes: vectorised hooking and pointer jumping."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        live = label[u] != label[v]
        u, v = u[live], v[live]
    return label
