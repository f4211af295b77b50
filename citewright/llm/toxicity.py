"""Toxicity scores from averaged subword embeddings and a linear softmax.

A text is the bag of its byte strings of SIZES bytes that cross no white space (a word's edge
counts as a byte, A-Z are lower-cased), hashed into BUCKETS embeddings. Their mean feeds a softmax
over two classes; embeddings and weights are trained jointly in numpy by Adam, on at most
SAMPLE labelled texts by class, chosen by hash, whose bags take SAMPLE_BYTES at most: these bounds keep the fit independent of
the corpus. A misspelling shares most of its strings with the word it disguises.

As everything behind the mean is linear, a fitted model scores by one table of bucket scores;
every whole text is scored by gathering and averaging them.

Defined cases: null counts as empty, and an empty text scores by the bias alone; labels other than 0 and 1
and null ids don't train; of repeated labels of an id the largest counts, of its texts the least; repeated rows are
scored alike; if no label of either class can be learnt from, all scores are 0; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bound_batches, carried, carried_text, chunks, flat, lower, powers, prefix_hashes, stage

SIZES = (3, 4, 5)
BUCKETS = 1 << 16
DIM = 8
SAMPLE = {1: 2_500, 0: 7_500}  # at most so many labelled texts of each class are learnt from
SAMPLE_BYTES = 1 << 27  # of the bags that are learnt from, taken in order of hash
EPOCHS = 12
SCALE = 50.0
SLICE = 1 << 19  # bytes of text whose subwords are held at once


def held_out(doc_id: str = "doc_id", modulus: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 0


_EDGE = np.arange(256, dtype=np.uint8)
_EDGE[[9, 10, 11, 12, 13]] = 32
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"]] = 32


def subwords(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and the text each belongs to."""
    sizes = np.diff(offs) + 2
    ends = np.cumsum(sizes)
    text = np.full(int(ends[-1]) if len(sizes) else 0, 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(ends - sizes + 1 - offs[:-1], np.diff(offs))] = _EDGE[lower(buf)]
    sums = prefix_hashes(text)
    _, down = powers(len(sums))
    blank = np.append(0, np.cumsum(text == 32, dtype=np.int32))
    buckets, places = [], []
    for n in SIZES:
        at = np.flatnonzero(blank[n - 1 : len(text)] == blank[1 : len(text) - n + 2])  # no blank inside; one may stand at an edge
        h = (sums[at + n] - sums[at]) * down[at]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((h >> np.uint64(48)).astype(np.int32))
        places.append(at)
    at = np.concatenate(places)
    return np.concatenate(buckets), np.searchsorted(ends, at, "right")


def packed_bag(bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Buckets in the upper and counts in the lower 16 bits of 32-bit numbers; a count beyond 65535 takes several."""
    times = -(-n // 65535)
    last = np.cumsum(times) - 1
    out = np.full(int(times.sum()), 65535, np.int64)
    out[last] = n - 65535 * (times - 1)
    return ((np.repeat(bucket, times).astype(np.uint32) << 16) | out.astype(np.uint32)).astype(np.uint32)


def _bags(rows: DataFrame) -> DataFrame:
    """(doc_id, label, bag): each text as its distinct buckets and their counts."""

    def run(batches):
        for b in batches:
            buf, offs = flat(b.column(2))
            for i, j in chunks(offs, SLICE):
                bucket, text = subwords(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                key, n = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                cuts = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
                bags = [packed_bag(key[lo:hi] % BUCKETS, n[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    return rows.mapInArrow(run, "doc_id long, label int, bag binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] | None = None) -> np.ndarray | None:
    """Scores of the buckets, with the bias as a last element."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.xxhash64("doc_id", F.lit(17))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(size) < 2:
        return None
    sample = sample or SAMPLE
    # ids of the sample are bounded by its parameter, so they are joined by broadcast
    chosen = known.where("label = 1").orderBy(order).limit(sample[1]).union(known.where("label = 0").orderBy(order).limit(sample[0]))
    texts = present.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    bags = stage(_bags(texts), "bags")
    # the sample has a bounded number of rows, so their sizes may be summed in one task
    so_far = F.sum(F.length("bag")).over(W.orderBy(order, "doc_id"))
    chosen = stage(bags.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id"), "chosen")
    bags = bags.join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id").select("label", "bag").toArrow()
    y = bags.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    packed, bounds = flat_words(bags.column("bag").combine_chunks())
    del bags
    tilt = np.log(size[1] / size[0]) - np.log(y.sum() / (len(y) - y.sum()))  # back to the shares among all labels
    table = train(bounds, packed, y)
    table[-1] += tilt
    return table


def flat_words(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all bags end to end, and their bounds."""
    _, offsets, data = bags.buffers()
    offs = np.frombuffer(offsets, np.int32)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64) // 4
    numbers = np.frombuffer(data, np.uint32) if data is not None else np.zeros(0, np.uint32)
    return numbers[offs[0] : offs[-1]], offs - offs[0]


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, text: np.ndarray, back: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of texts whose entries have the embeddings e[back] at these weights, and its gradients."""
    h = np.stack([np.bincount(text, weight * e[back, k], len(y)) for k in range(e.shape[1])], axis=1)
    logits = h @ w + b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(p[np.arange(len(y)), y]).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    dh = (p @ w.T).astype(e.dtype)
    return loss, {"w": h.T @ p, "b": p.sum(axis=0), "e": np.stack([np.bincount(back, weight * dh[text, k], len(e)) for k in range(e.shape[1])], axis=1)}


def train(bounds: np.ndarray, packed: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Joint fit of embeddings and softmax weights to bags of packed buckets and counts; gives the
    log-odds per bucket and the bias. Only a mini-batch is ever unpacked."""
    rng = np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "w": rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step, rows = 0, np.arange(len(y))
    for epoch in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), 128):
            part = rows[lo : lo + 128]
            lengths = bounds[part + 1] - bounds[part]
            at = np.repeat(bounds[part] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            text, count = np.repeat(np.arange(len(part)), lengths), (packed[at] & np.uint32(0xFFFF)).astype(np.float32)
            own, weight = packed[at] >> np.uint32(16), count * np.float32(SCALE) / np.bincount(text, count, len(part))[text].astype(np.float32)
            used, back = np.unique(own, return_inverse=True)
            _, grad = gradients(params["e"][used], params["w"], params["b"], text, back, weight, y[part])
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k, g in grad.items():
                spot = used if k == "e" else slice(None)
                first[k][spot] = 0.9 * first[k][spot] + 0.1 * g
                second[k][spot] = 0.999 * second[k][spot] + 0.001 * g * g
                params[k][spot] -= rate * (first[k][spot] / (1 - 0.9**step)) / (np.sqrt(second[k][spot] / (1 - 0.999**step)) + 1e-8)
    odds = params["w"][:, 1] - params["w"][:, 0]
    return np.append(SCALE * (params["e"] @ odds), params["b"][1] - params["b"][0]).astype(np.float64)


def _score(table: np.ndarray | None, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if table is None:
        return np.zeros(len(offs) - 1)
    bucket, text = subwords(buf, offs)
    n = np.bincount(text, minlength=len(offs) - 1)
    mean = np.bincount(text, table[bucket], len(offs) - 1) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(mean + table[-1], -700, 700)))


def scored(docs: DataFrame, table: np.ndarray | None) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, and the probability of label 1."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows, at = carried(docs)

    def run(batches):
        for b in batches:
            buf, offs = flat(carried_text(b, at))
            score = [_score(shared.value, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs, SLICE)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["row", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic."""
    return scored(docs, fit(docs, labels)).where("score < 0.5").select("row.*")
