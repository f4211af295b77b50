"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, looked up by every
window of every document; bytes decide on each hit, and the hit spans or the documents go.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased; a window is ``WINDOW``
consecutive words of an item, or all words of an item that has fewer. A word of a document is hit inside any
occurrence of a window; windows never cross documents.

The hash set is broadcast behind a check of the benchmark's bytes: up to ``SHARD_BYTES`` it is one set, and finding is
a map without shuffle. A larger benchmark is dealt into shards by hash, and the documents, staged between
rounds, meet one shard a round: what a task holds stays bounded, and no window is left out. (An item longer
than a shard is one shard's alone.) Hashes only propose: windows of a set that share a hash and differ in bytes
are held in tables of their own.

Null and empty texts, of documents and of items, have no words and hit nothing. Repeated documents are
answered row by row, null ids included. Rows of one item_id are one item; a null item_id is written as an
empty string. An empty benchmark hits nothing. Columns of the documents keep their names whatever they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, bound_batches, chunks, flat, lower, prefix_hashes, powers, span_hashes, stage, word_spans

WINDOW = 10
SHARD_BYTES = 1 << 24  # of benchmark text in one broadcast set, which takes about six times as much
EXPAND = 1 << 22  # pairs of window and item that are held at once
_GAP = np.zeros(256, bool)
_GAP[:0x30] = _GAP[0x3A:0x61] = _GAP[0x7B:0x80] = True


class Words:
    """The words of texts that lie end to end: bytes (lower-cased), start, end, hash, and how many each text has."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offs = flat(texts)
        self.buf = lower(self.raw)
        start, end, hashes = [], [], []
        for i, j in self._pieces():
            inner = self.offs[(self.offs > i) & (self.offs < j)]
            s, e, _ = word_spans(self.buf[i:j], np.concatenate([[0], inner - i, [j - i]]), _GAP)
            hashes.append(span_hashes(prefix_hashes(self.buf[i:j]), s, e))
            start.append(s + i)
            end.append(e + i)
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *start]), np.concatenate([none, *end])
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])
        self.counts = np.diff(np.searchsorted(self.start, self.offs))
        self.sums = np.zeros(len(self.hash) + 1, np.uint64)
        up, _ = powers(len(self.hash) + 1)
        np.cumsum(self.hash * up[: len(self.hash)], out=self.sums[1:])

    def _pieces(self):
        """Byte ranges of about CHUNK bytes that end between words, so a long text is never widened as a whole."""
        i, n = 0, len(self.buf)
        while i < n:
            j = i + CHUNK
            while j < n:
                free = np.flatnonzero(_GAP[self.buf[j : j + CHUNK]])
                if len(free):
                    j += int(free[0])
                    break
                j += CHUNK
            yield i, min(j, n)
            i = min(j, n)

    def windows(self, length: int) -> np.ndarray:
        """First words of all windows of ``length`` words inside one text."""
        last = np.repeat(np.cumsum(self.counts), self.counts)
        return np.flatnonzero(last - np.arange(len(self.hash)) >= length)

    def hashes(self, first: np.ndarray, length: int) -> np.ndarray:
        return span_hashes(self.sums, first, first + length)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at words i of ``a`` and at words j of ``b`` agree word by word, byte by byte."""
    live = np.arange(len(i))
    for k in range(length):
        s, u = a.start[i[live] + k], b.start[j[live] + k]
        n = a.end[i[live] + k] - s
        fits = n == b.end[j[live] + k] - u
        live, s, u, n = live[fits], s[fits], u[fits], n[fits]
        if not len(live):
            break
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = a.buf[np.repeat(s, n) + step] == b.buf[np.repeat(u, n) + step]
        live = live[np.logical_and.reduceat(equal, first)]
    out = np.zeros(len(i), bool)
    out[live] = True
    return out


class WindowSet:
    """The windows of a shard of items: tables of (length, sorted hashes, a place of each in the words, items of each)."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.ids)}
        self.words = w = Words(pa.array(texts, pa.string()))
        item = np.repeat(np.array([number[x] for x in ids], np.int64), w.counts)
        text = np.repeat(np.arange(len(texts)), w.counts)
        self.tables = []
        for length in np.unique(np.minimum(w.counts[w.counts > 0], WINDOW)).tolist():
            at = w.windows(length)
            at = at if length == WINDOW else at[w.counts[text[at]] == length]
            while len(at):
                at = at[np.argsort(w.hashes(at, length), kind="stable")]
                h, first, group = np.unique(w.hashes(at, length), return_index=True, return_inverse=True)
                agree = same_words(w, at, w, at[first][group], length)
                pairs = np.unique(group[agree] * np.int64(len(self.ids)) + item[at[agree]])
                self.tables.append((length, h, at[first], np.searchsorted(pairs // len(self.ids), np.arange(len(h) + 1)), pairs % len(self.ids)))
                at = at[~agree]  # same hash, other bytes

    def find(self, docs: Words):
        """For each table: first words, length, and the table's offsets into items and items, with the windows that they hit."""
        for length, h, place, offs, items in self.tables:
            at = docs.windows(length)
            for lo in range(0, len(at), CHUNK):
                part = at[lo : lo + CHUNK]
                got = docs.hashes(part, length)
                k = np.minimum(np.searchsorted(h, got), len(h) - 1)
                hit = h[k] == got
                part, k = part[hit], k[hit]
                true = same_words(docs, part, self.words, place[k], length)
                if true.any():
                    yield part[true], length, offs, items, k[true]


def _doc_items(doc: np.ndarray, k: np.ndarray, offs: np.ndarray, items: np.ndarray, found: list[set]) -> None:
    """Add the items of the windows k to the sets of their documents; each window of a document counts once."""
    pairs = np.unique(doc * np.int64(len(offs)) + k)
    doc, k = pairs // len(offs), pairs % len(offs)
    n = offs[k + 1] - offs[k]
    upto = np.cumsum(n)
    lo = 0
    while lo < len(k):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + EXPAND, "right")))
        size = n[lo:hi]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        both = np.unique(np.repeat(doc[lo:hi], size) * np.int64(1 << 32) + items[np.repeat(offs[k[lo:hi]], size) + step])
        for d, i in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist(), strict=True):
            found[d].add(i)
        lo = hi


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(texts: pa.Array, index: WindowSet, before: list | None, cut: bool) -> tuple[list, pa.Array | None]:
    """n_words, n_hit, runs, spans, items of texts, ``before`` being (runs, items) of earlier shards; and the texts without their spans."""
    w = Words(texts)
    upto = np.concatenate([[0], np.cumsum(w.counts)])
    delta = np.zeros(len(w.hash) + 1, np.int32)
    found: list[set] = [set() for _ in range(len(texts))]
    doc_of = np.repeat(np.arange(len(texts)), w.counts)
    for first, length, offs, items, k in index.find(w):
        np.add.at(delta, first, 1)
        np.add.at(delta, first + length, -1)
        _doc_items(doc_of[first], k, offs, items, found)
    named = [{index.ids[i] for i in x} for x in found]
    for d, (runs, items) in enumerate(before or ()):
        named[d].update(items)
        for r in runs:
            delta[upto[d] + r["start"]] += 1
            delta[upto[d] + r["end"]] -= 1
    hit = np.cumsum(delta[:-1]) > 0
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[upto])
    runs, spans, texts_left = [], [], []
    for d in range(len(texts)):
        if not n_hit[d]:
            runs.append([])
            spans.append([])
            continue
        s, e = _runs(hit[upto[d] : upto[d + 1]])
        base = w.offs[d]
        raw = w.raw[base : w.offs[d + 1]]
        b0, b1 = w.start[upto[d] + s] - base, w.end[upto[d] + e - 1] - base
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        runs.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        spans.append([{"start": x, "end": y} for x, y in zip(chars[b0].tolist(), chars[b1].tolist(), strict=True)])
        if cut:
            gone = np.zeros(len(raw) + 1, np.int32)
            np.add.at(gone, b0, 1)
            np.add.at(gone, b1, -1)
            texts_left.append((d, raw[np.cumsum(gone[:-1]) == 0].tobytes().decode()))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = [pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(runs, kind), pa.array(spans, kind), pa.array([sorted(x) for x in named], pa.list_(pa.string()))]
    if not cut:
        return out, None
    kept = texts.to_pylist()
    for d, t in texts_left:
        kept[d] = t
    return out, pa.array(kept, pa.string())


def find(docs: DataFrame, benchmark: DataFrame, text: str | None = None) -> DataFrame:
    """``row`` (all columns of ``docs`` but text), n_words, n_hit, runs (hit words [start, end), by number), spans (the same in
    code points of the text), items (ids of the items with occurring windows, sorted as strings); with ``text`` also the
    texts: "whole" ones, or "cut" ones, which have the spans no more."""
    spark = docs.sparkSession
    bound_batches(spark)
    named = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*named).alias("row"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    shards = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    head = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    spans = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    for k in range(shards):
        table = (items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)).toArrow()  # a shard, by the check above
        index = spark.sparkContext.broadcast(WindowSet(table.column("item_id").to_pylist(), table.column("text").to_pylist()))
        last = k == shards - 1
        if last:
            out = T.StructType(list(head.fields)).add("n_words", "long").add("n_hit", "long").add("runs", spans).add("spans", spans).add("items", T.ArrayType(T.StringType()))
            out = out.add("text", "string") if text else out
        else:
            out = T.StructType(list(head.fields)).add("text", "string").add("runs", spans).add("items", T.ArrayType(T.StringType()))

        def run(batches, index=index, later=k > 0, last=last, names=out.names):
            for b in batches:
                for i, j in chunks(flat(b.column(1))[1]):
                    part = b.slice(i, j - i)
                    before = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) if later else None
                    found, left = _scan(part.column(1), index.value, before, last and text == "cut")
                    if last:
                        more = [left] if text == "cut" else [part.column(1)] if text else []
                        yield pa.RecordBatch.from_arrays([part.column(0), *found, *more], names=names)
                    else:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found[2], found[4]], names=names)

        rows = rows.mapInArrow(run, out)
        rows = rows if last else stage(rows, "decontaminate")
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, contaminated of every row of ``docs`` (doc_id, text)."""
    out = find(docs.select("doc_id", "text"), benchmark)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts; other texts stay as they are."""
    return _like(find(docs, benchmark, "cut"), docs)


def remove_documents(docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most`` is hit."""
    out = find(docs, benchmark, "whole")
    return _like(out.where(F.col("n_hit") <= F.col("n_words") * F.lit(most)), docs)
