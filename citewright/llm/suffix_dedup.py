"""Removal of long repeated passages with run-length compressed indexes.

Bytes are removed that a 50-byte string covers which also starts in a document with a
smaller id. Every 50-byte window is dealt by its anchor, the least of its 33 hashed 18-byte
substrings; equal windows have equal anchors, so anchors choose the shards and nothing else. Consecutive windows with one anchor are
a segment of at most 82 bytes.

0. Texts that a smaller document has as a whole (by SHA-256) go whole, and take no part in the following.
1. Anchors that two documents share are found by one shuffle. A task sends an anchor once,
   however many of its documents hold it; those it has seen in two documents itself are known
   to be shared and are dealt by document instead. Anchors that many documents share are cut once more, by the least of the
   windows' substrings under another hash, so that a common phrase is spread over the contexts it stands in.
2. Documents meet their shared anchors and cut out the segments, which are dealt by anchor with their bytes. A segment
   whose bytes a smaller document of the same batch has is a repeat, and is told so without being dealt.
3. A task takes the distinct segments of a shard in order of document and builds their Burrows-Wheeler transform, kept
   as runs. Where the rows that agree on 50 bytes lie in one run and step to just such rows, the window before is held by the same
   documents; so the first document is sampled only where runs end within such rows or begin anew. Matching
   statistics are streamed through the index: all segments step backwards together by LF over the runs, and
   the sample met last tells the first document that holds the window.
4. The covered spans of a document are merged, and its remaining bytes digested.

Defined cases: null counts as empty; texts under 50 bytes lose nothing; rows of equal doc_id don't
remove from each other, and where their texts differ, ``part`` (a hash of the text, else 0) tells whose spans are whose; a null doc_id neither removes nor loses bytes; an empty table gives an
empty result; long texts are processed whole; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, chunks, flat, mix, powers, prefix_hashes, span_hashes, stage

LENGTH = 50
KMER = 18
_WINDOW = LENGTH - KMER + 1
BLOCK = 1 << 18  # half the bytes of the segments of an index: run ends then stay in a core's cache
BROADCAST_ROWS = 1 << 19
HEAVY = 1 << 11  # rows of a shared anchor from which on its segments are cut once more
_LOW = np.uint64(63)


def cut_segments(buf: np.ndarray, offs: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (int64), first and end byte of every segment, in order."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none
    sums = prefix_hashes(buf)
    _, down = powers(len(sums))
    n = len(buf) - KMER + 1
    key = mix((sums[KMER:] - sums[:-KMER]) * down[:n] + np.uint64(seed))
    # the lowest bits hold the position, so that the least key tells where its anchor is
    key = (key & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW)
    span = 1
    while span * 2 <= _WINDOW:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    least = np.minimum(key[: len(buf) - LENGTH + 1], key[_WINDOW - span : _WINDOW - span + len(buf) - LENGTH + 1])
    inside = np.ones(len(least), bool)
    for end in offs[1:-1]:  # windows that would cross from one text to the next
        inside[max(0, end - LENGTH + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none
    place = at + ((least[at] - at.astype(np.uint64)) & _LOW).astype(np.int64)
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    last = np.append(head[1:], len(at)) - 1
    return (least[at[head]] & ~_LOW).view(np.int64), at[head], at[last] + LENGTH


def _cut_again(buf: np.ndarray, offs: np.ndarray, anchor: np.ndarray, start: np.ndarray, end: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments, those of ``heavy`` anchors cut where the anchors under another hash change."""
    other, first, last = cut_segments(buf, offs, 1)
    # both cuts hold the same windows in the same order: a window's segment is the last that starts at or before it
    sizes = end - start - LENGTH + 1
    mine = np.repeat(np.arange(len(start)), sizes)
    window = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[mine]
    theirs = np.searchsorted(first, window, "right") - 1
    head = np.append(True, (mine[1:] != mine[:-1]) | (heavy[mine[1:]] & (theirs[1:] != theirs[:-1])))[: len(mine)]
    at = np.flatnonzero(head)
    upto = np.append(at[1:], len(mine)) - 1
    both = (mix(anchor[mine[at]].view(np.uint64) ^ mix(other[theirs[at]].view(np.uint64))) & ~_LOW).view(np.int64)
    return np.where(heavy[mine[at]], both, anchor[mine[at]]), window[at], window[upto] + LENGTH


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by anchor, those of kind 2 by document. An anchor's low bits hold the kind of its row."""
    return rows.repartition(F.when(F.expr("anchor & 3 = 2"), F.col("doc_id")).otherwise(F.expr("shiftright(anchor, 6)")))


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id), of kind 0 from the only document of a task, 1 from one of several, 2 known shared."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hashes, owners = [], []
            buf, offs = flat(b.column(1))
            for i, j in chunks(offs):
                own = offs[i : j + 1] - offs[i]
                anchor, start, _ = cut_segments(buf[offs[i] : offs[j]], own)
                hashes.append(anchor)
                owners.append(ids[i + np.searchsorted(own, start, "right") - 1])
            if not hashes:
                continue
            h, d = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
            h, d = h[new], d[new]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            count = np.diff(np.append(head, len(h)))
            known = np.repeat(count > 1, count)
            out = np.concatenate([h[head] | (count > 1), h[known] | 2]), np.concatenate([d[head], d[known]])
            order = np.argsort(out[1], kind="stable")  # rows of one document together compress better
            yield _batch("anchor doc_id", out[0][order], out[1][order])

    rows = docs.where("doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(run, "anchor long, doc_id long")


def _groups(batches, key: int, low: int = 0):
    """Tables of whole groups: what follows the last change of column ``key`` (but for its ``low``
    lowest bits) waits for the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        k = t.column(key).to_numpy() >> low
        change = np.flatnonzero(k[1:] != k[:-1])
        if not t.num_rows:
            continue
        if len(change):
            yield t.slice(0, int(change[-1]) + 1)
            held = t.slice(int(change[-1]) + 1).combine_chunks()
        else:
            held = t
    if held is not None and held.num_rows:
        yield held


def _shared(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor): the anchors of each document that others may share."""

    def run(batches):
        for t in _groups(batches, 0, 6):
            h, d = (t.column(i).to_numpy() for i in range(2))
            h, kind = h & ~np.int64(63), h & 3
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            count = np.diff(np.append(head, len(h)))
            several = np.add.reduceat((kind < 2).astype(np.int64), head) > 1
            some = np.maximum.reduceat((kind == 1).astype(np.int64), head) > 0
            keep = (np.repeat(several | some, count) & (kind == 0)) | (kind == 2)
            yield _batch("doc_id anchor", d[keep], h[keep])

    rows = _dealt(_anchors(docs)).sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "doc_id long, anchor long")


def _segments(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, doc_id, part, start, size, segment): the shared segments with their bytes, of kind 0; of kind 2, without, the spans of those
    whose bytes a smaller document of the batch has. An odd anchor is a heavy one."""

    def run(batches):
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))))
            ids, parts, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False), b.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            named = _of_row(values & ~np.int64(63), np.repeat(np.arange(b.num_rows), np.diff(bounds)))
            odd = values & 1 == 1
            buf, offs = flat(b.column(1))
            found = []
            for i, j in chunks(offs):
                part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                anchor, start, end = cut_segments(part, own)
                doc = np.searchsorted(own, start, "right") - 1
                mine = slice(bounds[i], bounds[j])
                key = _of_row(anchor, i + doc)
                wanted = _among(key, named[mine])
                anchor, start, end, key = anchor[wanted], start[wanted], end[wanted], key[wanted]
                often = _among(key, named[mine][odd[mine]])
                if often.any():
                    anchor, start, end = _cut_again(part, own, anchor, start, end, often)
                doc = np.searchsorted(own, start, "right") - 1
                found.append((anchor, i + doc, span_hashes(prefix_hashes(part), start, end), offs[i] + start, end - start))
            if not found:
                continue
            anchor, doc, h, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = ids[doc]
            order = np.lexsort((owner, h, anchor))
            anchor, doc, h, begin, size, owner = (x[order] for x in (anchor, doc, h, begin, size, owner))
            head = np.append(True, (anchor[1:] != anchor[:-1]) | (h[1:] != h[:-1]))[: len(h)]
            first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))  # the same hash from the smallest document
            known = (owner > owner[first]) & (size == size[first])
            at = np.flatnonzero(known)
            known[at] = _equal(buf, begin[at], begin[first[at]], size[at])
            yield from told(buf, offs, ids, parts, anchor, doc, begin, size, known)

    def told(buf, offs, ids, parts, anchor, doc, begin, size, known):
        names = "anchor doc_id part start size segment"
        at = np.flatnonzero(known)
        at = at[np.lexsort((begin[at], doc[at]))]
        d, a, e = doc[at], begin[at], (begin + size)[at]
        # what follows on from each other is one row
        head = np.append(True, (d[1:] != d[:-1]) | (a[1:] > e[:-1]))[: len(at)]
        lo = np.flatnonzero(head)
        hi = np.append(lo[1:], len(at))[: len(lo)] - 1
        yield _batch(names, np.full(len(lo), 2), ids[d[lo]], parts[d[lo]], a[lo] - offs[d[lo]], e[hi] - a[lo], pa.nulls(len(lo), pa.binary()))
        at = np.flatnonzero(~known)
        at = at[np.argsort(doc[at], kind="stable")]
        anchor, doc, begin, size = anchor[at], doc[at], begin[at], size[at]
        for lo in range(0, len(at), 1 << 15):
            own = slice(lo, lo + (1 << 15))
            ends = np.append(0, np.cumsum(size[own]))
            spot = np.repeat(begin[own] - ends[:-1], size[own]) + np.arange(int(ends[-1]))
            cut = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(buf[spot].tobytes())])
            yield _batch(names, anchor[own], ids[doc[own]], parts[doc[own]], begin[own] - offs[doc[own]], size[own], cut)

    rows = docs.join(anchors, "doc_id", "left").select("doc_id", "text", "anchors", "part")
    return rows.mapInArrow(run, "anchor long, doc_id long, part long, start long, size long, segment binary")


def _of_row(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for an anchor in a row. Should two agree by chance, a segment more goes to its shard."""
    return mix(anchor.view(np.uint64) ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _among(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(key), bool)
    some = np.sort(some)
    return some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of the spans at a and at b agree."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 15):
        n = size[lo : lo + (1 << 15)]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        same = buf[np.repeat(a[lo : lo + len(n)], n) + step] == buf[np.repeat(b[lo : lo + len(n)], n) + step]
        out[lo : lo + len(n)] = np.logical_and.reduceat(same, ends - n)
    return out


class RunIndex:
    """Run-length Burrows-Wheeler index of segments that are in order of document."""

    def __init__(self, segments: list[bytes], docs: np.ndarray):
        self.docs, self.sizes = docs, np.array([len(x) for x in segments])
        ends = np.cumsum(self.sizes + 1) - 1
        text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it ends a segment and sorts first
        n = len(text)
        owner = np.repeat(np.arange(len(segments)), self.sizes + 1)
        left = ends[owner] - np.arange(n)
        order, ranks = self._sorted(text, left, n)
        # rows whose suffixes agree on 50 bytes: 32 and the 32 that start 18 later
        depth = np.where(left >= LENGTH, ranks * np.int64(n) + np.append(ranks[LENGTH - 32 :], np.zeros(LENGTH - 32, np.int64)), -1 - np.arange(n))
        depth = depth[order]
        bwt = text[order - 1]
        self.start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.head = bwt[self.start]
        length = np.diff(np.append(self.start, n))
        by_char = np.argsort(self.head, kind="stable")
        self.base = np.empty(len(self.start), np.int64)
        self.base[by_char] = np.cumsum(length[by_char]) - length[by_char]
        # groups of rows that agree on 50 bytes, and the first document of each
        group = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
        end = np.append(group[1:], n)
        first_doc = np.minimum.reduceat(docs[owner[order]], group)
        whole = depth[group] >= 0
        # a group in one run that steps to just such a group hands its first document on; the others are sampled
        run = np.searchsorted(self.start, group, "right")
        one = whole & (run == np.searchsorted(self.start, end - 1, "right")) & (self.head[run - 1] > 0)
        low = self.step(group[one])
        to = np.searchsorted(group, low, "right") - 1
        just = (group[to] == low) & (end[to] == low + (end - group)[one]) & whole[to]
        sampled = whole.copy()
        sampled[to[just]] = False
        self.sample_first, self.sample_end, self.sample_doc = group[sampled], end[sampled], first_doc[sampled]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, each up to the end of its segment, and their ranks by 32 bytes."""
        key = np.zeros(n, np.uint64)
        padded = np.append(text, np.zeros(8, np.uint8))
        for j in range(8):
            key = (key << np.uint64(8)) | np.where(left >= j, padded[j : j + n], 0).astype(np.uint64)
        rank, ranks = _dense(key), None
        step, longest = 8, int(left.max()) + 1
        while step < longest:
            if step == 32:
                ranks = rank
            later = np.append(rank[step:], np.zeros(min(step, n), np.int64))[:n]
            rank = _dense(rank * np.int64(n + 1) + np.where(left >= step, later + 1, 0))
            step *= 2
        return np.argsort(rank * np.int64(n) + np.arange(n)), ranks if ranks is not None else rank

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: rows of the suffixes one byte longer."""
        run = np.searchsorted(self.start, rows, "right") - 1
        return self.base[run] + rows - self.start[run]

    def stream(self) -> np.ndarray:
        """(segment, window) pairs, one row each, that a document before the segment's holds."""
        rows, alive, found = np.arange(len(self.docs)), np.arange(len(self.docs)), []
        first = np.full(len(self.docs), np.iinfo(np.int64).max)
        for length in range(1, int(self.sizes.max()) + 1):
            more = self.sizes[alive] >= length
            alive, rows, first = alive[more], self.step(rows[more]), first[more]
            if length >= LENGTH and len(self.sample_first):
                at = np.searchsorted(self.sample_first, rows, "right") - 1
                first = np.where((at >= 0) & (rows < self.sample_end[at]), self.sample_doc[at], first)
                hit = first < self.docs[alive]
                found.append(np.stack([alive[hit], self.sizes[alive[hit]] - length], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    sorted_ = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(0, (sorted_[1:] != sorted_[:-1]).astype(np.int64)))
    return out


def repeated_spans(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, segment: list[bytes], part: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, part, first, end) of the spans that smaller documents hold, for whole anchor groups."""
    least: dict[bytes, int] = {}
    for x, d in zip(segment, doc.tolist(), strict=True):
        if least.get(x, d) >= d:
            least[x] = d
    size = np.array([len(x) for x in segment])
    own = np.array([least[x] == d for x, d in zip(segment, doc.tolist(), strict=True)])
    out = [(doc[~own], part[~own], start[~own], (start + size)[~own])]
    # distinct segments, of anchors that have several
    at = {}
    for k in np.flatnonzero(own).tolist():
        at.setdefault(segment[k], []).append(k)
    keys = list(at)
    group = anchor[[at[x][0] for x in keys]]
    _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
    keys = [x for x, c in zip(keys, count[inverse], strict=True) if c > 1]
    if keys:
        owner = np.array([least[x] for x in keys])
        order = np.argsort(owner, kind="stable")
        keys = [keys[k] for k in order]
        hits = RunIndex(keys, owner[order]).stream()
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        if len(hits):
            head = np.append(True, (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1))
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(hits)) - 1
            rows = [(k, lo, hi + LENGTH) for s, lo, hi in zip(hits[first, 0], hits[first, 1], hits[last, 1], strict=True) for k in at[keys[s]]]
            k, lo, hi = (np.array(x) for x in zip(*rows, strict=True))
            out.append((doc[k], part[k], start[k] + lo, start[k] + hi))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<part, a, b>>) of bytes to remove, possibly overlapping."""

    def run(batches):
        waiting, size, spans = [], 0, []

        def done():
            t = pa.concat_tables(waiting)
            anchor, doc, part, start = (t.column(i).to_numpy() for i in range(4))
            return _batch("doc_id part a b", *repeated_spans(anchor, doc, start, t.column(5).to_pylist(), part))

        def unknown():
            for b in batches:
                known = b.column(0).to_numpy() == 2
                if known.any():
                    own = b.filter(pa.array(known))
                    start = own.column(3).to_numpy()
                    spans.append(_batch("doc_id part a b", own.column(1), own.column(2), start, start + own.column(4).to_numpy()))
                yield b.filter(pa.array(~known))

        for t in _groups(unknown(), 0):
            while spans:
                yield spans.pop()
            for part in _slices(t):
                waiting.append(part)
                size += part.nbytes
                if size >= 2 * BLOCK:
                    yield done()
                    waiting, size = [], 0
        yield from spans
        if waiting:
            yield done()

    anchors = stage(_shared(docs), "anchors")
    heavy = stage(anchors.groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") >= HEAVY).select("anchor", F.lit(1).alias("bit")), "heavy")
    lists = anchors.join(heavy, "anchor", "left").groupBy("doc_id").agg(F.collect_list(F.col("anchor") + F.coalesce("bit", F.lit(0))).alias("anchors"))
    found = _dealt(_segments(docs, lists)).sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, part long, a long, b long")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("part", "a", "b")).alias("spans"))


def _slices(t: pa.Table):
    """Parts of about BLOCK bytes that end where an anchor ends."""
    k = t.column(0).to_numpy()
    rows = max(1, int(t.num_rows * BLOCK / max(1, t.nbytes)))
    lo = 0
    while lo < t.num_rows:
        hi = min(t.num_rows, lo + rows)
        while hi < t.num_rows and k[hi] == k[hi - 1]:
            hi += 1
        yield t.slice(lo, hi - lo)
        lo = hi


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, n_bytes) of texts that a smaller document has too: all of their bytes go."""
    rows = docs.where("doc_id is not null").select("doc_id", _sha(), F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= LENGTH)
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    return rows.join(first, "sha").where("doc_id > first").select("doc_id", "sha", "n_bytes")


def _sha():
    return F.unhex(F.sha2("text", 256)).alias("sha")


def _with_parts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``part``: the hash of the text for ids that have several texts in ``docs``, else 0."""
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = stage(texts.where("low <> high").select(F.col("doc_id").alias("_r")), "several")
    n = several.count()
    if not n:
        return rows.withColumn("part", F.lit(0).cast("long"))
    found = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, F.col("doc_id") == F.col("_r"), "left")
    return found.withColumn("part", F.when(F.col("_r").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))).drop("_r")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""

    def run(batches):
        for b in batches:
            buf, offs = flat(b.column(1))
            removed, spans, digests, kept = [], [], [], []
            parts = b.column(3).to_numpy(zero_copy_only=False)
            for i, own in enumerate(b.column(2)):
                text = buf[offs[i] : offs[i + 1]]
                if own.is_valid:
                    change = np.zeros(len(text) + 1, np.int32)
                    part, lo, hi = (own.values.field(k).to_numpy() for k in range(3))
                    mine = part == parts[i]  # the others are of another text of the id
                    np.add.at(change, lo[mine], 1)
                    np.add.at(change, hi[mine], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    spans.append(0)
                removed.append(int(offs[i + 1] - offs[i] - len(text)))
                kept.append(text.tobytes())
                digests.append(sha256(kept[-1]).hexdigest())
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256 kept", b.column(0), np.diff(offs), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()))

    bound_batches(docs.sparkSession, 4 * BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies = stage(exact_copies(docs), "copies")
    few = copies.count() <= BROADCAST_ROWS  # beyond it, the anti-join is a shuffled one
    gone = copies.select(F.col("doc_id").alias("_d"), F.col("sha").alias("_s"))
    rest = docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("_d")) & (_sha() == F.col("_s")), "left_anti")
    rest = _with_parts(rest, docs)
    rows = rest.join(covered_spans(rest), "doc_id", "left").select("doc_id", "text", "spans", "part")
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    empty = F.lit(sha256(b"").hexdigest())
    return out.union(copies.select("doc_id", "n_bytes", "n_bytes", F.lit(1).cast("long"), empty, F.lit(b"").cast("binary")))
