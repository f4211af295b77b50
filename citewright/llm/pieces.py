"""SentencePiece encoding and decoding of whole batches with numpy.

A batch is cut into units, a run of blanks and the word behind it; pieces never reach from one
unit into the next. Distinct units of equal length advance together through a Viterbi pass:
at every byte, hashes of the substrings that end there probe the sorted keys of the pieces, candidates are
ranked, and a vectorised maximum stores how far back the best one starts.

For a model of kind ``unigram`` the rank is the usual sum of piece scores. The models of kind
``bpe`` define another segmentation, by merges in order of score. For these the maximum runs over
candidates that byte-pair encoding would leave standing behind the last piece before them: two
neighbours are compatible when encoding their concatenation gives just them, and of the
candidates at a place exactly one is compatible, which makes the pass exact. Compatibility of a pair of
pieces is worked out once per worker and looked up from then on. Units with several leading blanks, where equal scores
meet, units with any leftover and units beyond LONG bytes, which have hardly any equals to advance with, are merged directly, by
a heap of neighbours: n log n in their bytes.

Characters outside the vocabulary become byte pieces. Decoding concatenates pieces, so texts
come back whole, except that a U+2581 sign becomes a blank, as the format has it.

Defined cases: null and empty texts have no pieces; repeated rows are encoded alike; long
texts and long words are encoded whole; an empty table gives an empty result; other columns
are kept by ``encode`` and ignored by the query.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import bound_batches, carried, carried_text, chunks, flat, prefix_hashes, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_KEY = 1 << 30
BATCH = 1 << 21
LONG = 1 << 10  # bytes of a unit from which on merges by a heap are faster than a pass of its own


class Model:
    """Pieces of a model file as sorted hashes, with scores; blanks stand for the U+2581 sign."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.kind, n = kind, sp.get_piece_size()
        self.bytes_ = np.zeros(256, np.int32)
        self.text: list[bytes] = []
        self.rank: dict[bytes, float] = {}
        self.ids: dict[bytes, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                key = piece.replace("▁", " ").encode()
                self.text.append(key)
                self.rank[key], self.ids[key] = sp.get_score(i), i
        own = [k for k in self.rank if kind != "bpe" or self.merge(k) == [self.ids[k]]]
        sizes = np.array([len(k) for k in own])
        ends = np.cumsum(sizes)
        hashes = span_hashes(prefix_hashes(np.frombuffer(b"".join(own), np.uint8)), ends - sizes, ends)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.key_ids = np.array([self.ids[k] for k in own], np.int64)[order]
        self.key_scores = np.array([self.rank[k] for k in own])[order]
        self.longest = int(sizes.max())
        self.maybe = np.zeros(1 << 20, bool)  # which hashes can be keys, by their top 20 bits
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        inside = np.zeros(256, bool)
        for k in self.rank:
            inside[list(k)] = True
        self.breaks = ~inside & (np.arange(256) < 128)
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.pool_ends = np.append(0, np.cumsum([len(x) for x in self.text]))

    def merge(self, text: bytes) -> list[int]:
        """Byte-pair encoding by merges: the best-scored neighbours first, the leftmost of equals."""
        ends = [i for i in range(1, len(text)) if text[i] & 0xC0 != 0x80] + [len(text)]
        begins = [0, *ends[:-1]]
        n = len(ends)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for k in range(n - 1):
            score = rank.get(text[begins[k] : ends[k + 1]])
            if score is not None:
                heap.append((-score, k, ends[k + 1]))
        heapify(heap)
        alive = [True] * n
        while heap:
            _, k, end = heappop(heap)
            r = after[k]
            if not alive[k] or r >= n or ends[r] != end or ends[k] == end:
                continue  # one of the two has been merged since
            ends[k], alive[r], after[k] = end, False, after[r]
            if after[r] < n:
                before[after[r]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if right < n:
                    score = rank.get(text[begins[left] : ends[right]])
                    if score is not None:
                        heappush(heap, (-score, left, ends[right]))
        out: list[int] = []
        k = 0
        while k < n:
            part = text[begins[k] : ends[k]]
            if part in self.ids:
                out.append(self.ids[part])
            else:
                out += self.bytes_[list(part)].tolist()
            k = after[k]
        return out


class Encoder:
    """Encodes units; remembers which pairs of pieces are compatible."""

    def __init__(self, model: Model):
        self.m = model
        self.pairs: dict[int, bool] = {}
        self.slots = np.full(1 << 21, -1, np.int64)
        self.good = np.zeros(1 << 21, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int64(1 << 31) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        miss = self.slots[slot] != key
        out = self.good[slot]
        if miss.any():
            kinds, back = np.unique(key[miss], return_inverse=True)
            fresh = np.array([self._pair(k) for k in kinds.tolist()], bool)
            out[miss] = fresh[back]
            at = (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
            self.slots[at], self.good[at] = kinds, fresh
            # of kinds with one slot the last one holds it, in both arrays alike
        return out

    def _pair(self, key: int) -> bool:
        found = self.pairs.get(key)
        if found is None:
            a, b = key >> 31, key & ((1 << 31) - 1)
            found = a >= UNKNOWN_KEY or b >= UNKNOWN_KEY or self.m.merge(self.m.text[a] + self.m.text[b]) == [a, b]
            if len(self.pairs) < 1 << 18:
                self.pairs[key] = found
        return found

    def units(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units end to end, and their count per unit."""
        ids: list[np.ndarray | None] = [None] * len(start)
        sums = prefix_hashes(buf)
        width = (buf < 0x80) * 1 + (buf >> 5 == 6) * 2 + (buf >> 4 == 14) * 3 + (buf >> 3 == 30) * 4  # 0 inside a character
        own = (size >= 2) & (buf[start] == 32) & (buf[np.minimum(start + 1, len(buf) - 1)] == 32) if self.m.kind == "bpe" else np.zeros(len(start), bool)
        if self.m.kind == "bpe":
            own |= size > LONG
        for k in np.flatnonzero(own).tolist():
            ids[k] = np.array(self.m.merge(buf[start[k] : start[k] + size[k]].tobytes()))
        # lengths over 48 share a pass with lengths up to a quarter more
        bucket = np.where(size <= 48, size, (48 * 1.25 ** np.ceil(np.log(np.maximum(size, 48) / 48) / np.log(1.25))).astype(np.int64))
        left = np.flatnonzero(~own)
        left = left[np.argsort(bucket[left], kind="stable")]
        cuts = np.flatnonzero(np.append(True, bucket[left][1:] != bucket[left][:-1])) if len(left) else []
        out_at, out_ids, out_counts = [], [], []
        for c, lo in enumerate(cuts):
            hi = cuts[c + 1] if c + 1 < len(cuts) else len(left)
            step = min(1 << 15, max(1, (1 << 20) // int(bucket[left[lo]] + 1)))
            for a in range(lo, hi, step):
                at = left[a : min(hi, a + step)]
                got, counts, done = self._advance(buf, sums, width, start[at], size[at])
                for k in at[~done].tolist():
                    ids[k] = np.array(self.m.merge(buf[start[k] : start[k] + size[k]].tobytes()))
                out_at.append(at[done])
                out_ids.append(got)
                out_counts.append(counts)
        single = [k for k, x in enumerate(ids) if x is not None]
        out_at.append(np.array(single, np.int64))
        out_ids.append(np.concatenate([ids[k] for k in single]) if single else np.zeros(0, np.int64))
        out_counts.append(np.array([len(ids[k]) for k in single], np.int64))
        at, flat_ids, counts = np.concatenate(out_at), np.concatenate(out_ids), np.concatenate(out_counts)
        begin = np.cumsum(counts) - counts
        back = np.empty(len(start), np.int64)
        back[at] = np.arange(len(at))
        return flat_ids[_ragged(begin[back], counts[back])], counts[back]

    def _advance(self, buf, sums, width, start, size):
        """The Viterbi pass over units of about equal length."""
        m, n, top = self.m, len(start), int(size.max())
        last = np.full((top + 1, n), -1, np.int64)  # id of the last piece of the best path to here; -1 none
        back = np.zeros((top + 1, n), np.int16 if top < 1 << 15 else np.int32)
        score = np.full((top + 1, n), -np.inf)
        score[0] = 0
        rows = np.arange(n)
        edge = np.zeros((top + 1, n), bool)  # whether a character starts here
        for e in range(top):
            edge[e] = width[np.minimum(start + e, len(buf) - 1)] > 0
        edge[top] = True
        for e in range(1, top + 1):
            live = rows[(size >= e) & (edge[e] | (size == e))]
            if not len(live):
                continue
            lengths = np.arange(min(e, m.longest), 0, -1)
            end = (start[live] + e)[:, None]
            begin = end - lengths
            h = span_hashes(sums, begin, np.broadcast_to(end, begin.shape))
            ok = m.maybe[(h >> np.uint64(44)).astype(np.int64)]
            r, c = np.nonzero(ok)
            at = np.minimum(np.searchsorted(m.keys, h[r, c]), len(m.keys) - 1)
            hit = m.keys[at] == h[r, c]
            r, c, at = r[hit], c[hit], at[hit]
            before = e - lengths[c]
            unit = live[r]
            open_ = (before == 0) | (last[before, unit] >= 0)
            r, c, at, before, unit = r[open_], c[open_], at[open_], before[open_], unit[open_]
            ids = m.key_ids[at]
            if m.kind == "bpe":
                fine = before == 0
                rest = np.flatnonzero(~fine)
                fine[rest] = self.compatible(last[before[rest], unit[rest]], ids[rest])
                rank = np.where(fine, 1.0, -np.inf)
            else:
                rank = score[before, unit] + m.key_scores[at]
            # a character without a piece: only where no piece matches it alone
            for w in range(1, 5):
                if w > e:
                    break
                lone = live[width[start[live] + e - w] == w]
                if not len(lone):
                    continue
                alone = np.zeros(n, bool)
                alone[unit[before == e - w]] = True
                lone = lone[~alone[lone] & ((e == w) | (last[e - w, lone] >= 0))]
                if len(lone):
                    unit, before = np.append(unit, lone), np.append(before, np.full(len(lone), e - w))
                    ids = np.append(ids, np.full(len(lone), UNKNOWN_KEY))
                    rank = np.append(rank, np.ones(len(lone)) if m.kind == "bpe" else score[e - w, lone] - 1e6)
            if not len(unit):
                continue
            order = np.lexsort((rank, unit))
            best = order[np.append(unit[order][1:] != unit[order][:-1], True)]
            best = best[rank[best] > -np.inf]
            u = unit[best]
            last[e, u], back[e, u], score[e, u] = ids[best], e - before[best], rank[best]
        # paths are read from their ends
        at, reached = size.copy(), last[size, rows] >= 0
        got_unit, got_id, got_at = [], [], []
        active = rows[reached]
        while len(active):
            e = at[active]
            got_unit.append(active)
            got_id.append(last[e, active])
            got_at.append(e)
            at[active] = e - back[e, active]
            active = active[at[active] > 0]
        done = np.flatnonzero(reached)
        if not len(done):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), reached
        unit, ids, end = np.concatenate(got_unit), np.concatenate(got_id), np.concatenate(got_at)
        order = np.lexsort((end, unit))
        unit, ids, end = unit[order], ids[order], end[order]
        lone = ids == UNKNOWN_KEY
        if lone.any():  # the bytes of each unknown character
            wide = np.where(lone, back[end, unit], 1).astype(np.int64)
            spread = np.repeat(np.arange(len(ids)), wide)
            offset = np.arange(len(spread)) - np.repeat(np.cumsum(wide) - wide, wide)
            place = start[unit[spread]] + end[spread] - wide[spread] + offset
            ids = np.where(lone[spread], m.bytes_[buf[np.minimum(place, len(buf) - 1)]], ids[spread])
            unit = unit[spread]
        return ids, np.bincount(unit, minlength=n)[done], reached


def _ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [begin, begin + count) end to end."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode_batch(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and their count per text."""
    m = encoder.m
    buf, offs = flat(texts)
    buf, offs = _blanked(buf, offs)
    n = len(offs) - 1
    sizes = np.diff(offs)
    full = sizes > 0
    ends = np.cumsum(sizes + full)  # every text that isn't empty starts with a blank
    text = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(np.cumsum(full), sizes)] = buf
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    first = ends - sizes - full
    blank, stop = text == 32, m.breaks[text]
    head = np.append(True, (blank[1:] & ~blank[:-1]) | stop[1:] | stop[:-1])
    head[first[full]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(text))
    hashes = span_hashes(prefix_hashes(text), start, end)
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    kind_start, kind_size = start[at], (end - start)[at]
    own_end = np.cumsum(kind_size)
    compact = text[_ragged(kind_start, kind_size)]
    ids, counts = encoder.units(compact, own_end - kind_size, kind_size)
    begin = np.cumsum(counts) - counts
    per_unit = counts[back]
    doc = np.searchsorted(first[full], start, "right") - 1
    out_counts = np.zeros(n, np.int64)
    out_counts[full] = np.bincount(doc, per_unit, int(full.sum())).astype(np.int64)
    return ids[_ragged(begin[back], per_unit)], out_counts


def _blanked(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U+2581 signs replaced by blanks."""
    if len(buf) < 3:
        return buf, offs
    sign = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
    if not len(sign):
        return buf, offs
    keep = np.ones(len(buf), bool)
    keep[sign + 1] = keep[sign + 2] = False
    buf = buf.copy()
    buf[sign] = 32
    return buf[keep], np.append(0, np.cumsum(keep))[offs]


def decode_batch(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    sizes = np.diff(model.pool_ends)[ids]
    text = model.pool[_ragged(model.pool_ends[ids], sizes)].tobytes()
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
    return [text[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _encoders(shared):
    """One encoder a worker process: what it has learnt of pairs serves later batches."""
    global _ENCODER
    if _ENCODER is None or _ENCODER[0] != shared.value.path_key:
        _ENCODER = (shared.value.path_key, Encoder(shared.value))
    return _ENCODER[1]


_ENCODER: tuple | None = None


def _parts(b: pa.RecordBatch, at: int):
    """Slices of a batch with about BATCH bytes of text."""
    _, offs = flat(carried_text(b, at))
    for i, j in chunks(offs, BATCH):
        yield b.slice(i, j - i)


def encode(docs: DataFrame, model_path: str = MODEL, kind: str = "bpe", text: str = "text", into: str = "pieces") -> DataFrame:
    """All columns of ``docs`` and the piece ids of ``text``, as array<int> ``into`` (replacing one of that name)."""
    shared = _shared(docs, model_path, kind)
    rows, at = carried(docs, text)

    def run(batches):
        for b in batches:
            for part in _parts(b, at):
                ids, counts = encode_batch(_encoders(shared), carried_text(part, at))
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", "found"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("found", ArrayType(IntegerType()))]))
    return out.select(*_others(docs, into), F.col("found").alias(into))


def decode(encoded: DataFrame, model_path: str = MODEL, kind: str = "bpe", pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of its piece ids; a null list is an empty text."""
    shared = _shared(encoded, model_path, kind)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = decode_batch(shared.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "found"])

    rows = encoded.select(F.struct("*").alias("row"), F.col(pieces).alias("pieces"))
    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("found", StringType())]))
    return out.select(*_others(encoded, into), F.col("found").alias(into))


def _others(df: DataFrame, into: str) -> list:
    return [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != into.lower()]


def _shared(docs: DataFrame, path: str, kind: str):
    """The model, of the fixed size of its vocabulary, for the executors."""
    bound_batches(docs.sparkSession)
    model = Model(path, kind)
    model.path_key = f"{kind}:{path}"
    return docs.sparkSession.sparkContext.broadcast(model)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (ids as 32-bit little-endian numbers), decoded_sha256, and whether the text came back."""
    shared = _shared(docs, MODEL, "bpe")

    def run(batches):
        for b in batches:
            for part in _parts(b, -1):
                ids, counts = encode_batch(_encoders(shared), part.column(1))
                texts = decode_batch(shared.value, ids, counts)
                bounds, numbers = np.append(0, np.cumsum(counts)), ids.astype("<i4")
                digests = [sha256(numbers[lo:hi].tobytes()).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                same = [x == (y.as_py() or "").replace("▁", " ") for x, y in zip(texts, part.column(1), strict=True)]
                decoded = [sha256(x.encode()).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, same boolean")
