"""Language-model scores by prediction by partial matching over bytes.

Pretraining counts every string of ORDER + 1 bytes (A-Z lower-cased, with a line feed before and after):
each task counts its own distinct strings, and one shuffle adds them up. All strings of the training
texts, and with them all their suffixes, are the trie: a node is a context of up to ORDER bytes, its
children the symbols seen there. No node is dropped, so the model grows with the corpus.

A symbol is coded in the longest context of the trie: with c of the T occurrences after the
context of q distinct symbols it costs -log10(c / (T + q)); else an escape costs
-log10(q / (T + q)) and the next shorter context is tried, from which the symbols of the longer one are
excluded. At the end any byte has the same share. As the trie is fixed, all of this depends on the last
ORDER + 1 bytes only, so each distinct string of the corpus, held-out rows included, is walked once. The
trie is dealt by the last two bytes of the contexts: a part holds whole all contexts of two bytes and
more that end alike, and the strings of one and two bytes, 65,792 at most, are at hand everywhere. The
finished costs of the NODES most frequent strings are broadcast as a cache, the other strings of a
row are joined with the table of costs by hash.

Words are counted exactly over all training rows for the base score: frequent ones (at most
FREQUENT) are broadcast, the rest joined by hash.

Defined cases: null counts as empty, whose only token is the end; rows of equal doc_id are
scored alone, a row without doc_id hashes as the empty string; an empty training set gives base
probabilities 1 / (V + 1) and uniform bytes; long texts count whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, flat, lower, most_frequent, stage, word_hashes

ORDER = 4
LEAST = 1  # every string counts
NODES = 1 << 19  # strings of the cache; the trie itself has no bound
FREQUENT = 1 << 19
RUN = 1 << 20  # strings walked at once
END = -1  # the end token's key among word hashes


def held_out(doc_id: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _framed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each with ORDER line feeds before it and one after."""
    n = len(offs) - 1
    sizes = np.diff(offs) + ORDER + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if n else 0, 10, np.uint8)
    at = np.arange(len(buf)) + np.repeat((ends - sizes) + ORDER - offs[:-1], np.diff(offs))
    out[at] = lower(buf)
    return out, np.append(0, ends)


def _codes(text: np.ndarray, size: int) -> np.ndarray:
    """Strings of ``size`` bytes ending at each byte from size - 1 on, as integers."""
    n = len(text) - size + 1
    code = np.zeros(max(0, n), np.int64)
    for k in range(size):
        code = (code << 8) | text[k : k + n]
    return code


def _count(docs: DataFrame) -> DataFrame:
    """(kind, code, n, held) of (text, held_out): strings of ORDER + 1 bytes that end on a symbol (kind 0)
    with their occurrences in training and in held-out rows, words of training rows (kind 1)."""

    def run(batches):
        for b in batches:
            buf, offs = flat(b.column(0))
            out = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            grams, words = [], []
            for i, j in chunks(offs):
                own = offs[i : j + 1] - offs[i]
                part, held = buf[offs[i] : offs[j]], out[i:j]
                text, ends = _framed(part, own)
                code = _codes(text, ORDER + 1)
                inside = np.ones(len(code), bool)  # strings that would run from one text into the next
                inside[(ends[1:-1][:, None] - ORDER + np.arange(ORDER)[None, :]).ravel()] = False
                aside = np.repeat(held, np.diff(ends))[ORDER:]
                key, n = _counted(code[inside & ~aside])
                grams.append((key, n, np.zeros_like(n)))
                key, n = _counted(code[inside & aside])
                grams.append((key, np.zeros_like(n), n))
                w, counts = word_hashes(part, own)
                words.append(_counted(w.view(np.int64)[np.repeat(~held, counts)]))
            if grams:
                key, n, more = _summed(grams)
                yield _batch("kind code n held", np.full(len(key), 0, np.int8), key, n, more)
                key, n = _summed(words)
                yield _batch("kind code n held", np.full(len(key), 1, np.int8), key, n, np.zeros_like(n))
            if not out.all():
                yield _batch("kind code n held", np.array([2], np.int8), np.array([END]), np.array([int((~out).sum())]), np.array([0]))

    rows = docs.mapInArrow(run, "kind tinyint, code long, n long, held long")
    return rows.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    last = np.flatnonzero(np.append(x[1:] != x[:-1], True)[: len(x)])
    return x[last], np.diff(np.append(-1, last))


def _summed(parts) -> tuple[np.ndarray, ...]:
    key, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[head], *(np.add.reduceat(n[order], head) if len(head) else n for n in values)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


class Trie:
    """Costs (-log10 probability) of symbols after contexts of up to ORDER bytes: of strings whose contexts
    end on the two bytes that those of ``code`` end on, with ``low``, the strings of one and of two bytes."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]):
        # strings of ORDER + 1 bytes; shorter ones are their suffixes, with all their counts
        self.levels = list(low)  # per order k: sorted strings of k + 1 bytes, their counts
        for k in range(len(low), ORDER + 1):
            self.levels.append(_summed([(code & ((np.int64(1) << (8 * (k + 1))) - 1), n)]))
        self.contexts = []  # per order k: sorted contexts of k bytes, T, q
        for strings, counts in self.levels:
            context = strings >> 8
            head = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
            total = np.add.reduceat(counts, head) if len(head) else counts
            self.contexts.append((context[head], total, np.diff(np.append(head, len(context)))))
        self.excluded = [self._exclusions(k) for k in range(ORDER)]

    def _exclusions(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For contexts of k + 1 bytes: occurrences and number of their symbols in the context of k bytes."""
        strings, _ = self.levels[k + 1]
        short, n = self.levels[k]
        mask = (np.int64(1) << (8 * (k + 1))) - 1
        at = np.searchsorted(short, strings & mask)
        context = strings >> 8
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        gone = np.add.reduceat(n[at], head) if len(head) else np.zeros(0, np.int64)
        return np.append(gone, 0), np.append(np.diff(np.append(head, len(context))), 0)  # the last is of no context

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Costs of the last byte of each string after the others, by walking down from the longest context."""
        cost = np.zeros(len(code))
        left = np.arange(len(code))
        above = np.zeros(len(code), np.int64)  # index of the context one longer, escaped from, plus 1
        for k in range(ORDER, -1, -1):
            if not len(left):
                return cost
            strings, counts = self.levels[k]
            contexts, total, distinct = self.contexts[k]
            if not len(contexts):
                continue
            mask = (np.int64(1) << (8 * (k + 1))) - 1
            own = code[left] & mask
            at = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
            seen = contexts[at] == own >> 8
            t, q = total[at].astype(np.float64), distinct[at].astype(np.float64)
            up = above[left] - 1
            if k < ORDER:
                gone, kinds = self.excluded[k]
                t, rest = t - gone[up], q - kinds[up]
            else:
                rest = q
            spot = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
            hit = seen & (strings[spot] == own)
            # nothing but excluded symbols: the escape is certain
            escape = np.where(seen & (rest > 0), -np.log10(np.where(rest > 0, rest, 1) / np.where(rest > 0, t + rest, 1)), 0.0)
            cost[left] += np.where(hit, -np.log10(np.where(hit, counts[spot], 1) / np.where(hit, t + rest, 1)), escape)
            above[left] = np.where(seen, at + 1, 0)
            left = left[~hit]
        # the bytes seen in no context share what is left
        base = self.contexts[0][2]
        cost[left] += np.log10(max(1, 256 - int(base[0]) if len(base) else 256))
        return cost


class Cache:
    """Finished costs of some strings, found through an open table; NaN where a string has none."""

    def __init__(self, code: np.ndarray, cost: np.ndarray):
        self.code, self.costs = code, cost  # sorted by code
        self.bits = max(4, int(4 * len(code)).bit_length())
        self.at = np.zeros(1 << self.bits, np.int32)
        self.at[self._slot(code)] = np.arange(len(code))  # of strings in one slot the last stays, the others are searched

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def cost(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.full(len(code), np.nan)
        at = self.at[self._slot(code)]
        out = self.costs[at]
        miss = np.flatnonzero(self.code[at] != code)
        at = np.minimum(np.searchsorted(self.code, code[miss]), len(self.code) - 1)
        out[miss] = np.where(self.code[at] == code[miss], self.costs[at], np.nan)
        return out


def _costs(grams: DataFrame) -> DataFrame:
    """(code, n, cost) of every string (code, n, held) of the corpus; n counts held-out rows too."""
    pairs = grams.where(f"n >= {LEAST}").groupBy(F.expr("code & 65535").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    two = _sorted(pairs)
    shared = grams.sparkSession.sparkContext.broadcast([_summed([(two[0] & 255, two[1])]), two])

    def walked(code, n, held):
        known = n >= LEAST
        return _batch("code n cost", code, n + held, Trie(code[known], n[known], shared.value).cost(code))

    def run(batches):
        wait = [np.zeros(0, np.int64)] * 3
        for b in batches:
            wait = [np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(wait)]
            if len(wait[0]) >= RUN:
                block = wait[0] >> 8 & 65535
                cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if cut:
                    yield walked(*(x[:cut] for x in wait))
                    wait = [x[cut:] for x in wait]
        if len(wait[0]):
            yield walked(*wait)

    block = F.expr("shiftright(code, 8) & 65535")
    dealt = grams.select("code", "n", "held").repartition(block).sortWithinPartitions(block)
    return dealt.mapInArrow(run, "code long, n long, cost double")


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, n = table
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, n[at], 0)


def score(docs: DataFrame, hold: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    bound_batches(docs.sparkSession)
    hold = held_out() if hold is None else hold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), hold.alias("held_out"))
    counts = stage(_count(rows.select("text", F.coalesce("held_out", F.lit(True)).alias("held_out"))), "counts")
    words = counts.where("kind > 0")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    costs = stage(_costs(counts.where("kind = 0")), "costs")
    hot = most_frequent(costs, NODES, "cost").select("code", "cost").toArrow()
    often = most_frequent(counts.where("kind = 1"), FREQUENT).toArrow()
    frequent = _sorted(often)
    scored = stage(_scored(rows, Cache(*_sorted(hot)), frequent, tokens > 0), "scored")
    rest = words.where(F.col("kind") == 1).select("code", "n")
    rare = scored.select("row_id", F.explode("rare").alias("code")).join(rest, "code")
    rare = rare.groupBy("row_id").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    others = scored.select("row_id", F.explode("others").alias("code")).join(costs.select("code", "cost"), "code")
    others = others.groupBy("row_id").agg(F.sum("cost").alias("other_cost"))
    end = words.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = F.log10(F.lit(float(tokens + kinds + 1)))
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) + F.log10(F.lit(end + 1.0)) - F.col("n_tokens") * share
    return scored.join(rare, "row_id", "left").join(others, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") - F.coalesce("other_cost", F.lit(0.0))).alias("score"),
    )


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def _scored(rows: DataFrame, cache: Cache, frequent: tuple[np.ndarray, np.ndarray], trained: bool) -> DataFrame:
    """row_id, doc_id, held_out, n_tokens, known, logs, score, and what neither cache has: the words, and the
    strings, whose costs ``score`` lacks."""
    shared = rows.sparkSession.sparkContext.broadcast((cache, frequent))

    def run(batches):
        cache, frequent = shared.value
        for b in batches:
            buf, offs = flat(b.column(2))
            for i, j in chunks(offs):
                part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                w, counts = word_hashes(part, own)
                w = w.view(np.int64)
                n = _lookup(frequent, w)
                doc = np.repeat(np.arange(j - i), counts)
                logs = np.bincount(doc, np.log10(n + 1.0), j - i).astype(np.float64)  # of no words, bincount makes integers
                known = np.bincount(doc, n > 0, j - i).astype(np.int64) + int(trained)
                rare = w[n == 0]
                sizes = np.bincount(doc[n == 0], minlength=j - i)
                text, ends = _framed(part, own)
                code = _codes(text, ORDER + 1)
                cost = cache.cost(code)
                inside = np.ones(len(code), bool)
                inside[(ends[1:-1][:, None] - ORDER + np.arange(ORDER)[None, :]).ravel()] = False
                miss = np.isnan(cost)
                cost[miss] = 0.0
                miss = np.flatnonzero(miss & inside)
                upto = np.searchsorted(miss, ends - ORDER).clip(0)
                # the string that ends on byte p has index p - ORDER; sums run from a text's first symbol to its end
                total = np.append(0.0, np.cumsum(cost))
                value = -(total[ends[1:] - ORDER] - total[ends[:-1]])
                yield _batch(
                    "row_id doc_id held_out n_tokens known logs score rare others", b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(3).slice(i, j - i),
                    counts + 1, known, logs, value, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rare)),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(code[miss])),
                )

    named = rows.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "text", "held_out")
    return named.mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, others array<long>")
