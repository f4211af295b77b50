"""Self-join of documents whose 5-word shingle sets have Jaccard similarity 0.8 or more.

Shingles are 64-bit hashes in one global order: common ones last, else by value. By that
order the first n - ceil(0.8 n) + 1 shingles of a set, its prefix, share one at least with the prefix
of every partner. Documents with equal sets are one set, named by a hash of it; all that follows is about
distinct sets, and ids come back at the end, so an id may have several texts.

1. Prefix rows are grouped by shingle; the smallest set of a group is its centre, so a group of m members
   makes m - 1 pairs, whatever m is. Each batch makes its own groups first and sends only their centres on,
   so a shingle of any frequency is a few rows a batch.
2. A set goes to the block of the centre it meets most often, of those that lengths and sketches allow. Large
   blocks are dealt into parts, which share some members as landmarks. The globally ordered sets of a part
   form a prefix tree; every member traverses it: shared runs of shingles are matched once, a subtree is cut
   when its overlap so far plus the least remaining length can't reach the required overlap, or when all
   of it is linked to the member already. Links give components.
3. Only pairs whose ends lie in different components can still add a link. Groups that hold several
   components are dealt into tiles, so that no task holds a whole group; within tiles, lengths, places in the prefixes and
   512-bit sketches, which bound the overlap from above, rule pairs out. A pair that shares the shingle before, too, was
   met there and isn't met again. In a first round a set tries only the likeliest member of each component of its tile,
   which joins most of what belongs together; in the second, all pairs left are verified through the same trees, so no
   link between texts is lost.

Which shingles count as common is found by counting all prefixes; the COMMON_MOST most
frequent of at least COMMON_LEAST go last. Any choice gives the same links: it only keeps
passages that many documents share out of the prefixes.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are
components of their own; one to four words form one shingle; rows that repeat a doc_id are
one document with that id (the links of all its texts are united), one row out for each row in;
null ids take no part and come out with a null component; an empty table gives an empty result; long texts
count whole; other columns are ignored. Equal hashes of unequal shingles or sets, one pair in 2**64,
would count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, chunks, components, flat, mix, most_frequent, stage, word_hashes
from .suffix_dedup import _groups

WORDS = 5
NUM, DEN = 80, 100  # links have DEN * intersection >= NUM * union
COMMON_LEAST = 3
COMMON_MOST = 1 << 20
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 18
PART = 384  # members of a part of a block
LANDMARKS = 16  # members all parts of a block share, about
TILE = 512  # members of a group that are compared with as many others in one go
TREE = 256  # partners of a set that form one tree


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct int64 shingles of each text, in order of the texts."""
    buf, offs = flat(texts)
    factor = [pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(words)]
    for i, j in chunks(offs):
        own = offs[i : j + 1] - offs[i]
        w, counts = word_hashes(buf[offs[i] : offs[j]], own)
        first = np.concatenate([[0], np.cumsum(counts)])
        rolled = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            rolled += w[k : k + len(rolled)] * np.uint64(factor[k])
        rolled = mix(rolled).view(np.int64)
        for d in range(j - i):
            n = int(counts[d])
            if n >= words:
                yield np.unique(rolled[first[d] : first[d] + n - words + 1])
            elif n:
                short = w[first[d] : first[d] + n] * np.array(factor[:n], np.uint64)
                yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(n)], np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def set_key(s: np.ndarray) -> int:
    """The name of a set: 64 bits of a digest of its sorted shingles."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def in_order(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The sorted set in the global order: shingles of ``common`` last."""
    if not len(common) or not len(s):
        return s
    at = np.searchsorted(common, s)
    last = common[np.minimum(at, len(common) - 1)] == s
    return np.concatenate([s[~last], s[last]])


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def needed(a: int | np.ndarray, b: int | np.ndarray):
    """Least intersection with which sets of a and b elements link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def sketch(s: np.ndarray) -> np.ndarray:
    """512 bits as 8 int64: for each residue of the shingles, whether an odd number has it. Where two
    sketches differ, the sets differ by one shingle at least."""
    odd = np.bincount((s.view(np.uint64) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, key, n, prefix, sketch: of sets equal within a task only the first has the latter two."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            keys, ns, prefixes, sketches = [], [], [], []
            for doc, s in zip(ids, shingle_sets(b.column(1)), strict=True):
                key = set_key(s)
                first = doc is not None and len(s) > 0 and key not in seen
                if first:
                    seen.add(key)
                keys.append(key)
                ns.append(len(s))
                prefixes.append(in_order(s, shared.value)[: prefix_length(len(s))].copy() if first else None)
                sketches.append(sketch(s) if first else None)
            columns = [pa.array(x, pa.int64()) for x in (ids, keys, ns)] + [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, sketches)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, n long, prefix array<long>, sketch array<long>")


def _members(prefixes: DataFrame) -> DataFrame:
    """Members (token, key, n, pos, centre, centre_n) of the prefix groups of two sets and more.

    kind is 0 for a set alone with its shingle in its batch, 1 for the centre of several, 2 for the others of those."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            values, key, size = lists.flatten().to_numpy(zero_copy_only=False), b.column(0).to_numpy(), b.column(1).to_numpy()
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + ROWS_AT_ONCE, "right")))
                token = values[ends[lo] - sizes[lo] : ends[hi - 1]]
                owner = np.repeat(np.arange(lo, hi), sizes[lo:hi])
                pos = np.arange(len(token)) - np.repeat(ends[lo:hi] - sizes[lo:hi] - (ends[lo] - sizes[lo]), sizes[lo:hi])
                order = np.lexsort((key[owner], token))
                token, owner, pos = token[order], owner[order], pos[order]
                head = np.append(True, token[1:] != token[:-1])
                several = ~(head & np.append(head[1:], True))
                kind = np.where(several, np.where(head, 1, 2), 0)
                centre = owner[np.maximum.accumulate(np.where(head, np.arange(len(token)), 0))]
                back = np.argsort(owner, kind="stable")  # rows of one set together compress better
                token, owner, pos, kind, centre = token[back], owner[back], pos[back], kind[back], centre[back]
                columns = (token, key[owner], size[owner], pos, np.where(kind == 2, key[centre], 0), np.where(kind == 2, size[centre], 0), kind)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["token", "key", "n", "pos", "centre", "centre_n", "kind"])
                lo = hi

    rows = prefixes.where("prefix is not null").select("key", "n", "prefix")
    rows = rows.mapInArrow(run, "token long, key long, n long, pos long, centre long, centre_n long, kind long")
    local = F.col("kind") == 2
    order = W.partitionBy("token", F.when(local, F.col("key"))).orderBy("key", "kind")
    rows = rows.select("*", F.first("key").over(order).alias("c"), F.first("n").over(order).alias("cn"), F.lead("key").over(order).alias("next"))
    # of equal sets from several batches one row is enough
    last = F.col("next").isNull() | (F.col("next") != F.col("key"))
    kept = rows.where(last & ((F.col("kind") > 0) | (F.col("c") != F.col("key")) | F.col("next").isNotNull()))
    return kept.select("token", "key", "n", "pos", F.when(local, F.col("centre")).otherwise(F.col("c")).alias("centre"), F.when(local, F.col("centre_n")).otherwise(F.col("cn")).alias("centre_n"))


def _fit(a: str, b: str) -> Column:
    """Whether sets of so many elements can link."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _allowed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose lengths and sketches allow a link."""
    one = sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.where(_fit("na", "nb")).join(one, "a").join(two, "b")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where((F.col("na") + F.col("nb") - differ) * (NUM + DEN) >= 2 * NUM * (F.col("na") + F.col("nb"))).drop("sa", "sb")


def _blocks(met: DataFrame) -> DataFrame:
    """(block, part, key): each set in the block of the centre it meets most often, the centre
    too; parts of about PART members, and the landmarks of a block in each of its parts."""
    home = stage(met.groupBy(F.col("b").alias("key")).agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("block")), "home")
    rows = home.select("block", "key").union(home.select("block", F.col("block").alias("key")).distinct())
    sizes = stage(rows.groupBy("block").agg(F.count("*").alias("size")), "sizes")
    rows = rows.join(sizes, "block").withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).withColumn("at", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)))
    mark = (F.col("at") * F.col("size") < F.lit(LANDMARKS << 40)) | (F.col("key") == F.col("block"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    return rows.withColumn("part", F.explode(F.when(mark, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))).select("block", "part", "key").distinct()


def _linked_blocks(docs: DataFrame, blocks: DataFrame, owners: DataFrame, common: np.ndarray) -> DataFrame:
    """(u, v): links that join the members of each part of a block as far as they link at all."""

    def run(batches):
        for t in _groups(batches, 0):
            block = t.column(0).to_numpy()
            lists = t.column(2).combine_chunks()
            values, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            keys = t.column(1).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            us, vs = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                got = _join_part([values[bounds[k] : bounds[k + 1]] for k in range(lo, hi)])
                us += [int(keys[lo + a]) for a, _ in got]
                vs += [int(keys[lo + b]) for _, b in got]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    blocks = stage(blocks, "blocks")
    sets = _ordered_sets(docs, blocks.select("key").distinct(), owners, common)
    rows = blocks.join(sets, "key").select(F.xxhash64("block", "part").alias("at"), "key", "shingles")
    return stage(rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, "u long, v long"), "links")


def _join_part(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``: each traverses the tree of all, past what it is linked to."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
    tree = [sets[i] for i in order]
    label = np.arange(len(tree))
    out = []
    for k in range(len(tree)):
        if (label == label[k]).all():
            break
        found: list[int] = []
        _walk(tree, np.sort(tree[k]), 0, len(tree), 0, 0, found, label, label[k])
        for f in found:
            if label[f] != label[k]:
                out.append((order[k], order[f]))
                low, high = sorted((label[f], label[k]))
                label[label == high] = low
    return out


def _walk(sets: list[np.ndarray], probe: np.ndarray, lo: int, hi: int, depth: int, overlap: int, found: list[int], label: np.ndarray | None = None, own: int = -1) -> None:
    """Descend the prefix tree of sets[lo:hi] (sorted, equal up to ``depth``), matching ``probe``.

    A tree node with one child is a run of shared shingles: it is matched in one step. found
    gets the indexes of sets that reach the required overlap; subtrees that wholly have the ``label`` own are passed by."""
    while True:
        if label is not None and (label[lo:hi] == own).all():
            return
        first, last = sets[lo], sets[hi - 1]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        upto = depth + int(differ[0]) if len(differ) else m
        edge = first[depth:upto]
        at = np.searchsorted(probe, edge)
        overlap += int((probe[np.minimum(at, len(probe) - 1)] == edge).sum())
        ended = lo
        while ended < hi and len(sets[ended]) == upto:
            if overlap >= needed(len(probe), upto):
                found.append(ended)
            ended += 1
        lo, depth = ended, upto
        if lo >= hi:
            return
        lengths = [len(x) for x in sets[lo:hi]]
        if overlap + min(max(lengths) - depth, len(probe) - overlap) < needed(len(probe), min(lengths)):
            return
        i = lo
        while i < hi:
            j = i + 1
            while j < hi and sets[j][depth] == sets[i][depth]:
                j += 1
            if i == lo and j == hi:
                break
            _walk(sets, probe, i, j, depth, overlap, found, label, own)
            i = j
        if i >= hi:
            return


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, key, n, pos, component, main, firsts, others): members of the groups that hold several components.

    The sets outside a group's largest component, usually few, are to form its first parts, those of the
    largest the others, if the group is beyond TILE."""
    own = members.select("token", "key", "n", "pos").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    own = stage(own, "own")
    counts = own.groupBy("token", "component").agg(F.count("*").alias("rows"))
    groups = counts.groupBy("token").agg(F.max_by("component", "rows").alias("main"), F.max("rows").alias("inside"), F.sum("rows").alias("all"), F.count("*").alias("kinds"))
    parts = lambda rows: F.ceil(rows / TILE).cast("int")
    small = F.col("all") <= TILE
    groups = groups.where("kinds > 1").select(
        "token", "main", F.when(small, 1).otherwise(parts(F.col("all") - F.col("inside"))).alias("firsts"), F.when(small, 0).otherwise(parts(F.col("inside"))).alias("others")
    )
    return stage(own.join(stage(groups, "groups"), "token"), "mixed")


def _tiles(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """(tile, side, key, n, pos, before, component, sketch): the members dealt into tiles.

    A tile is two parts of a group, one of the first ones at least, or one of these alone; side tells its parts apart, 2 is
    a part with itself. ``before`` is the shingle of such a group that precedes in the set's prefix."""
    rows = mixed.withColumn("before", F.lag("token").over(W.partitionBy("key").orderBy("pos"))).join(sketches, "key")
    hashed = F.xxhash64("key")
    inside = (F.col("component") == F.col("main")) & (F.col("others") > 0)
    part = F.when(inside, F.col("firsts") + F.pmod(hashed, F.greatest(F.col("others"), F.lit(1)))).otherwise(F.pmod(hashed, F.col("firsts"))).cast("int")
    rows = rows.withColumn("part", part)
    most = F.when(F.col("part") < F.col("firsts"), F.col("firsts") + F.col("others")).otherwise(F.col("firsts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), most - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    tile = F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(tile.alias("tile"), side.alias("side"), "key", "n", "pos", "before", "component", "sketch")


def _across(tiles: DataFrame, likeliest: bool) -> DataFrame:
    """(a, b): pairs in different components that may link, each from the tiles where it is met first; or
    only the ``likeliest`` pair, by sketches, of each set with each component of its tile."""

    def run(batches):
        for t in _groups(batches, 0):
            tile, side, key, n, pos = (t.column(k).to_numpy() for k in range(5))
            chained = t.column(5).combine_chunks()
            component = t.column(6).to_numpy()
            _, cell = np.unique(tile, return_inverse=True)
            order = np.lexsort((key, n, cell))
            bits = t.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 8)[order]
            has = chained.is_valid().to_numpy(zero_copy_only=False)[order]
            before = chained.fill_null(0).to_numpy()[order]
            cell, side, key, n, pos, component = (x[order] for x in (cell, side, key, n, pos, component))
            # partners of a member are those behind it in its tile that have up to 5/4 of its size
            place = cell * np.int64(1 << 40) + n
            high = np.searchsorted(place, cell * np.int64(1 << 40) + DEN * n // NUM, "right")
            count = high - np.arange(len(n)) - 1
            bounds = np.append(0, np.cumsum(count))
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + PAIRS_AT_ONCE, "right")) - 1)
                i = np.repeat(np.arange(lo, hi), count[lo:hi])
                j = i + 1 + np.arange(len(i)) - np.repeat(bounds[lo:hi] - bounds[lo], count[lo:hi])
                lo = hi
                ok = (component[i] != component[j]) & ((side[i] != side[j]) | (side[i] == 2)) & ~((before[i] == before[j]) & has[i] & has[j])
                i, j = i[ok], j[ok]
                least = needed(n[i], n[j])
                ok = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
                i, j, least = i[ok], j[ok], least[ok]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                ok = (n[i] + n[j] - differ) // 2 >= least
                i, j, differ = i[ok], j[ok], differ[ok]
                if likeliest:
                    one = _first_of(component[j], i, differ / (n[i] + n[j]))
                    two = _first_of(component[i], j, differ / (n[i] + n[j]))
                    both = np.intersect1d(one, two)  # the likeliest from either end
                    i, j = i[both], j[both]
                i, j = key[i], key[j]
                pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def _first_of(component: np.ndarray, own: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the least rank is for each row ``own`` and each ``component``."""
    order = np.lexsort((rank, component, own))
    c, o = component[order], own[order]
    return order[np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1]))[: len(order)]]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Consecutive partners of a probe form one prefix tree."""

    def links(probe_set: np.ndarray, keys: list[int], members: list[np.ndarray]) -> list[int]:
        out = []
        for at in range(0, len(keys), TREE):
            own = members[at : at + TREE]
            order = sorted(range(len(own)), key=lambda i: own[i].astype(">i8").tobytes())
            found: list[int] = []
            _walk([own[i] for i in order], np.sort(probe_set), 0, len(order), 0, 0, found)
            out += [keys[at + order[i]] for i in found]
        return out

    def run(batches):
        for b in batches:
            a = b.column(0).to_numpy(zero_copy_only=False)
            keys = b.column(1).to_pylist()
            probes, members = b.column(2), b.column(3)
            us, vs = [], []
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
            for k, lo in enumerate(cuts):
                hi = cuts[k + 1] if k + 1 < len(cuts) else len(a)
                got = links(_values(probes, lo), keys[lo:hi], [_values(members, i) for i in range(lo, hi)])
                us += [int(a[lo])] * len(got)
                vs += got
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    one = sets.select(F.col("key").alias("b"), F.col("shingles").alias("tb"))
    two = sets.select(F.col("key").alias("a"), F.col("shingles").alias("ta"))
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "u long, v long")


def _values(lists: pa.Array, i: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False)


def _ordered_sets(docs: DataFrame, wanted: DataFrame, owners: DataFrame, common: np.ndarray) -> DataFrame:
    """key and ordered shingles of the ``wanted`` keys, from the texts of their ``owners`` (key, doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for b in batches:
            wanted, keys, sets = b.column(0).to_numpy(), [], []
            for key, s in zip(wanted.tolist(), shingle_sets(b.column(1)), strict=True):
                if set_key(s) == key:  # else it is another text of the id
                    keys.append(key)
                    sets.append(in_order(s, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = stage(wanted.join(owners, "key").select("key", "doc_id"), "wanted")
    found = rows.join(wanted, "doc_id").select("key", "text").mapInArrow(run, "key long, shingles array<long>")
    return found.dropDuplicates(["key"])  # an id may repeat a text


def _linked(docs: DataFrame, pairs: DataFrame, owners: DataFrame, common: np.ndarray) -> DataFrame:
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    return stage(_verified(pairs, stage(_ordered_sets(docs, ends, owners, common), "sets")), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    bound_batches(docs.sparkSession)
    counts = _prefixes(docs, np.zeros(0, np.int64)).select(F.explode("prefix").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    counts = stage(counts.where(F.col("n") >= COMMON_LEAST), "common")
    common = np.sort(most_frequent(counts, COMMON_MOST).select("code").toArrow().column(0).to_numpy())
    prefixes = stage(_prefixes(docs, common), "prefixes")
    rows = prefixes.select("doc_id", "key", "n")
    owners = stage(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "owners")
    sketches = stage(prefixes.where("sketch is not null").select("key", "sketch").dropDuplicates(["key"]), "sketches")
    members = stage(_members(prefixes), "members")
    met = members.where("key <> centre").groupBy(F.col("centre").alias("a"), F.col("key").alias("b"), F.col("centre_n").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("met"))
    links = _linked_blocks(docs, _blocks(_allowed(met, sketches)), owners, common)
    labels = stage(components(links), "labels").select(F.col("id").alias("key"), "component")
    mixed = _mixed(members, labels)
    likely = stage(_across(_tiles(mixed, sketches), True), "pairs")
    links = links.union(_linked(docs, likely, owners, common))
    # components only grow, so what is mixed now was mixed before
    labels = stage(components(links), "labels").select(F.col("id").alias("key"), "component")
    rest = stage(_across(_tiles(_mixed(mixed, labels), sketches), False).join(likely, ["a", "b"], "left_anti"), "pairs")
    late = _linked(docs, rest, owners, common)
    several, joins = _united(rows)
    found = stage(components(links.union(late).union(joins)), "components").select(F.col("id").alias("key"), "component")
    named = owners.join(found, "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    least = stage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = stage(named.join(least, "component").select("key", "component_id"), "named")
    # a row without words has the component of its id's other texts, if there are any
    rows = rows.join(several, F.col("doc_id") == F.col("id"), "left").withColumn("key", F.when(F.col("n") > 0, F.col("key")).otherwise(F.col("low")))
    out = rows.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _united(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, low): ids with several texts and the least key of those with words; (u, v): what joins the keys of such an id."""
    own = F.when(F.col("n") > 0, F.col("key"))
    ids = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("rows"))
    several = stage(ids.where("rows > 1 and low is not null").select("id", "low"), "several")
    joins = rows.where("n > 0").join(several, F.col("doc_id") == F.col("id")).where("key <> low").select(F.col("low").alias("u"), F.col("key").alias("v")).distinct()
    return several, joins


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; null ids stay."""
    drop = near_groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return keyed.join(stage(drop, "near"), F.col("doc_id") == F.col("id"), "left_anti").select("row.*")
