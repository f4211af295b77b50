"""Benchmark decontamination against a plain version by word lists."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from citewright.llm import decontaminate as dec

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))]


def plain(text, items):
    """n_words, hit word numbers and items, window by window."""
    w = [x[0] for x in words_of(text)]
    hit, found = set(), set()
    for item, body in items:
        v = [x[0] for x in words_of(body)]
        n = min(len(v), 10)
        for k in range(len(v) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add("" if item is None else str(item))
    return len(w), hit, sorted(found)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocab = ["Die", "éa", "x1", "of", "ß", "B", "the", "日本", "zz9", "Á"]
    say = lambda n: rng.choice([" ", "-", "\n", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 9, 10, 11, 14, 30, 40, 40])] + [(2, say(12)), (None, say(10)), (90, None), (91, ""), (92, "!! @["), (10, say(25))]
    items += [(100, items[7][1])]  # two items with the same windows
    rare = [(i, t) for i, t in items if i not in (0, 1)]
    texts = [None, "", " ", "!?", "the", say(5), say(9), say(400), items[2][1], items[3][1].upper(), items[7][1].replace(" ", "... "), "q " + items[6][1] + " q", say(30) + "[" + items[8][1] + "]" + say(30)]
    texts += [f"{say(4)} {items[rng.randrange(2, 9)][1]} {say(4)}" for _ in range(40)] + ["w" * 500_000 + " " + items[5][1]]
    return items, rare, texts


@pytest.mark.parametrize("shard", [1 << 24, 150])
@pytest.mark.parametrize("which", [0, 1])
def test_against_plain(spark, tables, monkeypatch, shard, which):
    """One shard or many, windows of few common words or not, give the same hits."""
    items, texts = tables[which], tables[2]
    monkeypatch.setattr(dec, "SHARD_BYTES", shard)
    monkeypatch.setattr(dec, "EXPAND", 3)
    docs = spark.createDataFrame([(i, t, "r", "w") for i, t in enumerate(texts)] + [(None, "the", "r", "w"), (4, "the", "r", "w")], "doc_id long, text string, row string, `n.words` string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "the" if r.doc_id is None else texts[r.doc_id]
        n, hit, found = plain(text, items)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, len(hit), found, bool(hit)), r.doc_id
        w = words_of(text)
        assert sorted(k for k in range(n) if any(s.start <= w[k][1] and w[k][2] <= s.end for s in r.spans)) == sorted(hit)
    left = {r.doc_id: r.text for r in dec.remove_spans(docs, bench).collect()}
    whole = {r.doc_id: r.text for r in dec.remove_documents(docs, bench).collect()}
    for r in got:
        text = "the" if r.doc_id is None else texts[r.doc_id]
        for s in reversed(r.spans):
            text = text[: s.start] + text[s.end :]
        assert left[r.doc_id] == text
        assert (r.doc_id in whole) == (not r.contaminated)
    assert dec.remove_spans(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dec.contamination(docs, none).orderBy("doc_id").collect()] == [(2, 0), (0, 0)]
    assert dec.contamination(docs.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join("ab é"[rng.randrange(4)] * rng.randrange(1, 40) for _ in range(60)) for _ in range(9)] + ["x" * 300, None]
    whole = dec.Words(pa.array(texts))
    monkeypatch.setattr(dec, "CHUNK", 64)
    parts = dec.Words(pa.array(texts))
    assert (whole.hash == parts.hash).all() and (whole.start == parts.start).all() and (whole.counts == parts.counts).all()


def test_digest_is_of_the_item_ids(spark, tables):
    out = dec.contamination(spark.createDataFrame([(1, tables[0][8][1])], "doc_id long, text string"), spark.createDataFrame(tables[0], "item_id long, text string"))
    r = out.select(F.sha2(F.array_join("items", ","), 256).alias("d"), "items").first()
    assert r.d == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r["items"] == sorted(r["items"])
