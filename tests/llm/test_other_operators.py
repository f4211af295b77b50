"""WARC, vectors, toxicity, components, the pipeline and the registry."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citewright.llm import common, embedding_dedup, pieces, queries, toxicity, warc


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(50)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in parent}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes_agree_with_words():
    texts = ["The  quick\tbrown", None, "", "the QUICK  brown fox", "É é"]
    buf, offs = common.flat(pa.array(texts))
    h, counts = common.word_hashes(buf, offs)
    assert counts.tolist() == [3, 0, 0, 4, 2]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 6


def test_warc(spark):
    long = "x" * 100 + "é\r\n\r\nWARC/1.1\r\n"
    html = [long, "short", long, None, "short", "", "y" * 99, "y" * 99, long, "z" * 200_000, "q" * 300_000, "r" * 5_000_000, "r" * 5_000_000]
    rows = [(i, f"http://h.example/{i}\nx" if i else None, h, "extra", "b") for i, h in enumerate(html)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, body string, digest string")).collect()}
    assert sorted(got) == list(range(len(html)))
    for i, h in enumerate(html):
        data, c = (h or "").encode(), got[i].capture
        first = html.index(h)
        revisit = len(data) >= 100 and first < i
        assert (c.payload_bytes, c.payload_digest, c.record_type) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response")
        assert c.refers_to == (f"<urn:capture:response:{first}>" if revisit else None)
        assert revisit or (c.held_bytes, c.held_digest) == (c.payload_bytes, c.payload_digest)
        assert f"page-id: {i}" in got[i].metadata.fields and got[i].request.fields.startswith("GET ")
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([(None, "u", "h")], "page_id long, url string, html string")).count() == 0


def test_warc_files_of_many_members_and_short_records(spark, tmp_path):
    record = lambda i, body: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s" % (i, len(body), body)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * i for i in range(5)]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(record(i, x) + b"\r\n\r\n") for i, x in enumerate(blocks)))
    got = {r.record_id: bytes(r.payload) for r in warc.read_records(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<urn:{i}>": bytes([65 + i]) * i for i in range(5)}
    whole = record(1, b"abcdef") + b"\r\n\r\n"
    assert [x for _, x in warc.parse_records(whole * 2)] == [b"abcdef"] * 2
    for bad in (whole[:-4], whole[:-7], whole[:-2], b"x" + whole, record(1, b"abcdef") + whole):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_warc_keeps_every_row_and_takes_digests_from_payloads(spark, tmp_path):
    rows = [(1, "u", "a" * 100), (1, "v", "a" * 100), (1, "w", "b" * 120), (2, "u", "a" * 100), (3, "u", "b" * 120), (3, "u", "b" * 120), (None, "u", "a" * 100), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_pages(pages, f"file://{tmp_path}/all", unnamed=True).collect()
    want = []
    for i, _, h in rows:
        first = min(j for j, _, x in rows if j is not None and x == h) if h and i is not None else i
        want.append((i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first != i else "response"))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.record_type) for r in got), key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))
    ids = {r.capture.record_id for r in got}
    assert len(ids) == len(rows) and all(r.capture.refers_to in ids for r in got if r.capture.record_type == "revisit")
    assert warc.archive_pages(pages).count() == 6
    records = warc.read_records(spark, f"file://{tmp_path}/all").withColumn("payload_digest", F.lit("of the header"))
    assert {r.capture.payload_digest for r in warc.assemble(records).collect()} == {x[2] for x in want}


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    near = [base[i % 20] + rng.normal(size=32) * s for i, s in zip(range(200), rng.choice([0.1, 0.3, 0.45, 0.6], 200))]
    vectors = [*base, *near, base[0], base[0], base[5]]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    odd = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] + [1.0] * 31, 1), (9003, [None] + [1.0] * 31, 1), (9004, [], 1), (9005, [1.0] * 8, 1), (None, [1.0] * 32, 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, weight int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    links = close.sum(1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(9000, 9006))
    assert not got[None].kept and got[300 + 200].component_id == got[0].component_id
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tiles_of_large_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    x = base + rng.normal(size=(120, 16)) * 0.05
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(r.n_links for r in got) >= 0.97 * links.sum() and all(r.n_links <= links[r.vec_id] for r in got)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 50 and right >= 0.85 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "", "s")], "doc_id long, text string, score string")
    none = labels.where("false")
    assert [r.score for r in toxicity.score_documents(odd, none).collect()] == [0.0] * 3
    assert toxicity.keep_clean(odd, none).columns == odd.columns and toxicity.keep_clean(odd, none).count() == 3
    assert toxicity.score_documents(odd.where("false"), labels).count() == 0


def plain_buckets(text):
    """The bucket of every subword of a text, by plain integers."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    edge = bytes(32 if chr(c) in "\t\n\v\f\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789" else c for c in low)
    framed, full, out = b" " + edge + b" ", (1 << 64) - 1, []
    for n in toxicity.SIZES:
        for k in range(len(framed) - n + 1):
            if b" " not in framed[k + 1 : k + n - 1]:
                h = sum(int(common._VALUE[c]) * pow(common._BASE, i, 1 << 64) for i, c in enumerate(framed[k : k + n])) & full
                out.append(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & full) >> 48)
    return out


def test_scores_of_a_fixed_table_by_brute_force(spark):
    table = np.random.default_rng(6).normal(size=toxicity.BUCKETS + 1) * 20
    texts = [None, "", " ", "a", "You ABSOLUTE b4d-word, é日", "x" * 3000, "one two  three\tfour " * 50]
    got = {r.row.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()}
    for i, t in enumerate(texts):
        own = plain_buckets(t)
        odds = (sum(table[k] for k in own) / len(own) if own else 0.0) + table[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(8)
    p = {"e": rng.normal(size=(9, 4)), "w": rng.normal(size=(4, 2)), "b": rng.normal(size=2)}
    text, back, weight, y = np.repeat(np.arange(5), 6), rng.integers(0, 9, 30), rng.random(30), np.array([0, 1, 1, 0, 1])
    _, grad = toxicity.gradients(**p, text=text, back=back, weight=weight, y=y)
    for name, x in p.items():
        for at in np.ndindex(x.shape):
            own = x[at]
            x[at] = own + 1e-6
            up, _ = toxicity.gradients(**p, text=text, back=back, weight=weight, y=y)
            x[at] = own - 1e-6
            down, _ = toxicity.gradients(**p, text=text, back=back, weight=weight, y=y)
            x[at] = own
            assert abs((up - down) / 2e-6 - grad[name][at]) < 1e-6


def test_bags_keep_all_counts():
    packed = toxicity.packed_bag(np.array([3, 70, 65535]), np.array([1, 65535 * 2 + 5, 65536]))
    assert np.bincount(packed >> 16, packed & 65535).nonzero()[0].tolist() == [3, 70, 65535]
    assert [int((packed & 65535)[packed >> 16 == k].sum()) for k in (3, 70, 65535)] == [1, 65535 * 2 + 5, 65536]


def test_misspellings_share_vectors():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" zyzzyvax" if i % 2 else "") for i in range(400)]
    buf, offs = common.flat(pa.array(texts))
    bucket, text = toxicity.subwords(buf, offs)
    bounds = np.searchsorted(text[order := np.argsort(text, kind="stable")], np.arange(401))
    table = toxicity.train(bounds, (bucket[order].astype(np.uint32) << 16) | np.uint32(1), np.arange(400) % 2)
    flat = common.flat(pa.array(["abcdef zyzzyvaxx bcdefg " + texts[0], texts[2]]))
    score = toxicity._score(table, *flat)
    assert score[0] > 0.5 > score[1]


def test_pipeline_stages(spark):
    """Every stage against brute force on what its predecessor kept."""
    from sentencepiece import SentencePieceProcessor

    from .test_text_operators import brute_links, brute_mix, components, shingles, words

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, names = [docs], docs.columns
    for name, function in corpus_pipeline.STAGES:
        tables.append(common.stage(function(spark, tables[-1], sf), name))
    assert all(t.columns == names for t in tables[:-1]) and tables[-1].columns == [*names, "pieces"]
    start, clean, exact, near, mixed, encoded = (t.collect() for t in tables)
    plain = lambda rows: sorted(tuple(str(r[c]) for c in names) for r in rows)
    score = {r.row.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert plain(clean) == plain([r for r in start if score[r.doc_id] < 0.5]) and len(clean) < len(start)
    last = {}
    for r in clean:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert plain(exact) == plain([r for r in clean if last[r.text or ""] == r.doc_id])
    sets = {r.doc_id: shingles(r.text) for r in exact}
    least = components(sets, brute_links(sets))
    assert plain(near) == plain([r for r in exact if least[r.doc_id] == r.doc_id])
    taken = {(i, s): n for i, s, size, n in brute_mix([(r.doc_id, r.source, len(words(r.text))) for r in near]) if size}
    sizes = {r.doc_id: len(words(r.text)) for r in near}
    assert plain(mixed) == plain([r for r in near if sizes[r.doc_id] for _ in range(taken[r.doc_id, r.source] // sizes[r.doc_id])])
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    assert plain(encoded) == plain(mixed) and all(r.pieces == sp.encode(r.text or "") for r in encoded)


def test_registry():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in queries.queries()
