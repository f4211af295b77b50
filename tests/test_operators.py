"""Operators on hand-made tables and against plain Python models."""

import random

from pyspark.sql import functions as F

from citewright.operators import evidence, flow, prompts, resolve, segment, workspace
from citewright.sources import corpus, works


def test_reading_order_of_columns(spark):
    boxes = [("p", 1, 600.0, 50.0, 100.0 + 20 * i, 280.0, 115.0 + 20 * i, f"left {i}") for i in range(6)] + [("p", 1, 600.0, 320.0, 101.0 + 20 * i, 560.0, 116.0 + 20 * i, f"right {i}") for i in range(6)]
    df = spark.createDataFrame(boxes, "paper_id string, page_no int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    got = [r.text for r in segment.reading_order(df).orderBy("position").collect()]
    assert got == [f"left {i}" for i in range(6)] + [f"right {i}" for i in range(6)]


def test_last_heading_cuts(spark):
    df = spark.createDataFrame([("p", 0, i, t) for i, t in enumerate(["Body", "References", "more body", "7. Références", "[1] x"])], "paper_id string, page_no int, line_no int, line string")
    assert segment.before_heading(df).count() == 3
    assert segment.summary_text(segment.before_heading(df), most=20, marker="..").first()["text"].startswith("Body\nReferenc")


def test_pacing_equals_recursion(spark):
    rng = random.Random(1)
    calls = [("h", i, float(rng.randrange(200)), float(rng.randrange(1, 60))) for i in range(200)]
    got = {r.call_id: r.start for r in flow.pacing(spark.createDataFrame(calls, "host string, call_id long, arrival double, duration double"), 30).collect()}
    free = float("-inf")
    for _, i, arrival, duration in sorted(calls, key=lambda c: (c[2], c[1])):
        start = max(arrival, free)
        assert abs(got[i] - start) < 1e-9
        free = start + max(30, duration)



def test_precedence_and_copies(spark):
    copies = spark.createDataFrame([("p", 1, "https://a.example/1#x", None, None), ("p", 2, "https://a.example/1", "publishedVersion", "cc-by"), ("p", 3, "http://localhost/1", "publishedVersion", None), ("p", 4, "https://b.example/1", "acceptedVersion", None)], "paper_id string, position int, url string, version string, license string")
    got = [(r.url, r.version, r.license, r["rank"]) for r in resolve.best_copies(copies).orderBy("rank").collect()]
    assert got == [("https://a.example/1", "publishedVersion", "cc-by", 1), ("https://b.example/1", "acceptedVersion", None, 2)]


def test_shared_references_resolve_titles(spark):
    rows = [("o", 1, "10.1/X", "A title long enough"), ("o", 2, None, "A  Title, long enough"), ("o", 3, "10.1/y", "short"), ("o", 4, None, "short")]
    got = workspace.shared_references(spark.createDataFrame(rows, "owner string, session_id int, doi string, title string")).collect()
    assert [(r.key, r.sessions) for r in got] == [("10.1/x", 2)]


def test_model_failures_stay_with_their_rows(spark):
    def generate(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return '<think>x</think>```json\n{"themes": [{"id": "a", "name": "One"}, {"id": "2", "name": "Two"}]}\n```'

    got = prompts.call_model(spark.createDataFrame([("1", "good"), ("2", "bad")], "request_id string, prompt string"), generate)
    assert {r.request_id: r.error for r in got.collect()} == {"1": None, "2": "no"}
    themes = prompts.parse_themes(got.where("answer is not null")).orderBy("theme_id").collect()
    assert [(t.theme_id, t.name) for t in themes] == [(1, "One"), (2, "Two")]


def test_bad_batches_fail_alone(spark):
    sent = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "request_id string, paper_id long")
    assigned = spark.createDataFrame([("a", 1, 1), ("a", 9, 1), ("b", 3, 1)], "request_id string, paper_id long, theme_id long")
    assert [r.request_id for r in prompts.failed_batches(sent, assigned).collect()] == ["a"]


def test_provider_records(spark):
    raw = spark.createDataFrame([('{"id": "W1", "display_name": "T", "publication_year": 2001, "doi": "10.1/a", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["W2"], "locations": [{"is_oa": true, "pdf_url": "https://a.example/p"}, {"is_oa": false}]}',)], "json string")
    w = works.openalex(raw)
    r = w.first()
    assert (r.abstract, r.year, len(r.copies)) == ("a b a", "2001", 1)
    assert {(x.work_id, x.kind, x.other_id) for x in works.relationships(w).collect()} == {("W1", "references", "W2"), ("W2", "citing", "W1")}
    c = works.crossref(spark.createDataFrame([('{"DOI": "10.1/A", "title": ["X"], "issued": {"date-parts": [[1999, 2]]}, "page": "7-9", "abstract": "<p>a &amp; b</p>"}',)], "json string")).first()
    assert (c.year, c.first_page, c.abstract) == ("1999", "7", "a & b")
    dates = '{"DOI": "10.1/%s", "published-print": {"date-parts": [[%s]]}, "published-online": {"date-parts": [[%s]]}, "issued": {"date-parts": [[null]]}, "created": {"date-parts": [[1990]]}, "page": %s, "article-number": "e12"}'
    read = works.crossref(spark.createDataFrame([(dates % x,) for x in (("a", "1995", "1994", '"S3 \u2013 S9"'), ("b", "", "1994", "null"), ("c", "null", "", '" "'))], "json string")).orderBy("doi").collect()
    assert [(x.year, x.first_page) for x in read] == [("1995", "S3"), ("1994", "e12"), ("1990", "e12")]
    spot = '{"is_oa": %s, "pdf_url": %s, "landing_page_url": "%s", "source": {"type": "repository", "display_name": %s}}'
    best, more = spot % ("true", '"https://a.example/b.pdf"', "https://a.example/b", '"Store"'), [spot % ("true", "null", "https://a.example/b", "null"), spot % ("false", '"https://c.example/x"', "https://c.example/c", "null"), spot % ("true", '"http://localhost/x"', "https://d.example/d", "null")]
    o = works.openalex(spark.createDataFrame([('{"id": "W3", "best_oa_location": %s, "locations": [%s], "primary_location": {"source": {"display_name": "J"}}}' % (best, ", ".join(more)),), ('{"id": "W4"}',)], "json string")).orderBy("work_id").collect()
    assert [(x.url, x.host_type) for x in o[0].copies] == [("https://a.example/b.pdf", "repository")] and o[0].journal == "J" and o[1].copies == o[1].open_records == []
    assert [(x.name, x.url) for x in o[0].open_records] == [("Open Access · Store", "https://a.example/b"), ("Open Access · repository", "https://d.example/d")]


def test_corpus_scan_and_sessions(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1 same"), ("b.pdf", b"%PDF-1 same"), ("c.txt", b"no pdf"), ("d.pdf", b"%PDF-1 other")):
        (tmp_path / name).write_bytes(data)
    files = corpus.scan_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()) == ["a.pdf", "d.pdf"]
    pages = corpus.decode_pages(files, lambda c: [c.decode() * 5])
    assert pages.count() == 2
    held = spark.createDataFrame([("s1", "2024-01-01"), ("s2", "2024-01-02")], "session_id string, saved_at string")
    corpus.export_sessions(held, str(tmp_path / "out"))
    newer = spark.createDataFrame([("s1", "2024-02-01"), ("s9", "2023-01-01")], "session_id string, saved_at string")
    schema = "session_id string, saved_at string"
    got = lambda path, held: sorted(map(tuple, corpus.import_sessions(spark, str(tmp_path / path), schema, held).collect()))
    assert got("out", newer) == [("s1", "2024-01-01"), ("s2", "2024-01-02"), ("s9", "2023-01-01")] and got("out", None) == [("s1", "2024-01-01"), ("s2", "2024-01-02")]
    corpus.export_sessions(spark.range(51).selectExpr("concat('m', id) session_id", "'2024-01-01' saved_at"), str(tmp_path / "many"))
    corpus.export_sessions(spark.createDataFrame([("s3", "no date")], schema), str(tmp_path / "bad"))
    assert got("many", newer) == got("bad", newer) == [("s1", "2024-02-01"), ("s9", "2023-01-01")]
