"""Decoded files: pages, links and metadata of those that can be read, a status for each."""

from citewright.sources import corpus


def decoder():
    """Made here, so that it goes to the workers by value."""
    def decode(content):
        kind = content.decode().split()[1]
        if kind == "locked":
            raise ValueError("Encrypted: a password is needed")
        if kind == "broken":
            raise RuntimeError("bad cross-reference table")
        if kind == "null":
            return None
        if kind == "scan":
            return {"pages": ["  \n ", None], "links": [(0, "bib1")], "title": "Scan"}
        return {"pages": ["Page one of a paper that is long enough.", "Page two"], "links": [(0, "cite.bib7"), (0, "Reference12"), (1, "bib7"), (1, "bib7x"), (1, None), (1, "figure7"), (1, "7")], "title": "A title", "author": "A. Stone; B. Wood"}

    return decode


def test_documents(spark, tmp_path):
    for name in ("good", "locked", "broken", "scan", "null"):
        (tmp_path / f"{name}.pdf").write_bytes(f"%PDF-1.4 {name}".encode())
    rows = corpus.decode_documents(corpus.scan_files(spark, str(tmp_path)), decoder()).collect()
    name = lambda r: r.path.rsplit("/", 1)[1][:-4]
    assert {name(r): (r.text, r.title) for r in rows if r.kind == "document"} == {"good": ("parsed", "A title"), "locked": ("encrypted", None), "broken": ("broken", None), "scan": ("scanned", "Scan"), "null": ("scanned", None)}
    assert {(name(r), r.page_no) for r in rows if r.kind == "page"} == {("good", 0), ("good", 1)} and sum(r.kind == "link" for r in rows) == 6
    links = spark.createDataFrame([("p", r.text) for r in rows if r.kind == "link"], "paper_id string, text string")
    valid = spark.createDataFrame([("p", 7), ("p", 7), ("p", 1)], "paper_id string, number int")
    assert [tuple(r) for r in corpus.link_counts(links, valid).collect()] == [("p", 7, 2)]
    assert corpus.decode_documents(corpus.scan_files(spark, str(tmp_path)).where("false"), decoder()).count() == 0
