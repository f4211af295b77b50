"""References completed from works, and intents by batches."""

import json

from citewright.operators import enrich


def test_enrich(spark):
    works = spark.createDataFrame([
        ("w1", "10.1/A", "The work of the identifier", "2001", ["Jane Stone"], "x" * 3000), ("w2", None, "Quite a long title in a citation", "2002", ["Ann Wood"], None), ("w3", "10.1/b", " ", "2003", None, "An abstract"),
    ], "work_id string, doi string, title string, year string, authors array<string>, abstract string")
    refs = spark.createDataFrame([
        (1, "A. Stone, some paper, 2001.", "Printed title of it", "2001", ["A. Stone"], "https://doi.org/10.1/a"), (2, "B. Wood, Quite a long title in a citation, J. Testing 3 (2002) 1.", "", "2002", None, None),
        (3, "C. Hill, J. Power Sources 3 (2003) 1.", None, None, None, None), (4, "D. Vale, A usable title of its own, J. Testing 3 (2004) 1.", "A usable title of its own", None, [], ""), (5, "E. Dale (2003).", None, None, None, "10.1/B"), (6, None, None, None, None, "10.1/none"),
    ], "ref_id int, citation string, title string, year string, authors array<string>, doi string")
    got = {r.ref_id: r for r in enrich.enrich_references(refs, works).collect()}
    assert (got[1].title, got[1].authors, len(got[1].abstract), got[1].title_status, got[1].title_source, got[1].evidence) == ("The work of the identifier", ["Jane Stone"], 2500, "verified", "DOI metadata", "abstract")
    assert (got[2].title, got[2].title_status, got[2].evidence) == ("Quite a long title in a citation", "from_pdf", "title-metadata")
    assert (got[3].title, got[3].year, got[3].authors, got[3].title_status, got[3].evidence) == ("", "2003", ["C. Hill"], "unresolved", "citation")
    assert (got[4].title, got[4].title_source, got[4].evidence) == ("A usable title of its own", "PDF", "title-metadata")
    assert (got[5].title, got[5].abstract, got[5].evidence) == ("", "An abstract", "abstract") and got[6].evidence == "citation" and len(got) == 6


def test_intents(spark):
    rows = [("a", i, i, f"T{i}", [" ", f"context {i}"] if i % 4 else None) for i in range(1, 25)] + [("b", 1, 1, "T", ["c"]), ("b", 2, 2, "T", []), ("c", 1, 1, "T", ["c"]), ("d", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "request_id string, position int, paper_id int, title string, contexts array<string>")

    def model(prompt):
        batch = json.loads(prompt.split("Evidence:\n")[1])
        if len(batch) > 8 or any(not b["contexts"][0]["text"].strip() for b in batch):
            raise ValueError("no such batch")
        if len(batch) == 1:
            return '{"intents": [{"id": 1, "intent": "Praise"}]}' if batch[0]["title"] == "T" else "none"
        return json.dumps({"intents": [{"id": b["id"], "intent": "Background" if b["id"] % 2 else "Tool/Dataset"} for b in reversed(batch)]})

    got = {(r.request_id, r.paper_id): (r.intent, r.failed) for r in enrich.classify_intents(df, model).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", i): ("Unknown" if i % 4 == 0 else "Background" if i % 2 else "Tool/Dataset", False) for i in range(1, 25)}
    assert got["b", 1] == got["b", 2] == got["c", 1] == (None, True) and got["d", 1] == ("Unknown", False) and len(got) == len(rows)
