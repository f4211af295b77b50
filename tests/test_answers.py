"""A model's rows against printed entries, and reference lists with aliases, in cases each rule decides."""

from citewright.operators import answers, prompts, resolve

SCHEMA = "paper_id string, request int, place int, number int, title string, authors array<string>, year string, doi string, text string"


def row(paper, place, number, title=None, authors=None, year="2014", doi=None, text="x", request=0):
    return (paper, request, place, number, title, authors, year, doi, text)


def merged(spark, printed, rows):
    out = answers.merge_answers(spark.createDataFrame(printed, "paper_id string, number int, entry string"), spark.createDataFrame(rows, SCHEMA))
    return {(r.paper_id, r.number): r for r in out.collect()}


def test_printed_entries_decide(spark):
    printed = [("p", k, f"A. Stone, On the state of thing {k}, J. Power Sources {k} (201{k}) 10. doi:10.1000/Ab{k}.") for k in range(1, 8)]
    rows = [
        row("p", 0, 1, "Title one", ["M"], doi="https://doi.org/10.1000/aB1"), row("p", 1, 1, "TITLE: one!", ["N"]), row("p", 2, 2, "Title two", doi="10.1000/other"), row("p", 3, 2, "Else"),
        row("p", 0, None, "By text", text=printed[2][2].upper() + " !", request=1), row("p", 1, 99, "Nobody printed it", request=1), row("p", 2, 4, None, None, None, "nonsense", None, request=1), row("p", 3, None, "No such text", request=1),
        row("p", 4, 5, "", text="One reading", request=1), row("p", 5, 5, "", text="Other reading", request=1), row("p", 6, 6, "Later request wins nothing", request=1), row("p", 9, 6, "later REQUEST wins nothing", year="1900"),
    ]
    got = merged(spark, printed, rows)
    assert sorted(got) == [("p", k) for k in range(1, 8)] and not any(r.refused for r in got.values())
    assert (got["p", 1].title, got["p", 1].authors, got["p", 1].doi, got["p", 1].fallback) == ("Title one", ["M"], "10.1000/aB1", False)
    assert (got["p", 2].title, got["p", 2].year, got["p", 2].doi, got["p", 2].authors, got["p", 2].fallback) == ("On the state of thing 2", "2012", "10.1000/Ab2", [], True)
    assert (got["p", 3].title, got["p", 3].doi, got["p", 3].fallback) == ("By text", None, False)
    assert (got["p", 4].title, got["p", 4].year, got["p", 4].doi, got["p", 4].fallback) == ("", None, None, False)
    assert got["p", 5].fallback and got["p", 7].fallback and got["p", 7].title == "On the state of thing 7"
    assert (got["p", 6].title, got["p", 6].year) == ("later REQUEST wins nothing", "1900")


def test_without_printed_entries(spark, monkeypatch):
    rows = [
        row("q", 0, 2, "Two", ["A"]), row("q", 1, None, "Free", ["A"]), row("q", 2, None, "FREE!", ["A"]), row("q", 3, None, "Free", ["B"]), row("q", 4, None, "Two", ["A"]), row("q", 5, 2, "two", ["C"]), row("q", 6, None, None, doi="10.1000/in", text="text with 10.1000/IN"),
        row("r", 0, 1, "One"), row("r", 1, 1, "Else"), row("s", 0, None, "Before", ["A"]), row("s", 1, 4, "before", ["A"]),
    ]
    got = merged(spark, [], rows)
    q = {k[1]: (r.title, r.authors) for k, r in got.items() if k[0] == "q"}
    assert q == {2: ("Two", ["A"]), 1: ("Free", ["A"]), 3: ("Free", ["B"]), 4: ("", [])} and got["q", 4].doi == "10.1000/in"
    assert [r.refused for k, r in got.items() if k[0] == "r"] == [True] and ("r", None) in got
    assert {k[1]: r.title for k, r in got.items() if k[0] == "s"} == {1: "Before", 4: "before"}
    monkeypatch.setattr(answers, "MOST", 3)
    assert merged(spark, [], rows)["q", None].refused and merged(spark, [], []) == {}


def test_failed_requests_fall_back(spark):
    printed = spark.createDataFrame([("p", k, k, f"A. Stone, A title of some length, J. Power Sources {k} (2014) 10.") for k in range(1, 8)], "paper_id string, position int, number int, entry string")

    def model(prompt):
        if '"number":1' in prompt:
            raise RuntimeError("status 500")
        return '{"references": [{"number": "7", "text": null, "title": "Seven", "authors": ["M"], "year": 2014}]}'

    got = {r.number: (r.title, r.year, r.fallback) for r in prompts.extract_references(printed, model).collect()}
    assert got == {k: ("A title of some length", "2014", True) for k in range(1, 7)} | {7: ("Seven", "2014", False)}


def test_reference_lists_with_aliases(spark):
    rows = [
        # a title answers for the identifier that comes later, and for rows that have only that
        ("a", 0, 0, None, "One Title", "1999", "short"), ("a", 0, 1, "10.1/A", "one title!", None, "a longer text"), ("a", 1, 0, "https://doi.org/10.1/a", None, "2001", "mid text"), ("a", 1, 1, "10.1/b", None, None, "other"),
        # a row of two known names is the first name's row, and takes no name from the other row
        ("b", 0, 0, "10.1/a", None, None, "x"), ("b", 0, 1, None, "T", None, "y"), ("b", 0, 2, "10.1/a", "T", None, "xxx"), ("b", 0, 3, None, "T", "1990", "zz"),
        # rows without either go by their text
        ("c", 0, 0, None, None, None, "Some text"), ("c", 0, 1, "", "", None, "some TEXT."), ("c", 0, 2, None, None, None, None), ("c", 1, 0, None, None, None, ""),
        # nothing behind the row that reaches the limit is read
        *[("d", 0, k, f"10.1/{k}", None, None, str(k)) for k in range(5)], ("d", 1, 0, "10.1/0", "Late title", None, "a long late text"),
    ]
    df = spark.createDataFrame(rows, "paper_id string, source_rank int, position int, doi string, title string, year string, text string").repartition(3)
    got = {}
    for r in resolve.merge_references(df, limit=4).orderBy("paper_id", "number").collect():
        got.setdefault(r.paper_id, []).append((r.number, r.doi, r.title, r.year, r.text))
    assert got["a"] == [(1, "10.1/A", "One Title", "1999", "a longer text"), (2, "10.1/b", None, None, "other")]
    assert got["b"] == [(1, "10.1/a", "T", None, "xxx"), (2, None, "T", "1990", "zz")]
    assert got["c"] == [(1, None, None, None, "some TEXT."), (2, None, None, None, "")]
    assert got["d"] == [(k + 1, f"10.1/{k}", None, None, str(k)) for k in range(4)]
