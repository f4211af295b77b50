"""Plans and batches of themes: the fate of each batch, papers without evidence, shapes of answers."""

import json

from citewright.operators import prompts, themes

THEMES = '{"themes": [{"id": 1, "name": "Cells"}, {"id": 2, "name": "Rivers"}]}'
SCHEMA = "request_id string, position int, paper_id long, title string, abstract string, evidence string"


def papers(spark, n=54, request="r"):
    return spark.createDataFrame([(request, i, 3 * i, f"Paper {i}", "Evidence", None) for i in range(1, n + 1)], SCHEMA)


def run(spark, df, answer, plan=THEMES):
    """Answers by the number of the batch, and all that was asked."""
    def model(prompt):
        if "Catalogue:" in prompt:
            return plan
        assert json.loads(prompt.split("Themes:\n")[1].split("\nPapers:\n")[0]) == json.loads(THEMES)["themes"]
        batch = json.loads(prompt.split("\nPapers:\n")[1])
        return answer(batch)

    out, outcome = themes.assign_themes(df, model)
    return {r.paper_id: (r.theme_id, r.theme) for r in out.collect()}, {r.request_id: r for r in outcome.collect()}


def all_to(theme):
    return lambda batch: json.dumps({"assignments": [{"id": p["id"], "theme_id": theme} for p in batch]})


def test_one_failed_batch_leaves_its_twelve(spark):
    for broken in ("no json", '{"assignments": [{"id": 999, "theme_id": 1}]}', '{"assignments": [{"id": 39, "theme_id": 7}]}', '{"assignments": [{"id": 39, "theme_id": 1}, {"id": 39, "theme_id": 1}]}', None):
        def answer(batch, broken=broken, cells=all_to(1)):
            if batch[0]["id"] != 39:
                return cells(batch)
            if broken is None:
                raise RuntimeError("status 429")
            return broken

        got, outcome = run(spark, papers(spark), answer)
        assert [k for k, v in sorted(got.items()) if v == (None, None)] == [3 * i for i in range(13, 25)] and sum(v == (1, "Cells") for v in got.values()) == 42, broken
        r = outcome["r"]
        assert (r.status, r.papers, r.batches, r.failed_batches, r.unassigned) == ("done", 54, 5, [2], 12)


def test_nulls_missing_and_unknown_papers(spark):
    df = papers(spark, 14).union(spark.createDataFrame([("r", 99, 300, " ", None, None), ("none", 1, 1, None, "", None), ("none", 2, 2, "", None, None)], SCHEMA))
    got, outcome = run(spark, df, lambda batch: json.dumps([{"paper_id": str(p["id"]), "theme": "rivers" if p["id"] % 2 else None} for p in batch if p["id"] != 9]))
    assert {k for k, v in got.items() if v == (2, "Rivers")} == {3, 15, 21, 27, 33, 39} - {27} | {27} and got[300] == got[9] == (None, None)
    assert (outcome["none"].status, outcome["none"].batches, outcome["none"].unassigned) == ("no evidence", 0, 2) and outcome["r"].batches == 2 and outcome["r"].failed_batches == []


def test_a_plan_that_cannot_be_read_stops(spark):
    def never(batch):
        raise AssertionError("no batch may be sent")

    got, outcome = run(spark, papers(spark, 13), never, plan='{"themes": []}')
    assert set(got.values()) == {(None, None)} and (outcome["r"].status, outcome["r"].batches, outcome["r"].unassigned) == ("no plan", 0, 13)


def test_batches_keep_to_their_room(spark):
    rows = [("r", i, i, "t" * 1200, "é\"" * 4000, None) for i in range(1, 41)] + [("s", i, i, "t", "a", None) for i in range(1, 26)]
    got = {}
    for r in themes.evidence_batches(spark.createDataFrame(rows, SCHEMA)).orderBy("request_id", "position").collect():
        got.setdefault((r.request_id, r.batch), []).append(json.loads(r.shown))
    sizes = {k: len(json.dumps(v, ensure_ascii=False)) for k, v in got.items()}
    assert max(sizes.values()) <= 7000 and [len(got["s", k]) for k in range(3)] == [12, 12, 1] and all(len(got["r", k]) > 6 for k in range(3))
    for k in range(3):  # one more paper wouldn't have fitted
        assert len(got["r", k]) == 12 or len(json.dumps([*got["r", k], got["r", k + 1][0]], ensure_ascii=False)) > 7000


def test_each_request_has_its_own_themes(spark):
    named = spark.createDataFrame([("a", 1, "Cells"), ("b", 1, "Rivers")], "request_id string, theme_id int, name string")
    answers = [("a", '{"groups": [{"id": 1, "name": "cells", "ids": [7]}]}'), ("b", '{"groups": [{"id": 1, "name": "Cells", "ids": [7]}]}')]
    got = prompts.read_assignments(spark.createDataFrame(answers, "request_id string, answer string"), named).collect()
    assert [(r.request_id, r.paper_id, r.theme_id) for r in got] == [("a", 7, 1)]
