"""Steps that once read their input, or a model's answers, several times."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citewright.functions import folds
from citewright.operators import answers, decide, matching, packing, prompts, resolve, sections, segment


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(20))
def test_placed_equals_batch_starts(seed):
    rng = np.random.default_rng(seed)
    sizes, alone, taken = rng.integers(0, 9, 60), rng.random(60) < 0.1, int(rng.integers(0, 4))
    begins = np.zeros(60, int)
    begins[packing.batch_starts(packing.next_starts(sizes, alone, 12, 3), taken)] = 1
    assert packing._placed(sizes.tolist(), alone.tolist(), taken, 6, 12, 3) == (6 + np.cumsum(begins)).tolist()


def test_answers_are_read_once_where_all_papers_are_printed(spark):
    said = spark.range(4).select(F.lit(1).alias("paper_id"), F.lit(0).alias("request"), F.col("id").alias("place"), F.col("id").cast("int").alias("number"), F.lit("T").alias("title"), F.array(F.lit("A. B")).alias("authors"), F.lit("1900").alias("year"), F.lit("10.1/x").alias("doi"), F.lit("x").alias("text"))
    out = answers.merge_answers(spark.createDataFrame([(1, 2, "A. Bcd, an entry, 1997.")], "paper_id int, number int, entry string"), said)
    assert plan(out).count("Range (") <= 2
    assert [(r.title, r.fallback) for r in out.collect()] == [("T", False)]


def test_model_answers_are_parsed_once(spark):
    printed = spark.createDataFrame([(1, k, k, f"A. Bcd, entry number {k}, J. Power Sources 4 (1997) 1-2.") for k in range(1, 9)], "paper_id int, position int, number int, entry string")
    out = prompts.extract_references(printed, lambda p: '{"references": [{"number": 2, "text": "x", "title": "T", "year": "1900"}]}')
    assert "from_json" not in plan(out) and "mapInPandas" not in plan(out)
    assert sorted((r.number, r.fallback) for r in out.collect()) == [(k, k != 2) for k in range(1, 9)]


def test_lines_are_read_once_for_headers(spark):
    lines = spark.range(8).select(F.lit(1).alias("paper_id"), F.col("id").alias("page_no"), F.lit(0).alias("line_no"), F.lit(" A  Header").alias("line"))
    for out in (segment.running_headers(lines), segment.with_repeated(lines)):
        assert plan(out).count("Range (") == 1
    assert segment.with_repeated(lines).where("repeated").count() == 8


def test_following_line_is_not_searched_anew_for_each_line(spark):
    lines = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(["A", "", "", "B", ""])], "paper_id int, page_no int, line_no int, line string")
    assert "unboundedfollowing" not in plan(sections.marked(lines)).lower()


def test_titles_are_rated_beside_their_rows(spark):
    refs = spark.createDataFrame([(1, "A. Bcd, Learning to parse things well, J. 4 (1997) 1.", "Learning to parse things well", "1997")], "ref_id int, citation string, title string, year string")
    found = spark.createDataFrame([(1, "openalex", 1, w, None, t, "1997", ["Bcd, A."], "4", "1", "J.", None) for w, t in ((5, "Rivers of the north and south"), (6, "Learning to parse thing well"))], "ref_id int, provider string, position int, work_id int, doi string, work_title string, work_year string, families array<string>, volume string, page string, journal string, score double")
    out = decide.decide(refs, found)
    assert plan(out).count("Join ") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "openalex", 6)]


def test_a_title_of_many_works_is_met_once(spark):
    refs = spark.createDataFrame([(k, f"A. Bcd, a title of some works, J. {k}.") for k in range(5)], "ref_id int, citation string")
    works = spark.range(50).select(F.col("id").alias("work_id"), F.lit("A title of some works").alias("title"))
    assert matching.contained_keys(refs, works.select(matching.compact_key(F.col("title")).alias("key"))).count() == 5
    assert matching.contained_titles(refs, works).count() == 250


def test_references_without_identifier_are_dealt_out(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        refs = spark.range(400).select(F.col("id").alias("ref_id"), F.when(F.col("id") < 4, F.concat(F.lit("10.1/"), F.col("id").cast("string"))).alias("doi"))
        works = spark.createDataFrame([(7, "https://doi.org/10.1/3"), (8, None)], "work_id int, doi string")
        out = resolve.join_by_doi(refs, works)
        assert out.columns == ["ref_id", "doi", "work_id"] and out.where("work_id is not null").count() == 1 and out.count() == 400
        assert out.where("doi is null").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_are_read_once_for_both_ways_of_labels(spark):
    lines = spark.createDataFrame([(1, 0, k, x) for k, x in enumerate(["[1] Bracketed entry of the first, 1999.", "(2023) goes on in the first.", "[2] Bracketed entry of the second, 2001."])] + [(2, 0, 0, "1. Plain entry of the year 1999 alone.")], "paper_id int, start int, at int, line string")
    out = sections.numbered(lines)
    assert "Join" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 1, "Bracketed entry of the first, 1999. (2023) goes on in the first."), (1, 0, 2, "Bracketed entry of the second, 2001."), (2, 0, 1, "Plain entry of the year 1999 alone.")]


def test_shared_references_need_no_join(spark):
    from citewright.operators import workspace

    rows = spark.createDataFrame([("o", 1, "10.1/A", "A long title of a paper"), ("o", 2, None, "A long title -- of a paper"), ("o", 2, None, "short"), ("p", 3, "10.1/a", "A long title of a paper")], "owner string, session_id int, doi string, title string")
    out = workspace.shared_references(rows)
    assert "Join" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("o", "10.1/a", 2, "a long title of a paper")]


def test_names_of_lists_are_made_behind_the_sort(spark):
    rows = spark.createDataFrame([("p", 0, 0, "10.1/A", None, None, "x")], "paper_id string, source_rank int, position int, doi string, title string, year string, text string")
    above, below = plan(resolve.merge_references(rows)).split("Sort [")
    assert "doi_name" in above and "regexp_replace" in above and "regexp_replace" not in below


@pytest.mark.parametrize("seed", range(20))
def test_lists_merged_at_once_equal_the_fold(seed):
    """Rows of few names, cut into batches anywhere: chains of aliases, papers over several batches, limits within and beyond them."""
    rng = np.random.default_rng(seed)
    some = lambda sign, few: None if rng.random() < 0.2 else "" if rng.random() < 0.2 else f"{sign}{rng.integers(few)}"
    rows, limit, few = [], int(rng.integers(1, 7)), int(rng.integers(1, 14))
    for paper in [None, *range(int(rng.integers(1, 30)))]:
        for _ in range(int(rng.integers(1, 25))):
            doi, title, year, text = some("D", few), some("T", few), some("", 9), some("\u00e9" * int(rng.integers(3)) + "x", few)
            rows.append((paper, doi, title, year, text, "d" + doi if doi else None, "t" + title if title else None, None if doi or title else "x" + (text or "")))
    want = [(paper, *got) for paper, group in itertools.groupby(rows, lambda r: r[0]) for got in resolve.merged((r[1:] for r in group), limit)]
    cuts = [0, *sorted(rng.integers(0, len(rows) + 1, 8).tolist()), len(rows)]
    kinds = [pa.int64(), *[pa.string()] * 7]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], t) for k, t in enumerate(kinds)], names=list("pdtyxabc")) for a, b in itertools.pairwise(cuts)]
    streamed = []
    fold = lambda r: streamed.append(0) or resolve.merged(r, limit)
    out = folds.folded(iter(batches), fold, lambda b, papers: resolve.merged_at_once(b, papers, limit), ["paper_id", "number", "doi", "title", "year", "text"], [pa.int32(), *[pa.string()] * 4])
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    assert len(streamed) <= len(batches)  # a paper for each batch at most is folded row by row


def test_candidates_beside_their_references_meet_them_without_a_shuffle(spark):
    refs = spark.createDataFrame([(1, "A. Bcd, J. Power Sources 4 (1997) 11.", None, "1997")], "ref_id int, citation string, title string, year string")
    schema = "ref_id int, provider string, position int, work_id int, doi string, work_title string, work_year string, families array<string>, volume string, page string, journal string, score double"
    found = spark.createDataFrame([(1, p, n, w, d, "Rivers of the north", "1997", ["Bcd, A."], "4", "11", "Journal of Power Sources", 40.0) for p, n, w, d in (("openalex", 1, 5, None), ("openalex", 6, 4, None), ("crossref", 1, 6, "10.1/A"), ("crossref", 2, 7, "10.1/a"))], schema)
    beside = refs.join(found.groupBy("ref_id").agg(F.collect_list(F.struct(*found.columns[1:])).alias("candidates")), "ref_id").localCheckpoint()
    out = decide.decide(beside)
    assert "Join" not in plan(out) and plan(out).count("Aggregate") == 1
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in decide.decide(refs, found).collect()) == [(1, "crossref", 6), (1, "openalex", 5)]
    other = beside.withColumn("candidates", F.transform("candidates", lambda c: c.withField("doi", F.concat(F.lit("10.1/"), c["work_id"].cast("string")))))
    assert [tuple(r) for r in decide.decide(other).collect()] == [(1, "openalex", 5)]  # two identities
