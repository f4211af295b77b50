"""Joins without a common key against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citewright.operators import decide, matching


def keys(rng, n, letters, lo, hi):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi))) for _ in range(n)]
    out = list(base)
    for k in base:
        for _ in range(2):
            s = list(k)
            for _ in range(rng.randrange(0, max(2, len(s) // 7))):
                at = rng.randrange(len(s))
                kind = rng.randrange(3)
                s[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice(letters)]
            at = rng.randrange(len(s))
            out.append("".join(s if rng.random() < 0.8 else s[at:] + s[:at]))
    return out


@pytest.mark.parametrize("least", [0.88, 0.93, 0.7])
def test_like_keys_lose_no_pair(spark, least):
    """Short and long keys, few letters and many, repeated grams, and keys whose frequent letters are passed over."""
    rng = random.Random(int(least * 100))
    some = keys(rng, 25, "abcdefgh0", 8, 14) + keys(rng, 25, "abcdefghijklmnopqrstuvwxyzé", 10, 60) + keys(rng, 6, "ab", 8, 30) + keys(rng, 4, "abcdefghijklmnopqrstuvwxyz0123456789", 190, 260)
    left = sorted({k for k in some[::2] if len(k) >= 8}) + ["a" * 12, "日本語の題名です長い"]
    right = sorted({k for k in some[1::2] if len(k) >= 8}) + ["a" * 13, "日本語の題名です長"]
    got = {(r.ka, r.kb): r.ratio for r in matching.like_keys(spark.createDataFrame([(k,) for k in left], "ka string"), spark.createDataFrame([(k,) for k in right], "kb string"), least).collect()}
    want = {(a, b): r for a in left for b in right if min(len(a), len(b)) >= 8 and (r := SequenceMatcher(None, a, b).ratio()) >= least}
    assert got == want and len(want) > 30


def test_fuzzy_titles(spark):
    refs = spark.createDataFrame([(1, "On the Shape of Rivers!"), (2, "On the shapes of river"), (3, "short"), (4, None), (5, "Quite another thing altogether"), (6, "on the shape of rivers")], "ref_id int, title string")
    works = spark.createDataFrame([(9, "On the shape of rivers"), (7, "On the Shape of Rivers."), (8, "On the shape of rives"), (6, "short"), (5, None)], "work_id int, title string")
    got = {r.ref_id: (r.work_id, r.ratio) for r in matching.fuzzy_titles(refs, works).collect()}
    assert set(got) == {1, 2, 6} and got[1] == got[6] == (7, 1.0) and got[2][0] == 7
    assert matching.fuzzy_titles(refs.where("false"), works).count() == 0 and matching.fuzzy_titles(refs, works.where("false")).count() == 0


def test_contained_titles(spark):
    rng = random.Random(6)
    words = ["of", "rivers", "Étude", "deep", "x1", "the", "learning", "systems", "größe"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    titles = [(i, say(rng.randrange(1, 7))) for i in range(60)] + [(100, None), (101, ""), (102, "the the the the the the the")]
    titles += [(200 + i, t) for i, t in titles[:5]]
    cites = [(i, f"A. Doe, {say(3)} {rng.choice(titles)[1]}, {say(4)} 12 (2001) 3.") for i in range(80)] + [(90, None), (91, ""), (92, titles[0][1].replace(" ", " -- ").upper())]
    got = sorted((r.ref_id, r.work_id) for r in matching.contained_titles(spark.createDataFrame(cites, "ref_id int, citation string"), spark.createDataFrame(titles, "work_id int, title string")).collect())
    key = lambda s: re.sub(r"[\W_]+", "", s or "").lower()
    want = sorted((r, w) for r, c in cites for w, t in titles if len(key(t)) >= 15 and key(t) in key(c))
    assert got == want and len(want) > 40


PLACES = [
    ("A. Stone, J. Power Sources 45 (1998) 101-109.", "45", "101-109", True), ("A. Stone, J. Power Sources 45 (1998) 101-109.", "45", "109", False), ("A. Stone, J. Power 1998, 45(3), p. 101.", "45", "101", True),
    ("A. Stone, Nature 45 (3) (1998): 101", "45", "101", True), ("A. Stone, Nature [45] 101 (1998)", "45", "101", False), ("A. Stone, Nature 45, e101.", "45", "E101", True), ("A. Stone, Nature 45, pp101-3.", "45", "101", True),
    ("A. Stone, Nature 145, 101.", "45", "101", False), ("A. Stone, Nature 45, 1011.", "45", "101", False), ("A. Stone, Nature 45 1998; 101.", "45", "101", True), ("A. Stone, 101, Nature 45.", "45", "101", False),
    ("A. Stone, Nature 1998, 101.", "1998", "101", False), ("A. Stone, Nature Suppl 2 (1998) 101.", "Suppl 2", "101", True), ("A. Stone, Nature Part 2 (1998) 101.", "Suppl 2", "101", False), ("A. Stone, Nature 45 (a; b) 101.", "45", "101", False),
    ("A. Stone, Nature 45, 101.", None, "101", False), ("A. Stone, Nature 45, 101.", "45", None, False), ("A. Stone, Nature 45, S101–S109.", "45", "S101–S109", True), (None, "45", "101", False), ("", "45", "101", False),
]


def test_places(spark):
    rows = [(i, c, "1998", "stone", v, p) for i, (c, v, p, _) in enumerate(PLACES)]
    df = spark.createDataFrame(rows, "ref_id int, citation string, year string, family string, volume string, first_page string")
    works = df.select(F.col("ref_id").alias("work_id"), "year", "family", "volume", "first_page")
    met = {(r.ref_id, r.work_id) for r in matching.match_coordinates(df.select("ref_id", "citation", "year", "family"), works).collect()}
    assert [(i, i) in met for i in range(len(PLACES))] == [x[3] for x in PLACES]
    other = works.withColumn("family", F.lit("wood")).union(works.withColumn("year", F.lit("1999")))
    assert matching.match_coordinates(df.select("ref_id", "citation", "year", "family"), other).count() == 0


def test_decide_by_place(spark):
    """A reference without title is found by year, family, place and journal together; each of them alone can reject."""
    cite = "Stone, A., J. Power Sources 45 (1998) 101-109."
    sound = {"work_year": "1998", "families": ["Stone"], "volume": "45", "page": "101-109", "journal": "Journal of Power Sources", "score": 40.0}
    wrong = [{}, {"work_year": "1999"}, {"families": ["Wood"]}, {"volume": "46"}, {"page": "109"}, {"journal": "Nature Physics"}, {"score": 30.0}, {"volume": None}, {"families": None}]
    rows = [(i, "crossref", 1, i, None, "A work of some other name", *(sound | w).values()) for i, w in enumerate(wrong)]
    candidates = spark.createDataFrame(rows, "ref_id int, provider string, position int, work_id int, doi string, work_title string, work_year string, families array<string>, volume string, page string, journal string, score double")
    refs = spark.createDataFrame([(i, cite, None, "1998") for i in range(len(wrong))], "ref_id int, citation string, title string, year string")
    assert [r.ref_id for r in decide.decide(refs, candidates).collect()] == [0]
