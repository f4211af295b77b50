"""Every registered query against its SQL twin in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from citewright.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_fuzzy_titles_equal_all_pairs(spark):
    """The whole query at the smallest size against every pair of distinct keys."""
    from difflib import SequenceMatcher

    from citewright.functions.text import compact_key
    from citewright.operators import matching

    taken = {}
    keep, matching.fuzzy_titles = matching.fuzzy_titles, lambda a, b: taken.update(a=a, b=b) or keep(a, b)
    try:
        got = {r.ref_id: (r.work_id, round(r.ratio, 9)) for r in catalogue.QUERIES["fuzzy_title_match"](spark, DATA).collect()}
    finally:
        matching.fuzzy_titles = keep
    keys = lambda df, i: [(r[0], r[1]) for r in df.select(i, compact_key(df["title"])).collect()]
    first = {}
    for w, k in sorted(keys(taken["b"], "work_id")):
        first.setdefault(k, w)
    best, want = {}, {}
    for r, k in keys(taken["a"], "ref_id"):
        if k not in best:
            near = [(-SequenceMatcher(None, k, x).ratio(), w) for x, w in first.items() if 2 * min(len(k), len(x)) >= 0.88 * (len(k) + len(x))]
            best[k] = min(near, default=(0, None))
        if best[k][0] <= -0.88:
            want[r] = (best[k][1], round(-best[k][0], 9))
    assert got == want and len(want) > 300


def test_entry_point(spark):
    assert entry.entry(spark).columns == ["owner", "key", "sessions", "title"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
