"""Rows that repeat id and text: the queries return one row for each, as their SQL does."""

import duckdb

from citewright.llm import queries


def test_op1_repeated_rows_equal_sql(spark, tmp_path):
    rows = [(3, "t"), (3, "t"), (4, "t"), (3, "u"), (None, None), (None, ""), (5, ""), (5, None), (6, "alone"), (7, "twice"), (7, "twice"), (7, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = queries.op1_exact_dedup(spark, str(tmp_path)).select(*names).where("doc_id is not null").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op1_exact_dedup']}) WHERE doc_id IS NOT NULL").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 10
