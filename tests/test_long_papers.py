"""Papers of more entries than the small tables have, against the SQL twins."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citewright.operators import answers, evidence
from citewright.plans.tables import table


@pytest.fixture
def lines(spark, tmp_path):
    """Writes tables with one order for each number of lines."""

    def write(*counts: int) -> str:
        day = datetime.datetime(1997, 3, 4)
        rows = [(o, (7 * k + o) % 200, k % 10, k % 7 + 1, float(k % 50 + 1), float(k), "N", "O", day) for o, n in enumerate(counts) for k in range(n)]
        schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        table(spark, "/root/testdata/sf0.001", "part").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


def differs(spark, sf, name, columns=None):
    """Rows that only the query or only its SQL gives."""
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    rows = entry.queries()[name](spark, sf)
    columns = columns or rows.columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted({tuple(r) for r in rows.select(*columns).collect()} ^ set(want))


def test_model_extraction_equals_its_sql_in_longer_papers(spark, lines):
    assert differs(spark, lines(3, 21, 75), "model_extraction") == []


def test_no_paper_is_too_long_for_a_model(spark, lines):
    assert differs(spark, lines(3, 1_100), "model_extraction") == []


def test_no_paper_is_too_long_to_recover(spark):
    said = spark.range(1_001).select(F.lit("p").alias("paper_id"), F.lit(0).alias("request"), F.col("id").alias("place"), (F.col("id") + 1).cast("int").alias("number"), F.format_string("Title %d", "id").alias("title"), F.array(F.lit("A. B")).alias("authors"), F.lit("1900").alias("year"), F.lit("10.1/x").alias("doi"), F.lit("x").alias("text"))
    printed = said.select("paper_id", "number", F.lit("A. Bcd, an entry, 1997.").alias("entry"))
    bare = said.withColumn("number", F.when(F.col("number") % 3 == 0, F.col("number")))
    for rows in (answers.merge_answers(printed, said), answers.merge_answers(printed.limit(0), bare)):
        got = rows.select("number", "refused").collect()
        assert sorted(r.number for r in got) == list(range(1, 1_002)) and not any(r.refused for r in got)


def test_numbers_left_are_told_without_a_list_of_them(spark):
    rows = spark.createDataFrame([("p", k, n) for k, n in enumerate([None, 3, 1, None, 3, 0, None, 6, None, -2])] + [("q", 0, None), ("q", 1, 1)], "paper_id string, position int, number int")
    out = evidence.allocate_ids(rows)
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.id for r in out.orderBy("paper_id", "position").collect()] == [2, 3, 1, 4, 3, 0, 5, 6, 7, -2, 2, 1]


def test_record_decision_shuffles_no_texts(spark, lines):
    sf = lines(3, 99)
    text = entry.queries()["record_decision"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1 and text.count("Aggregate") == 1  # parts; the choice
    assert differs(spark, sf, "record_decision") == []
