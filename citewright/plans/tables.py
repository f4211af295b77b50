"""The bibliography views over the driver's tables: orders cite parts, suppliers provide records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, LETTERS = "0123456789", "abcdefghij"

#: The same views for DuckDB; every oracle starts with them.
REFS_SQL = """refs AS (
  SELECT l_orderkey AS paper_id, l_linenumber AS number, l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity,
         CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE '10.' || CAST(1000 + l_partkey % 9000 AS VARCHAR) || '/Part.' || CAST(l_partkey AS VARCHAR) END AS doi,
         p_name || ' for ' || lower(p_type) || ' systems' AS title, CAST(year(l_shipdate) AS VARCHAR) AS year,
         upper(substr(translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij'), 1, 1)) || substr(translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij'), 2) || 'son' AS family,
         CAST(l_partkey % 90 + 10 AS VARCHAR) AS volume, CAST(CAST(l_quantity AS INT) * 10 + 1 AS VARCHAR) AS first_page,
         l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS shipped
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cited AS (
  SELECT *, 'A. ' || family || ', ' || title || ', J. Power Sources ' || volume || ' (' || year || ') ' || first_page || '-' || CAST(CAST(quantity AS INT) * 10 + 9 AS VARCHAR) || '.' AS citation,
         row_number() OVER (PARTITION BY paper_id ORDER BY number, part, supp, quantity, price, shipped) AS position FROM refs)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _printed(rows: DataFrame, *more: str) -> DataFrame:
    family = F.translate(F.col("l_suppkey").cast("string"), DIGITS, LETTERS)
    part = F.col("l_partkey").cast("string")
    return rows.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("10."), (F.lit(1000) + F.col("l_partkey") % 9000).cast("string"), F.lit("/Part."), part)).alias("doi"),
        F.concat("p_name", F.lit(" for "), F.lower("p_type"), F.lit(" systems")).alias("title"), F.year("l_shipdate").cast("string").alias("year"),
        F.concat(F.upper(F.substring(family, 1, 1)), F.substring(family, 2, 20), F.lit("son")).alias("family"),
        (F.col("l_partkey") % 90 + 10).cast("string").alias("volume"), (F.col("l_quantity").cast("int") * 10 + 1).cast("string").alias("first_page"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipped"), *more,
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(_items(spark, sf_dir))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with their place in the paper. The items are placed as they are; what is printed of them is made behind the shuffle."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = _printed(_items(spark, sf_dir).withColumn("position", F.row_number().over(order)), "position")
    text = F.concat(
        F.lit("A. "), "family", F.lit(", "), "title", F.lit(", J. Power Sources "), "volume", F.lit(" ("), "year", F.lit(") "), "first_page", F.lit("-"),
        (F.col("quantity").cast("int") * 10 + 9).cast("string"), F.lit("."),
    )
    return rows.select(*[c for c in rows.columns if c != "position"], text.alias("citation"), "position")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of papers, a paper for each source."""
    from ..operators.segment import page_lines

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_no"), "text")
    return page_lines(docs)


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a paper of three pages, with a header on each and page numbers: a body, then a bibliography over two pages. Entries
    are wrapped lines; even papers have bracketed labels, every third of them alone on a line, odd ones none. An appendix
    follows in every third paper, and every fifth paper's heading is numbered."""
    rows = cited(spark, sf_dir)
    n = F.col("position")
    numbered = F.col("paper_id") % 2 == 0
    label = F.when(numbered, F.concat(F.lit("["), n.cast("string"), F.lit("]"), F.when(n % 3 == 0, "\n").otherwise(" "))).otherwise("")
    wrapped = F.concat(label, F.regexp_replace("citation", ", J. Power", ",\nJ. Power"))
    papers = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", wrapped.alias("entry")))).alias("e"))
    half = F.ceil(F.size("e") / 2).cast("int")
    lines = lambda e: F.array_join(F.transform(e, lambda x: x["entry"]), "\n")
    head = F.concat(F.lit("Proceedings on  Systems "), (F.col("paper_id") % 9).cast("string"), F.lit("\n"))
    title = F.when(F.col("paper_id") % 5 == 0, "7. References").otherwise("REFERENCES:")
    texts = F.array(
        F.concat(head, F.lit("Body of paper "), F.col("paper_id").cast("string"), F.lit("\n\n1")),
        F.concat(head, title, F.lit("\n"), lines(F.slice("e", F.lit(1), half)), F.lit("\n2")),
        F.concat(head, lines(F.slice("e", half + 1, F.size("e"))), F.lit("\n3\n"), F.when(F.col("paper_id") % 3 == 0, "Appendix A\n[99] B. Behind, no entry of the list, 1999.").otherwise("")),
    )
    return papers.select("paper_id", F.posexplode(texts).alias("page_no", "text"))


LINES_SQL = r"""lines AS (
  SELECT paper_id, page_no, line FROM (SELECT source AS paper_id, doc_id AS page_no, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
keyed AS (SELECT *, lower(trim(regexp_replace(line, '[\s\x{a0}]+', ' ', 'g'))) AS key FROM lines),
counted AS (SELECT paper_id, count(DISTINCT page_no) AS pages FROM lines GROUP BY paper_id),
heads AS (
  SELECT paper_id, key, n_pages FROM (SELECT paper_id, key, count(*) AS n_pages FROM (SELECT DISTINCT paper_id, page_no, key FROM keyed WHERE key <> '') GROUP BY ALL)
  JOIN counted USING (paper_id) WHERE n_pages >= greatest(3, (pages + 3) // 4))"""
