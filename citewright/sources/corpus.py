"""Scans and sinks: document files, page text from an injected decoder, sessions, BibTeX, JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_BYTES = 50 << 20
HISTORY = {"format": "citewright-history", "version": 1, "most": 50, "file": 16 << 20, "room": 8 << 20}


def scan_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Files (path, sha, length, content) that start as PDF and aren't too large, each content once: the first path stays."""
    rows = spark.read.format("binaryFile").load(path).where((F.col("length") <= most) & (F.col("length") > 0))
    rows = rows.where(F.substring("content", 1, 5) == F.lit(b"%PDF-")).withColumn("sha", F.sha2("content", 256))
    order = W.partitionBy("sha").orderBy("path")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("path", "sha", "length", "content")


def decode_pages(files: DataFrame, decoder: Callable[[bytes], list[str]], least: int = 30) -> DataFrame:
    """(paper_id, page_no, text) by an injected decoder; papers with under ``least`` characters besides blanks are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(decoder(c))]
            yield pd.DataFrame(rows, columns=["paper_id", "page_no", "text"])

    pages = files.select("path", "content").mapInPandas(run, "paper_id string, page_no int, text string")
    sizes = pages.groupBy("paper_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("n")).where(F.col("n") >= least)
    return pages.join(sizes.select("paper_id"), "paper_id", "left_semi")


#: What a decoder's failure means by the word it begins with; others are "broken".
FAILURES = ("encrypted", "empty")
DECODED = "path string, kind string, page_no int, text string, title string, author string"


def decode_documents(files: DataFrame, decoder: Callable[[bytes], dict], least: int = 30) -> DataFrame:
    """Files (path, content) to one table of (path, kind, page_no, text, title, author), each file decoded once: a "page" row for each
    page, a "link" row for each internal link, with its destination as text, and one "document" row with title, author and, as
    text, its status.

    The injected decoder gives {"pages": [text], "links": [(page_no, destination)], "title", "author"}; what is missing or null is
    empty. Where it raises, the status is the first word of its message if that is one of FAILURES, else "broken"; where the pages hold
    under ``least`` characters besides blanks, "scanned"; else "parsed". Only parsed files have pages and links; no file fails
    another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = decoder(content) or {}
                    pages, links = [t or "" for t in found.get("pages") or []], found.get("links") or []
                    status = "parsed" if len("".join("".join(pages).split())) >= least else "scanned"
                except Exception as e:  # the file's failure is its row's result
                    word = (str(e).split() or [""])[0].lower().strip(".,:;")
                    found, pages, links, status = {}, [], [], word if word in FAILURES else "broken"
                rows = [(path, "document", None, status, found.get("title"), found.get("author"))]
                if status == "parsed":
                    rows += [(path, "page", i, t, None, None) for i, t in enumerate(pages)] + [(path, "link", i, d, None, None) for i, d in links if d]
                yield pd.DataFrame(rows, columns=["path", "kind", "page_no", "text", "title", "author"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, DECODED)


def linked_number(destination: Column) -> Column:
    """The reference that an internal link's destination names at its end, as "cite.bib7" or "Reference12" do, else null."""
    figures = F.regexp_extract(destination, "([0-9]{1,9})$", 1)
    word = F.regexp_replace(F.lower(destination), "[0-9]+$", "")
    return F.when((figures != "") & (F.endswith(word, F.lit("bib")) | F.endswith(word, F.lit("reference"))), figures.cast("int"))


def link_counts(links: DataFrame, valid: DataFrame) -> DataFrame:
    """(paper_id, text: destinations) with the references there are (paper_id, number) to (paper_id, number, citations)."""
    named = links.select("paper_id", linked_number(F.col("text")).alias("number")).where("number is not null")
    return named.join(valid.select("paper_id", "number").distinct(), ["paper_id", "number"], "left_semi").groupBy("paper_id", "number").agg(F.count("*").alias("citations"))


def evaluate(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Extraction counts (sha, found) against expected ones; count_matches is null where none is known."""
    return report.join(expected, "sha", "left").withColumn("count_matches", F.when(F.col("expected").isNotNull(), F.col("found") == F.col("expected")))


def corpus_summary(report: DataFrame) -> DataFrame:
    """One row of a report (sha, status, count_matches, gaps): distinct files, those parsed, checks made and passed, and whether the run
    passes, as no check failed."""
    counts = report.agg(
        F.countDistinct("sha").alias("unique_files"), F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.count("count_matches").alias("exact_count_checks"), F.count_if("count_matches").alias("checks_passed"),
    )
    return counts.withColumn("passes", F.col("checks_passed") == F.col("exact_count_checks"))


def document_metadata(raw: DataFrame) -> DataFrame:
    """(paper_id, title, author) as a decoder reads them to title and authors: names a program gives aren't titles, authors are
    parted by semicolons, 40 at most; what is missing is empty."""
    title = F.trim(F.coalesce("title", F.lit("")))
    names = F.filter(F.transform(F.split(F.coalesce("author", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    # Titles programs give
    return raw.select("paper_id", F.when(F.lower(title).isin("untitled", "microsoft word"), "").otherwise(F.left(title, F.lit(1200))).alias("title"), F.slice(names, 1, 40).alias("authors"))


def export_sessions(sessions: DataFrame, path: str) -> None:
    head = [F.lit(HISTORY["format"]).alias("format"), F.lit(HISTORY["version"]).alias("version")]
    sessions.select(*head, "*").write.mode("overwrite").json(path)


def import_sessions(spark: SparkSession, path: str, schema: str, held: DataFrame | None = None) -> DataFrame:
    """Valid exported sessions merged with those held: an imported one replaces one of its id. If they are more than "most" of HISTORY,
    their file is larger than "file", or what would be held is too many or more than "room" bytes of JSON, the import is
    refused and those held stay as they are; that is decided inside the plan, by one row of counts."""
    rows = spark.read.schema(f"format string, version int, {schema}").json(path)
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("file"))
    good = (F.col("format") == HISTORY["format"]) & (F.col("version") == HISTORY["version"]) & F.col("session_id").isNotNull() & F.try_to_timestamp("saved_at").isNotNull()
    sound = rows.agg(F.every(F.coalesce(good, F.lit(False))).alias("sound"), F.count("*").alias("n"))
    rows = rows.drop("format", "version").dropDuplicates(["session_id"])
    old = held if held is not None else spark.createDataFrame([], rows.schema)
    merged = old.join(rows.select("session_id"), "session_id", "left_anti").unionByName(rows)
    total = merged.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0)).alias("bytes"))
    taken = F.coalesce("sound", F.lit(False)) & (F.col("n") <= HISTORY["most"]) & (F.col("file") <= HISTORY["file"]) & (F.col("all") <= HISTORY["most"]) & (F.col("bytes") <= HISTORY["room"])
    verdict = size.crossJoin(sound).crossJoin(total).select(taken.alias("taken"))  # three single rows
    return merged.join(verdict.where("taken")).drop("taken").unionByName(old.join(verdict.where("not taken")).drop("taken"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    entries.select(F.col("entry").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_events(rows: DataFrame, path: str) -> None:
    """NDJSON: an item line for each row."""
    rows.select(F.to_json(F.struct(F.lit("item").alias("type"), F.struct("*").alias("data"))).alias("value")).write.mode("overwrite").text(path)
