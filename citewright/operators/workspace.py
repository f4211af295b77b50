"""Local workspaces: shared references, unique sessions, BibTeX, retention, graph layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import latex, spaced_key, workspace_doi


def unique_sessions(sessions: DataFrame) -> DataFrame:
    """Of sessions (owner, session_id, saved_at, source_key) of one source the last saved."""
    order = W.partitionBy("owner", "source_key").orderBy(F.desc("saved_at"), F.desc("session_id"))
    return sessions.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def shared_references(refs: DataFrame, least: int = 2, title_least: int = 15) -> DataFrame:
    """References (owner, session_id, doi, title) that several sessions of an owner share.

    A reference is its DOI, case ignored; one without is the DOI its title has, if just one; else its title.
    Each session votes once."""
    rows = refs.select("owner", "session_id", F.nullif(workspace_doi(F.col("doi")), F.lit("")).alias("doi"), spaced_key(F.col("title")).alias("title"))
    # two shuffles: by title, for the one identifier it may have, and by key, under which sessions and votes are both counted
    same = W.partitionBy("owner", "title")
    one = F.when((F.min("doi").over(same) == F.max("doi").over(same)) & (F.length("title") >= title_least), F.min("doi").over(same))
    named = rows.where(F.col("doi").isNotNull() | (F.length("title") >= title_least)).withColumn("only", one)
    keyed = named.select("owner", "session_id", F.coalesce("doi", "only", "title").alias("key"), "title").repartition("owner", "key")
    votes = keyed.groupBy("owner", "session_id", "key").agg(F.min("title").alias("title"))
    return votes.groupBy("owner", "key").agg(F.count("*").alias("sessions"), F.min("title").alias("title")).where(F.col("sessions") >= least)


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with their place in the order of ``by``, from 1: counted within ranges, behind the rows of the ranges before. Only
    the ranges' sizes, a row each, meet in one task; ranges are staged, as their bounds are drawn anew when recomputed."""
    ranged = staged(rows.repartitionByRange(by).withColumn("range_no", F.spark_partition_id()))
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("n"))
    before = sizes.select("range_no", F.coalesce(F.sum("n").over(W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("range_no").orderBy(by))
    return ranged.join(before, "range_no").withColumn(name, F.col("before") + within).drop("range_no", "before")


def bibtex(refs: DataFrame) -> DataFrame:
    """References (position, doi, title, authors, year, journal) to entries, one per identity, in order of first arrival;
    a row with DOI stands for those without. A reference is its DOI, else the one DOI its title has, else its title; one
    whose title key has under 15 characters is only itself."""
    rows = refs.withColumns({"key": spaced_key(F.coalesce("title", F.lit(""))), "own": F.nullif(workspace_doi(F.col("doi")), F.lit(""))})
    known = rows.where("own is not null and length(key) >= 15").groupBy("key").agg(F.countDistinct("own").alias("n"), F.min("own").alias("only")).where("n = 1").drop("n")
    rows = rows.join(known, "key", "left")
    own = F.concat(F.lit("doi:"), F.coalesce("own", "only"))
    identity = F.coalesce(own, F.when(F.length("key") >= 15, F.concat(F.lit("title:"), "key")), F.concat(F.lit("row:"), F.col("position").cast("string")))
    best = F.struct(F.col("own").isNull().alias("without"), F.col("position"))
    kept = rows.groupBy(identity.alias("identity")).agg(F.min("position").alias("at"), F.min_by(F.struct("doi", "title", "authors", "year", "journal"), best).alias("r")).select("at", "r.*")
    rows, number = numbered(kept, "at", "number"), F.col("number")
    field = lambda n: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), latex(F.col(n)) if n != "doi" else F.col(n), F.lit("},\n"))).otherwise("")
    kind = F.when(F.coalesce("journal", F.lit("")) != "", "article").otherwise("misc")
    names = F.when(F.coalesce("authors", F.lit("")) != "", F.concat(F.lit("  author = {"), latex(F.col("authors")), F.lit("},\n"))).otherwise("")
    entry = F.concat(F.lit("@"), kind, F.lit("{ref"), number.cast("string"), F.lit(",\n"), field("title"), names, field("year"), field("journal"), field("doi"), F.lit("}"))
    return rows.select("at", entry.alias("entry"))


def retain(sessions: DataFrame, most: int = 50, room: int = 8 << 20) -> DataFrame:
    """The newest ``most`` sessions (owner, session_id, saved_at, bytes) of an owner that fit in ``room``; one at least."""
    order = W.partitionBy("owner").orderBy(F.desc("saved_at"), F.desc("session_id"))
    rows = sessions.withColumn("nth", F.row_number().over(order)).withColumn("used", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where((F.col("nth") <= most) & ((F.col("used") <= room) | (F.col("nth") == 1)))


def search_sessions(sessions: DataFrame, query: str) -> DataFrame:
    from ..functions.citation import nfkc

    text = F.lower(nfkc(F.concat_ws(" ", *[c for c in sessions.columns if c != "session_id"])))
    return sessions.where(F.contains(text, F.lit(query.lower())))


def layout(papers: DataFrame, columns: int = 3, dx: int = 260, dy: int = 110) -> DataFrame:
    """Nodes of a two-level tree: groups in order of their first paper, papers in a grid below their group."""
    group = W.partitionBy("group_id")
    rows = papers.withColumn("first", F.min("position").over(group)).withColumn("nth", F.row_number().over(group.orderBy("position")) - 1)
    firsts = numbered(rows.select("group_id", "first").distinct(), "first", "group_no").withColumn("group_no", F.col("group_no") - 1).drop("first")
    rows = rows.join(firsts, "group_id")
    x = F.col("group_no") * (columns * dx + 80) + (F.col("nth") % columns) * dx
    return rows.select("paper_id", "group_id", "group_no", x.alias("x"), (F.floor(F.col("nth") / columns) * dy + 160).alias("y"))
