"""Provider records as tables: nested JSON to one work schema, relationships, open copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_date_year, safe_url
from ..operators.resolve import strip_tags

CROSSREF = "DOI string, title array<string>, score double, author array<struct<given string, family string>>, issued struct<`date-parts`: array<array<int>>>, created struct<`date-parts`: array<array<int>>>, `published-print` struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, volume string, page string, `article-number` string, `container-title` array<string>, abstract string"
OPENALEX = "id string, doi string, display_name string, publication_year int, authorships array<struct<author struct<display_name string>>>, biblio struct<volume string, first_page string>, abstract_inverted_index map<string, array<int>>, cited_by_count int, referenced_works array<string>, primary_location struct<source struct<display_name string>>, best_oa_location struct<is_oa boolean, pdf_url string, landing_page_url string, version string, license string, source struct<type string, display_name string>>, locations array<struct<is_oa boolean, pdf_url string, landing_page_url string, version string, license string, source struct<type string, display_name string>>>"
SEMANTIC = "paperId string, title string, year int, authors array<struct<name string>>, journal struct<volume string, pages string, name string>, externalIds struct<DOI string, ArXiv string>, url string, openAccessPdf struct<url string>, abstract string"
CROSSREF, OPENALEX, SEMANTIC = (x.replace("struct<given string, family string>", "struct<given: string, family: string>") for x in (CROSSREF, OPENALEX, SEMANTIC))


def _names(c: Column) -> Column:
    return F.slice(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), 1, 40)


def _first_page(c: Column) -> Column:
    """Of a range of pages, or an article number."""
    return F.nullif(F.trim(F.split(c, r"\s*[-\x{2013}\x{2014}]\s*")[0]), F.lit(""))


def _opened(best: Column, others: Column) -> Column:
    """The best open location of a work, then the others, those that are open."""
    return F.filter(F.concat(F.array(best), F.coalesce(others, F.array())), lambda x: F.coalesce(x["is_oa"], F.lit(False)))


def _first_of(a: Column, field: str) -> Column:
    """The elements that have a value in the field, each value once, where it is first."""
    has = F.filter(a, lambda x: x[field].isNotNull())
    return F.filter(has, lambda x, i: F.array_position(F.transform(has, lambda y: y[field]), x[field]) == i + 1)


def crossref(raw: DataFrame) -> DataFrame:
    """(json) to works; null elements of lists are passed over, years come from the first date that has one."""
    r = raw.select(F.from_json("json", CROSSREF).alias("r"))
    authors = F.transform("r.author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    return r.select(
        F.lit("crossref").alias("provider"), F.col("r.DOI").alias("doi"), F.get("r.title", 0).alias("title"), _names(authors).alias("authors"),
        first_date_year(*[F.col(f"r.{c}.date-parts") for c in ("published-print", "published-online", "issued", "created")]).alias("year"),
        F.col("r.volume").alias("volume"), _first_page(F.coalesce(F.nullif(F.trim("r.page"), F.lit("")), F.trim("r.article-number"))).alias("first_page"), F.get("r.container-title", 0).alias("journal"),
        strip_tags(F.col("r.abstract")).alias("abstract"), F.col("r.score").alias("score"),
    )


def openalex(raw: DataFrame) -> DataFrame:
    r = raw.select(F.from_json("json", OPENALEX).alias("r"))
    places = F.transform(F.map_entries("r.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    abstract = F.array_join(F.transform(F.array_sort(F.flatten(places)), lambda x: x["w"]), " ")
    opened = _opened(F.col("r.best_oa_location"), F.col("r.locations"))
    return r.select(
        F.lit("openalex").alias("provider"), F.col("r.doi").alias("doi"), F.col("r.display_name").alias("title"),
        _names(F.transform("r.authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.col("r.publication_year").cast("string").alias("year"),
        F.col("r.biblio.volume").alias("volume"), F.col("r.biblio.first_page").alias("first_page"), abstract.alias("abstract"),
        F.col("r.id").alias("work_id"), F.coalesce("r.cited_by_count", F.lit(0)).alias("cited_by_count"), F.slice("r.referenced_works", 1, 100).alias("referenced"),
        F.col("r.primary_location.source.display_name").alias("journal"),
        F.filter(F.transform(opened, lambda x: F.struct(safe_url(x["pdf_url"]).alias("url"), safe_url(x["landing_page_url"]).alias("landing_url"), x["version"].alias("version"), x["license"].alias("license"), x["source"]["type"].alias("host_type"))), lambda x: x["url"].isNotNull()).alias("copies"),
        _first_of(F.transform(opened, lambda x: F.struct(F.concat(F.lit("Open Access · "), F.coalesce(F.nullif(x["source"]["display_name"], F.lit("")), F.lit("repository"))).alias("name"), safe_url(x["landing_page_url"]).alias("url"))), "url").alias("open_records"),
    )


def semantic_scholar(raw: DataFrame) -> DataFrame:
    r = raw.select(F.from_json("json", SEMANTIC).alias("r"))
    return r.select(
        F.lit("semanticscholar").alias("provider"), F.col("r.externalIds.DOI").alias("doi"), F.col("r.title").alias("title"), _names(F.transform("r.authors", lambda a: a["name"])).alias("authors"),
        F.col("r.year").cast("string").alias("year"), F.col("r.journal.volume").alias("volume"), _first_page(F.col("r.journal.pages")).alias("first_page"), F.col("r.journal.name").alias("journal"),
        F.col("r.abstract").alias("abstract"), F.col("r.externalIds.ArXiv").alias("arxiv_id"), safe_url(F.col("r.url")).alias("paper_url"), safe_url(F.col("r.openAccessPdf.url")).alias("oa_pdf_url"),
    )


def as_reference_text(works: DataFrame) -> DataFrame:
    """Works as printed references: up to four authors, title, year and DOI, what is missing left out."""
    parts = [F.array_join(F.slice("authors", 1, 4), ", "), F.col("title"), F.col("year"), F.concat(F.lit("https://doi.org/"), F.col("doi"))]
    return works.withColumn("original_text", F.concat_ws(". ", *[F.nullif(p, F.lit("")) for p in parts]))


def relationships(works: DataFrame, references: int = 100, citing: int = 20) -> DataFrame:
    """(work_id, kind, other_id, rank): what works refer to, and the most cited of those that refer to them."""
    edges = works.select("work_id", "cited_by_count", F.posexplode("referenced").alias("position", "other_id"))
    out = edges.where(F.col("position") < references).select("work_id", F.lit("references").alias("kind"), "other_id", (F.col("position") + 1).alias("rank"))
    order = W.partitionBy("other_id").orderBy(F.desc("cited_by_count"), "work_id")
    back = edges.select("other_id", "work_id", "cited_by_count").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= citing)
    return out.union(back.select(F.col("other_id").alias("work_id"), F.lit("citing"), F.col("work_id").alias("other_id"), "rank"))


def summary_material(works: DataFrame) -> DataFrame:
    """One row per DOI: Crossref's fields where they are there, else the others'."""
    rank = F.array_position(F.array(*map(F.lit, ("crossref", "openalex", "semanticscholar"))), F.col("provider"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("rank"))).alias(c)
    rows = works.withColumn("rank", rank).withColumn("doi", F.lower("doi")).where("doi is not null")
    return rows.groupBy("doi").agg(first("title"), first("year"), F.slice(F.min_by("authors", F.when(F.size("authors") > 0, F.col("rank"))), 1, 12).alias("authors"), first("abstract"))
