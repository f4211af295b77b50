"""Answers of open-access providers as tables of copies, each held against the paper that asked.

Input is (paper_id, doi, title, json), for arXiv also the printed text and Atom XML; output has one row per copy or landing page:
(paper_id, source, url, landing_url, version, license, host_type, matched_by). An answer that can't be read, or whose
identifier is another one than the paper's, gives no rows; addresses that aren't public are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi_key, safe_url
from ..operators.decide import match_open_records

# The fields read of each provider's answer
UNPAYWALL_PLACE = "struct<url_for_pdf: string, url_for_landing_page: string, version: string, license: string, host_type: string>"
UNPAYWALL = f"doi string, best_oa_location {UNPAYWALL_PLACE}, oa_locations array<{UNPAYWALL_PLACE}>"
EUROPE_PMC = "resultList struct<result: array<struct<doi: string, title: string, pmcid: string, isOpenAccess: string, fullTextUrlList: struct<fullTextUrl: array<struct<documentStyle: string, availabilityCode: string, url: string>>>>>>"
ARXIV = "entry array<struct<id: string, title: string, doi: string>>"
HAL = "response struct<docs: array<struct<doiId_s: string, title_s: string, fileMain_s: string, uri_s: string>>>"
ZENODO = (
    "hits struct<hits: array<struct<doi: string, links: struct<html: string>, files: array<struct<key: string, links: struct<self: string>>>, metadata: struct<doi: string, title: string, access_right: string,"
    " resource_type: struct<type: string>, license: struct<id: string>, related_identifiers: array<struct<identifier: string, relation: string>>>>>>"
)
CORE = "results array<struct<id: string, doi: string, title: string, downloadUrl: string>>"
ARXIV_ID = r"[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+/[0-9]{7}(?:v[0-9]+)?"
SAME_WORK = ("isVersionOf", "isIdenticalTo", "isPreprintOf", "isPreviousVersionOf")
COPY = ("paper_id", "source", "url", "landing_url", "version", "license", "host_type", "matched_by")


def _copy(rows: DataFrame, source: str | Column, url: Column, landing: Column, version=None, license=None, host=None, matched: str | Column = "doi") -> DataFrame:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    filled = lambda x: F.nullif(text(x), F.lit(""))
    out = (text(source), safe_url(url), safe_url(landing), F.coalesce(filled(version), F.lit("unknown")), filled(license), filled(host), text(matched))
    out = rows.select("paper_id", *[c.alias(n) for c, n in zip(out, COPY[1:], strict=True)])
    return out.where("url is not null or landing_url is not null")


def _matched(answers: DataFrame, records: Column, doi: str, title: Column) -> DataFrame:
    """Answers with each of their records as ``r``, and whether it is of the paper (``fits``)."""
    rows = answers.select("paper_id", "doi", "title", F.posexplode(records).alias("record_id", "r"))
    found = match_open_records(answers.select("paper_id", "doi", "title"), rows.select("paper_id", "record_id", F.col(doi).alias("record_doi"), title.alias("record_title")))
    fits = found.select("paper_id", "record_id", F.lit(True).alias("fits")).distinct()
    return rows.join(fits, ["paper_id", "record_id"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def _known(c: str) -> Column:
    return F.coalesce(doi_key(F.col(c)), F.lit("")) != ""


def unpaywall(answers: DataFrame) -> DataFrame:
    a = answers.withColumn("a", F.from_json("json", UNPAYWALL)).where(_known("doi") & (doi_key(F.col("a.doi")) == doi_key(F.col("doi"))))
    places = F.concat(F.array("a.best_oa_location"), F.coalesce("a.oa_locations", F.expr(f"cast(array() as array<{UNPAYWALL_PLACE}>)")))
    rows = a.select("paper_id", F.explode(places).alias("r"))
    return _copy(rows, "Unpaywall", F.col("r.url_for_pdf"), F.col("r.url_for_landing_page"), F.col("r.version"), F.col("r.license"), F.col("r.host_type"))


def europe_pmc(answers: DataFrame) -> DataFrame:
    """The links an open article lists as PDF, and the archive's own."""
    rows = _matched(answers, F.from_json("json", EUROPE_PMC)["resultList"]["result"], "r.doi", F.col("r.title")).where(F.col("fits") & F.col("r.pmcid").rlike("^PMC[0-9]+$") & (F.col("r.isOpenAccess") == "Y"))
    links = F.filter("r.fullTextUrlList.fullTextUrl", lambda x: (F.lower(x["documentStyle"]) == "pdf") & (x["availabilityCode"] == "OA"))
    listed = F.transform(F.coalesce(links, F.expr("cast(array() as array<struct<documentStyle: string, availabilityCode: string, url: string>>)")), lambda x: F.struct(F.lit("Europe PMC").alias("source"), x["url"].alias("url"), F.lit(None).cast("string").alias("host")))
    own = F.struct(F.lit("PubMed Central").alias("source"), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), "r.pmcid", F.lit("/pdf/")).alias("url"), F.lit("repository").alias("host"))
    rows = rows.select("paper_id", F.concat(F.lit("https://europepmc.org/articles/"), "r.pmcid").alias("landing"), F.explode(F.concat(listed, F.array(own))).alias("x"))
    return _copy(rows, F.col("x.source"), F.col("x.url"), F.col("landing"), "publishedVersion", None, F.col("x.host"))


def arxiv(answers: DataFrame) -> DataFrame:
    """Atom answers (paper_id, doi, title, original_text, xml): a printed id alone decides where a paper has neither
    identifier nor title. Answers that declare types or entities aren't read."""
    safe = answers.where(~F.col("xml").rlike("(?i)<!(doctype|entity)"))
    entries = F.from_xml("xml", ARXIV, {"ignoreNamespace": "true"})["entry"]
    rows = _matched(safe, entries, "r.doi", F.regexp_replace(F.trim(F.col("r.title")), r"\s+", " "))
    printed = answers.select("paper_id", F.coalesce(F.col("original_text").rlike(rf"(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)(?:{ARXIV_ID})"), F.lit(False)).alias("has_id"))
    rows = rows.join(printed, "paper_id").withColumn("key", F.regexp_extract(F.col("r.id"), rf"(?:^|/abs/)({ARXIV_ID})$", 1))
    alone = F.col("has_id") & ~_known("doi") & (F.coalesce("title", F.lit("")) == "")
    rows = rows.where((F.col("fits") | alone) & (F.col("key") != ""))
    by = F.when(_known("doi") & _known("r.doi"), "doi").when(F.col("has_id"), "arxiv_id").otherwise("title")
    return _copy(rows, "arXiv", F.concat(F.lit("https://arxiv.org/pdf/"), "key"), F.concat(F.lit("https://arxiv.org/abs/"), "key"), "submittedVersion", None, "repository", by)


def hal(answers: DataFrame) -> DataFrame:
    title = F.coalesce(F.get_json_object("r.title_s", "$[0]"), F.col("r.title_s"))
    rows = _matched(answers, F.from_json("json", HAL)["response"]["docs"], "r.doiId_s", title).where("fits")
    return _copy(rows, "HAL", F.col("r.fileMain_s"), F.col("r.uri_s"), None, None, "repository", F.when(_known("doi") & _known("r.doiId_s"), "doi").otherwise("title"))


def zenodo(answers: DataFrame) -> DataFrame:
    """Open publications that match, or that name the paper's identifier as the same work."""
    hits = F.transform(F.from_json("json", ZENODO)["hits"]["hits"], lambda h: F.struct(F.coalesce(h["metadata"]["doi"], h["doi"]).alias("doi"), h["links"].alias("links"), h["files"].alias("files"), h["metadata"].alias("metadata")))
    rows = _matched(answers, hits, "r.doi", F.col("r.metadata.title"))
    related = F.coalesce(_known("doi") & F.exists("r.metadata.related_identifiers", lambda x: (doi_key(x["identifier"]) == doi_key(F.col("doi"))) & x["relation"].isin(*SAME_WORK)), F.lit(False))
    rows = rows.withColumn("related", related).where((F.col("fits") | F.col("related")) & (F.col("r.metadata.access_right") == "open") & (F.col("r.metadata.resource_type.type") == "publication"))
    rows = rows.withColumn("file", F.explode_outer(F.filter("r.files", lambda f: F.lower(f["key"]).endswith(".pdf"))))
    by = F.when(F.col("related"), "related_doi").when(_known("doi"), "doi").otherwise("title")
    return _copy(rows, "Zenodo", F.col("file.links.self"), F.col("r.links.html"), None, F.col("r.metadata.license.id"), "repository", by)


def core(answers: DataFrame) -> DataFrame:
    rows = _matched(answers, F.from_json("json", CORE)["results"], "r.doi", F.col("r.title")).where("fits")
    landing = F.when(F.col("r.id").rlike("^[0-9]+$"), F.concat(F.lit("https://core.ac.uk/works/"), "r.id"))
    return _copy(rows, "CORE", F.col("r.downloadUrl"), landing, None, None, "repository", F.when(_known("doi") & _known("r.doi"), "doi").otherwise("title"))


PROVIDERS = {"unpaywall": unpaywall, "europepmc": europe_pmc, "arxiv": arxiv, "hal": hal, "zenodo": zenodo, "core": core}
