"""References against academic works: exact and fuzzy joins, precedence, open copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citation import VENUES
from ..functions.folds import fold_batches
from ..functions.text import compact_key, doi_key, normalize_doi, safe_url
from ..functions.tokens import candidate_title, usable_title
from .matching import contained_titles, fuzzy_titles

#: The rank of versions of a copy, best first.
VERSIONS = ("publishedVersion", "acceptedVersion", "submittedVersion", "unknown")
OPEN_SOURCES = ("unpaywall", "openalex", "europepmc", "arxiv", "hal", "zenodo", "core", "semanticscholar")


def join_by_doi(refs: DataFrame, works: DataFrame) -> DataFrame:
    """References with the work of each provider that has their identifier, case ignored."""
    key = doi_key(F.col("doi"))
    keyed = works.select("*", key.alias("key"), F.lit(True).alias("known")).drop("doi").where("key is not null")
    # references without one meet nothing, and are dealt by their rows rather than all to one task
    rows = refs.select("*", F.coalesce(key, F.hex(F.xxhash64(*refs.columns))).alias("key"), key.isNotNull().alias("known"))
    return rows.join(keyed, ["key", "known"], "left").drop("key", "known")


def ambiguous_titles(works: DataFrame) -> DataFrame:
    """Works with the number of identities of their title; over one, a title alone doesn't resolve."""
    key = compact_key(F.col("title"))
    n = works.groupBy(key.alias("key")).agg(F.countDistinct("doi").alias("identities"))
    return works.withColumn("key", key).join(n, "key").withColumn("ambiguous", F.col("identities") > 1)


def merge_precedence(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Printed references (ref_id, title, authors, year, doi) and providers' records for them (ref_id, rank, source, title, authors, year,
    doi, abstract, journal, arxiv_id, url) to one row each.

    By rank, the first record's title that can be one is the matched title, and the first authors take the place of the printed
    ones; abstract, journal and address are the first there are; year and identifier are the printed ones if there are any;
    arxiv_id is the last; sources stand once each in order of arrival. Empty and null values are none."""
    some = lambda c: F.when(F.size(F.col(c)) > 0, F.col("rank")) if c == "authors" else F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("rank"))
    first = lambda c: F.min_by(c, some(c)).alias(c)
    titled = F.when(candidate_title(F.col("title"), VENUES), F.col("rank"))
    rows = records.withColumn("url", safe_url(F.col("url")))
    sources = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]))
    got = rows.groupBy("ref_id").agg(
        F.min_by("title", titled).alias("matched_title"), F.min_by("source", titled).alias("title_of"), F.min_by("source", some("authors")).alias("authors_of"),
        *[first(c) for c in ("authors", "year", "doi", "abstract", "journal", "url")], F.max_by("arxiv_id", some("arxiv_id")).alias("arxiv_id"), sources.alias("sources"),
    )
    printed = refs.select("ref_id", F.coalesce("title", F.lit("")).alias("printed_title"), F.col("authors").alias("printed_authors"), F.nullif("year", F.lit("")).alias("printed_year"), F.nullif("doi", F.lit("")).alias("printed_doi"))
    out = printed.join(got, "ref_id", "left")
    own = F.col("matched_title").isNotNull()
    names = F.coalesce("authors", "printed_authors", F.expr("cast(array() as array<string>)"))
    return out.select(
        "ref_id", F.col("printed_title").alias("title"), "matched_title", F.when(own, F.col("title_of")).when(F.col("printed_title") != "", "PDF").alias("title_source"),
        F.when(own, "verified").when(F.col("printed_title") != "", "from_pdf").otherwise("unresolved").alias("title_status"), names.alias("authors"),
        F.coalesce("authors_of", F.when(F.size("printed_authors") > 0, "pdf")).alias("authors_source"), F.coalesce("printed_year", "year").alias("year"), F.coalesce("printed_doi", normalize_doi(F.col("doi"))).alias("doi"),
        "abstract", "journal", "url", "arxiv_id", F.coalesce("sources", F.expr("cast(array() as array<string>)")).alias("sources"),
    )


def access_category(pdf_url: Column, sources: Column) -> Column:
    opened = F.arrays_overlap(sources, F.array(*map(F.lit, OPEN_SOURCES)))
    return F.when(pdf_url.isNotNull(), "pdf").when(opened, "open_record").otherwise("scholar")


def best_copies(copies: DataFrame) -> DataFrame:
    """Copies (paper_id, position, url, version, license) to one row per address without fragment, with its
    first known version and licence, ranked by version, then by arrival."""
    rows = copies.withColumn("url", safe_url(F.col("url"))).where("url is not null")
    known = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("unknown")) != "unknown", F.col("position")))
    once = rows.groupBy("paper_id", "url").agg(F.min("position").alias("position"), F.coalesce(known("version"), F.lit("unknown")).alias("version"), known("license").alias("license"))
    rank = F.array_position(F.array(*map(F.lit, VERSIONS)), F.col("version"))
    order = W.partitionBy("paper_id").orderBy(rank, "position")
    return once.withColumn("rank", F.row_number().over(order))


def merge_references(records: DataFrame, limit: int = 100) -> DataFrame:
    """Ordered union of provider lists (paper_id, source_rank, position, doi, title, year, text) to (paper_id, number, doi, title, year,
    text), ``limit`` rows at most.

    A row is known by its DOI and by its title, or by its text if it has neither. The first of these that an earlier row is known
    by makes it that row again, which then answers for its other name too, unless another row does already. The longest
    text and the first of the other fields stay. Behind the row that reaches the limit nothing is read. Papers that lie whole in a
    batch are merged at once; one that doesn't is a fold that streams: it holds ``limit`` rows and their names."""
    rows = records.withColumn("year", F.col("year").cast("string") if "year" in records.columns else F.lit(None).cast("string"))
    doi, title, text = F.nullif("doi", F.lit("")), F.nullif("title", F.lit("")), F.coalesce("text", F.lit(""))
    names = {
        "doi_name": F.concat(F.lit("d"), F.lower(normalize_doi(doi))), "title_name": F.concat(F.lit("t"), compact_key(title)),
        "text_name": F.when(doi.isNull() & title.isNull(), F.concat(F.lit("x"), compact_key(text))),
    }
    out = T.StructType().add("number", "integer").add("doi", "string").add("title", "string").add("year", "string").add("text", "string")
    columns = ["doi", "title", "year", "text"]
    return fold_batches(rows, "paper_id", ["source_rank", "position"], columns, names, lambda r: merged(r, limit), lambda b, papers: merged_at_once(b, papers, limit), out)


def merged(rows, limit: int):
    kept: list[list] = []
    known: dict[str, list] = {}
    for doi, title, year, text, *names, by_text in rows:
        names = [n for n in names if n is not None] or [by_text]
        row = next((known[n] for n in names if n in known), None)
        if row is None:
            row = [doi or None, title or None, year or None, text or ""]
            kept.append(row)
        else:
            row[:3] = [a or b or None for a, b in zip(row[:3], (doi, title, year), strict=True)]
            row[3] = text if text and len(text) > len(row[3]) else row[3]
        for n in names:
            known.setdefault(n, row)
        if len(kept) >= limit:
            break
    return [(k, *row) for k, row in enumerate(kept, 1)]


def merged_at_once(rows: pa.RecordBatch, papers: np.ndarray, limit: int) -> tuple[np.ndarray, list[pa.Array]]:
    """``merged`` of many papers. A name belongs to the row of the first that bears it; so each row points to the first one with
    its first name, or else with its second, and the row it is stands where the pointers end."""
    n, at, codes, count = rows.num_rows, np.arange(rows.num_rows), [], 0
    for c in rows.columns[4:]:
        encoded = c.dictionary_encode()
        codes.append(encoded.indices.fill_null(-1 - count).to_numpy(zero_copy_only=False).astype(np.int64) + count)
        count += len(encoded.dictionary)
    by_doi, by_title, by_text = codes
    first = np.where(by_doi >= 0, by_doi, np.where(by_title >= 0, by_title, by_text))
    second = np.where(by_doi >= 0, by_title, -1)
    two = np.flatnonzero(second >= 0)
    bearers = np.concatenate([at, two])
    _, name = np.unique(np.concatenate([first, second[two]]) + papers[bearers] * count, return_inverse=True)
    earliest = np.full(name.max() + 1, n)
    np.minimum.at(earliest, name, bearers)
    row, other = earliest[name[:n]], at.copy()
    other[two] = earliest[name[n:]]
    row = np.where(row < at, row, other)
    while (further := row[row]).tobytes() != row.tobytes():
        row = further
    new = row == at
    before = np.cumsum(new) - new
    before -= before[np.searchsorted(papers, papers)]
    read = np.flatnonzero(before < max(limit, 1))
    read = read[np.argsort(row[read], kind="stable")]
    starts = np.flatnonzero(np.diff(row[read], prepend=-1))
    kept, fields = row[read][starts], []
    for c in rows.columns[:3]:
        some = np.minimum.reduceat(np.where(_lengths(c)[read] > 0, read, n), starts)
        fields.append(c.take(pa.array(some, mask=some == n)))
    longest = np.maximum.reduceat(_lengths(rows.column(3))[read] * (n + 1) + n - read, starts)
    texts = rows.column(3).take(pa.array(n - longest % (n + 1))).fill_null("")
    return kept, [pa.array(before[kept] + 1), *fields, texts]


def _lengths(c: pa.Array) -> np.ndarray:
    return pc.utf8_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def rebuild_abstract(works: DataFrame) -> DataFrame:
    """(work_id, inverted map<string, array<int>>) to (work_id, abstract)."""
    pairs = works.select("work_id", F.explode("inverted").alias("word", "places")).select("work_id", "word", F.explode("places").alias("place"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return pairs.groupBy("work_id").agg(F.array_join(words, " ").alias("abstract"))


def invert(texts: DataFrame) -> DataFrame:
    """(work_id, text) to (work_id, inverted): places of each word."""
    rows = texts.select("work_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    rows = rows.groupBy("work_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return rows.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("inverted"))


def strip_tags(c: Column) -> Column:
    """An abstract without markup; the five XML entities are read."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def top_citing(edges: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` cited of the papers that cite each work."""
    order = W.partitionBy("work_id").orderBy(F.desc("cited_by_count"), "citing_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Words of journal names that say nothing.
GENERIC = ("journal", "of", "the", "and", "j", "proceedings", "proc")


def journal_matches(journal: Column, citation: Column) -> Column:
    """Whether each significant word of the journal begins, or is begun by, a printed word; true for no journal,
    false for one of generic words only."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    named = F.filter(words(F.coalesce(journal, F.lit(""))), lambda w: ~w.isin(*GENERIC))
    printed = words(citation)
    all_printed = (F.size(named) > 0) & F.forall(named, lambda w: F.exists(printed, lambda p: F.startswith(w, p) | F.startswith(p, w)))
    return (F.trim(F.coalesce(journal, F.lit(""))) == "") | F.coalesce(all_printed, F.lit(False))


def resolve(refs: DataFrame, works: DataFrame, least: float = 0.88) -> DataFrame:
    """References (ref_id, doi, title, year, citation) to their works, staged as cheaper before dearer:
    identifier, then contained title, then title ratio; each stage sees what the ones before left. A year conflict
    rejects, and a reference without usable title isn't resolved by title when two identities would fit.

    Gives (ref_id, work_id, matched_by)."""
    by_doi = refs.withColumn("key", doi_key(F.col("doi"))).join(works.select("work_id", doi_key(F.col("doi")).alias("key")), "key")
    found = by_doi.groupBy("ref_id").agg(F.min("work_id").alias("work_id")).withColumn("matched_by", F.lit("doi"))
    years = works.select("work_id", F.col("year").alias("work_year"))
    agree = lambda df, left: df.join(left.select("ref_id", "year", "title"), "ref_id").join(years, "work_id").where("year is null or work_year is null or year = work_year")
    left = refs.join(found, "ref_id", "left_anti")
    inside = agree(contained_titles(left, works), left).groupBy("ref_id", "title").agg(F.min("work_id").alias("work_id"), F.countDistinct("work_id").alias("n"))
    inside = inside.where(usable_title(F.col("title"), VENUES) | (F.col("n") == 1)).select("ref_id", "work_id", F.lit("contained").alias("matched_by"))
    left = left.join(inside, "ref_id", "left_anti")
    near = agree(fuzzy_titles(left.where(usable_title(F.col("title"), VENUES)), works, least), left).select("ref_id", "work_id", F.lit("title").alias("matched_by"))
    return found.union(inside).union(near)
