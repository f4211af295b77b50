"""Registry of the bibliography queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citation, text
from ..operators import answers, evidence, excerpts, flow, history, matching, packing, resolve, sections, segment, workspace
from ..sources import corpus
from . import lifecycle
from .tables import LINES_SQL, REFS_SQL, cited, document_lines, printed_pages, refs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register the function under its name, and its SQL over the named views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {views} {sql}" if views else sql
        return f

    return register


# --- scalar functions ---------------------------------------------------------------------------


@query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 5
        WHEN 0 THEN 'https://doi.org/10.1234/AbC%2F' || p_partkey WHEN 1 THEN ' doi: 10.1234/x+y' || p_partkey || ').'
        WHEN 2 THEN 'DOI:10.12/short' || p_partkey WHEN 3 THEN 'http://dx.doi.org/10.98765/Q(' || p_partkey || ');' ELSE '10.5555/' || p_partkey || '%zz' END AS raw FROM part),
    b AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^doi:\s*', '', 'i'), '^https?://(dx\.)?doi\.org/', '', 'i') AS bare FROM r),
    n AS (SELECT p_partkey, regexp_replace(trim(replace(bare, '%2F', '/')), '[.,;:)\]}]+$', '') AS doi FROM b)
    SELECT p_partkey, doi, regexp_matches(doi, '^10\.[0-9]{4,9}/\S+$') AS valid, lower(doi) AS doi_key FROM n""")
def doi_normalize(spark, sf):
    k, part = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    raw = (
        F.when(part == 0, F.concat(F.lit("https://doi.org/10.1234/AbC%2F"), k)).when(part == 1, F.concat(F.lit(" doi: 10.1234/x+y"), k, F.lit(").")))
        .when(part == 2, F.concat(F.lit("DOI:10.12/short"), k)).when(part == 3, F.concat(F.lit("http://dx.doi.org/10.98765/Q("), k, F.lit(");"))).otherwise(F.concat(F.lit("10.5555/"), k, F.lit("%zz")))
    )
    rows = table(spark, sf, "part").select("p_partkey", text.normalize_doi(raw).alias("doi"))
    return rows.select("p_partkey", "doi", text.valid_doi(F.col("doi")).alias("valid"), text.doi_key(F.col("doi")).alias("doi_key"))


@query(r"""
    SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS compact_key,
           md5(replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g'), 'ß', 'ss')) AS folded_key,
           md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS spaced_key FROM documents""")
def title_keys(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[F.md5(f(t)).alias(f.__name__) for f in (text.compact_key, text.folded_key, text.spaced_key)])


@query("""SELECT paper_id, position, list_filter(regexp_extract_all(citation, '[0-9]+'), lambda x: length(x) = 4 AND x BETWEEN '1800' AND '2099') AS years FROM cited""", REFS_SQL)
def year_tokens(spark, sf):
    return cited(spark, sf).select("paper_id", "position", text.years(F.col("citation")).alias("years"))


_URL = """CASE page_id % 7 WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'http://10.0.0.' || CAST(page_id AS {s}) || '/x' WHEN 3 THEN 'https://localhost/' || CAST(page_id AS {s})
    WHEN 4 THEN 'ftp://host.example/' || CAST(page_id AS {s}) WHEN 5 THEN 'http://host.example:8080/#a' WHEN 6 THEN 'http://host.example:443/p#' || CAST(page_id AS {s}) ELSE url END"""


@query(rf"""
    WITH u AS (SELECT page_id, {_URL.format(s="VARCHAR")} AS url FROM pages),
    h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@\s\[\]]+)(:[0-9]*)?(?:[/?#]|$)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#:@\s\[\]]+(?::([0-9]*))?(?:[/?#]|$)', 1) AS port FROM u)
    SELECT page_id, CASE WHEN length(url) <= 4000 AND regexp_matches(url, '^https?://', 'i') AND NOT regexp_matches(url, '\s') AND host <> '' AND port IN ('', '80', '443')
        AND host <> 'localhost' AND NOT regexp_matches(host, '^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.') THEN regexp_replace(url, '#.*$', '') END AS safe FROM h""")
def url_safety(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_url(F.expr(_URL.format(s="STRING"))).alias("safe"))


@query("""SELECT p_partkey, 'https://scholar.google.com/scholar?q=' || replace(p_name, ' ', '+') AS url,
    CASE WHEN p_size % 3 = 0 THEN least(p_size * 40, 300) END AS retry_after, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS id FROM part""")
def request_fields(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", text.scholar_url(F.col("p_name")).alias("url"),
        text.retry_after(F.when(F.col("p_size") % 3 == 0, (F.col("p_size") * 40).cast("string")).otherwise("soon")).alias("retry_after"),
        text.strict_integer(F.when(F.col("p_size") % 2 == 0, size).otherwise(F.concat(size, F.lit(".0")))).alias("id"),
    )


# --- segmentation and coverage --------------------------------------------------------------------


@query("SELECT DISTINCT paper_id, 'proceedings on systems ' || CAST(paper_id % 9 AS VARCHAR) AS key, 3::BIGINT AS n_pages FROM refs", REFS_SQL)
def running_headers(spark, sf):
    return segment.running_headers(segment.page_lines(printed_pages(spark, sf)))


@query("""SELECT paper_id, position AS number, citation, title, year, 'A. ' || family AS authors FROM cited""", REFS_SQL)
def extracted_references(spark, sf):
    """All printed pages read back: headers, page numbers, headings, wrapped lines and appendices go, and the fields are those that were printed."""
    return lifecycle.extract(printed_pages(spark, sf)).select("paper_id", "number", "citation", "title", "year", F.array_join("authors", "; ").alias("authors"))


@query("SELECT k.page_no, count(*) AS lines, count(*) FILTER (WHERE h.key IS NULL) AS kept FROM keyed k LEFT JOIN heads h USING (paper_id, key) GROUP BY k.page_no", LINES_SQL)
def header_filtered_lines(spark, sf):
    lines = document_lines(spark, sf)
    kept = segment.without_headers(lines).groupBy("page_no").agg(F.count("*").alias("kept"))
    return lines.groupBy("page_no").agg(F.count("*").alias("lines")).join(kept, "page_no", "left").fillna(0, ["kept"])


@query("""e AS (SELECT paper_id, number, arg_min(citation, position) AS entry FROM cited GROUP BY ALL),
    a AS (SELECT paper_id FROM e GROUP BY paper_id HAVING min(number) = 1 AND count(*) * 4 >= max(number) * 3)
    SELECT paper_id, number, entry FROM e SEMI JOIN a USING (paper_id)""", REFS_SQL + ",")
def numbered_entries(spark, sf):
    rows = cited(spark, sf)
    # a printed entry is two lines: its label and authors, then the rest
    head = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.substring_index("citation", ", ", 1), F.lit(","))
    tail = F.expr("substring(citation, length(substring_index(citation, ', ', 1)) + 3)")
    lines = rows.select("paper_id", F.lit(0).cast("long").alias("start"), F.explode(F.array(F.struct((F.col("position") * 2).alias("at"), head.alias("line")), F.struct((F.col("position") * 2 + 1).alias("at"), tail.alias("line")))).alias("l"))
    return sections.numbered(lines.select("paper_id", "start", "l.*")).drop("start")


@query("""g AS (SELECT paper_id, max(number) AS expected, count(DISTINCT number) AS found, list(DISTINCT number) AS seen FROM refs GROUP BY paper_id)
    SELECT paper_id, expected, CAST(found AS INT) AS found, list_filter(range(1, expected + 1), lambda x: NOT list_contains(seen, x)) AS gaps FROM g WHERE found < expected""", REFS_SQL + ",")
def number_gaps(spark, sf):
    return segment.number_gaps(refs(spark, sf))


@query("""SELECT paper_id, max(number) AS expected, count(DISTINCT number) AS labels, count(*) AS n_rows, count(*) FILTER (WHERE part % 4 <> 0) AS titles, count(*) AS with_authors,
    count(DISTINCT number) = max(number) AND count(*) = max(number) AS complete FROM refs GROUP BY paper_id""", REFS_SQL)
def extraction_diagnostics(spark, sf):
    rows = refs(spark, sf).withColumn("title", F.when(F.col("part") % 4 != 0, F.col("title")).otherwise("")).withColumn("authors", F.array("family"))
    return segment.diagnostics(rows)


@query("SELECT paper_id, position, CASE WHEN part % 4 = 0 THEN '' ELSE title END AS title, year, 'A. ' || family AS authors, lower(doi) AS doi FROM cited", REFS_SQL)
def citation_fields(spark, sf):
    """The parser recovers the columns that the citations were printed from, also where the title was left out."""
    rows = cited(spark, sf)
    untitled = F.expr("replace(citation, title || ', ', '')")
    printed = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.when(F.col("part") % 4 == 0, untitled).otherwise(F.col("citation")), F.coalesce(F.concat(F.lit(" doi:"), F.col("doi"), F.lit(".")), F.lit("")))
    out = rows.select("paper_id", "position", citation.citation_fields(printed).alias("f"))
    return out.select("paper_id", "position", "f.title", "f.year", F.array_join("f.authors", "; ").alias("authors"), F.lower("f.doi").alias("doi"))


@query("SELECT part AS paper_id, number, count(*) AS citations FROM refs JOIN part ON part = p_partkey WHERE p_size < 25 AND number <= 4 GROUP BY ALL", REFS_SQL)
def citation_counts(spark, sf):
    links = refs(spark, sf).select(F.col("part").alias("paper_id"), "number")
    small = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number"))
    return segment.citation_counts(links, small)


@query("""d AS (SELECT part AS paper_id, number, CASE supp % 5 WHEN 0 THEN 'cite.bib' || number WHEN 1 THEN 'Reference' || number WHEN 2 THEN 'bib' || number || 'x' WHEN 3 THEN 'fig' || number END AS text FROM refs)
    SELECT d.paper_id, d.number, count(*) AS citations FROM d JOIN (SELECT DISTINCT part, number FROM refs WHERE number <= 5) v ON v.part = d.paper_id AND v.number = d.number WHERE text LIKE 'cite.bib%' OR text LIKE 'Reference%' GROUP BY ALL""", REFS_SQL + ",")
def internal_links(spark, sf):
    """Destinations of all kinds; those that name a reference that is there are counted."""
    n, kind = F.col("number").cast("string"), F.col("supp") % 5
    rows = refs(spark, sf)
    text = F.when(kind == 0, F.concat(F.lit("cite.bib"), n)).when(kind == 1, F.concat(F.lit("Reference"), n)).when(kind == 2, F.concat(F.lit("bib"), n, F.lit("x"))).when(kind == 3, F.concat(F.lit("fig"), n))
    return corpus.link_counts(rows.select(F.col("part").alias("paper_id"), text.alias("text")), rows.where("number <= 5").select(F.col("part").alias("paper_id"), "number"))


@query("""SELECT paper_id, CAST(n AS INT) AS number, count(*) AS markers FROM (SELECT paper_id, unnest(list_concat([number], range(number + 2, number + 5))) AS n FROM refs) GROUP BY ALL""", REFS_SQL)
def citation_markers(spark, sf):
    n = F.col("number")
    body = F.concat(F.lit("as shown in ["), n.cast("string"), F.lit(", "), (n + 2).cast("string"), F.lit("-"), (n + 4).cast("string"), F.lit("] before"))
    rows = segment.explode_markers(refs(spark, sf).select("paper_id", F.lit(1).alias("page"), body.alias("text")))
    return rows.groupBy("paper_id", "number").agg(F.count("*").alias("markers"))


@query("""c AS (SELECT part AS paper_id, number, flag || status || CAST(CAST(quantity AS INT) % 7 AS VARCHAR) AS text, min(paper_id) AS page FROM refs GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, number ORDER BY page, text) AS rank FROM c)
    SELECT paper_id, number, rank, page, text FROM k WHERE rank <= 3""", REFS_SQL + ",")
def citation_contexts_top3(spark, sf):
    snippet = F.concat("flag", "status", (F.col("quantity").cast("int") % 7).cast("string"))
    rows = refs(spark, sf).select(F.col("part").alias("paper_id"), "number", F.col("paper_id").alias("page"), F.lit(0).alias("position"), snippet.alias("text"))
    return segment.first_contexts(rows)


# --- resolution ------------------------------------------------------------------------------------

_WORKS_SQL = REFS_SQL + """, works AS (
    SELECT p_partkey AS work_id, 'crossref' AS provider, 1 AS rank, upper('10.' || CAST(1000 + p_partkey % 9000 AS VARCHAR) || '/Part.' || CAST(p_partkey AS VARCHAR)) AS wdoi, p_retailprice AS weight FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'openalex', 2, 'https://doi.org/10.' || CAST(1000 + p_partkey % 9000 AS VARCHAR) || '/Part.' || CAST(p_partkey AS VARCHAR), p_retailprice FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'semanticscholar', 3, '10.' || CAST(1000 + p_partkey % 9000 AS VARCHAR) || '/part.' || CAST(p_partkey AS VARCHAR), p_retailprice FROM part WHERE p_partkey % 7 = 0)"""


def _works(spark, sf) -> DataFrame:
    doi = F.concat(F.lit("10."), (F.lit(1000) + F.col("p_partkey") % 9000).cast("string"), F.lit("/Part."), F.col("p_partkey").cast("string"))
    part = table(spark, sf, "part")
    one = lambda every, name, rank, form: part.where(F.col("p_partkey") % every == 0).select(F.col("p_partkey").alias("work_id"), F.lit(name).alias("provider"), F.lit(rank).alias("rank"), form.alias("doi"), F.col("p_retailprice").alias("weight"))
    return one(2, "crossref", 1, F.upper(doi)).union(one(3, "openalex", 2, F.concat(F.lit("https://doi.org/"), doi))).union(one(7, "semanticscholar", 3, F.lower(doi)))


@query("""SELECT r.paper_id, r.position, w.work_id, w.provider FROM cited r LEFT JOIN works w ON lower(r.doi) = lower(replace(w.wdoi, 'https://doi.org/', ''))""", _WORKS_SQL)
def doi_join_resolve(spark, sf):
    return resolve.join_by_doi(cited(spark, sf), _works(spark, sf)).select("paper_id", "position", "work_id", "provider")


@query("""WITH m AS (SELECT p_partkey AS ref_id, k AS rank, (p_partkey + k) % 3 > 0 AND NOT (k = 1 AND p_partkey % 5 = 0) AS titled, p_name || ' ' || k AS title, CASE WHEN k = 2 AND p_partkey % 7 > 0 THEN 'B. Two' END AS authors,
        CASE WHEN (p_partkey + k) % 2 = 0 THEN CAST(1990 + k AS VARCHAR) END AS year, CASE WHEN k <> 3 THEN 'arx' || k END AS arxiv_id, CASE WHEN k > 2 THEN '10.1/' || p_partkey || '.' || k END AS doi, CASE k % 2 WHEN 0 THEN 'openalex' ELSE 'crossref' END AS source
        FROM part, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p_partkey % 11 > 0)
    SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS title, arg_min(m.title, rank) FILTER (WHERE titled) AS matched_title,
        CASE WHEN bool_or(titled) THEN arg_min(source, rank) FILTER (WHERE titled) WHEN p_partkey % 2 = 0 THEN 'PDF' END AS title_source,
        CASE WHEN bool_or(titled) THEN 'verified' WHEN p_partkey % 2 = 0 THEN 'from_pdf' ELSE 'unresolved' END AS title_status,
        coalesce(max(authors), CASE WHEN p_partkey % 3 = 0 THEN 'P. Printed' ELSE '' END) AS authors, CASE WHEN max(authors) IS NOT NULL THEN 'openalex' WHEN p_partkey % 3 = 0 THEN 'pdf' END AS authors_source,
        CASE WHEN p_partkey % 4 = 0 THEN '1900' ELSE arg_min(year, rank) FILTER (WHERE year IS NOT NULL) END AS year, CASE WHEN p_partkey % 9 = 0 THEN '10.9/own' ELSE arg_min(doi, rank) FILTER (WHERE doi IS NOT NULL) END AS doi,
        arg_max(arxiv_id, rank) FILTER (WHERE arxiv_id IS NOT NULL) AS arxiv_id, CASE WHEN p_partkey % 11 > 0 THEN 'crossref;openalex' ELSE '' END AS sources
    FROM part LEFT JOIN m ON ref_id = p_partkey GROUP BY p_partkey, p_name""")
def precedence_merge(spark, sf):
    """Printed references and four records for most: titles that are none, or a list of names, missing authors, years and identifiers."""
    k, part = F.col("k"), F.col("p_partkey")
    base = table(spark, sf, "part")
    printed = base.select(part.alias("ref_id"), F.when(part % 2 == 0, F.col("p_name")).alias("title"), F.when(part % 3 == 0, F.array(F.lit("P. Printed"))).alias("authors"), F.when(part % 4 == 0, "1900").alias("year"), F.when(part % 9 == 0, "10.9/own").alias("doi"))
    title = F.when((part + k) % 3 == 0, "").when((k == 1) & (part % 5 == 0), "A. Stone, B. Wood").otherwise(F.concat("p_name", F.lit(" "), k.cast("string")))
    rows = base.where(part % 11 > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        part.alias("ref_id"), k.alias("rank"), title.alias("title"), F.when((k == 2) & (part % 7 > 0), F.array(F.lit("B. Two"))).alias("authors"), F.when((part + k) % 2 == 0, (k + 1990).cast("string")).alias("year"),
        F.when(k > 2, F.concat(F.lit("https://doi.org/10.1/"), part.cast("string"), F.lit("."), k.cast("string"))).alias("doi"), F.when(k != 3, F.concat(F.lit("arx"), k.cast("string"))).alias("arxiv_id"),
        F.when(k % 2 == 0, "openalex").otherwise("crossref").alias("source"), *[F.lit(None).cast("string").alias(c) for c in ("abstract", "journal", "url")],
    )
    out = resolve.merge_precedence(printed, rows).drop("abstract", "journal", "url")
    return out.withColumns({c: F.array_join(c, ";") for c in ("authors", "sources")})


@query("""s AS (SELECT p_partkey, bool_or(provider <> 'crossref') AS opened, max(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS pdf FROM part LEFT JOIN works ON p_partkey = work_id GROUP BY p_partkey)
    SELECT CASE WHEN pdf = 1 THEN 'pdf' WHEN coalesce(opened, false) THEN 'open_record' ELSE 'scholar' END AS category, count(*) AS n FROM s GROUP BY 1""", _WORKS_SQL + ",")
def access_category(spark, sf):
    sources = _works(spark, sf).groupBy(F.col("work_id").alias("p_partkey")).agg(F.collect_set("provider").alias("sources"))
    rows = table(spark, sf, "part").join(sources, "p_partkey", "left")
    category = resolve.access_category(F.when(F.col("p_size") > 40, F.lit("url")), F.coalesce("sources", F.expr("cast(array() as array<string>)")))
    return rows.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("""c AS (SELECT part AS paper_id, paper_id * 100 + position AS position, 'https://host' || CAST(supp % 4 AS VARCHAR) || '.example/' || CAST(part AS VARCHAR) AS url,
        [NULL, 'acceptedVersion', 'publishedVersion', 'submittedVersion'][CAST(number % 4 AS INT) + 1] AS version, CASE WHEN number % 3 = 0 THEN 'cc-by' END AS license FROM cited),
    o AS (SELECT paper_id, url, min(position) AS position, coalesce(arg_min(version, position) FILTER (WHERE version IS NOT NULL), 'unknown') AS version, arg_min(license, position) FILTER (WHERE license IS NOT NULL) AS license FROM c GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY list_position(['publishedVersion', 'acceptedVersion', 'submittedVersion', 'unknown'], version), position) AS rank FROM o""", REFS_SQL + ",")
def pdf_locations_best(spark, sf):
    version = F.get(F.array(F.lit(None), F.lit("acceptedVersion"), F.lit("publishedVersion"), F.lit("submittedVersion")), (F.col("number") % 4).cast("int"))
    rows = cited(spark, sf).select(
        F.col("part").alias("paper_id"), (F.col("paper_id") * 100 + F.col("position")).alias("position"), version.alias("version"), F.when(F.col("number") % 3 == 0, "cc-by").alias("license"),
        F.concat(F.lit("https://host"), (F.col("supp") % 4).cast("string"), F.lit(".example/"), F.col("part").cast("string"), F.lit("#page="), F.col("number").cast("string")).alias("url"),
    )
    return resolve.best_copies(rows)


def _titled(spark, sf) -> DataFrame:
    """Works: the parts' and the benchmark's titles, whole."""
    part, items = table(spark, sf, "part"), table(spark, sf, "benchmark")
    named = F.concat("p_name", F.lit(" for "), F.lower("p_type"), F.lit(" systems"))
    return part.select(F.col("p_partkey").alias("work_id"), named.alias("title")).union(items.select(F.col("item_id") + 1_000_000_000, "text"))


@query()
def fuzzy_title_match(spark, sf):
    """Titles as line items print them - a letter lost, a word added, two words changed - and benchmark texts with letters lost, against
    all works; the ratio isn't SQL, tests compare it with all pairs."""
    works = _titled(spark, sf)
    slips = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("work_id"), (F.col("l_linenumber") % 3).alias("slip")).distinct()
    rows = works.join(slips.union(table(spark, sf, "benchmark").select(F.col("item_id") + 1_000_000_000, F.lit(3))), "work_id")
    lost = F.when(F.col("slip") == 0, F.regexp_replace("title", " systems$", " system")).when(F.col("slip") == 1, F.concat(F.lit("The "), F.regexp_replace("title", "e", "")))
    lost = lost.when(F.col("slip") == 2, F.regexp_replace("title", "for (\\w+)", "of new")).otherwise(F.regexp_replace("title", "th(?=e)", "t"))
    return matching.fuzzy_titles(rows.select((F.col("work_id") * 4 + F.col("slip")).alias("ref_id"), lost.alias("title")), works)


@query(r"""c AS (SELECT paper_id * 100 + position AS ref_id, CASE WHEN position % 4 = 0 THEN citation ELSE replace(citation, ' for ', ' - for: ') END AS citation FROM cited),
    w AS (SELECT p_partkey AS work_id, CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) ELSE p_name || ' for ' || lower(p_type) END AS title FROM part),
    k AS (SELECT DISTINCT citation, lower(regexp_replace(citation, '[^\p{L}\p{N}]+', '', 'g')) AS text FROM c),
    t AS (SELECT DISTINCT lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM w)
    SELECT ref_id, count(*) AS works, min(work_id) AS first_work FROM c JOIN (SELECT citation, key FROM k, t WHERE length(key) >= 15 AND contains(text, key)) USING (citation)
    JOIN (SELECT work_id, lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM w) USING (key) GROUP BY ref_id""", REFS_SQL + ",")
def contained_title_match(spark, sf):
    """Every printed citation, with signs inside its title or without, against all works, whose titles are whole or a part of one."""
    rows = cited(spark, sf).select(
        (F.col("paper_id") * 100 + F.col("position")).alias("ref_id"),
        F.when(F.col("position") % 4 == 0, F.col("citation")).otherwise(F.replace("citation", F.lit(" for "), F.lit(" - for: "))).alias("citation"),
    )
    title = F.when(F.col("p_partkey") % 5 == 0, F.lower("p_type")).otherwise(F.concat("p_name", F.lit(" for "), F.lower("p_type")))
    works = table(spark, sf, "part").select(F.col("p_partkey").alias("work_id"), title.alias("title"))
    titles = works.groupBy(text.compact_key(F.col("title")).alias("key")).agg(F.count("*").alias("n"), F.min("work_id").alias("first"))
    found = matching.contained_keys(rows, titles.select("key")).join(titles, "key")
    return found.groupBy("ref_id").agg(F.sum("n").alias("works"), F.min("first").alias("first_work"))


@query("""w AS (SELECT DISTINCT part AS work_id, year, family, volume, first_page FROM refs)
    SELECT r.paper_id, r.position, w.work_id FROM cited r JOIN w ON r.year = w.year AND r.family = w.family AND r.volume = w.volume AND r.first_page = w.first_page AND w.volume <> w.year""", REFS_SQL + ",")
def coordinates_match(spark, sf):
    works = refs(spark, sf).select(F.col("part").alias("work_id"), "year", "family", "volume", "first_page").distinct()
    rows = cited(spark, sf).select(F.struct("paper_id", "position").alias("ref_id"), "year", "family", "citation")
    return matching.match_coordinates(rows, works).select("ref_id.paper_id", "ref_id.position", "work_id")


@query(r"""SELECT p_partkey, n AS identities, n > 1 AS ambiguous FROM (SELECT p_partkey, count(*) OVER (PARTITION BY lower(regexp_replace(p_name, '[^\p{L}\p{N}]+', '', 'g'))) AS n FROM part)""")
def ambiguous_identity(spark, sf):
    works = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("doi"))
    return resolve.ambiguous_titles(works).select("p_partkey", "identities", "ambiguous")


@query(r"""m AS (SELECT paper_id, CASE WHEN part % 4 = 1 THEN NULL ELSE CASE part % 2 WHEN 0 THEN 'https://doi.org/' || upper(doi) ELSE doi END END AS doi, CASE WHEN position % 3 = 0 THEN '' ELSE title END AS title, year, citation AS text,
        row_number() OVER (PARTITION BY paper_id ORDER BY number % 3, position) AS i FROM cited),
    k AS (SELECT *, CASE WHEN doi IS NULL AND title = '' THEN ['x' || lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))]
        ELSE list_filter(['d' || lower(replace(doi, 'https://doi.org/', '')), CASE WHEN title <> '' THEN 't' || lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) END], lambda n: n IS NOT NULL) END AS names FROM m),
    f AS (SELECT DISTINCT paper_id, 0::BIGINT AS i, 0 AS row, 0 AS n, MAP {}::MAP(VARCHAR, INTEGER) AS known FROM k
      UNION ALL SELECT paper_id, i, coalesce(row, n + 1), CASE WHEN row IS NULL THEN n + 1 ELSE n END, map_concat(map_from_entries(list_transform(names, lambda x: (x, coalesce(row, n + 1)))), known)
      FROM (SELECT k.paper_id, k.i, k.names, f.n, f.known, coalesce(f.known[k.names[1]], f.known[k.names[2]]) AS row FROM f JOIN k ON f.paper_id = k.paper_id AND k.i = f.i + 1 WHERE f.n < 4))
    SELECT paper_id, row AS number, arg_min(doi, i) AS doi, arg_min(title, i) FILTER (WHERE title <> '') AS title, arg_min(year, i) AS year, arg_max(text, (length(text), -i)) AS text
    FROM f JOIN k USING (paper_id, i) WHERE row > 0 GROUP BY paper_id, row""", "RECURSIVE " + REFS_SQL + ",")
def merge_references(spark, sf):
    """Lists of three providers, rows of which lack the title, the identifier, or both; every paper's first four."""
    part = F.col("part")
    doi = F.when(part % 4 != 1, F.when(part % 2 == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi"))).otherwise(F.col("doi")))
    title = F.when(F.col("position") % 3 == 0, "").otherwise(F.col("title"))
    rows = cited(spark, sf).select("paper_id", (F.col("number") % 3).alias("source_rank"), "position", doi.alias("doi"), title.alias("title"), "year", F.col("citation").alias("text"))
    return resolve.merge_references(rows, limit=4)


@query("""SELECT item_id AS work_id, md5(text) AS abstract FROM benchmark""")
def inverted_index_roundtrip(spark, sf):
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("work_id"), "text")
    return resolve.rebuild_abstract(resolve.invert(texts)).withColumn("abstract", F.md5("abstract"))


@query("""e AS (SELECT part AS work_id, paper_id AS citing_id, count(*) AS cited_by_count FROM refs GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY cited_by_count DESC, citing_id) AS rank FROM e) WHERE rank <= 20""", REFS_SQL + ",")
def citing_topk(spark, sf):
    edges = refs(spark, sf).groupBy(F.col("part").alias("work_id"), F.col("paper_id").alias("citing_id")).agg(F.count("*").alias("cited_by_count"))
    return resolve.top_citing(edges)


# --- workspaces ------------------------------------------------------------------------------------


@query(r"""s AS (SELECT o_custkey AS owner, paper_id AS session_id, lower(doi) AS doi, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM refs JOIN orders ON paper_id = o_orderkey),
    u AS (SELECT owner, title, min(doi) AS only_doi FROM s WHERE doi IS NOT NULL AND length(title) >= 15 GROUP BY ALL HAVING count(DISTINCT doi) = 1),
    v AS (SELECT owner, session_id, coalesce(doi, only_doi, title) AS key, min(title) AS title FROM s LEFT JOIN u USING (owner, title) WHERE doi IS NOT NULL OR length(title) >= 15 GROUP BY 1, 2, 3)
    SELECT owner, key, count(*) AS sessions, min(title) AS title FROM v GROUP BY 1, 2 HAVING count(*) >= 2""", REFS_SQL + ",")
def shared_references(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("owner"))
    rows = refs(spark, sf).join(orders, "paper_id").select("owner", F.col("paper_id").alias("session_id"), "doi", "title")
    return workspace.shared_references(rows)


@query("""SELECT owner, session_id, source_key FROM (SELECT o_custkey AS owner, o_orderkey AS session_id, o_orderpriority AS source_key,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def unique_sessions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("saved_at"), F.col("o_orderpriority").alias("source_key"))
    return workspace.unique_sessions(rows).drop("saved_at")


@query(r"""WITH b AS (SELECT *, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS title_key, CASE WHEN p_partkey % 3 <> 0 THEN '10.1000/' || p_partkey || '_x' END AS own FROM part),
    t AS (SELECT title_key, min(own) AS sole FROM b WHERE own IS NOT NULL AND length(title_key) >= 15 GROUP BY title_key HAVING count(DISTINCT own) = 1),
    i AS (SELECT b.*, CASE WHEN own IS NOT NULL OR sole IS NOT NULL THEN 'd' || coalesce(own, sole) WHEN length(title_key) >= 15 THEN 't' || title_key ELSE 'r' || p_partkey END AS identity FROM b LEFT JOIN t USING (title_key)),
    k AS (SELECT identity, min(p_partkey) AS place, coalesce(min(p_partkey) FILTER (WHERE own IS NOT NULL), min(p_partkey)) AS best FROM i GROUP BY identity),
    r AS (SELECT place, row_number() OVER (ORDER BY place) AS n, p.* FROM k JOIN part p ON p.p_partkey = k.best)
    SELECT place AS "at", '@' || CASE WHEN p_size > 25 THEN 'article' ELSE 'misc' END || '{ref' || n || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {A. \& B\_' || p_partkey || '},' || chr(10) || '  year = {' || (1990 + p_size) || '},' || chr(10)
        || CASE WHEN p_size > 25 THEN '  journal = {J. 100\%},' || chr(10) ELSE '' END || CASE WHEN p_partkey % 3 <> 0 THEN '  doi = {10.1000/' || p_partkey || '_x},' || chr(10) ELSE '' END || '}' AS entry FROM r""")
def bibtex_entries(spark, sf):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("10.1000/"), k, F.lit("_x"))).alias("doi"), F.col("p_name").alias("title"),
        F.concat(F.lit("A. & B_"), k).alias("authors"), (F.col("p_size") + 1990).cast("string").alias("year"), F.when(F.col("p_size") > 25, "J. 100%").alias("journal"),
    )
    return workspace.bibtex(rows)


@query("""SELECT owner, session_id FROM (SELECT user_id AS owner, event_id AS session_id, row_number() OVER w AS nth, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS used
    FROM (SELECT *, CAST(value * 100 AS BIGINT) AS size FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) WHERE nth <= 50 AND (used <= 20000 OR nth = 1)""")
def retention(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("session_id"), F.col("ts").alias("saved_at"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return workspace.retain(rows, room=20_000).select("owner", "session_id")


@query(r"""WITH o AS (SELECT user_id AS owner, event_id AS k, event_type AS op, json_extract_string(props, '$.k') AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved_at FROM events),
    c AS (SELECT owner, max(k) FILTER (WHERE op = 'error' AND k % 5 = 0) AS cleared FROM o GROUP BY owner),
    r AS (SELECT owner, session_id, greatest(coalesce(max(k) FILTER (WHERE op = 'view'), -1), coalesce(any_value(cleared), -1)) AS gone FROM o JOIN c USING (owner) GROUP BY owner, session_id),
    s AS (SELECT o.owner, o.session_id, min(o.k) AS first, arg_min(o.saved_at, o.k) AS saved_at FROM o JOIN r USING (owner, session_id) WHERE op IN ('signup', 'purchase') AND o.k > gone GROUP BY ALL)
    SELECT s.owner, s.session_id, s.saved_at, max(o.k) AS written FROM s JOIN o ON o.owner = s.owner AND o.session_id = s.session_id AND o.k >= s.first AND op IN ('signup', 'purchase', 'click') GROUP BY ALL""")
def history_replay(spark, sf):
    """Each user's events as operations on sessions: sign-ups and purchases save, clicks update, views delete, some errors clear."""
    e = F.col("event_type")
    op = F.when(e.isin("signup", "purchase"), "save").when(e == "click", "update").when(e == "view", "delete").when(F.col("event_id") % 5 == 0, "clear")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("at"), op.alias("op"), F.get_json_object("props", "$.k").alias("session_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), F.lit(1).alias("bytes"),
    )
    return history.replay(rows, most=1_000_000).drop("bytes")


@query("""f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), g AS (SELECT p_brand, row_number() OVER (ORDER BY first) - 1 AS group_no FROM f),
    n AS (SELECT p_partkey AS paper_id, p_brand AS group_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS nth FROM part)
    SELECT paper_id, group_id, group_no, group_no * 860 + (nth % 3) * 260 AS x, nth // 3 * 110 + 160 AS y FROM n JOIN g ON group_id = p_brand""".replace("f AS", "WITH f AS", 1))
def graph_layout(spark, sf):
    return workspace.layout(table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("position")))


# --- evidence ----------------------------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT source AS group_id, doc_id AS position, n_chars AS size, n_chars > 6000 AS alone, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    p AS (SELECT group_id, position, i, size AS used, 1 AS held, 0 AS batch, alone FROM o WHERE i = 1
      UNION ALL SELECT group_id, position, i, CASE WHEN new THEN size ELSE used + size END, CASE WHEN new THEN 1 ELSE held + 1 END, batch + CASE WHEN new THEN 1 ELSE 0 END, alone
      FROM (SELECT o.*, p.used, p.held, p.batch, o.alone OR p.alone OR p.used + o.size > 6000 OR p.held >= 4 AS new FROM p JOIN o ON o.group_id = p.group_id AND o.i = p.i + 1))
    SELECT group_id, position, batch FROM p""")
def pack_batches(spark, sf):
    """All documents of a source in order; one over the room is a batch of its own. A source is a third of the table, and spreads."""
    units = table(spark, sf, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("position"), F.col("n_chars").alias("size"), (F.col("n_chars") > 6000).alias("alone"))
    return packing.pack(units, 6000, 4)


@query(r"""e AS (SELECT paper_id, position, '[' || position || '] ' || citation || CASE WHEN position = 3 THEN repeat(' and more', 40) ELSE '' END || chr(10) AS unit, max(position) OVER (PARTITION BY paper_id) AS n FROM cited),
    u AS (SELECT paper_id, position, length(unit) - CASE WHEN position = n THEN 1 ELSE 0 END AS size, n, length(unit) - CASE WHEN position = n THEN 1 ELSE 0 END > 400 AS alone FROM e),
    p AS (SELECT paper_id, position, size + 1 AS used, 1 AS held, 0 AS batch, alone FROM u WHERE position = 1
      UNION ALL SELECT paper_id, position, CASE WHEN new THEN size + 1 ELSE used + size + 1 END, CASE WHEN new THEN 1 ELSE held + 1 END, batch + CASE WHEN new THEN 1 ELSE 0 END, alone
      FROM (SELECT u.*, p.used, p.held, p.batch, u.alone OR p.alone OR p.used + u.size + 1 > 400 OR p.held >= 3 AS new FROM p JOIN u ON u.paper_id = p.paper_id AND u.position = p.position + 1)),
    b AS (SELECT paper_id AS group_id, batch, count(*) AS units, sum(size) + count(*) - 1 AS size FROM p JOIN u USING (paper_id, position) WHERE n > 1 GROUP BY paper_id, batch)
    SELECT group_id, batch, units, CAST(size AS BIGINT) AS size FROM b""", "RECURSIVE " + REFS_SQL + ",")
def bibliography_batches(spark, sf):
    """Every paper's printed list: labelled entries, one of them over the room, packed whole; lists of one entry are left out, as a
    single label doesn't make a list."""
    rows = cited(spark, sf).withColumn("more", F.when(F.col("position") == 3, F.repeat(F.lit(" and more"), F.lit(40))).otherwise(""))
    entry = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), "citation", "more")
    lists = rows.groupBy(F.col("paper_id").alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("entry")))).alias("entries")).where(F.size("entries") > 1)
    texts = lists.select("group_id", F.array_join(F.transform("entries", lambda x: x["entry"]), "\n").alias("text"))
    return packing.bibliography_batches(texts, 400, 3, preserve=True).select("group_id", "batch", "units", F.length("text").cast("long").alias("size"))


@query("""SELECT doc_id, CAST(least(600, 3000 // n) AS INT) AS room, md5(substr(text, 1, least(600, 3000 // n))) AS abstract FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def abstract_budget(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("request_id"), F.col("text").alias("abstract"))
    return evidence.abstract_budget(rows).select("doc_id", "room", F.md5("abstract").alias("abstract"))


@query("SELECT conv_id, turn, role, substr(text, 1, 600) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def history_compact(spark, sf):
    return evidence.last_messages(table(spark, sf, "conversations"))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS INT) AS batch FROM documents")
def intent_batches(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("request_id"), F.col("doc_id").alias("position"))
    return evidence.fixed_batches(rows).select("doc_id", "batch")


@query(r"""l AS (SELECT doc_id, line, position FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)),
    s AS (SELECT *, least(3, len(regexp_extract_all(lower(line), 'this'))) + least(3, len(regexp_extract_all(lower(line), 'les'))) AS hits FROM l)
    SELECT doc_id AS source_id, position, hits * 10 + CASE WHEN regexp_matches(left(line, 140), '(^|[^\p{L}\p{N}_])(abstract|conclusions?|results?|limitations?|methods?|methodology|discussion)($|[^\p{L}\p{N}_])', 'i') THEN 3 ELSE 0 END AS score,
      hits > 0 OR coalesce(lag(hits) OVER w, 0) > 0 OR coalesce(lead(hits) OVER w, 0) > 0 AS chosen FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY position)""".replace("l AS", "WITH l AS", 1))
def excerpt_rank(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return evidence.score_blocks(rows, ["this", "les"]).select("source_id", "position", "score", "chosen")


@query()
def source_excerpts(spark, sf):
    """Every document cut to a tenth of a source's room for a question; the greedy choice is compared with a plain one in the tests."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text", F.lit("What does les und the this show?").alias("question"))
    return excerpts.compact_sources(rows, excerpts.ROOM // 10).select("source_id", "cut", F.length("text").alias("length"), F.md5("text").alias("text"))


@query(r"""p AS (SELECT paper_id, number, arg_min(citation, position) AS entry, arg_min(title, position) AS title, arg_min(year, position) AS year FROM cited GROUP BY ALL),
    a AS (SELECT paper_id, number, position, CASE position % 2 WHEN 0 THEN upper(title) || '!' ELSE title END AS title, lower(regexp_replace(title, '[^\p{L}\p{N}_]+', '', 'g')) AS key FROM cited WHERE part % 3 <> 0),
    m AS (SELECT paper_id, number, arg_min(title, position) AS title FROM a GROUP BY ALL HAVING count(DISTINCT key) = 1)
    SELECT paper_id, number, coalesce(m.title, p.title) AS title, CASE WHEN m.title IS NULL THEN p.year ELSE '1900' END AS year, m.title IS NULL AS fallback FROM p LEFT JOIN m USING (paper_id, number)""", REFS_SQL + ",")
def ai_recovery(spark, sf):
    """A model's rows for each printed entry: two rows of one number agree if their titles do but for case and signs; else, and where it
    has none, title and year are those that are printed."""
    rows = cited(spark, sf)
    printed = rows.groupBy("paper_id", "number").agg(F.min_by("citation", "position").alias("entry"))
    title = F.when(F.col("position") % 2 == 0, F.concat(F.upper("title"), F.lit("!"))).otherwise(F.col("title"))
    said = rows.where("part % 3 <> 0").select("paper_id", F.lit(0).alias("request"), F.col("position").alias("place"), "number", title.alias("title"), F.array(F.lit("A. Model")).alias("authors"), F.lit("1900").alias("year"), "doi", F.lit("x").alias("text"))
    said = said.union(said.withColumn("number", F.col("number") + 100))  # numbers nobody printed
    return answers.merge_answers(printed, said).select("paper_id", "number", "title", "year", "fallback")


@query("""a AS (SELECT paper_id, position, CASE WHEN part % 3 <> 0 THEN position * 2 END AS number FROM cited),
    f AS (SELECT paper_id, k, row_number() OVER (PARTITION BY paper_id ORDER BY k) AS nth FROM (SELECT paper_id, unnest(range(1, 2 * count(*) + 1)) AS k FROM a GROUP BY paper_id) x
          ANTI JOIN a ON x.paper_id = a.paper_id AND x.k = a.number),
    n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, number IS NULL ORDER BY position) AS nth FROM a)
    SELECT n.paper_id, n.position, CAST(coalesce(n.number, f.k) AS INT) AS id FROM n LEFT JOIN f ON n.paper_id = f.paper_id AND n.nth = f.nth""", REFS_SQL + ",")
def id_allocation(spark, sf):
    rows = cited(spark, sf).select("paper_id", "position", F.when(F.col("part") % 3 != 0, F.col("position") * 2).alias("number"))
    return evidence.allocate_ids(rows).select("paper_id", "position", F.col("id").cast("int").alias("id"))


@query("""SELECT vec_id AS paper_id, vec_id % 10 <> 0 AS has_evidence, CASE WHEN vec_id % 10 <> 0 AND vec_id % 3 <> 0 AND vec_id % 7 <> 0 THEN label ELSE -1 END AS theme_id FROM embeddings""")
def theme_partition(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").alias("theme_id"))
    members = rows.where("paper_id % 3 <> 0")
    members = members.union(members.where("paper_id % 7 = 0").select("paper_id", F.col("theme_id") + 1))  # members of two themes
    return evidence.partition_check(members, rows.select("paper_id", (F.col("paper_id") % 10 != 0).alias("has_evidence")))


# --- flow --------------------------------------------------------------------------------------------

_CALLS_SQL = """c AS (SELECT event_type AS host, event_id AS call_id, CAST(user_id AS DOUBLE) * 0 + CAST(event_id // 4 AS DOUBLE) AS arrival, CAST(1 + event_id % 5 AS DOUBLE) AS duration FROM events)"""


@query(f"""WITH RECURSIVE {_CALLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, call_id) AS i FROM c),
    s AS (SELECT host, call_id, i, arrival AS start, duration FROM o WHERE i = 1
      UNION ALL SELECT o.host, o.call_id, o.i, greatest(o.arrival, s.start + greatest(3.0, s.duration)), o.duration FROM s JOIN o ON o.host = s.host AND o.i = s.i + 1)
    SELECT host, call_id, start FROM s""")
def pacing_schedule(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("call_id"), F.floor(F.col("event_id") / 4).cast("double").alias("arrival"), (F.col("event_id") % 5 + 1).cast("double").alias("duration"))
    return flow.pacing(calls, 3.0).select("host", "call_id", "start")


@query("""SELECT user_id AS host, event_id AS call_id, coalesce(max(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM events""")
def circuit_breaker(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") == "error").alias("blocked"))
    return flow.breaker(calls).select("host", "call_id", "skipped")


@query("SELECT event_id AS call_id, row_number() OVER (PARTITION BY event_type || props ORDER BY ts, event_id) = 1 AS sent FROM events")
def request_memo(spark, sf):
    calls = table(spark, sf, "events").select(F.concat("event_type", "props").alias("key"), F.col("event_id").alias("call_id"), "ts")
    return flow.memo(calls).select("call_id", "sent")


@query("SELECT event_id AS call_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000, false) AS hit FROM events")
def ttl_cache(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts")
    return flow.ttl_cache(calls).select("call_id", "hit")


@query("SELECT user_id AS request_id, count(*) AS requests, CAST(sum(length(props)) AS BIGINT) AS characters, max(length(props)) AS largest FROM events GROUP BY 1")
def usage_meter(spark, sf):
    return flow.usage(table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.length("props").alias("size")))


# --- corpus ------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS files FROM documents GROUP BY text")
def corpus_dedup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("files"))


@query("""c AS (SELECT year, CASE WHEN part % 2 = 0 THEN 'pdf' WHEN part % 3 = 0 THEN 'open_record' ELSE 'scholar' END AS category FROM refs)
    SELECT category, year, count(*) AS n FROM c GROUP BY ROLLUP (category, year)""", REFS_SQL + ",")
def openness_rollup(spark, sf):
    """An extension: openness by category and year, with subtotals."""
    rows = refs(spark, sf).select("year", F.when(F.col("part") % 2 == 0, "pdf").when(F.col("part") % 3 == 0, "open_record").otherwise("scholar").alias("category"))
    return rows.rollup("category", "year").agg(F.count("*").alias("n"))
