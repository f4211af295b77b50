"""Joins of references with works that share no key: by like titles, by a title inside a citation, by printed place.

Each finds its candidates through an index that loses none - rarest grams, window fingerprints, inverted places - joins ids
only, and decides on the texts afterwards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.citation import title_ratio
from ..functions.text import compact_key
from ..functions.tokens import once, place_key, stands_in

SHORTEST = 8  # characters of a key that has a ratio
WHOLE = 200  # from this length on even equal keys may have a ratio below 1: it passes over a key's frequent characters
EVIDENCE = 4  # shared grams that a pair must show, where so many are sure


def gram_size(least: float, shortest: int = SHORTEST) -> int:
    """The longest gram of which two keys that reach the ratio must share one, whatever their length."""
    return next(q for q in (4, 3, 2, 1) if sure_grams(2 * shortest, least, q) >= 1)


def sure_grams(both: int, least: float, q: int) -> float:
    """Grams of q characters that two keys of together ``both`` characters share at least if their ratio reaches ``least``.

    They match M >= least * both / 2 characters. Between two of their matching blocks lies an unmatched character at least, so
    there are at most both - 2 M + 1 blocks; each holds its length less q - 1 grams."""
    return both * (least / 2 - (q - 1) * (1 - least)) - (q - 1)


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the intersection of the character bags: an upper bound of matched characters."""
    letters = F.array_distinct(F.split(a, ""))
    count = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    return F.aggregate(letters, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def _grams(key: str, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - q + 1), lambda i: F.substring(F.col(key), i, F.lit(q))))


def like_keys(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(ka, kb, ratio) of all pairs of the distinct keys ka of ``left`` and kb of ``right`` that reach the ratio.

    A prefix filter on grams: of a key with d grams at most that a partner can lack, one of the d + 1 rarest is in the partner, and
    among as many of the partner's. EVIDENCE more of each are indexed, so that pairs must share several of them; what these
    leave is tested by all grams, then by the bags of characters, and only the rest is rated. Keys travel as 128-bit names."""
    q = gram_size(least)
    closest = least / (2 - least)  # the shortest partner, as a share of a key's length
    slope, base = least / 2 - (q - 1) * (1 - least), q - 1
    sure = lambda both: F.greatest(F.lit(1), F.ceil(both * slope - base - 1e-9)).cast("int")
    lacked = lambda n, s: n - (q - 1) - s  # grams of a key of n characters that needn't be in the partner
    named = lambda df, key: df.select(key).distinct().select(F.unhex(F.md5(key)).alias("id"), F.col(key).alias("key"), F.length(key).alias("n"), _grams(key, q).alias("grams"))
    a, b = named(left, "ka"), named(right, "kb")
    each = lambda df, side: df.select(F.lit(side).alias("side"), "id", "n", F.explode("grams").alias("gram"))
    rows = each(a, 0).union(each(b, 1))
    use = rows.groupBy("gram").agg(F.count("*").alias("uses"), F.count_if(F.col("side") == 0).alias("in_a"))
    use = use.where("in_a > 0 and in_a < uses").select("gram", "uses")  # a gram of one side alone still takes a rank
    ranked = rows.join(use, "gram", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    index = ranked.groupBy("side", "id", "n").agg(F.collect_list(F.struct("uses", "gram")).alias("all"))
    prefix = (lacked(F.col("n"), sure(F.col("n") * (1 + closest))) + EVIDENCE).cast("int")
    index = index.select("side", "id", "n", F.size("all").alias("m"), F.explode(F.slice(F.array_sort("all"), F.lit(1), prefix)).alias("g")).where("g.uses > 0")
    of = lambda side, x: index.where(F.col("side") == side).select(F.col("g.gram").alias("gram"), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"))
    both = sure(F.col("n_a") + F.col("n_b"))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * closest - 1e-9)
    pairs = of(0, "a").join(of(1, "b"), "gram").where(fits)
    needed = F.greatest(F.lit(1), F.col("m_a") - lacked(F.col("n_a"), both), F.col("m_b") - lacked(F.col("n_b"), both))
    pairs = pairs.groupBy("id_a", "id_b", "n_a", "n_b", "m_a", "m_b").agg(F.count("*").alias("shared")).withColumn("needed", needed)
    pairs = pairs.where(F.col("shared") >= F.least(F.col("needed"), F.lit(EVIDENCE))).select("id_a", "id_b", "needed")
    full = pairs.join(a.select(F.col("id").alias("id_a"), F.col("key").alias("ka"), F.col("grams").alias("ga")), "id_a").join(b.select(F.col("id").alias("id_b"), F.col("key").alias("kb"), F.col("grams").alias("gb")), "id_b")
    full = full.where(F.size(F.array_intersect("ga", "gb")) >= F.col("needed")).select("ka", "kb")
    full = full.where(shared_characters(F.col("ka"), F.col("kb")) * 2.0 >= F.lit(least) * (F.length("ka") + F.length("kb")) - 1e-9)
    return full.withColumn("ratio", title_ratio("ka", "kb")).where(F.col("ratio") >= least)


def fuzzy_titles(refs: DataFrame, works: DataFrame, least: float = 0.88) -> DataFrame:
    """Best work by title ratio for each reference: (ref_id, work_id, ratio).

    Equal keys, whose ratio none exceeds, are joined first; the others meet by ``like_keys``. Ties go to the smallest work_id.
    Keys under SHORTEST characters, and null titles, match nothing."""
    keyed = lambda df, key: df.withColumn(key, compact_key(F.col("title"))).where(F.length(key) >= SHORTEST)
    a, b = keyed(refs, "ka").select("ref_id", "ka"), keyed(works, "kb").select("work_id", "kb")
    first = b.groupBy("kb").agg(F.min("work_id").alias("work_id"))
    equal = a.where(F.length("ka") < WHOLE).join(first, F.col("ka") == F.col("kb")).select("ref_id", "ka", "work_id", F.lit(1.0).alias("ratio"))
    left = a.join(equal.select("ka").distinct(), "ka", "left_anti")
    rated = like_keys(left.select("ka"), first.select("kb"), least)
    best = rated.join(first, "kb").groupBy("ka").agg(F.min_by("work_id", F.struct((-F.col("ratio")).alias("worse"), "work_id")).alias("work_id"), F.max("ratio").alias("ratio"))
    near = left.join(best, "ka").select("ref_id", "work_id", "ratio")
    return equal.select("ref_id", "work_id", "ratio").union(near)


def contained_keys(refs: DataFrame, keys: DataFrame, least: int = 15) -> DataFrame:
    """(ref_id, key) where a title key of ``least`` characters and more stands in the key of a citation.

    A title meets citations by the fingerprint of one of its windows of ``least`` characters, the one that fewest citations have;
    only fingerprints of windows that some title has are kept of the citations, and ids only. The texts decide."""
    windows = lambda key: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - least + 1), lambda i: F.xxhash64(F.substring(F.col(key), i, F.lit(least)))))
    cited = refs.select("ref_id", compact_key(F.col("citation")).alias("text")).where(F.length("text") >= least)
    # equal keys share their fate, so each is met once
    distinct = keys.where(F.length("key") >= least).select("key").distinct().withColumn("name", F.unhex(F.md5("key")))
    wanted = distinct.select("name", F.explode(windows("key")).alias("print"))
    printed = cited.select("ref_id", F.explode(windows("text")).alias("print")).join(wanted.select("print").distinct(), "print", "left_semi")
    uses = printed.groupBy("print").agg(F.count("*").alias("n"))
    rarest = wanted.join(uses, "print", "left").groupBy("name").agg(F.min_by("print", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "print")).alias("print"))
    met = printed.join(rarest, "print").select("ref_id", "name")
    return met.join(distinct, "name").join(cited, "ref_id").where(F.contains("text", F.col("key"))).select("ref_id", "key")


def contained_titles(refs: DataFrame, works: DataFrame, least: int = 15) -> DataFrame:
    """(ref_id, work_id) where a work's title key of ``least`` characters and more stands in the key of a citation.

    A title of many works gives each of its citations all of them; where a number or the least will do, works are grouped by key
    first and meet ``contained_keys``."""
    titled = works.select("work_id", compact_key(F.col("title")).alias("key"))
    return contained_keys(refs, titled.select("key"), least).join(titled, "key").select("ref_id", "work_id")


#: Words before a page, signs before it, what a year looks like; and what stands for a bracketed issue or date.
PAGES, SIGNS, YEAR, GROUP = ("p", "pp"), (",", ";", ":"), "^(1[89]|20)[0-9]{2}$", "§"


def places(citation: Column) -> Column:
    """All places that a citation may print, as an array of volume and page, lower case, each once.

    Each word with a figure in it may be a page. From there the tokens are read backwards: a "p." or "pp.", a comma,
    semicolon or colon, a year, at most two bracketed groups, and the volume, a word that no square or round bracket
    touches. A year may be the volume itself, and a page may follow its p without a blank."""
    text = F.regexp_replace(F.lower(citation), r"\([\p{L}\p{N}_\s,\x{2013}-]+\)", f" {GROUP} ")
    return once(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)), _places)


def _places(t: Column) -> Column:
    at = lambda k: F.coalesce(F.get(t, F.when(k >= 0, k)), F.lit(""))
    less = lambda k, hit: k - F.when(hit, 1).otherwise(0)
    # each step is a pass over (page, place): what a step reads often is made once by the one before
    step = lambda rows, k: F.transform(rows, lambda x: F.struct(x["w"].alias("w"), k(x).alias("k")))
    rows = F.filter(F.transform(t, lambda w, j: F.struct(w.alias("w"), j.alias("k"))), lambda x: x["w"].rlike("[0-9]"))
    rows = step(rows, lambda x: F.when(at(x["k"] - 1).isin(*PAGES), x["k"] - 2).when((at(x["k"] - 1) == ".") & at(x["k"] - 2).isin(*PAGES), x["k"] - 3).otherwise(x["k"] - 1))
    rows = step(rows, lambda x: less(x["k"], at(x["k"]).isin(*SIGNS)))
    rows = F.flatten(F.transform(rows, lambda x: F.when(at(x["k"]).rlike(YEAR), F.array(x, F.struct(x["w"].alias("w"), (x["k"] - 1).alias("k")))).otherwise(F.array(x))))
    rows = step(rows, lambda x: less(less(x["k"], at(x["k"]) == GROUP), (at(x["k"]) == GROUP) & (at(x["k"] - 1) == GROUP)))
    rows = F.filter(rows, lambda x: at(x["k"]).rlike(r"^[\p{L}\p{N}_]") & ~at(x["k"] - 1).isin("[", "(") & ~at(x["k"] + 1).isin("]", ")"))
    place = lambda x, page: F.struct(at(x["k"]).alias("volume"), page.alias("page"))
    found = F.transform(rows, lambda x: F.when(x["w"].rlike("^pp?[0-9]"), F.array(place(x, x["w"]), place(x, F.regexp_replace(x["w"], "^pp?", "")))).otherwise(F.array(place(x, x["w"]))))
    return F.array_distinct(F.flatten(found))


def printed_places(refs: DataFrame, *ids: str) -> DataFrame:
    """(ids, key: volume and page, lower case) of all ``places`` of a citation."""
    return refs.select(*ids, F.explode(places(F.col("citation"))).alias("key"))


def match_coordinates(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id) of references (ref_id, citation, year, family) that print volume and first page of a work (work_id, volume,
    first_page, year, family): an equi-join on year, family, volume and page, as each citation is read once into the places it
    may print. Ids only are joined; the citation is fetched again where a volume or page is more than one word."""
    found = printed_places(refs, "ref_id", "year", "family")
    keyed = works.select("work_id", "year", "family", "volume", "first_page", place_key(F.col("volume"), F.col("first_page")).alias("key")).where("key is not null and not volume <=> year")
    met = found.join(keyed, ["year", "family", "key"]).select("ref_id", "work_id", "year", "volume", "first_page")
    one_word = F.trim("volume").rlike(r"^[\p{L}\p{N}_]+$") & F.trim("first_page").rlike(r"^[\p{L}\p{N}_]+(\s*[-\x{2013}\x{2014}].*)?$")
    rest = met.where(~one_word).join(refs.select("ref_id", "citation"), "ref_id").where(stands_in(F.col("citation"), F.col("volume"), F.col("first_page"), F.col("year")))
    return met.where(one_word).select("ref_id", "work_id").union(rest.select("ref_id", "work_id"))
