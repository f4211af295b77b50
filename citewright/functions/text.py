"""Column functions over titles, identifiers, years and addresses; all of them stay in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])"
DOI = r"^10\.[0-9]{4,9}/\S+$"
#: How hosts of figures in private ranges begin, whatever follows: "10.0.0.1003" is no address, but no public name either.
UNROUTED = r"^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\."


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]{2,}|[\s\u00a0&&[^ ]]", " "))  # a single blank stays, unreplaced


def compact_key(c: Column) -> Column:
    """Letters and digits only, lower-cased: the key of title similarity and of merging."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def folded_key(c: Column) -> Column:
    """Case-folded, keeping underscores: the key of open-access matches and fingerprints."""
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", ""), F.lit("ß"), F.lit("ss"))


def spaced_key(c: Column) -> Column:
    """Lower-cased words with one blank between: the workspace's title key, for composed text."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]{2,}|[^\p{L}\p{N} ]", " "))


def normalize_doi(c: Column) -> Column:
    """Without prefix, resolver address, percent codes and closing punctuation; case is kept.

    A plus sign isn't a blank here, and text that can't be decoded stays as it is."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    decoded = F.when(F.contains(bare, F.lit("%")), decoded).otherwise(bare)  # nothing else is decoded
    return F.regexp_replace(F.trim(decoded), r"[.,;:)\]}]+$", "")


def valid_doi(c: Column) -> Column:
    return c.rlike(DOI)


def doi_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", "")))


def years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(YEAR), F.lit(1))


def safe_url(c: Column) -> Column:
    """The address without fragment, or null unless it is a public http(s) one: no user or
    password, default ports, no white space, no local host, no address outside the global ranges, no IPv6 literal."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:@\s\[\]]+)(:[0-9]*)?(?:[/?#]|$)", 1))
    port = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#:@\s\[\]]+(?::([0-9]*))?(?:[/?#]|$)", 1)
    octets = F.transform(F.split(F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), host), r"\."), lambda x: x.cast("int"))
    first, second, third = octets[0], octets[1], octets[2]
    # Ranges of addresses that aren't global (private, shared, local, documentation, benchmark, reserved)
    private = F.coalesce(
        first.isin(0, 10, 127) | (first >= 240) | ((first == 100) & second.between(64, 127)) | ((first == 169) & (second == 254))
        | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)) | ((first == 198) & second.isin(18, 19))
        | ((first == 192) & (second == 0) & third.isin(0, 2)) | ((first == 198) & (second == 51) & (third == 100)) | ((first == 203) & (second == 0) & (third == 113)),
        F.lit(False),
    ) | (host.rlike(r"^[0-9.]+$") & host.rlike(UNROUTED))
    ok = (
        (F.length(c) <= 4000) & c.rlike(r"(?i)^https?://") & ~c.rlike(r"\s") & (host != "")
        & port.isin("", "80", "443") & ~host.isin("localhost", "metadata.google.internal") & ~host.endswith(".localhost") & ~private
    )
    return F.when(ok, F.regexp_replace(c, "#.*$", ""))


def strict_integer(c: Column) -> Column:
    """A positive id written as ASCII digits, else null."""
    return F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long")).cast("long")


def retry_after(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,10}$"), F.least(c.cast("long"), F.lit(300))).cast("long")


def latex(c: Column) -> Column:
    """Special characters escaped in one pass, so escapes aren't escaped again."""
    special = F.create_map(*[F.lit(x) for k, v in LATEX.items() for x in (k, v)])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(special, x), x)), "")


# LaTeX's special characters.
LATEX = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_", "%": r"\%",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}


def workspace_doi(c: Column) -> Column:
    """The key of an identifier in saved sessions: without resolver address, then without prefix, lower-cased; empty if there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", "")))


def redacted(c: Column, key: str | None) -> Column:
    """A text in which a secret key of eight characters and more doesn't stand."""
    return F.replace(c, F.lit(key), F.lit("[redacted]")) if key and len(key) >= 8 else c


def scholar_url(*titles: Column) -> Column:
    """A search address for the first title that isn't empty; blanks become plus signs."""
    c = F.coalesce(*[F.when(F.trim(t) != "", t) for t in titles])
    quoted = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), quoted)


def first_date_year(*parts: Column) -> Column:
    """The first year of the first of several nested date lists that has one."""
    return F.coalesce(*[F.get(F.get(p, 0), 0) for p in parts]).cast("string")


def clip_label(c: Column, width: int = 27, least: int = 12) -> Column:
    """A graph label of at most two lines of ``width`` characters, broken at the last blank behind ``least``."""
    head = F.regexp_extract(c, rf"^(.{{{least},{width}}})(?:\s|$)", 1)
    first = F.when(F.length(c) <= width, c).when(head != "", head).otherwise(F.left(c, F.lit(width)))
    rest = F.trim(F.substring(c, F.length(first) + 1, F.length(c)))
    second = F.when(F.length(rest) > width, F.concat(F.left(rest, F.lit(width - 1)), F.lit("…"))).otherwise(rest)
    return F.when(rest == "", F.array(first)).otherwise(F.array(first, second))


# Parts of a query's names that tell a secret.
SECRETS = ("key", "token", "secret", "password", "signature", "authorization")


def secret_free(url: Column, key: str | None = None) -> Column:
    """The address, or null where its query names a secret, or the ``key`` of eight characters and more stands in it."""
    names = F.transform(F.split(F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))), "&"), lambda x: F.split(x, "=")[0])
    told = F.exists(names, lambda n: functools.reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in SECRETS]))
    held = F.contains(url, F.lit(key)) if key and len(key) >= 8 else F.lit(False)
    return F.when(~told & ~held, url)
