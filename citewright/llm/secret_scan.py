"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Everything is a Column expression over one text; the scan is a map without shuffle.

Base kinds are found by pattern with code-point positions. Further candidates are runs of
24 and more characters of the base64 alphabets that mix at least two of lower case, upper
case and digits. Each gets the encoding whose alphabet fits (hex, base32, base64), and its
alphabet ranks face three tests of randomness: chi-squared uniformity over four equal parts
of the alphabet, the runs test about the alphabet's middle, and lag-one serial correlation.
The three p-values (normal approximations) are combined by the least times three. Within a
text, Benjamini-Hochberg at Q rejects randomness for candidates in order of p over a weight
that grows with length, as longer strings give the tests more power; candidates for which
randomness is not rejected are spans of kind ``random``, unless a base span covers them.

Defined cases: null counts as empty; an empty text has no spans and base_sha256 of the empty
string; long texts are scanned whole; repeated rows give repeated results; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a maximal run of 16 and more, the same as filtering maximal runs
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
Q = 0.05
_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<s, o, kind, e, m>> of the leftmost non-overlapping matches: start, order
    of kind, end and matched text. Starts add up the pieces between the matches and the matches."""
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(F.get(pieces, i))).alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"),
            (acc["at"] + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).alias("e"), F.get(found, i).alias("m"),
        ))).alias("out"),
    )
    none = F.expr("cast(array() as array<struct<s:int,o:int,kind:string,e:int,m:string>>)")
    all_ = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    out = F.when(F.regexp_like(text, F.lit(pattern)), all_).otherwise(none)
    return F.filter(out, keep) if keep is not None else out


def _tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal z (Abramowitz and Stegun 26.2.17, to 1e-7)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + x * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x / 2.0) * (2.0 * 0.3989422804014327))


def _score(m: Column) -> Column:
    """struct<s, o, kind, e, n, p> of a candidate: length and combined p-value under randomness."""
    body = F.rtrim(m["m"], F.lit("="))
    plain = F.translate(body, "-_", "+/")
    is_hex, is_b32 = F.regexp_like(F.lower(body), F.lit("^[0-9a-f]+$")), F.regexp_like(body, F.lit("^[A-Z2-7]+$"))
    alphabet = F.when(is_hex, _HEX).when(is_b32, _B32).otherwise(_B64)
    coded = F.when(is_hex, F.lower(body)).when(is_b32, body).otherwise(plain)
    size = F.length(alphabet).cast("double")
    n = F.length(body).cast("double")
    codes = F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: (F.position(F.substring(coded, i, F.lit(1)), alphabet) - F.lit(0.5)) / size)
    return F.struct(m["s"].alias("s"), m["o"].alias("o"), m["kind"].alias("kind"), m["e"].alias("e"), n.alias("n"), codes.alias("u"))


def _battery(c: Column) -> Column:
    u, n = c["u"], c["n"]
    fourth = lambda k: F.size(F.filter(u, lambda x: F.floor(x * 4.0) == k)).cast("double")
    chi = sum((fourth(k) - n / 4.0) * (fourth(k) - n / 4.0) / (n / 4.0) for k in range(4))
    # Wilson-Hilferty: the cube root of chi-squared over its 3 degrees of freedom is nearly normal
    z = (F.pow(chi / 3.0, F.lit(1 / 3)) - (1.0 - 2.0 / 27.0)) / (2.0 / 27.0) ** 0.5
    p_chi = F.when(z > 0, _tail(z) / 2.0).otherwise(F.lit(1.0))
    above = F.size(F.filter(u, lambda x: x >= 0.5)).cast("double")
    below = n - above
    lagged = F.zip_with(F.slice(u, F.lit(1), F.size(u) - 1), F.slice(u, F.lit(2), F.size(u) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = 1.0 + F.size(F.filter(lagged, lambda x: (x["a"] >= 0.5) != (x["b"] >= 0.5)))
    mean = 1.0 + 2.0 * above * below / n
    var = F.greatest(F.lit(1e-9), (mean - 1.0) * (mean - 2.0) / (n - 1.0))
    p_runs = F.when((above > 0) & (below > 0), _tail((runs - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
    total = F.aggregate(u, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(u, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n))
    cross = F.aggregate(lagged, F.lit(0.0), lambda a, x: a + (x["a"] - total / n) * (x["b"] - total / n))
    p_serial = F.when(square > 0, _tail((cross / square + 1.0 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
    p = F.least(F.lit(1.0), 3.0 * F.least(p_chi, p_runs, p_serial))
    return F.struct(c["s"].alias("s"), c["o"].alias("o"), c["kind"].alias("kind"), c["e"].alias("e"), (p / F.log2(n)).alias("w"), F.log2(n).alias("weight"))


def random_spans(text: Column, base: Column) -> Column:
    """Spans of candidates that pass for random under the length-weighted step-up procedure."""
    mixed = lambda m: (
        F.regexp_like(m["m"], F.lit("[A-Za-z]")) & F.regexp_like(m["m"], F.lit("[0-9]"))
        | F.regexp_like(m["m"], F.lit("[a-z][A-Z]"))
    )
    free = lambda m: ~F.exists(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    found = F.filter(spans(text, CANDIDATE, "random"), lambda m: mixed(m) & free(m))
    tested = F.array_sort(F.transform(F.transform(found, _score), _battery), lambda a, b: F.when(a["w"] < b["w"], -1).when(a["w"] > b["w"], 1).otherwise(a["s"] - b["s"]))
    weights = F.aggregate(tested, F.lit(0.0), lambda a, x: a + x["weight"])
    # the weights average one: a candidate of weight share w_i is compared at Q * rank / count * w_i
    rank_ok = F.filter(F.sequence(F.lit(1), F.size(tested)), lambda i: F.get(tested, i - 1)["w"] * weights <= F.lit(Q) * i)
    cut = F.coalesce(F.array_max(rank_ok), F.lit(0))
    left = F.filter(tested, lambda x, i: i >= cut)
    return F.when(F.size(found) > 0, F.transform(left, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["kind"].alias("kind"), x["e"].alias("e"))))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["kind"].alias("kind"), x["e"].alias("e")))
    out = docs.select(
        F.col("doc_id"), t.alias("_t"),
        bare(spans(t, ASSIGN, "assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)).alias("_assign"),
        bare(spans(t, ACCESS, "access", lambda x: F.length(x["m"]) >= 18)).alias("_access"), bare(spans(t, HEX, "hex")).alias("_hex"),
    )
    out = out.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    out = out.withColumn("_random", F.coalesce(random_spans(F.col("_t"), F.col("_base")), F.slice("_base", 1, 0)))
    count = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id", count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"), count("_random").alias("n_random"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", "_random")).alias("spans"),
    )
