"""Citation parsing and column functions on small cases of our own."""

import pytest
from pyspark.sql import functions as F

from citewright.functions import citation, text


@pytest.mark.parametrize(
    ("printed", "title", "year", "authors"),
    [
        ("[3] A. Bcd, E. Fgh, green widget for small brass systems, J. Power Sources 43 (1997) 11-20.", "green widget for small brass systems", "1997", ["A. Bcd", "E. Fgh"]),
        ("Smith, J., & Doe, A. B. (2011). Learning to parse. Journal of Tests, 3(2), 1-9.", "Learning to parse", "2011", ["Smith, J.", "Doe, A. B"]),
        ("[1] A. Bcd, J. Power Sources 12 (1996) 1-10.", "", "1996", ["A. Bcd"]),
        ("Miller AB. A study of things. Lancet 2001;3:4-9.", "A study of things", "2001", ["Miller AB"]),
        ("", "", None, []),
        (None, "", None, []),
    ],
)
def test_citation_fields(printed, title, year, authors):
    assert citation.fields_of(printed)[:3] == (title, year, authors)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_latex_is_escaped_once(spark):
    assert one(spark, text.latex(F.lit(r"a\b & c_d {50%}"))) == r"a\textbackslash{}b \& c\_d \{50\%\}"


@pytest.mark.parametrize(
    ("url", "safe"),
    [("https://a.example/x#p", "https://a.example/x"), ("http://u:p@a.example/", None), ("http://192.168.1.2/", None), ("http://[::1]/", None), ("ftp://a.example/", None), ("http://a.example:8080/", None), ("http://a b.example/", None)]
    + [(f"http://{x}/", None) for x in ("192.0.2.1", "198.18.0.1", "198.19.255.1", "198.51.100.7", "203.0.113.9", "240.0.0.1", "255.255.255.255", "100.64.0.1", "0.0.0.0")]
    + [(f"http://{x}/", f"http://{x}/") for x in ("192.0.3.1", "198.20.0.1", "100.128.0.1", "8.8.8.8", "172.32.0.1", "10.example")],
)
def test_safe_url(spark, url, safe):
    assert one(spark, text.safe_url(F.lit(url))) == safe


def test_ratio_keeps_argument_order(spark):
    df = spark.createDataFrame([("abcdefghij", "abcdefghiX"), ("short", "short")], "a string, b string")
    assert [round(r.r, 2) for r in df.select(citation.title_ratio("a", "b").alias("r")).collect()] == [0.9, 0.0]


def test_identifiers_and_secrets_of_sessions(spark):
    assert [one(spark, text.workspace_doi(F.lit(x))) for x in ("https://doi.org/10.1/A", "doi: 10.1/A ", "HTTP://dx.doi.org/doi:10.1/a", None)] == ["10.1/a"] * 3 + [""]
    assert one(spark, text.scholar_url(F.lit(None).cast("string"), F.lit(" "), F.lit("a b"))) == "https://scholar.google.com/scholar?q=a+b"
    assert one(spark, text.redacted(F.lit("x SECRET-12 y"), "SECRET-12")) == "x [redacted] y" and one(spark, text.redacted(F.lit("x abc y"), "abc")) == "x abc y"
    urls = {"https://a.example/?API_KEY=1": None, "https://a.example/?q=1&access_token=2": None, "https://a.example/?q=key": "https://a.example/?q=key", "https://a.example/": "https://a.example/", "https://a.example/?X-Amz-Signature=1": None, "https://a.example/?Authorization=1": None}
    assert {u: one(spark, text.secret_free(F.lit(u))) for u in urls} == urls and one(spark, text.secret_free(F.lit("https://a.example/SECRET-12"), "SECRET-12")) is None


@pytest.mark.parametrize("host", ["10.0.0.1003", "127.1", "192.168.1.2000", "172.20.0.999", "0.0.0.0"])
def test_hosts_that_begin_as_private_addresses_are_refused(spark, host):
    assert one(spark, text.safe_url(F.lit(f"http://{host}/x"))) is None


def test_hosts_that_only_resemble_private_addresses_stay(spark):
    assert [one(spark, text.safe_url(F.lit(f"http://{h}/x#a"))) for h in ("100.com", "172.32.0.1", "a10.example")] == ["http://100.com/x", "http://172.32.0.1/x", "http://a10.example/x"]
