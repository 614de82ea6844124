"""URL splitting against the standard library, hostile inputs included."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from lurewatch.operators import rules as R
from lurewatch.operators.parts import distinct_urls, labels_of, url_parts

HOSTILE = [
    "http://user:pw@Shop.Example.co.uk:8080/a/b;p=1?x=1&y=#frag", "https://exa_mple.com/a|b", "www.plain.org/path", "//cdn.example.net/x",
    "mailto:someone@example.org", "https://xn--bcher-kva.example/", "https://bücher.example/ü?ß=1", "http://a..b.com/../x", "http://[::1]:80/x",
    "http://192.168.0.1/login", "data:text/html,<b>x</b>", "javascript:alert(1)", "https://example.com?q=1#a?b", "http://%zz.example.com/%zz",
    "HTTP://UPPER.EXAMPLE.COM/A", "https://e.com/" + "a" * 3000, "x", "http://", "https://zero​width.com/‮gpj", "http:///nohost",
]


def test_parts_match_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(HOSTILE)), "url_id long, url string")
    for r in url_parts(df).collect():
        p = urlparse(r.url)
        assert (r.scheme, r.netloc, r.path, r.query, r.fragment) == (p.scheme, p.netloc, p.path, p.query, p.fragment), r.url


def test_registered_domain_and_label(spark):
    df = spark.createDataFrame(list(enumerate(HOSTILE)), "url_id long, url string")
    got = {r.url: r for r in url_parts(df).collect()}
    assert got[HOSTILE[0]].registered_domain == "example.co.uk" and got[HOSTILE[0]].subdomain == "shop" and got[HOSTILE[0]].port == 8080
    assert got["http://192.168.0.1/login"].tld == "" and got["http://192.168.0.1/login"].is_ip
    assert got["www.plain.org/path"].netloc == ""


def test_suffix_list_and_join_agree(spark):
    df = spark.createDataFrame([(1, "http://a.b.co.uk/"), (2, "http://a.b.com/"), (3, "http://x.y.z.gov.au/")], "url_id long, url string")
    few = spark.createDataFrame([("co.uk",), ("z.gov.au",)], "suffix string")
    many = few.union(spark.range(600).select(F.concat(F.lit("s"), "id", F.lit(".zz"))))
    a = url_parts(df, few).orderBy("url_id").collect()
    assert a == url_parts(df, many).orderBy("url_id").collect()
    assert [r.registered_domain for r in a] == ["b.co.uk", "b.com", "y.z.gov.au"]


def test_distinct_first(spark):
    df = spark.range(1000).select(F.col("id").alias("url_id"), F.when(F.col("id") < 900, "http://hot.com/").otherwise(F.concat(F.lit("http://c"), "id", F.lit(".com"))).alias("url"))
    rows = {r.url: r.n_seen for r in distinct_urls(df).collect()}
    assert rows["http://hot.com/"] == 900 and len(rows) == 101
    assert labels_of(url_parts(distinct_urls(df))).count() == 101


def test_validity_reasons(spark):
    cases = [("", "empty"), ("ab", "too_short"), ("http:///x", "missing_domain"), ("http://a b.com/", "space_in_domain"), ("http://a<b.com/", "bad_character"),
             ("http://a..com/", "double_dot"), ("http://999.1.1.1/", "bad_ip"), ("http://ok.com/\x00", "null_byte"), ("ok.com/x", None), ("http://[::1]/x", None)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "url_id long, url string")
    for r in R.with_validity(df).collect():
        want = cases[r.url_id][1]
        assert (want in r.issues) if want else r.is_valid, (cases[r.url_id], r.issues)
