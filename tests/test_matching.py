"""The anchor index and the regex rules against brute force, user tables in the scorers, spread joins."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.operators import containment as C
from lurewatch.operators import findings as A
from lurewatch.operators import rules as R
from lurewatch.operators.base_features import pattern_columns, pattern_flags
from lurewatch.operators.parts import url_parts
from lurewatch.session import spread_left_join
from lurewatch.sources.reference import read_reference

URLS = ["http://paypal-login.com/a", "https://x.tk/login?u=1", "http://10.1.2.3:8080/p.exe", "https://asdf--aaaa.com/secure/", None, "",
        "https://www.verify-account.xyz/wp-admin/x", "http://xn--pypal-4ve.com/12345/", "https://example.org/", "https://g00gle.com/signin"]


def random_texts(rng, n, alphabet="abc.-"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 24))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_scan(spark, seed):
    rng = random.Random(seed)
    texts, terms = random_texts(rng, 200), [t[:8] for t in random_texts(rng, 120) if t is not None] + ["", "abc", "abc", None]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    right = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, s in enumerate(texts) for t in {t for t in terms if t is not None} if s is not None and t in s)
    for literal_max in (0, 512):
        assert sorted((r.id, r.term) for r in C.containment_hits(left, "s", right, "term", literal_max).collect()) == want
    assert C.containment_hits(left, "s", right.where("false"), "term", 0).count() == 0


def test_many_terms_meet_few_rows(spark):
    """20,000 terms: a text meets the terms of its own grams, not one row per substring of every length."""
    terms = spark.range(20_000).select(F.concat(F.lit("host"), F.md5(F.col("id").cast("string")), F.lit(".com")).alias("term"))
    texts = spark.range(400).select("id", F.concat(F.lit("http://a.host"), F.md5((F.col("id") * 1000).cast("string")), F.lit(".com/login")).alias("s"))
    got = C.containment_hits(texts, "s", terms, "term")
    want = texts.where("id * 1000 < 20000").count()
    assert sorted(r.id for r in got.select("id").collect()) == list(range(want))
    met = texts.select(F.explode(C.substrings(F.col("s"), [C.GRAM])).alias("_anchor")).join(C.anchors(terms, "term"), "_anchor").count()
    assert met < 20_000 * 400 / 50


RULES = [r for _, r, _ in refdata.PATTERN_REGEXES] + [r for _, r in refdata.SIGNATURE_REGEXES] + refdata.TABLE_REGEXES + [
    r"abc", r"ab?c", r"a+bc", r"(abc|b)", r"abc|b", r"[abc]{2}bca", r"\.com\b", r"a\.b-c", r"ab{2}c", r"(?i)ABC", r"(?:ab)+cab", r"^ab.*ca$",
    r"\Qa.b\E", r"a\x62c", r"ab*?ca", r"((a)(b(c)))bb", r"[a\]]bca", r"ab(?=c)", r"a??bcb", r"(a{2}b)?cc", r"\p{L}bc\pLa", "", r"cab\-b", r"abca++b"]


def test_required_text_is_in_every_match(spark):
    rng = random.Random(5)
    texts = [t for t in random_texts(rng, 1500, "abc.-") if t] + [u for u in URLS if u]
    rows = spark.createDataFrame([(r,) for r in RULES], "regex string").withColumn("must", C.required_text(F.col("regex"))).collect()
    must = {r.regex: r.must for r in rows}
    pairs = spark.createDataFrame([(r, t) for r in RULES for t in texts], "regex string, t string").where(F.rlike("t", F.col("regex")))
    assert all(must[r.regex] is None or must[r.regex] in r.t for r in pairs.collect())
    assert (must["abc"], must[r"ab?c"], must[r"a+bc"], must[r"abc|b"], must[r"ab(?=c)"], must[r"xn--"], must[r"((a)(b(c)))bb"]) == (
        "abc", "c", "bc", None, None, "xn--", "bb")


def test_rules_equal_scan(spark):
    rng = random.Random(8)
    texts = random_texts(rng, 150) + URLS
    rules = [(f"r{i}", r, i) for i, r in enumerate(RULES)] + [("r0", RULES[0], 0), (None, "a", 1), ("n", None, 1)]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    right = spark.createDataFrame(rules, "rule_id string, regex string, weight int")
    each = spark.createDataFrame([(i, s, r, w, x) for i, s in enumerate(texts) for r, x, w in set(rules) if r and x is not None], "id long, s string, rule_id string, weight int, regex string")
    want = sorted((r.id, r.rule_id, r.weight) for r in each.where(F.rlike("s", F.col("regex"))).collect())
    for literal_max, block in ((0, 2), (0, 64), (512, 64)):
        got = C.rule_hits(left, "id", "s", right, literal_max, block).collect()
        assert sorted((r.id, r.rule_id, r.weight) for r in got) == want
    assert C.rule_hits(left, "id", "s", right.where("false"), 0).count() == C.rule_hits(left, "id", "s", right.where("false")).count() == 0


def parts_of(spark):
    return url_parts(spark.createDataFrame([(i, u) for i, u in enumerate(URLS) if u], "url_id long, url string"))


def test_default_tables_give_the_default_scores(spark):
    parts = parts_of(spark)
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    rules = read_reference(spark, "url_rules")
    literal_max = 0  # the literal form is held by the SQL of the queries
    for got, want, cols in (
        (R.pattern_score(parts, rules=rules.where("target = 'pattern'"), literal_max=literal_max), R.pattern_score(parts), ["url_id", "risk_score", "verdict"]),
        (R.signature_score(parts, rules=rules.where("target = 'signature'"), literal_max=literal_max,
                           substrings=read_reference(spark, "lexicon").where("family = 'signature_substring'")), R.signature_score(parts), ["url_id", "n_rules", "n_substrings", "risk_score", "method"]),
        (pattern_flags(parts, read_reference(spark, "flag_terms"), rules.where("target = 'table'"), literal_max),
         parts.select("url_id", *[c.alias(n) for n, c in pattern_columns().items()]), ["url_id", *pattern_columns()])):
        assert rows(got, cols) == rows(want, cols)
    tlds = read_reference(spark, "tlds")
    assert rows(R.garbage_score(parts, tlds), ["url_id", "tld_valid", "tld_category", "garbage_score"]) == rows(R.garbage_score(parts), ["url_id", "tld_valid", "tld_category", "garbage_score"])
    assert rows(R.threat_indicators(parts, tlds), ["url_id", "risk_score"]) == rows(R.threat_indicators(parts), ["url_id", "risk_score"])
    brands = read_reference(spark, "brands")
    user = {"keyboard": read_reference(spark, "keyboard"), "tlds": tlds, "shorteners": read_reference(spark, "shorteners")}
    assert rows(A.attack_findings(parts, brands, **user), ["*"]) == rows(A.attack_findings(parts, brands), ["*"])


def test_least_brand_length_of_the_row_counts(spark):
    parts = url_parts(spark.createDataFrame([(1, "https://ubs-login.com/"), (2, "https://chase-login.com/")], "url_id long, url string"))
    brands = spark.createDataFrame([("ubs", 3), ("chase", 9)], "brand string, min_len int")
    assert {r.brand for r in A.attack_findings(parts, brands).collect()} == {"ubs"}
    assert {r.brand for r in A.attack_findings(parts, brands.drop("min_len")).collect()} == {"chase"}


@pytest.mark.parametrize("max_rows", [0, 100])
def test_spread_join_keeps_every_row(spark, max_rows):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"))
    side = spark.createDataFrame([("hot", 1), ("k4", 2), (None, 3)], "k string, v int")
    got = spread_left_join(df, side, ["k"], "id", max_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.join(side, ["k"], "left").collect()))
