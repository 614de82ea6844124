"""Attack findings, fusion, sources and reference tables on own cases."""

import json

import pytest

from lurewatch.operators import findings as A
from lurewatch.operators import fusion as U
from lurewatch.operators import rules as R
from lurewatch.operators import ultra_features as W
from lurewatch.operators.base_features import base_features
from lurewatch.operators.homograph import punycode_features
from lurewatch.operators.parts import url_parts
from lurewatch.sources import feeds, sinks
from lurewatch.sources.reference import read_reference

CASES = [
    ("https://gogle.com/", "TYPOSQUATTING_OMISSION", "google"), ("https://googgle.com/", "TYPOSQUATTING_INSERTION", "google"),
    ("https://goolge.com/", "TYPOSQUATTING_TRANSPOSITION", "google"), ("https://gpogle.com/", "TYPOSQUATTING_KEYBOARD", "google"),
    ("https://paypa1.com/", "TYPOSQUATTING_SUBSTITUTION", "paypal"), ("https://amazon-login.com/", "COMBOSQUATTING", "amazon"),
    ("https://paypal.evil-site.com/", "LEVELSQUATTING", "paypal"), ("https://netflixcom.org/", "DOPPELGANGER_DOMAIN", "netflix"),
    ("http://10.1.2.3/x", "IP_ADDRESS_URL", None), ("http://0x7f.0x0.0x0.0x1/", "HEX_IP_ADDRESS", None), ("https://bit.ly/abc", "URL_SHORTENER_ABUSE", None),
    ("https://exa%6dple.com/", "URL_ENCODING_ABUSE", None), ("https://exa%256dple.com/%41", "DOUBLE_ENCODING", None),
    ("https://exam​ple.org/", "ZERO_WIDTH_CHARS", None), ("https://example.org/‮fdp", "RTLO_ATTACK", None),
    ("https://gооgle.com/", "IDN_HOMOGRAPH_CYRILLIC", "google"), ("https://xn--80ak6aa92e.com/", "PUNYCODE_ATTACK", None),
    ("https://google.tk/", "BRAND_TLD_SWAP", "google"), ("https://example.org/amazon/offer", "PATH_MANIPULATION", "amazon"),
    ("https://www.google.com/", "LEGITIMATE", None), ("https://example.org/", "LEGITIMATE", None),
]


def test_attack_cases(spark):
    brands = read_reference(spark, "brands")
    parts = url_parts(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CASES)], "url_id long, url string"))
    got = {r.url_id: (r.attack_type, r.brand) for r in A.classify_urls(parts, brands).collect()}
    assert {CASES[i][0]: v for i, v in got.items()} == {u: (t, b) for u, t, b in CASES}


def test_narrow_and_aggregated_strongest_agree(spark):
    brands = read_reference(spark, "brands")
    parts = url_parts(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CASES)], "url_id long, url string"))
    long = {r.url_id: r.attack_type for r in A.strongest_finding(A.attack_findings(parts, brands)).collect()}
    flat = {r.url_id: r.attack_type for r in A.classify_urls(parts, brands).where("is_attack").collect()}
    assert long == flat


def test_feature_counts_and_invariants(spark):
    parts = url_parts(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CASES)], "url_id long, url string"))
    base, wide = base_features(parts, punycode_features(parts)), W.ultra_features(parts)
    assert len(base.columns) == 71 and len(wide.columns) == 196
    assert base.count() == wide.count() == len(CASES)
    for r in R.pattern_score(parts).collect():
        assert 0 <= r.risk_score <= 100 and len(r.reasons) <= 5
    assert base.where("url_entropy < 0 OR idn_homograph_score > 1").count() == 0


@pytest.mark.parametrize("layers,verdict,decision", [
    ([("pattern", "extreme"), ("domain", "absent_brand"), ("lookalike", "critical")], "PHISHING_DETECTED", True),
    ([("pattern", "extreme"), ("lookalike", "critical")], "LIKELY_PHISHING", True), ([("safe_browsing", "threat")], "SUSPICIOUS", True),
    ([("pattern", "high")], "QUESTIONABLE", None), ([("domain", "exists")], "APPEARS_SAFE", False)])
def test_fusion_bands(spark, layers, verdict, decision):
    r = U.fuse(spark.createDataFrame([(1, a, b) for a, b in layers], "url_id long, layer string, outcome string")).first()
    assert (r.verdict, r.is_phishing) == (verdict, decision)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "http://a.com", "x": 1}, {"x": 2}, {"url": "http://b.com"}]))
    assert sorted(r.url for r in feeds.read_json_feed(spark, str(tmp_path / "a.json")).collect()) == ["http://a.com", "http://b.com"]
    (tmp_path / "c.csv").write_text('# c\n"1","d","http://x.com","on"\n"2","d","nan","on"\n')
    assert [r.url for r in feeds.read_commented_csv(spark, str(tmp_path / "c.csv"), "id string, d string, u string, s string").collect()] == ["http://x.com"]
    df = spark.createDataFrame([("http://a", "2024-01-01"), ("http://b", "2024-02-01")], "url string, snapshot_date string")
    df.write.partitionBy("snapshot_date").parquet(str(tmp_path / "p"))
    got = feeds.read_partitioned_latest(spark, str(tmp_path / "p"), "url string, snapshot_date string")
    assert [r.url for r in got.collect()] == ["http://b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a"]), (2, True, [])], "url_id long, is_phishing boolean, reasons array<string>")
    sinks.write_verdict_report(df, str(tmp_path / "r"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "r"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_reference_reader(spark, tmp_path):
    spark.createDataFrame([(".TK", "bad", 5, True, True, True)], "tld string, category string, weight int, is_valid boolean, is_signature boolean, is_finding boolean").write.parquet(str(tmp_path / "t"))
    assert read_reference(spark, "tlds", str(tmp_path / "t")).first().tld == "tk"
    with pytest.raises(ValueError):
        read_reference(spark, "brands", str(tmp_path / "t"))
