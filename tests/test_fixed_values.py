"""Scores, points and weights against literal numbers (a wrong constant would pass both sides of the query checks)."""

from lurewatch import refdata
from lurewatch.operators import brands, enrich, fusion


def test_lookalike_scores():
    assert brands.SCORES == {"omission": 0.95, "insertion": 0.90, "substitution": 0.92, "transposition": 0.93, "homophone": 0.85,
                             "idn_homograph": 0.98, "combosquatting": 0.87, "bitsquatting": 0.94}
    assert (brands.SIMILARITY_WEIGHT, brands.DETECTION, brands.CRITICAL, brands.HIGH) == (0.75, 0.70, 0.95, 0.85)


def test_fusion_points():
    points = {k: p for k, (p, _) in fusion.EVIDENCE.items()}
    assert points["domain", "absent_brand"] == 25 and points["domain", "absent"] == 12 and points["domain", "exists_suspicious"] == 18
    assert [points["lookalike", s] for s in ("critical", "high", "medium")] == [20, 16, 10]
    assert points["model", "phishing"] == 25 and [points["pattern", s] for s in ("extreme", "high", "suspicious")] == [20, 16, 8]
    assert [points["features", s] for s in ("high", "elevated")] == [10, 6] and [points["signatures", s] for s in ("phishing", "unclear", "minor")] == [15, 8, 4]
    assert [points["community", s] for s in ("confirmed", "listed")] == [15, 10] and points["safe_browsing", "threat"] == 25
    assert [points["scanners", s] for s in ("many", "several", "some")] == [20, 15, 10] and [points["sandbox", s] for s in ("malicious", "high_score")] == [10, 5]
    assert fusion.LAYER_WEIGHTS == {"model": 4, "services": 3, "safe_browsing": 2, "indicators": 1}


def test_tables():
    keywords, tlds, signatures = dict(refdata.PATTERN_KEYWORDS), dict(refdata.PATTERN_TLDS), dict(refdata.SIGNATURE_KEYWORDS)
    assert (keywords["verify"], keywords["login"], keywords["account"], keywords["portal"], len(keywords)) == (5, 3, 4, 2, 65)
    assert (tlds["tk"], tlds["xyz"], tlds["info"], tlds["ru"], len(tlds)) == (5, 4, 3, 2, 21)
    assert (signatures["suspended-account"], signatures["account"], len(signatures)) == (0.95, 0.4, 34)
    assert (enrich.NEW_DAYS, enrich.YOUNG_DAYS) == (30, 180)


def test_every_url_gets_a_verdict(spark):
    """No evidence: safe at confidence 0.5, in both forms of the fusion."""
    urls = spark.createDataFrame([(1,), (2,)], "url_id long")
    long = fusion.fuse(spark.createDataFrame([(1, "model", "phishing", 0.8), (1, "pattern", "extreme", None)], "url_id long, layer string, outcome string, own_confidence double"), urls)
    wide = fusion.fuse_layers(spark.createDataFrame([(1, "phishing", 0.8, "extreme"), (2, None, None, None)], "url_id long, model string, model_confidence double, pattern string"))
    want = [(1, 45, 0.85, True, "LIKELY_PHISHING", ["model:phishing", "pattern:extreme"]), (2, 0, 0.5, False, "APPEARS_SAFE", [])]
    for df in (long, wide):
        assert [(r.url_id, r.threat_level, round(r.confidence, 6), r.is_phishing, r.verdict, r.reasoning) for r in df.orderBy("url_id").collect()] == want


def test_newest_snapshot_counts(spark):
    parts = spark.createDataFrame([(1, "a.com"), (2, ""), (3, "b.com")], "url_id long, registered_domain string")
    dns = spark.createDataFrame([("a.com", True, False, False, 1), ("a.com", False, False, False, 2), ("b.com", False, True, False, 1)], "domain string, has_a boolean, has_mx boolean, has_ns boolean, as_of int")
    from pyspark.sql import functions as F

    show = lambda df: [(r.url_id, r.exists_in_dns) for r in df.orderBy("url_id").collect()]
    assert show(enrich.with_dns(parts, dns)) == [(1, False), (2, False), (3, True)]
    assert show(enrich.with_dns(parts, dns, F.lit(1))) == [(1, True), (2, False), (3, True)]
