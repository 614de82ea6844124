"""Staged routing, per-service freshness and threat layers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

AT = dt.datetime(2024, 5, 1, 12)
REPUTATION = "url_hash string, service string, status string, checked_at timestamp, flagged boolean, malicious int, suspicious int, score int, verified boolean, valid boolean"


def ago(**kw):
    return AT - dt.timedelta(**kw)


def test_newest_valid_finding_per_service(spark):
    from lurewatch.operators.enrich import reputation_wide

    rows = [("a", "scanners", "checked", ago(minutes=50), False, 0, 4, 0, False, False), ("a", "scanners", "checked", ago(minutes=10), False, 1, 0, 0, False, False),
            ("a", "scanners", "error", ago(minutes=1), True, 9, 9, 9, True, True),  # a failed check says nothing
            ("a", "sandbox", "checked", ago(minutes=61), True, 0, 0, 99, False, False),  # expired
            ("a", "community", "checked", ago(hours=23), True, 0, 0, 0, False, True),  # a day's time
            ("a", "safe_browsing", "checked", AT + dt.timedelta(seconds=1), True, 0, 0, 0, False, False),  # later
            ("b", "community", "not_found", ago(hours=1), False, 0, 0, 0, False, False), ("b", "community", "checked", ago(hours=2), True, 0, 0, 0, True, True)]
    rep = spark.createDataFrame(rows, REPUTATION)
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url_hash string")
    got = {r.url_hash: r for r in reputation_wide(urls, rep, F.lit(AT)).collect()}
    assert len(got) == 3
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.scanners_malicious, a.scanners_status, a.sandbox_status, a.safe_browsing_status) == (1, "checked", None, None)
    assert (a.community_flagged, a.community_verified, a.community_valid) == (True, False, True)
    assert b.community_status == "not_found" and b.community_flagged is False
    assert c.community_status is None
    assert got["a"].asDict() != {r.url_hash: r for r in reputation_wide(urls, rep).collect()}["a"].asDict()  # without a time nothing expires


def test_findings_at_the_time_of_each_request(spark):
    from lurewatch.operators.enrich import SERVICES, SERVICE_TTL, asof_findings

    rep = spark.createDataFrame([("a", s, "checked", ago(hours=h), False, h, 0, 0, False, False) for s in SERVICES for h in (1, 5, 20, 40)], REPUTATION)
    asked = spark.createDataFrame([("a", AT - dt.timedelta(minutes=30 * i), i) for i in range(60)], "url_hash string, at timestamp, request int").select("url_hash", F.unix_micros("at").alias("us"), "request")
    got = {(r.request, r.service): r.malicious for r in asof_findings(asked, rep).collect()}
    assert len(got) == 60 * len(SERVICES)
    for (i, s), h in got.items():
        fresh = [x for x in (1, 5, 20, 40) if 0 <= (x * 3600 - i * 1800) < SERVICE_TTL[s]]
        assert h == (min(fresh) if fresh else None), (i, s)


@pytest.fixture(scope="module")
def analysed(spark):
    """A hundred URLs of each kind, and what the gates let through."""
    from lurewatch.operators.analysis import full_analysis
    from lurewatch.operators.parts import url_parts

    urls = ["https://exists.com/a", "http://sp ace.com/", "https://xkcdqzvxj1.info/", "https://paypal-gone.com/", "https://gone-name.com/", "https://young.com/", "https://odd.notatld/x",
            "https://xkcdqzvxj2.info/", "http://1.2.3.999/", ""]
    parts = url_parts(spark.createDataFrame(list(enumerate(urls)), "url_id long, url string"))
    dns = spark.createDataFrame([(d, True, False, False) for d in ("exists.com", "young.com", "xkcdqzvxj2.info", "odd.notatld")], "domain string, has_a boolean, has_mx boolean, has_ns boolean")
    whois = spark.createDataFrame([("young.com", ago(days=10).date()), ("gone-name.com", ago(days=3).date())], "domain string, created date")
    asked = []

    def model(df):
        asked.append(df)
        return df.withColumns({"prediction": F.lit(0), "confidence": F.lit(0.5)})

    rep = spark.createDataFrame([], REPUTATION)
    brands = spark.createDataFrame([("paypal",)], "brand string")
    out = full_analysis(parts, brands, dns, whois, rep, model, F.lit(AT).cast("date"))
    return out, {r.url_id: r for r in out.collect()}, asked[0]


def test_every_url_leaves_where_it_should(analysed):
    out, got, asked = analysed
    assert sorted(got) == list(range(10))
    exits = {i: r.verdict for i, r in got.items() if r.verdict in ("INVALID_URL", "RANDOM_GARBAGE")}
    assert exits == {1: "INVALID_URL", 2: "RANDOM_GARBAGE", 8: "INVALID_URL", 9: "INVALID_URL"}
    assert all((got[i].threat_level, got[i].confidence, got[i].is_phishing, got[i].reasoning) == (0, 1.0, False, []) for i in (1, 8, 9))
    assert (got[2].threat_level, got[2].confidence, got[2].is_phishing) == (5, 0.95, False)
    assert sorted(r.url_id for r in asked.select("url_id").collect()) == [0, 3, 4, 5, 6, 7]  # only survivors reach the model
    layer = {i: [x for x in got[i].reasoning if x.startswith("domain:")] for i in got}
    assert layer[0] == ["domain:exists"] and layer[3] == ["domain:absent_brand"] and layer[4] == ["domain:absent"] and layer[7] == ["domain:exists_suspicious"] and layer[6] == []
    assert {i: (got[i].classification, got[i].domain_threat) for i in (0, 3, 4, 5, 6, 7)} == {
        0: ("REAL_DOMAIN_EXISTS", 0), 3: ("NOT_ON_INTERNET", 90), 4: ("NOT_ON_INTERNET", 60), 5: ("REAL_DOMAIN_EXISTS", 40), 6: ("INVALID_TLD", 5), 7: ("EXISTS_BUT_SUSPICIOUS", 70)}


def test_no_join_on_the_url_id(analysed):
    plan = analysed[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "url_id" in x]


def test_the_data_reach_every_outcome(spark):
    from lurewatch.operators import fusion as U
    from lurewatch.plans import load_all

    rows = load_all()["full_analysis"](spark, "/root/testdata/sf0.01").select("verdict", "reasoning", "domain_threat").collect()
    seen = {x for r in rows for x in r.reasoning.split("|") if x}
    assert seen == {f"{a}:{b}" for a, b in U.EVIDENCE}
    assert {r.domain_threat for r in rows} == {0, 5, 10, 20, 40, 60, 70, 90}
    assert {r.verdict for r in rows} == {"INVALID_URL", "RANDOM_GARBAGE", "PHISHING_DETECTED", "LIKELY_PHISHING", "SUSPICIOUS", "QUESTIONABLE", "APPEARS_SAFE"}


def test_threat_layers_weigh_only_what_they_know(spark):
    from lurewatch.operators.analysis import threat_layers
    from lurewatch.operators.fusion import weighted_threat
    from lurewatch.operators.parts import url_parts
    from lurewatch.operators.rules import url_hash

    urls = spark.createDataFrame([(1, "https://a.com/"), (2, "https://b.com/")], "url_id long, url string")
    h = {r.url_id: r.h for r in urls.select("url_id", url_hash(F.col("url")).alias("h")).collect()}
    rep = spark.createDataFrame([(h[1], "scanners", "checked", AT, True, 1, 0, 0, False, False), (h[1], "sandbox", "checked", AT, False, 0, 0, 0, False, False),
                                 (h[1], "community", "not_found", AT, True, 0, 0, 0, False, False), (h[1], "safe_browsing", "checked", AT, True, 0, 0, 0, False, False)], REPUTATION)
    rows = url_parts(urls).withColumns({"prediction": F.lit(1), "confidence": F.lit(0.7)})
    layers = threat_layers(rows, rep, F.lit(AT))
    got = {(r.url_id, r.layer): r.score for r in layers.collect() if r.score is not None}
    assert got == {(1, "model"): 70.0, (1, "services"): 50.0, (1, "safe_browsing"): 80.0, (1, "indicators"): 0.0, (2, "model"): 70.0, (2, "indicators"): 0.0}
    out = {r.url_id: (r.threat_score, r.confidence) for r in weighted_threat(layers, urls).collect()}
    assert out == {1: (59.0, 1.0), 2: (56.0, 0.5)}
