"""Queries for enrichment; snapshots are derived from the orders, customer and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import enrich as E
from lurewatch.operators import rules as R
from lurewatch.operators.parts import url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query
from lurewatch.session import materialize

AS_OF = "1998-06-30"
DAY = 86_400
# the snapshot's findings are years apart, so they stay valid for years, each service's for another time
TTL = {"safe_browsing": 900 * DAY, "scanners": 1200 * DAY, "sandbox": 1500 * DAY, "community": 2100 * DAY}
EVENT_TTL = {"safe_browsing": DAY, "scanners": 2 * DAY, "sandbox": 5 * DAY, "community": 10 * DAY}


def known_parts(spark, sf):
    return url_parts(fx.known_urls(spark, sf).select("url_id", "url"))


def dns_snapshot(spark, sf):
    """DNS facts, on two days, of two thirds of the registered domains of the parts table."""
    return spark.sql(fx.DNS_SQL, part=fx.table(spark, sf, "part"))


def whois_snapshot(spark, sf):
    return spark.sql(fx.WHOIS_SQL, part=fx.table(spark, sf, "part"), orders=fx.table(spark, sf, "orders"))


def reputation(spark, sf):
    return spark.sql(fx.REPUTATION_SQL, part=fx.table(spark, sf, "part"), lineitem=fx.table(spark, sf, "lineitem"))


@query("asof_cached_verdicts")
def _asof(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
                                             "event_id", "event_type", "value")
    req = e.where("event_type <> 'signup'").select("key", "us", "event_id")
    cache = e.where("event_type = 'signup'").select("key", "us", F.when(F.col("value") > 50, "phishing").otherwise("clean").alias("verdict"))
    return E.asof_verdicts(req, cache, 24 * 3600).select("event_id", "verdict", "checked_us", "is_hit")


@query("dns_existence")
def _dns(spark, sf):
    return E.with_dns(known_parts(spark, sf).select("url_id", "registered_domain"), dns_snapshot(spark, sf))


@query("domain_age")
def _age(spark, sf):
    return E.with_domain_age(known_parts(spark, sf).select("url_id", "registered_domain"), whois_snapshot(spark, sf), F.lit(AS_OF).cast("date"))


@query("private_addresses")
def _private(spark, sf):
    return E.private_addresses(E.latest_facts(dns_snapshot(spark, sf)))


@query("reputation_by_service")
def _reputation(spark, sf):
    urls = fx.known_urls(spark, sf).select("url_id", R.url_hash(F.col("url")).alias("url_hash"))
    return E.reputation_wide(urls, reputation(spark, sf), F.lit(AS_OF).cast("timestamp"), TTL).drop("url_hash")


@query("asof_service_findings")
def _service_findings(spark, sf):
    """Each event asks all services; sign-ups and purchases are the findings."""
    e = spark.sql(fx.SERVICE_EVENTS_SQL, events=fx.table(spark, sf, "events"))
    found = e.where("event_type IN ('signup', 'purchase')")
    asked = e.where("event_type NOT IN ('signup', 'purchase')").select("url_hash", F.unix_micros("checked_at").alias("us"), "event_id")
    return E.asof_findings(asked, found, EVENT_TTL).drop("url_hash", "us")


@query("flag_ratio")
def _ratio(spark, sf):
    return E.flag_ratio(reputation(spark, sf))


@query("domain_classification")
def _classes(spark, sf):
    parts = R.garbage_score(corpus_parts(spark, sf)).select("url_id", "registered_domain", "domain_label", "tld_valid", "is_garbage")
    df = E.with_dns(parts, dns_snapshot(spark, sf))
    df = E.with_domain_age(df, whois_snapshot(spark, sf), F.lit(AS_OF).cast("date"))
    return E.classify_domains(df).groupBy("classification", "threat_level").agg(F.count(F.lit(1)).alias("n"), F.max("domain_confidence").alias("confidence"))


@query("gated_enrichment")
def _gated(spark, sf):
    """DNS join only for URLs with a pattern risk of 15 or more."""
    parts = materialize(corpus_parts(spark, sf))
    scored = R.pattern_score(parts).select("url_id", "risk_score").join(parts.select("url_id", "registered_domain"), "url_id")
    scored = materialize(scored)  # both branches of the gate read it
    out = E.gated(scored, lambda d: E.with_dns(d, dns_snapshot(spark, sf)))
    return out.select("url_id", "risk_score", "enriched", "exists_in_dns")
