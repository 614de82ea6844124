"""Queries for attack findings and rule-test scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.functions.punycode import decoded_labels
from lurewatch.operators import findings as A
from lurewatch.operators import metrics as M
from lurewatch.operators import rules as R
from lurewatch.operators.homograph import punycode_features
from lurewatch.operators.parts import url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query
from lurewatch.plans.rules import user_tlds


def repaired_parts(spark, sf):
    """Parts of all URLs, missing scheme added."""
    return url_parts(R.with_validity(fx.corpus(spark, sf)).select("url_id", F.col("fixed_url").alias("url")))


@query("attack_findings")
def _findings(spark, sf):
    return A.attack_findings(repaired_parts(spark, sf), fx.brands(spark, sf))


@query("strongest_finding")
def _strongest(spark, sf):
    return A.strongest_finding(A.attack_findings(repaired_parts(spark, sf), fx.brands(spark, sf)))


@query("classified_urls")
def _classified(spark, sf):
    return A.classify_urls(repaired_parts(spark, sf), fx.brands(spark, sf))


def user_tables(spark, sf):
    """A keyboard on which the next letters are neighbours, other TLDs and shorteners, and a least length per brand."""
    keys = spark.range(25).select(F.char(F.col("id") + 97).alias("key"), F.char(F.col("id") + 98).alias("neighbour"))
    keyboard = keys.unionByName(keys.select(F.col("neighbour").alias("key"), F.col("key").alias("neighbour")))
    hosts = fx.brands(spark, sf).where(F.length("brand") % 4 == 0).select(F.concat("brand", F.lit(".com")).alias("host"))
    brands = fx.brands(spark, sf).withColumn("min_len", F.when(F.ascii("brand") % 2 == 0, 8).otherwise(5))
    return brands, {"keyboard": keyboard, "tlds": user_tlds(spark, sf), "shorteners": hosts}


@query("attack_findings_user_tables")
def _findings_user(spark, sf):
    """The checks with a user's keyboard, TLDs, shorteners and least brand lengths."""
    brands, tables = user_tables(spark, sf)
    return A.attack_findings(repaired_parts(spark, sf), brands, **tables)


@query("punycode_findings")
def _puny(spark, sf):
    parts = repaired_parts(spark, sf)
    return A.attack_findings(parts, fx.brands(spark, sf), decoded=decoded_labels(parts)).where("attack_type = 'PUNYCODE_ATTACK'")


@query("punycode_features")
def _puny_features(spark, sf):
    return punycode_features(corpus_parts(spark, sf))


@query("attack_scorecard")
def _scorecard(spark, sf):
    """Known look-alikes against their technique: passed, failed and rate per category; detection and false positives."""
    truth = fx.known_urls(spark, sf).select("url_id", "url", "brand", "technique_id")
    verdicts = A.classify_urls(url_parts(truth.select("url_id", "url")), fx.brands(spark, sf)).drop("brand")
    label = F.when(F.col("technique_id") == 0, "legitimate").when(F.col("technique_id") <= 4, "typo").when(
        F.col("technique_id") <= 7, "brand_name").when(F.col("technique_id") == 8, "ip").when(
        F.col("technique_id") == 9, "shortener").when(F.col("technique_id") == 10, "path").otherwise("missing_dot")
    cases = truth.withColumn("category", label).select("url_id", "category", (F.col("technique_id") > 0).alias("expected"))
    return M.rule_scorecard(verdicts.select("url_id", F.col("is_attack").alias("detected")), cases)
