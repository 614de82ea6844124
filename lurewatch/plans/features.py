"""Queries over the URL corpus: parts and feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import base_features as B
from lurewatch.operators.parts import distinct_urls, url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.registry import query


def corpus_parts(spark, sf):
    return url_parts(fx.corpus(spark, sf))


@query("url_parts")
def _parts(spark, sf):
    return corpus_parts(spark, sf).select(
        "url_id", "scheme", "netloc", "path", "query", "fragment", "host", "port", "n_labels", "is_ip", "tld", "suffix",
        "registered_domain", "domain_label", "subdomain", "host_label")


@query("distinct_url_occurrences")
def _distinct(spark, sf):
    """Occurrences reduced to distinct URLs before any feature work."""
    occ = fx.occurrences(spark, sf)
    return url_parts(distinct_urls(occ)).select("url_id", "url", "n_seen", "registered_domain", "tld")


@query("lexical_features")
def _lexical(spark, sf):
    return B.family(corpus_parts(spark, sf), B.lexical_columns())


@query("structural_features")
def _structural(spark, sf):
    return B.family(corpus_parts(spark, sf), B.structural_columns())


@query("obfuscation_base_features")
def _advanced(spark, sf):
    return B.family(corpus_parts(spark, sf), B.advanced_columns())


@query("homograph_features")
def _homograph(spark, sf):
    """Look-alike scores of all hosts (international names still encoded)."""
    return B.family(corpus_parts(spark, sf), B.homograph_columns())


@query("statistical_features")
def _statistical(spark, sf):
    return B.family(corpus_parts(spark, sf), B.statistical_columns())


@query("pattern_table_flags")
def _patterns(spark, sf):
    return B.family(corpus_parts(spark, sf), B.pattern_columns())


@query("brand_impersonation")
def _impersonation(spark, sf):
    """Brands of the parts table, protected at ``<brand>.com``; computed per distinct authority."""
    doms = fx.brands(spark, sf).withColumn("domain", F.concat("brand", F.lit(".com")))
    return B.brand_impersonation(corpus_parts(spark, sf), doms)


@query("brand_impersonation_defaults")
def _impersonation_literal(spark, sf):
    return B.family(corpus_parts(spark, sf), B.impersonation_columns())


@query("feature_summary")
def _summary(spark, sf):
    return B.feature_summary(B.base_features(corpus_parts(spark, sf)))
