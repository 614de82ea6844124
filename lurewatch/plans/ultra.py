"""Queries for the wide feature families."""

from __future__ import annotations

from lurewatch.operators import base_features as B
from lurewatch.operators import ultra_features as U
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query
from lurewatch.session import materialize


@query("ultra_basic_lexical")
def _basic(spark, sf):
    return U.family(corpus_parts(spark, sf), "basic", "lexical")


@query("base_feature_table")
def _base_table(spark, sf):
    """The base features, one row per URL."""
    df = B.base_features(materialize(corpus_parts(spark, sf)))
    return df.select("url_id", *[c for c in df.columns if c not in ("url_id", "url")])


@query("wide_feature_table")
def _wide_table(spark, sf):
    """All wide families, one row per URL."""
    df = U.ultra_features(materialize(corpus_parts(spark, sf)))
    return df.select("url_id", *[c for c in df.columns if c not in ("url_id", "url")])


@query("ultra_domain")
def _domain(spark, sf):
    return U.family(corpus_parts(spark, sf), "domain")


@query("ultra_path_query")
def _path(spark, sf):
    return U.family(corpus_parts(spark, sf), "path_query")


@query("ultra_linguistic_behaviour")
def _ling(spark, sf):
    return U.family(corpus_parts(spark, sf), "linguistic", "behaviour")


@query("ultra_lookalike")
def _look(spark, sf):
    return U.lookalike(corpus_parts(spark, sf))


@query("ultra_obfuscation_complexity")
def _obf(spark, sf):
    return U.family(corpus_parts(spark, sf), "obfuscation", "complexity")


@query("ultra_statistics")
def _stat(spark, sf):
    return U.family(corpus_parts(spark, sf), "statistics")
