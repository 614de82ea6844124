"""Queries for brand look-alike joins; brands come from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.functions import similarity as S
from lurewatch.functions import variants as V
from lurewatch.operators import brands as B
from lurewatch.operators.parts import distinct_urls, labels_of, url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query


def corpus_labels(spark, sf):
    return labels_of(corpus_parts(spark, sf))


@query("brand_edit_matches")
def _edit(spark, sf):
    brands = fx.brands(spark, sf)
    return B.technique_matches(B.unprotected_labels(corpus_labels(spark, sf), brands), brands)


@query("brand_similarity_matches")
def _similar(spark, sf):
    brands = fx.brands(spark, sf)
    labels = B.unprotected_labels(corpus_labels(spark, sf), brands)
    return B.similarity_matches(labels, brands)


@query("best_brand_per_label")
def _best(spark, sf):
    return B.best_brand_per_label(corpus_labels(spark, sf), fx.brands(spark, sf))


@query("lookalike_hosts")
def _hosts(spark, sf):
    return B.lookalike_hosts(corpus_parts(spark, sf), fx.brands(spark, sf))


@query("imitated_brands")
def _imitated(spark, sf):
    """Flagship: URL occurrences -> distinct URLs -> parts -> look-alike join -> best brand -> counts."""
    return B.imitated_brands(url_parts(distinct_urls(fx.occurrences(spark, sf))), fx.brands(spark, sf))


@query("brand_watch")
def _watch(spark, sf):
    return B.watch_hits(corpus_labels(spark, sf), fx.brands(spark, sf))


@query("brand_variants")
def _variants(spark, sf):
    return V.brand_variants(fx.brands(spark, sf))


@query("bitflip_neighbours")
def _bits(spark, sf):
    """Bit-flip neighbours of every character used by the brands."""
    used = fx.brands(spark, sf).select(F.explode(F.split("brand", "")).alias("src")).where("src <> ''").groupBy("src").count()
    return V.bitflip_table(spark).join(used, "src").select("src", "bit", "dst", F.col("count").alias("n_used"))


def _name_pairs(spark, sf):
    """Distinct (label, brand) pairs without an edit technique that may reach the Jaro-Winkler score of the query."""
    return B.similarity_candidates(corpus_labels(spark, sf).where(F.col("label").rlike("^[a-z0-9-]+$")), fx.brands(spark, sf))


@query("jaro_winkler_pairs")
def _jw(spark, sf):
    pairs = _name_pairs(spark, sf)
    return pairs.withColumn("score", S.jaro_winkler(F.col("label"), F.col("brand"))).where("score >= 0.9333333334")


@query("sequence_ratio_pairs")
def _ratio(spark, sf):
    """Pairs of unequal names with a ratio above 0.7, those within two edits included."""
    pairs = B.ratio_candidates(corpus_labels(spark, sf), fx.brands(spark, sf))
    return pairs.withColumn("ratio", S.sequence_ratio(F.col("label"), F.col("brand"))).where("ratio > 0.7")


@query("sql_functions")
def _sql(spark, sf):
    """The SQL surface: generated names of the brands and their similarity, through registered functions."""
    from lurewatch.functions.register import register_functions

    register_functions(spark)
    return spark.sql("""SELECT brand, kind, position, variant, jaro_winkler(brand, variant) AS similarity, url_hash(variant) AS hash
        FROM (SELECT brand, lookalike_names(brand) AS vs FROM {brands}) b LATERAL VIEW inline(vs) v AS kind, position, variant""", brands=fx.brands(spark, sf))
