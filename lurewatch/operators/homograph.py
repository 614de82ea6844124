"""International names: decoded hosts and their similarity to brands (only hosts with ``xn--`` labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions.punycode import decoded_hosts
from lurewatch.functions.similarity import sequence_ratio


def punycode_features(parts: DataFrame, brands: list[str] = refdata.IDN_BRANDS) -> DataFrame:
    """``netloc, decoded, punycode_length_diff, punycode_brand_similarity`` per distinct international host."""
    hosts = decoded_hosts(parts.select("netloc"))
    changed = hosts.where(F.col("decoded") != F.col("netloc")).withColumn("brand", F.explode(F.array(*[F.lit(b) for b in brands])))
    sims = changed.withColumn("r", sequence_ratio(F.col("brand"), F.lower("decoded"))).groupBy("netloc").agg(F.max("r").alias("best"))
    return hosts.join(sims, "netloc", "left").select(
        "netloc", "decoded", (F.length("decoded") - F.length("netloc")).alias("punycode_length_diff"),
        F.when(F.col("best") > 0.7, F.col("best")).otherwise(F.lit(0.0)).alias("punycode_brand_similarity"))
