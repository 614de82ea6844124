"""URL parts: the narrow table every other job reads (computed once per distinct URL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions.urlparts import add_host_parts, split_url
from lurewatch.session import settle

HOST_NOT_NAME = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$"


def distinct_urls(df: DataFrame, url: str = "url", key: str = "url_id") -> DataFrame:
    """One row per URL with its smallest id and its number of occurrences.

    The aggregate combines on the map side, so a URL holding a third of all
    occurrences reaches its reducer as one partial row per task.
    """
    return df.groupBy(url).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_seen"))


def url_parts(urls: DataFrame, suffixes: DataFrame | list[str] | None = None) -> DataFrame:
    """``url`` plus every URL component as columns; one row per input row.

    Deviations: the TLD is the last label (also of multi-label suffixes) and an
    IP host has no TLD, so neither is mistaken for an invalid TLD.
    """
    return add_host_parts(split_url(urls), refdata.SUFFIXES if suffixes is None else suffixes)


def usable_label(parts: DataFrame) -> DataFrame:
    """Rows whose host has a brand-comparable label (a dotted, non-IP host)."""
    # the host is derived by several regular expressions: evaluate it once, not once per predicate
    return settle(parts, ["host", "host_label"]).where((F.col("host_label") != "") & F.col("host").contains(".") & ~F.col("host").rlike(HOST_NOT_NAME))


def labels_of(parts: DataFrame) -> DataFrame:
    """Distinct brand-comparable host labels with their number of URLs."""
    return usable_label(parts).groupBy(F.col("host_label").alias("label")).agg(F.count(F.lit(1)).alias("n_urls"))
