"""Decoding of international (``xn--``) labels, on distinct labels only."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _decode(label: str) -> str:
    try:
        return label.encode("ascii").decode("idna")
    except (UnicodeError, ValueError):
        return label


def decode_label_udf():
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_decode, na_action="ignore")

    return run


def decode_label(label: Column) -> Column:
    """Decoded label; undecodable input is returned unchanged."""
    return decode_label_udf()(label)


def decoded_labels(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Distinct ``xn--`` labels of the hosts with their decoded form: ``label, decoded``."""
    labels = hosts.where(F.contains(F.col(host), F.lit("xn--"))).select(
        F.explode(F.filter(F.split(host, r"\."), lambda p: F.startswith(p, F.lit("xn--")))).alias("label")).distinct()
    return labels.withColumn("decoded", decode_label(F.col("label")))


def decoded_hosts(hosts: DataFrame, host: str = "netloc") -> DataFrame:
    """Distinct hosts with an ``xn--`` label and the host with all labels decoded: ``host, decoded``."""
    odd = hosts.where(F.contains(F.col(host), F.lit("xn--"))).select(host).distinct()
    labels = decoded_labels(odd, host)
    parts = odd.select(host, F.posexplode(F.split(host, r"\.")).alias("pos", "label")).join(labels, "label", "left")
    # a host has at most 127 labels, so its array is bounded
    named = parts.groupBy(host).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("decoded", "label").alias("d")))).alias("ls"))
    return named.select(host, F.array_join(F.transform("ls", lambda x: x["d"]), ".").alias("decoded"))
