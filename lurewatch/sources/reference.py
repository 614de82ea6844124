"""Reader for replaceable reference tables (lexicons, rules, brands, TLDs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import refdata


def read_reference(spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A reference table: the default, or a user table cast to the default's schema.

    Text keys are trimmed and lower-cased (dotted or upper-case entries would never match otherwise).  A TLD table without
    ``is_indicator`` lists no TLD as an indicator.
    """
    if name not in refdata.TABLES:
        raise KeyError(f"unknown reference table {name!r}; known: {sorted(refdata.TABLES)}")
    default = refdata.TABLES[name](spark)
    if path is None:
        return default
    reader = spark.read.option("header", True)
    given = reader.csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if name == "tlds" and "is_indicator" not in given.columns:
        given = given.withColumn("is_indicator", F.lit(False))
    missing = [c for c in default.columns if c not in given.columns]
    if missing:
        raise ValueError(f"reference table {name!r} lacks columns {missing}")
    keys = {"brand", "domain", "term", "tld", "suffix", "host"}

    def clean(field):
        c = F.col(field.name).cast(field.dataType)
        return F.ltrim(F.lower(F.trim(c)), F.lit(".")).alias(field.name) if field.name in keys else c.alias(field.name)

    return given.select(*[clean(f) for f in default.schema.fields]).dropDuplicates()
