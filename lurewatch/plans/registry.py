"""Query registry: ``@query("name")`` registers ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.session import compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Stable output types: integers as bigint, floating point as double rounded to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            compiled(spark)
            return tidy(fn(spark, sf_dir))

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = run
        return fn

    return deco
