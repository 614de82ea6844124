"""Sinks: corpora, verdict reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("label",),
                 mode: str = "overwrite") -> None:
    """Write a corpus partitioned by low-cardinality columns.

    CSV keeps blanks around values, so a written corpus reads back unchanged.
    """
    w = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def write_verdict_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested verdicts as JSON lines (maps, arrays and nullable decisions kept)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def verdict_json(df: DataFrame, key: str = "url_id") -> DataFrame:
    """One JSON document per verdict row."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("report"))


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def newest_version(spark: SparkSession, path: str, marker: str | None = "_SUCCESS", missing: int | None = None) -> int:
    """The highest N of the folders ``version=N`` that hold the ``marker`` (None: any folder); ``missing`` where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = [int(p.getName().partition("=")[2]) for p in folders
             if p.getName().startswith("version=") and (marker is None or fs.exists(hadoop.Path(p, marker)))]
    if not found and missing is None:
        raise ValueError(f"no complete version under {path}")
    return max(found, default=missing)
