"""Feed readers: every one declares its schema (no inference pass) and returns ``url[, label, source, ...]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tagged(df: DataFrame, label: int | None, source: str | None) -> DataFrame:
    if label is not None:
        df = df.withColumn("label", F.lit(label))
    return df.withColumn("source", F.lit(source)) if source is not None else df


def read_labelled_csv(spark: SparkSession, path: str, schema: str, source: str, url: str = "url",
                      label: str = "label") -> DataFrame:
    """Labelled CSV with its own column names: unified to ``url, label, source`` plus the vendor features."""
    df = spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.withColumnRenamed(url, "url").withColumnRenamed(label, "label")
    rest = [c for c in df.columns if c not in ("url", "label")]
    return df.select("url", F.col("label").try_cast("int").alias("label"), F.lit(source).alias("source"), *rest)


def read_line_feed(spark: SparkSession, path: str, label: int | None = 1, source: str | None = "lines") -> DataFrame:
    """One URL per line, trimmed, blank lines dropped.  ``label=None, source=None`` reads a plain URL list."""
    df = spark.read.text(path).select(F.trim("value").alias("url")).where(F.length("url") > 0)
    return _tagged(df, label, source)


def read_json_feed(spark: SparkSession, path: str, source: str = "json", multi_line: bool = False) -> DataFrame:
    """JSON lines, which split (or a JSON array with ``multi_line=True``, one task per file): entries that have a URL."""
    df = spark.read.schema("url string").option("multiLine", multi_line).json(path)
    return _tagged(df.where(F.col("url").isNotNull() & (F.col("url") != "")), 1, source)


def read_commented_csv(spark: SparkSession, path: str, schema: str, source: str = "commented") -> DataFrame:
    """Quoted CSV with ``#`` comments; malformed lines dropped; URL column by name, else the third column."""
    df = spark.read.schema(schema).csv(path, comment="#", quote='"', mode="DROPMALFORMED")
    name = "url" if "url" in df.columns else df.columns[2]
    urls = df.select(F.col(name).alias("url")).where(F.col("url").isNotNull() & ~F.col("url").isin("", "nan"))
    return _tagged(urls, 1, source)


def read_ranked_domains(spark: SparkSession, path: str, source: str = "ranked") -> DataFrame:
    """``rank,domain`` without header: every domain as ``https://domain`` with its rank, label 0."""
    df = spark.read.schema("rank int, domain string").csv(path).where(F.col("rank").isNotNull())
    return _tagged(df.select(F.concat(F.lit("https://"), "domain").alias("url"), "rank"), 0, source)


def first_ranked(ranked: DataFrame, n: int) -> DataFrame:
    """The ``n`` best ranked rows (ties by URL)."""
    return ranked.orderBy("rank", "url").limit(n)


LIFECYCLE = ("phish_id string, url string, phish_detail_url string, submission_time string, verified string, "
             "verification_time string, online string, target string")


def read_lifecycle_feed(spark: SparkSession, path: str) -> DataFrame:
    """Phishing feed with verification life cycle: flags typed, times parsed, label 1, empty URLs dropped."""
    df = spark.read.schema(LIFECYCLE).csv(path, header=True, escape='"')
    when = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return df.where(F.col("url").isNotNull() & (F.col("url") != "")).select(
        "url", "phish_id", "phish_detail_url", when("submission_time").alias("submission_time"),
        F.coalesce(F.col("verified") == "yes", F.lit(False)).alias("verified"),
        when("verification_time").alias("verification_time"),
        F.coalesce(F.col("online") == "yes", F.lit(False)).alias("online"), "target", F.lit(1).alias("label"))


def latest_snapshot(spark: SparkSession, pattern: str) -> tuple[str, list[str]]:
    """Newest ``YYYYMMDD`` among the paths matching ``pattern`` and the files of that date (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select(
        "path", F.regexp_extract("path", r"_([0-9]{8})[^0-9]", 1).alias("date")).where("date <> ''")
    newest = files.agg(F.max("date")).first()[0]
    if newest is None:
        raise FileNotFoundError(pattern)
    return newest, sorted(r[0] for r in files.where(F.col("date") == newest).select("path").collect())


def read_latest_lifecycle(spark: SparkSession, pattern: str) -> DataFrame:
    date, paths = latest_snapshot(spark, pattern)
    return read_lifecycle_feed(spark, paths).withColumn("snapshot_date", F.lit(date))


def read_partitioned_latest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newest ``snapshot_date=`` partition of a Parquet feed; the filter prunes the other partitions."""
    df = spark.read.schema(schema).parquet(path)
    newest = df.select("snapshot_date").agg(F.max("snapshot_date")).first()[0]  # no data column is read
    return df.where(F.col("snapshot_date") == F.lit(newest))
