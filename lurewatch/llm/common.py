"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.session import scratch_path

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: batches of few rows, both those read from Parquet and Arrow's, keep what the JVM and Python hold of
    a task small (session settings)."""
    for key in BATCH_CONFS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two needed columns only, so other columns of any name cannot clash; a null text is empty."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Longer words are not remembered by tasks, so what a number of words takes is bounded.
LONG_WORD = 256
#: Rows of a batch that holds whole texts, and the settings that have its size.
BATCH_ROWS = 512
BATCH_CONFS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything after ``most`` words, so its memory is bounded."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


def in_groups(batches: Iterator, key: str) -> Iterator:
    """Cut a stream of Arrow batches that is sorted by ``key`` into one Arrow table for each key value."""
    import pyarrow as pa

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and k[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = k[i]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected edge table of longs: ``(id, component)``, component = smallest id.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes.  Each step is a minimum per
    node (combined before the shuffle) and an equi join that Spark can split when a hub is hot; no neighbour list is
    ever gathered.  Every round is written to the shared folder.
    """
    e = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        # large star: the larger end of an edge goes to the least neighbour of the smaller end
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: a node and its smaller neighbours go to the least of them
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = stored(large.join(near, "u").select(ends.alias("e")).select("e.*").where("u <> v").distinct(), "stars")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
