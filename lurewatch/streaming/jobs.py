"""Structured Streaming jobs; every one has a batch twin in ``operators``."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lurewatch.operators.corpus import keep_first, normalized_url
from lurewatch.sources.sinks import newest_version

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024  # of keys, whose state is read and written together


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def run_available(writer, checkpoint: str) -> None:
    """Process what is there and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_new_urls(stream: DataFrame, held_path: str, checkpoint: str, order: list[str], digits: int = 2) -> None:
    """Append URLs not held yet.

    The held table is partitioned by the first ``digits`` of the URL's hash (16 ** digits partitions); a batch reads the
    partitions that its own URLs fall into and no others.  A re-run batch is harmless: what it already appended is found
    by the anti join.  Within a batch the first row (``order``) per normalised URL is kept.
    """
    def append(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("url_normalized", normalized_url(F.col("url")))
        fresh = keep_first(named, ["url_normalized"], order).withColumn("part", F.substring(F.md5("url_normalized"), 1, digits))
        fresh.limit(0).write.mode("append").partitionBy("part").parquet(held_path)  # the table exists from now on
        parts = [r[0] for r in fresh.select("part").distinct().collect()]  # 16 ** digits values at most
        held = spark.read.schema(fresh.schema).parquet(held_path).where(F.col("part").isin(parts)).select("part", "url_normalized")
        fresh.join(held, ["part", "url_normalized"], "left_anti").repartition("part").write.mode("append").partitionBy("part").parquet(held_path)

    run_available(stream.writeStream.foreachBatch(append), checkpoint)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> None:
    """Continuous scoring: ``score`` is any stateless table job (parts, features, rule scores)."""
    run_available(score(stream).writeStream.format("parquet").outputMode("append").option("path", out_path), checkpoint)


def scan_counters(log: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Scan counters per tumbling window: total, safe, phishing, questionable, detection rate (batch and streaming)."""
    df = log.withWatermark("ts", watermark) if watermark else log
    d, err = F.col("is_phishing"), F.col("error").isNotNull()
    g = df.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~err & ~d).alias("safe"), F.count_if(~err & d).alias("phishing"),
        F.count_if(~err & d.isNull()).alias("questionable"))
    return g.select(F.col("window.start").alias("start"), "total", "safe", "phishing", "questionable",
                    F.coalesce(F.try_divide(F.col("phishing").cast("double"), F.col("total")), F.lit(0.0)).alias("detection_rate"))


def rate_audit(requests: DataFrame, key: str, limit: int = 10, window: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Windows in which a source exceeded its request limit (partial counts combine before the shuffle)."""
    df = requests.withWatermark("ts", watermark) if watermark else requests
    g = df.groupBy(F.window("ts", window), key).agg(F.count(F.lit(1)).alias("n_requests"))
    return g.where(F.col("n_requests") > limit).select(F.col("window.start").alias("start"), key, "n_requests")


def write_updates(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Append the windows that each batch changed, open ones included, with the batch's number.

    The watermark closes old windows and drops their state; nothing written is written again.  ``read_updates`` gives
    the newest row of each window.  A batch that is run again appends the same rows under the same number.
    """
    run_available(df.writeStream.outputMode("update").foreachBatch(
        lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out_path)), checkpoint)


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class Suppressor(StatefulProcessor):
    """Per key: pass a check when its event time is at least ``ttl`` after the last one passed, in order of event time.

    State is kept per bucket of keys, one Arrow table each of the checks that wait and of the last ones passed, so that a call
    decides many keys.  Checks wait until a timer says that the watermark has passed them; then they are decided in order.  A
    check older than one already passed comes too late to be decided and goes out as such.
    """

    def __init__(self, ttl: int, key_type: pa.DataType):
        self.ttl, self.schema = ttl, pa.schema([("key", key_type), ("sec", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        table = T.StructType([T.StructField("rows", T.BinaryType())])
        self.handle, self.last, self.waiting = handle, handle.getValueState("last", table), handle.getValueState("waiting", table)

    def _read(self, state) -> pd.DataFrame:
        found = state.get()
        return (self.schema.empty_table() if found is None else pa.ipc.open_stream(bytes(found[0])).read_all()).to_pandas()

    def _write(self, state, rows: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(pa.Table.from_pandas(rows, self.schema, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))

    def _wait(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self._write(self.waiting, rows)
            self.handle.registerTimer(int(rows["sec"].min()) * 1000)
        else:
            self.waiting.clear()

    def _with_last(self, rows: pd.DataFrame, last: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list]:
        """The rows, the number of each one's key, and by number the second last passed (None: none)."""
        codes, keys = pd.factorize(pd.concat([last["key"], rows["key"]], ignore_index=True), use_na_sentinel=False)
        return rows, codes[len(last):], [*last["sec"].tolist(), *[None] * (len(keys) - len(last))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([p[["key", "sec"]] for p in rows], ignore_index=True).drop_duplicates()
        new, codes, passed = self._with_last(new, self._read(self.last))
        at = np.array([-(2**63) if p is None else p for p in passed], dtype=np.int64)[codes]
        late, fresh = new[new["sec"] < at], new[new["sec"] > at]
        if len(fresh):
            waiting = self._read(self.waiting)
            self._wait(pd.concat([waiting, fresh], ignore_index=True).drop_duplicates() if len(waiting) else fresh)
        if len(late):
            yield late.assign(kind="late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._read(self.waiting)
        is_ready = waiting["sec"] * 1000 <= timerValues.getCurrentWatermarkInMs()
        if not is_ready.any():
            return
        last = self._read(self.last)
        ready, codes, passed = self._with_last(waiting[is_ready].sort_values("sec", kind="stable"), last)
        kept = []
        for i, (k, s) in enumerate(zip(codes.tolist(), ready["sec"].tolist())):
            if passed[k] is None or s >= passed[k] + self.ttl:
                kept.append(i)
                passed[k] = s
        kept = ready.iloc[kept]
        self._write(self.last, pd.concat([last, kept], ignore_index=True).drop_duplicates("key", keep="last") if len(last) else kept.drop_duplicates("key", keep="last"))
        self._wait(waiting[~is_ready])
        if len(kept):
            yield kept.assign(kind="kept")

    def close(self) -> None:
        pass


def suppress_stream(stream: DataFrame, ttl: int, out_path: str, checkpoint: str, delay: str = "1 hour", buckets: int = BUCKETS) -> None:
    """Streaming look-up suppression over ``key, ts``, by event time: rows may come out of order by up to ``delay``.

    Writes ``key, sec`` under ``kind=kept``, and under ``kind=late`` the checks that came after a later one of their key had
    been passed.  A row without a key only moves the time on (a heartbeat, so that idle streams decide what waits).  State
    is a number per key and the distinct seconds that wait for the watermark, in ``buckets`` of keys (for the life of a checkpoint);
    keys are of a type that is no array, map or struct.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        key_type = stream.schema["key"].dataType
        # the event time itself is left out below the state, so that late rows reach it and are told apart there
        # a condition that reads the event time stays above the watermark, which so sees the heartbeats
        timed = stream.withWatermark("ts", delay).where("CASE WHEN ts IS NOT NULL THEN key IS NOT NULL ELSE false END")
        timed = timed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", event_seconds(F.col("ts")).alias("sec"))
        out = timed.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=Suppressor(ttl, to_arrow_type(key_type)), outputStructType=T.StructType([
                T.StructField("key", key_type), T.StructField("sec", T.LongType()), T.StructField("kind", T.StringType())]), outputMode="Append", timeMode="EventTime")
        run_available(out.writeStream.format("parquet").outputMode("append").partitionBy("kind").option("path", out_path), checkpoint)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def event_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def newest_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The newest complete version of a snapshot table, read now."""
    version = newest_version(spark, path)
    return version, spark.read.parquet(f"{path}/version={version}")


def score_with_snapshots(stream: DataFrame, score: Callable[..., DataFrame], snapshots: dict[str, str], out_path: str, checkpoint: str) -> None:
    """Continuous scoring against dimensions that change: known-bad hashes, cached findings, TLDs, DNS facts.

    Each batch reads the newest complete version of every snapshot (``newest_snapshot``) and runs ``score(batch,
    **snapshots)``, the same job as in batch; the versions used are written with its rows (``<name>_version``).  A batch
    has a folder of its own, which a re-run replaces, so a failed batch leaves nothing twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        tables = {name: newest_snapshot(batch.sparkSession, path) for name, path in snapshots.items()}
        out = score(batch, **{name: df for name, (_, df) in tables.items()})
        out = out.withColumns({f"{name}_version": F.lit(v) for name, (v, _) in tables.items()})
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(run), checkpoint)
