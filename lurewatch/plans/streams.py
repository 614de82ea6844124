"""Queries for the streaming jobs (available-now runs over the given tables) and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import rules as R
from lurewatch.operators.parts import url_parts
from lurewatch.operators.suppress import suppress_checks
from lurewatch.plans import fixtures as fx
from lurewatch.plans.registry import query
from lurewatch.session import scratch_path
from lurewatch.streaming import jobs as J


# the events span less than this, so no row of the given tables is late
LATE = "400 days"


def _landed(spark, df, name, of, rows=4000, files=512, batches=8):
    """The frame written as files in the shared folder, as a stream of them: at most ``rows`` rows a file, two files a batch.

    Every batch costs a start and a commit of all state, so a long table gets larger files and batches and not more of
    them: some ``files`` files (by the rows of ``of``, the table that the frame is made from) and at most ``batches`` batches.
    """
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", max(rows, -(-of.count() // files))).parquet(path)
    landed = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return J.file_stream(spark, path, df.schema, max(2, -(-landed // batches)))


def _landed_by_arrival(spark, df, name, slices=4, late_days=2):
    """Checks ``key, ts`` as files in order of arrival, up to ``late_days`` after their time, then a heartbeat; as a stream of them.

    A slice is a batch, whatever its length: it has as many files as any other (empty ones where its rows take fewer), and
    that many make a batch.  Its files in batches of their own would cost a pass over all state each, and move the time on
    before the rest of the slice is read.
    """
    path = scratch_path(spark, name)
    sec = F.unix_seconds("ts")
    arrived = df.withColumn("arrival", sec + F.pmod(F.xxhash64("key", "ts"), F.lit(late_days * 86_400)))
    lo, hi = arrived.agg(F.min("arrival"), F.max("arrival")).first()
    files = df.rdd.getNumPartitions()
    for i in range(slices):
        a, b = (lo + (hi + 1 - lo) * k // slices for k in (i, i + 1))
        arrived.where((F.col("arrival") >= a) & (F.col("arrival") < b)).drop("arrival").write.mode("append").parquet(path)
        missing = (i + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles())
        for _ in range(missing):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    beat = df.agg((F.max("ts") + F.expr(f"INTERVAL {late_days + 1} DAYS")).alias("ts")).select(F.lit(None).cast(df.schema["key"].dataType).alias("key"), "ts")
    beat.write.mode("append").parquet(path)
    return J.file_stream(spark, path, df.schema, files)


@query("stream_ingest_new_urls")
def _ingest(spark, sf):
    df = fx.feed_a(spark, sf)
    src, held = _landed(spark, df, "incoming", fx.table(spark, sf, "lineitem")), scratch_path(spark, "held")
    J.ingest_new_urls(src, held, scratch_path(spark, "ck"), ["ord", "f1"], digits=1)
    return spark.read.parquet(held).groupBy("url_normalized").agg(F.count(F.lit(1)).alias("n"))


@query("stream_scored_urls")
def _score(spark, sf):
    df = fx.corpus(spark, sf).select("url_id", "url")
    src, out = _landed(spark, df, "urls", df), scratch_path(spark, "scores")
    J.score_stream(src, lambda s: R.pattern_score(url_parts(s)).select("url_id", "risk_score", "verdict"),
                   out, scratch_path(spark, "ck"))
    return spark.read.parquet(out)


@query("stream_scored_with_snapshots")
def _score_snapshots(spark, sf):
    """All scores of the URL and its known hash, by a stream; the list of known hashes is replaced between two batches."""
    from lurewatch.operators.analysis import scored

    urls = fx.corpus(spark, sf).select("url_id", "url")
    src, bad, out, ck = (scratch_path(spark, n) for n in ("urls", "known-bad", "scores", "ck"))

    def score(batch, known_bad):
        return scored(url_parts(batch), known_bad).select("url_id", "risk_score", "pattern", "signatures", "behaviour")

    for version, (part, known) in enumerate((("url_id % 2 = 0", "url_id % 50 = 0"), ("url_id % 2 = 1", "url_id % 3 = 0")), 1):
        urls.where(part).write.mode("append").parquet(src)
        urls.where(known).select(R.url_hash(F.col("url")).alias("url_hash")).write.parquet(f"{bad}/version={version}")
        J.score_with_snapshots(J.file_stream(spark, src, urls.schema), score, {"known_bad": bad}, out, ck)
    return spark.read.parquet(out).drop("batch")


def _show(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("scan_counters")
def _counters(spark, sf):
    return _show(J.scan_counters(fx.scan_log(spark, sf), "6 hours"))


@query("stream_scan_counters")
def _stream_counters(spark, sf):
    df = fx.scan_log(spark, sf).select("ts", "is_phishing", "error")
    src, out = _landed(spark, df, "log", df), scratch_path(spark, "counters")
    J.write_updates(J.scan_counters(src, "6 hours", LATE), out, scratch_path(spark, "ck"))
    return _show(J.read_updates(spark, out, ["start"]))


@query("rate_audit")
def _audit(spark, sf):
    return _show(J.rate_audit(fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "event_type", 20, "6 hours"))


@query("stream_rate_audit")
def _stream_audit(spark, sf):
    df = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src, out = _landed(spark, df, "requests", df), scratch_path(spark, "audit")
    J.write_updates(J.rate_audit(src, "event_type", 20, "6 hours", LATE), out, scratch_path(spark, "ck"))
    return _show(J.read_updates(spark, out, ["start", "event_type"]))


def _requests(spark, sf):
    """The events as requests of their users, time running 8,640 times as fast (six days in a minute)."""
    fast = F.timestamp_seconds(F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 8640"))
    return fx.table(spark, sf, "events").select(fast.alias("ts"), "user_id")


@query("rate_audit_per_user")
def _audit_user(spark, sf):
    return _show(J.rate_audit(_requests(spark, sf), "user_id", 10))


@query("stream_rate_audit_per_user")
def _stream_audit_user(spark, sf):
    df = _requests(spark, sf)
    src, out = _landed(spark, df, "requests", df), scratch_path(spark, "audit")
    J.write_updates(J.rate_audit(src, "user_id", 20, watermark="1 hour"), out, scratch_path(spark, "ck"))
    return _show(J.read_updates(spark, out, ["start", "user_id"]))


def _checks(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), J.event_seconds(F.col("ts")).alias("sec"))


@query("suppressed_checks")
def _suppress(spark, sf):
    return suppress_checks(_checks(spark, sf), 24 * 3600)


@query("stream_suppressed_checks")
def _stream_suppress(spark, sf):
    """Checks that arrive out of order by up to two days; the watermark waits for them."""
    df = fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    src, out = _landed_by_arrival(spark, df, "checks"), scratch_path(spark, "kept")
    J.suppress_stream(src, 24 * 3600, out, scratch_path(spark, "ck"), "2 days")
    return spark.read.schema("key long, sec long, kind string").parquet(out).where("kind = 'kept'").drop("kind")
