"""Event-time suppression: out-of-order input, late rows, waiting rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TTL = 50


def land(spark, path, batches):
    for rows in batches:
        df = spark.createDataFrame([(k, START + dt.timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, batches, delay):
    from lurewatch.streaming import jobs as J

    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    land(spark, src, batches)
    schema = spark.read.parquet(src).schema
    J.suppress_stream(J.file_stream(spark, src, schema, 1), TTL, out, f"{tmp_path}/ck", delay)
    got = spark.read.schema("key string, sec long, kind string").parquet(out).collect()
    base = int(START.timestamp())
    return {kind: sorted((r.key, r.sec - base) for r in got if r.kind == kind) for kind in ("kept", "late")}


def scan(rows):
    out = []
    for k in {k for k, _ in rows}:
        allowed = None
        for t in sorted({t for kk, t in rows if kk == k}):
            if allowed is None or t >= allowed:
                out.append((k, t))
                allowed = t + TTL
    return sorted(out)


def test_shuffled_files_equal_the_batch_twin(spark, tmp_path):
    from lurewatch.operators.suppress import suppress_checks

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", rng.randrange(1500)) for _ in range(300)]
    rng.shuffle(rows)
    got = run(spark, tmp_path, [rows[:100], rows[100:200], rows[200:], [(None, 9000)]], "2000 seconds")
    twin = suppress_checks(spark.createDataFrame(rows, "key string, sec long"), TTL)
    assert got["kept"] == sorted(map(tuple, twin.collect())) == scan(rows) and got["late"] == []


def test_late_rows_go_aside(spark, tmp_path):
    first = [("a", 0), ("a", 100), ("a", 120), ("b", 5)]
    # the watermark of the first files passes second 100; a row at 30 is older than the check passed at 100
    got = run(spark, tmp_path, [first, [("c", 400)], [("a", 30), ("a", 130), ("a", 155), ("b", 40), ("c", 401)], [(None, 9000)]], "10 seconds")
    assert got["late"] == [("a", 30)]
    assert got["kept"] == [("a", 0), ("a", 100), ("a", 155), ("b", 5), ("c", 400)]


@pytest.mark.parametrize("beat", [False, True])
def test_rows_wait_for_the_watermark(spark, tmp_path, beat):
    got = run(spark, tmp_path, [[("a", 0), ("a", 60)], [("b", 100)], *([[(None, 1000)]] if beat else [])], "30 seconds")
    assert got["kept"] == [("a", 0), ("a", 60)] + ([("b", 100)] if beat else [])


def test_scoring_follows_a_snapshot(spark, tmp_path):
    """A snapshot replaced between two batches changes the later batch's rows only."""
    from lurewatch.streaming import jobs as J

    def publish(version, hosts):
        spark.createDataFrame([(h,) for h in hosts], "host string").write.parquet(f"{tmp_path}/bad/version={version}")

    src, out, ck = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck"
    schema = "url_id long, host string"
    score = lambda batch, bad: batch.join(bad.withColumn("known", F.lit(True)), "host", "left").select("url_id", F.coalesce("known", F.lit(False)).alias("known"))
    publish(1, ["x"])
    for i, hosts in enumerate((["x", "y"], ["x", "y"], ["x", "y"])):
        spark.createDataFrame([(10 * i + j, h) for j, h in enumerate(hosts)], schema).write.mode("append").parquet(src)
        if i == 1:
            publish(2, ["y"])
        J.score_with_snapshots(J.file_stream(spark, src, spark.read.parquet(src).schema, 1), score, {"bad": f"{tmp_path}/bad"}, out, ck)
    rows = {r.url_id: (r.known, r.bad_version) for r in spark.read.parquet(out).collect()}
    assert rows == {0: (True, 1), 1: (False, 1), 10: (False, 2), 11: (True, 2), 20: (False, 2), 21: (True, 2)}


def test_a_slice_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    from lurewatch.plans import streams as PS

    rng = random.Random(5)
    for i in range(3):  # each file has checks of all times
        rows = [(j, START + dt.timedelta(seconds=rng.randrange(30 * 86_400)), rng.randrange(4)) for j in range(150)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(PS, "scratch_path", lambda _spark, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, PS._stream_suppress(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, PS._suppress(spark, str(tmp_path)).collect()))
    assert len([p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()]) <= 6  # four slices, the heartbeat, what then waits


def test_buckets_of_keys_decide_as_keys_do(spark, tmp_path):
    from lurewatch.streaming import jobs as J

    rng = random.Random(6)
    rows = [(f"k{rng.randrange(20)}", rng.randrange(1500)) for _ in range(400)]
    land(spark, f"{tmp_path}/src", [rows[:200], rows[200:], [(None, 9000)]])
    stream = J.file_stream(spark, f"{tmp_path}/src", spark.read.parquet(f"{tmp_path}/src").schema, 1)
    J.suppress_stream(stream, TTL, f"{tmp_path}/out", f"{tmp_path}/ck", "2000 seconds", buckets=2)
    base = int(START.timestamp())
    assert sorted((r.key, r.sec - base) for r in spark.read.parquet(f"{tmp_path}/out").where("kind = 'kept'").collect()) == scan(rows)
