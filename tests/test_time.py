"""Time-based operators against naive scans: as-of verdicts, suppression, curves, samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.operators import metrics as M
from lurewatch.operators.corpus import balance_classes, hash_sample, keep_first, merge_reasons
from lurewatch.operators.enrich import asof_verdicts
from lurewatch.operators.suppress import suppress_checks


@pytest.mark.parametrize("slot", [1, 7, 100])
def test_asof_equals_scan(spark, slot):
    rng = random.Random(slot)
    key = lambda: "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}"
    req = [(key(), rng.randrange(600) * 1_000_000 + rng.randrange(3), i) for i in range(300)]
    ver = sorted({(key(), rng.randrange(600) * 1_000_000) for _ in range(60)})
    ver = [(k, t, f"v{i}") for i, (k, t) in enumerate(ver)]
    got = asof_verdicts(spark.createDataFrame(req, "key string, us long, rid long"), spark.createDataFrame(ver, "key string, us long, verdict string"), 40, slot)
    want = {}
    for k, t, i in req:
        past = [(vt, v) for vk, vt, v in ver if vk == k and vt <= t]
        want[i] = max(past)[1] if past and t - max(past)[0] < 40_000_000 else None
    rows = got.collect()
    assert len(rows) == len(req) and {r.rid: r.verdict for r in rows} == want


@pytest.mark.parametrize("ttl,chunk,block", [(10, 40, 64), (10, 15, 3), (300, 350, 2), (3, 1000, 1)])
def test_suppression_equals_scan(spark, ttl, chunk, block):
    rng = random.Random(ttl)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", rng.randrange(1200)) for _ in range(900)]
    want = []
    for k in {k for k, _ in rows}:
        allowed = None
        for t in sorted({t for kk, t in rows if kk == k}):
            if allowed is None or t >= allowed:
                want.append((k, t))
                allowed = t + ttl
    got = suppress_checks(spark.createDataFrame(rows, "key string, sec long"), ttl, chunk, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_curves_equal_naive(spark):
    rng = random.Random(3)
    data = [(rng.randrange(2), rng.randrange(40) / 40) for _ in range(500)]
    df = spark.createDataFrame(data, "label int, score double")
    y, s = np.array([a for a, _ in data]), np.array([b for _, b in data])
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df).first()[0] == pytest.approx(auc)
    for r in M.roc_curve(df).collect():
        assert r.tpr == pytest.approx((pos >= r.threshold).mean()) and r.fpr == pytest.approx((neg >= r.threshold).mean())
    assert M.roc_auc(df.withColumn("score", F.lit(0.5))).first()[0] == 0.0


def test_hash_sample_is_exact(spark):
    df = spark.range(3000).select(F.concat(F.lit("http://h"), "id", F.lit(".com/")).alias("url"), "id")
    got = {r.url for r in hash_sample(df, 1234, 9).collect()}
    want = {r.url for r in df.orderBy(F.md5(F.concat(F.lit("9:"), "url"))).limit(1234).collect()}
    assert got == want and hash_sample(df, 99999).count() == 3000
    lab = df.withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    assert sorted(r["count"] for r in balance_classes(lab).groupBy("label").count().collect()) == [300, 300]


def test_keep_first_and_reasons(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect())) == [("a", 1, None), ("b", 5, "z")]
    one = spark.range(1).select(merge_reasons(F.lit(["p1", "r1", "p2"]), F.lit(["r1", "r2"])).alias("m")).first().m
    assert one == ["p2", "p1", "r1", "r2"]
