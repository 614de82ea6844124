"""What only larger tables show: products of counts, samples and folds, tasks and batches."""

import threading

import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from lurewatch.operators import base_features as B
from lurewatch.operators import containment as C
from lurewatch.operators import findings as A
from lurewatch.operators import metrics as M
from lurewatch.operators import ml as L
from lurewatch.plans import fixtures as fx
from lurewatch.plans import streams as PS
from lurewatch.operators.parts import url_parts


def test_auc_of_classes_whose_pairs_exceed_an_int(spark):
    df = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 4).cast("double").alias("score"))
    # scores 0, 2 are negative and 1, 3 positive: three of four pairs of scores are in order
    assert M.roc_auc(df).first()[0] == pytest.approx(0.75)


def test_sampled_fitting_rows_lie_in_all_folds(spark):
    df = spark.range(2_000).select(F.col("id").alias("url_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    per = {r["fold"]: r["count"] for r in L.fitting_rows(df, limit=200).groupBy("fold").count().collect()}
    assert set(per) == set(range(5)) and sum(per.values()) == 200
    out = L.cross_validate(("decision_tree",), df, ["x"], sizes={"tree_depth": 2}, limit=200).first()
    assert out.folds == 5


def test_a_long_table_makes_larger_batches_not_more(spark, tmp_path):
    df = spark.range(12_000, numPartitions=2).select("id")
    seen = []
    stream = PS._landed(spark, df, "long", df, rows=100, files=16, batches=4)
    stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sorted(sum(seen, [])) == list(range(12_000))


def test_urls_of_a_short_file_are_dealt_to_many_tasks(spark, tmp_path):
    rows = spark.range(30_000, numPartitions=1).select(F.col("id").alias("p_partkey"), F.lit("blue pen").alias("p_name"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert fx.table(spark, str(tmp_path), "part").rdd.getNumPartitions() < 6
    known = fx.known_urls(spark, str(tmp_path))
    assert known.rdd.getNumPartitions() == 6
    assert sorted(r.url_id for r in known.select("url_id").collect()) == list(range(30_000))


def test_attack_checks_go_through_the_brand_list_once(spark):
    urls = [(1, "http://applebank.com/x"), (2, "http://a.apple.bank.tk/login"), (3, "http://site.net/apple"), (4, "http://applecom.com/"), (5, None), (6, "")]
    parts = url_parts(spark.createDataFrame(urls, "url_id long, url string"))
    brands = spark.createDataFrame([("apple",), ("bank",), ("zzzz",)], "brand string")
    out = A.findings_array(parts, brands)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter([apple,bank,zzzz]") == 1
    got = sorted((r.url_id, f.check_no, f.brand) for r in out.collect() for f in r.findings if f.check_no in (5, 6, 7, 12, 13))
    assert got == [(1, 5, "apple"), (2, 6, "apple"), (2, 12, "apple"), (3, 13, "apple"), (4, 5, "apple"), (4, 7, "apple")]


def test_flag_terms_meet_each_text_once(spark, monkeypatch):
    urls = [(1, "http://a-pay.com/b.exe"), (2, "http://x.com:8080/login"), (3, "http://payy.org/"), (4, "http://x.org/\U0001f600pay"), (None, "http://pay.com/"), (6, None)]
    parts = url_parts(spark.createDataFrame(urls, "url_id long, url string"))
    terms = spark.createDataFrame([("keyword", "pay"), ("keyword", "\U0001f600pa"), ("typo", "payy"), ("path", "/login"), ("extension", ".exe"), ("port", "8080"), ("port", None)], "family string, term string")
    rules = spark.createDataFrame([("r1", "[.-]pay|zz", 1), ("r2", "(?:org|net)/$", 2)], "rule_id string, regex string, weight int")
    calls = []
    real = C.containment_hits
    monkeypatch.setattr(C, "containment_hits", lambda *a, **k: calls.append(a[2].columns) or real(*a, **k))
    got = B.pattern_flags(parts, terms, rules, literal_max=0)
    assert len([c for c in calls if "_must" not in c]) == 3  # host, path and URL, whatever the families
    want = B.pattern_flags(parts, terms, rules)
    assert sorted(map(str, got.where("url_id IS NOT NULL").collect())) == sorted(map(str, want.where("url_id IS NOT NULL").collect()))


def test_rules_without_text_take_texts_in_blocks(spark):
    texts = spark.createDataFrame([(i % 7, "x" * (i % 5) + str(i % 3)) for i in range(200)] + [(None, "x1"), (1, None)], "id long, s string")
    rules = spark.createDataFrame([("a", "[0-1]$", 1), ("b", "^(x|y)2", 2), ("c", "^xxx|^1", 3)], "rule_id string, regex string, weight int")
    hits = C.rule_hits(texts, "id", "s", rules, 0, 2, 16)
    assert "_texts" in hits._jdf.queryExecution().optimizedPlan().toString()  # a regex is compiled per block of texts, not per text
    count = lambda df: sorted(map(str, df.groupBy("id", "rule_id", "weight").count().collect()))
    assert count(hits) == count(C.rule_hits(texts, "id", "s", rules))


def test_registered_queries_run_wide_projections_as_compiled_code(spark):
    from lurewatch.plans import load_all

    s = spark.newSession()
    s.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")  # Spark's default: up to that size a method is run, though interpreted
    load_all()["ultra_statistics"](s, "/root/testdata/sf0.001")
    assert s.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_labels_are_dealt_before_their_keys_are_made(spark, monkeypatch):
    from lurewatch.operators import brands as R

    seen, real = [], R.best_brand_per_label
    monkeypatch.setattr(R, "best_brand_per_label", lambda labels, brands: seen.append(labels.rdd.getNumPartitions()) or real(labels, brands))
    hosts = spark.sql("SELECT 'name' || id || '.com' AS host, 'name' || id AS label FROM range(12000) UNION ALL SELECT 'goggle.com', 'goggle'")
    rows = R.lookalikes_of(hosts, spark.createDataFrame([("google",)], "brand string")).collect()
    assert seen == [3] and [(r.host, r.brand) for r in rows] == [("goggle.com", "google")]


def test_all_labelled_rows_are_fitted_whatever_their_number(spark, monkeypatch):
    df = spark.range(50_100).select(F.col("id").alias("url_id"), F.when(F.col("id") >= 20, F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    assert L.fitting_rows(df).count() == 50_080
    seen, real = [], L.fit
    monkeypatch.setattr(L, "fit", lambda name, train, *a, **k: seen.append(train.count()) or real(name, train, *a, **k))
    _, metrics = L.train_all(df, df.where("url_id BETWEEN 100 AND 200"), ["x"], names=("decision_tree",), sizes={"tree_depth": 2})
    assert seen == [50_080] and metrics.first()["error"] is None
    seen.clear()
    assert L.cross_validate(("decision_tree",), df, ["x"], 2, sizes={"tree_depth": 2}).first()["folds"] == 2
    assert sum(seen) == 50_080


def test_short_fits_share_the_cores(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("url_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    both, real = threading.Barrier(2, timeout=60), L.fit
    monkeypatch.setattr(L, "fit", lambda *a, **k: both.wait() is not None and real(*a, **k))
    models, metrics = L.train_all(df, df, ["x"], names=("decision_tree", "random_forest"), sizes={"tree_depth": 2, "forest_trees": 2, "forest_depth": 2})
    assert [(r.model, r.error) for r in metrics.collect()] == [("decision_tree", None), ("random_forest", None)] and list(models) == ["decision_tree", "random_forest"]
    assert L.at_once(60) > 1 == L.at_once(10**9)


def test_grid_search_equals_the_cross_validator(spark):
    rows = spark.range(300).select(F.col("id").alias("url_id"), ((F.col("id") * 7 % 11 + F.col("id") % 3) > 5).cast("int").alias("label"),
                                   (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    df = L.fitting_rows(rows, folds=3)
    for stage in L.scaling_stages(["x", "y"]):
        df = (stage.fit(df) if hasattr(stage, "fit") else stage).transform(df)
    search = L.learner("logistic_regression", 2, {"folds": 3, "max_iter": 5})
    plain = CrossValidator(estimator=search.getEstimator(), estimatorParamMaps=search.getEstimatorParamMaps(), evaluator=search.getEvaluator(), numFolds=3, foldCol="fold")
    got, want = search.fit(df), plain.fit(df)
    assert got.avgMetrics == pytest.approx(want.avgMetrics) and got.stdMetrics == pytest.approx(want.stdMetrics)
    assert got.bestModel.coefficients.toArray() == pytest.approx(want.bestModel.coefficients.toArray()) and got.getFoldCol() == "fold"
    with pytest.raises(ValueError, match="fold 1 is empty"):
        search.fit(df.where("fold <> 1"))
