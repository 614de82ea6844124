"""Evaluation tables: confusion, class metrics, exact curves, correlations, histograms, scorecards.

Curves never sort raw rows in one task: rows are first aggregated per distinct
score, the distinct scores are cut into value buckets at approximate
quantiles, and prefix sums run inside the buckets on top of the bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rule_scorecard(verdicts: DataFrame, cases: DataFrame, key: str = "url_id") -> DataFrame:
    """Per category: passed, failed, percentage, and the detection / false-positive rate of its positive / negative cases."""
    j = cases.join(verdicts, key, "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    ok, pos = F.col("detected") == F.col("expected"), F.col("expected")
    return j.groupBy("category").agg(
        F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), (_ratio(F.count_if(ok), F.count(F.lit(1))) * 100).alias("pass_percent"),
        _ratio(F.count_if(pos & F.col("detected")), F.count_if(pos)).alias("detection_rate"),
        _ratio(F.count_if(~pos & F.col("detected")), F.count_if(~pos)).alias("false_positive_rate"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (0 on zero division), optionally per group."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    g = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"accuracy": _ratio(tp + F.col("tn"), F.col("n")), "precision": _ratio(tp, tp + fp),
                          "recall": _ratio(tp, tp + fn), "f1": _ratio(tp * 2, tp * 2 + fp + fn)})


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    m = class_metrics(df)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(a).alias(b) for a, b in pairs]) for c, pairs in (
        (1, (("tp", "hit"), ("fp", "over"), ("fn", "miss"))), (0, (("tn", "hit"), ("fn", "over"), ("fp", "miss"))))])
    r = m.select(F.explode(rows).alias("r")).select("r.*")
    hit, over, miss = F.col("hit"), F.col("over"), F.col("miss")
    return r.select("class", _ratio(hit, hit + over).alias("precision"), _ratio(hit, hit + miss).alias("recall"),
                    _ratio(hit * 2, hit * 2 + over + miss).alias("f1"), (hit + miss).alias("support"))


def false_predictions(df: DataFrame) -> DataFrame:
    """Misclassified rows with their kind."""
    y, p = F.col("label"), F.col("prediction")
    return df.where(y != p).withColumn("kind", F.when(p == 1, "false_positive").otherwise("false_negative"))


def cumulative_scores(df: DataFrame, score: str = "score", label: str = "label", buckets: int = 200) -> DataFrame:
    """Per distinct score, descending: ``pos, neg`` and the inclusive prefix sums ``tp, fp`` (exact)."""
    per = materialize(df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    edges = sorted(set(per.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e > F.col("score"))) if edges else F.lit(0)
    per = per.withColumn("bucket", bucket)
    # at most ``buckets`` rows reach the driver
    totals = {r["bucket"]: (r["p"], r["n"]) for r in per.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()}
    before, p, n = [], 0, 0
    for b in sorted(totals):
        before.append((b, p, n))
        p, n = p + totals[b][0], n + totals[b][1]
    schema = T.StructType([T.StructField(c, T.LongType() if i else T.IntegerType()) for i, c in enumerate(("bucket", "p0", "n0"))])
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, schema))  # at most ``buckets`` rows
    w = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.join(offsets, "bucket").select(
        "score", "pos", "neg", (F.col("p0") + F.sum("pos").over(w)).alias("tp"), (F.col("n0") + F.sum("neg").over(w)).alias("fp"))
    return out.withColumn("n_pos", F.lit(p).cast("long")).withColumn("n_neg", F.lit(n).cast("long"))  # a literal alone is an int


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC-AUC (ties averaged); 0 when the score is constant or a class is missing."""
    c = cumulative_scores(df, score, label)
    # pairs won by each score: its positives against all lower negatives, half of the equal ones
    won = F.col("pos") * (F.col("n_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    agg = c.agg(F.sum(won.cast("double")).alias("w"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"), F.count(F.lit(1)).alias("k"))
    return agg.select(F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(_ratio(F.col("w"), F.col("p").cast("double") * F.col("n"))).alias("roc_auc"))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = cumulative_scores(df, score, label)
    return c.select(F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = cumulative_scores(df, score, label)
    return c.select(F.col("score").alias("threshold"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over scores of (recall step) x precision."""
    c = cumulative_scores(df, score, label)
    step = _ratio(F.col("pos"), F.col("n_pos")) * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


PAIRS = 500  # feature pairs of one aggregate row


def feature_label_correlation(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Pearson correlation of every feature with the label, in one pass: ``feature, r``."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("c")).select("c.*")


def top_features(corr: DataFrame, k: int = 20) -> DataFrame:
    return corr.where(F.col("r").isNotNull() & ~F.isnan("r")).orderBy(F.desc(F.abs("r")), "feature").limit(k)


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature correlation matrix as rows ``f1, f2, r``, pairwise complete: each pair over the rows where both are present.

    Per pair of the upper triangle, the count, sums and products over its complete rows, taken around the features' means
    so that no precision is lost; partial sums combine before the one shuffle, of a row per task, in steps of ``PAIRS`` so
    that no aggregate row grows beyond that.  The matrix is features x features, whatever the rows.  A pair without two
    different values on both sides has no correlation (null).
    """
    df = materialize(df.select(*dict.fromkeys(features)))  # read for the means and for every step
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    out = None
    for at in range(0, len(pairs), PAIRS):
        some, sums, cells = pairs[at : at + PAIRS], [], []
        for k, (a, b) in enumerate(some):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = (F.when(both, F.col(f).cast("double") - F.lit(means[f] or 0.0)) for f in (a, b))
            terms = {"n": F.count(x), "x": F.sum(x), "y": F.sum(y), "xy": F.sum(x * y), "xx": F.sum(x * x), "yy": F.sum(y * y),
                     "vary": (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))}
            sums += [v.alias(f"{t}{k}") for t, v in terms.items()]
            n, x, y, xy, xx, yy, vary = (F.col(f"{t}{k}") for t in terms)
            spread = F.sqrt(F.greatest(F.lit(0.0), n * xx - x * x)) * F.sqrt(F.greatest(F.lit(0.0), n * yy - y * y))
            r = F.when(vary, F.try_divide(n * xy - x * y, spread))
            cells += [F.struct(F.lit(f).alias("f1"), F.lit(g).alias("f2"), r.alias("r")) for f, g in dict.fromkeys([(a, b), (b, a)])]
        part = df.agg(*sums).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        out = part if out is None else out.unionByName(part)
    return out


def class_histograms(df: DataFrame, features: list[str], label: str = "label", bins: int = 30) -> DataFrame:
    """Per feature and class: counts in equal-width bins over the feature's range, ``feature, label, bin, n``."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("c")
                     ).select(label, "c.*").where(F.col("x").isNotNull())
    rng = F.broadcast(long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row per feature
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return long.join(rng, "feature").groupBy("feature", label, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def batch_summary(df: DataFrame, decision: str = "is_phishing", error: str = "error") -> DataFrame:
    """Counts of phishing, safe, unclear and failed rows."""
    d, e = F.col(decision), F.col(error).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~e & d).alias("phishing"), F.count_if(~e & ~d).alias("safe"),
                  F.count_if(~e & d.isNull()).alias("unclear"), F.count_if(e).alias("error"))


def compare_models(metrics: DataFrame, by: str = "accuracy") -> DataFrame:
    """Model comparison table, best first (one row per model)."""
    return metrics.orderBy(F.desc(by), "model")


def best_model(metrics: DataFrame) -> DataFrame:
    """Most accurate and fastest model (ties: alphabetical)."""
    return metrics.agg(F.min_by("model", F.struct(-F.col("accuracy"), F.col("model"))).alias("most_accurate"),
                       F.min_by("model", F.struct(F.col("training_time"), F.col("model"))).alias("fastest"))
