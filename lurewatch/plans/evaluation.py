"""Queries for evaluation tables, splits, votes and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import base_features as B
from lurewatch.operators import fusion as U
from lurewatch.operators import metrics as M
from lurewatch.operators import rules as R
from lurewatch.operators import split as S
from lurewatch.operators.brands import lookalike_hosts
from lurewatch.operators.enrich import latest_facts
from lurewatch.operators.parts import url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query
from lurewatch.session import materialize, scratch_path
from lurewatch.sources.sinks import write_verdict_report

FEATURES = ["url_length", "domain_length", "path_length", "dot_count", "slash_count", "hyphen_count", "digit_count", "letter_count",
            "digit_ratio", "letter_ratio", "url_entropy", "domain_entropy"]


def labelled_features(spark, sf):
    """Lexical features of the known URLs with their label (1 = imitation)."""
    known = fx.known_urls(spark, sf)
    parts = url_parts(known.select("url_id", "url", (F.col("technique_id") > 0).cast("int").alias("label")))
    cols = B.lexical_columns()
    return parts.select("url_id", "label", *[cols[f].alias(f) for f in FEATURES])


@query("confusion_matrix")
def _confusion(spark, sf):
    return M.confusion_matrix(fx.scored(spark, sf))


@query("class_metrics")
def _metrics(spark, sf):
    return M.class_metrics(fx.scored(spark, sf))


@query("class_report")
def _report(spark, sf):
    return M.class_report(fx.scored(spark, sf))


@query("false_predictions")
def _false(spark, sf):
    return M.false_predictions(fx.scored(spark, sf)).select("doc_id", "label", "prediction", "kind")


@query("roc_auc")
def _auc(spark, sf):
    return M.roc_auc(fx.scored(spark, sf))


@query("roc_curve")
def _roc(spark, sf):
    return M.roc_curve(fx.scored(spark, sf))


@query("precision_recall_curve")
def _pr(spark, sf):
    return M.pr_curve(fx.scored(spark, sf))


@query("average_precision")
def _ap(spark, sf):
    return M.average_precision(fx.scored(spark, sf))


@query("feature_label_correlation")
def _corr(spark, sf):
    return M.feature_label_correlation(labelled_features(spark, sf), FEATURES)


@query("top_correlated_features")
def _top(spark, sf):
    return M.top_features(M.feature_label_correlation(labelled_features(spark, sf), FEATURES), 10)


@query("feature_correlation_matrix")
def _matrix(spark, sf):
    return M.correlation_matrix(labelled_features(spark, sf), FEATURES)


@query("pairwise_correlation")
def _pairwise(spark, sf):
    """Correlations of features with gaps: each pair over the rows where both are present."""
    df = labelled_features(spark, sf)
    gaps = {f: F.when(F.col("url_id") % (i + 3) != 0, F.col(f)) for i, f in enumerate(FEATURES[:6])}
    return M.correlation_matrix(df.withColumns(gaps), FEATURES[:6])


@query("class_histograms")
def _hist(spark, sf):
    return M.class_histograms(labelled_features(spark, sf), ["url_length", "domain_length", "dot_count", "digit_count"])


def _models(spark, sf):
    v = fx.votes(spark, sf).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    times = v.groupBy("model").agg(F.avg("probability").alias("training_time"))
    return M.class_metrics(v, ["model"]).select("model", "accuracy", "precision", "recall", "f1").join(times, "model")


@query("model_comparison")
def _compare(spark, sf):
    return M.compare_models(_models(spark, sf))


@query("best_model")
def _best(spark, sf):
    return M.best_model(_models(spark, sf))


@query("batch_summary")
def _batch(spark, sf):
    return M.batch_summary(fx.scan_log(spark, sf))


@query("train_test_split")
def _split(spark, sf):
    return S.split_flag(fx.corpus(spark, sf).select("url_id", "url"), "url").select("url_id", "is_train")


@query("fold_assignment")
def _folds(spark, sf):
    return S.fold_column(fx.scored(spark, sf), "doc_id").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("fold_accuracy")
def _fold_acc(spark, sf):
    return S.fold_accuracy(S.fold_column(fx.scored(spark, sf), "doc_id"))


@query("selected_features")
def _selected(spark, sf):
    """Numeric feature columns aligned to a saved list (one unknown, one reordered)."""
    df = labelled_features(spark, sf)
    wanted = ["digit_count", "vendor_score", *[c for c in S.feature_columns(df) if c != "digit_count"]]
    return S.align_features(df, wanted)


@query("majority_vote")
def _vote(spark, sf):
    return U.majority_vote(fx.votes(spark, sf), "doc_id")


@query("pattern_override")
def _override(spark, sf):
    """Model stand-in: digit share of the URL; pattern risk overrides it."""
    parts = corpus_parts(spark, sf)
    p = F.round(F.length(F.regexp_replace("url", "[^0-9]", "")) / F.length("url"), 6)
    model = parts.select("url_id", (p >= 0.3).cast("int").alias("prediction"), p.alias("confidence"))
    return U.pattern_override(model, R.pattern_score(parts))


def evidence(spark, sf):
    """Pattern, signature and look-alike evidence of the corpus, parsed once."""
    parts = materialize(corpus_parts(spark, sf))
    pat = R.pattern_score(parts).select("url_id", F.lit("pattern").alias("layer"), U.pattern_outcome(F.col("risk_score")).alias("outcome"),
                                        F.lit(None).cast("double").alias("own_confidence"))
    sig = R.signature_score(parts).select("url_id", F.lit("signatures").alias("layer"),
                                          U.signature_outcome(F.col("is_phishing"), F.col("risk_score")).alias("outcome"),
                                          F.col("confidence").alias("own_confidence"))
    look = parts.select("url_id", "host").join(lookalike_hosts(parts, fx.brands(spark, sf)), "host").select(
        "url_id", F.lit("lookalike").alias("layer"), F.col("severity").alias("outcome"), F.lit(None).cast("double").alias("own_confidence"))
    return pat.unionByName(sig).unionByName(look).where("outcome IS NOT NULL")


@query("fused_verdicts")
def _fuse(spark, sf):
    """Three layers, long evidence: every URL of the corpus gets a verdict."""
    return U.fuse(evidence(spark, sf), fx.corpus(spark, sf)).withColumn("reasoning", F.array_join("reasoning", "|"))


def digit_model(rows):
    """Stand-in for a model: the digits' share of a URL in hundredths, phishing from 30."""
    p = F.expr("CAST(length(regexp_replace(url, '[^0-9]', '')) * 100 div length(url) AS DOUBLE) / 100")
    return rows.withColumns({"prediction": (p >= 0.3).cast("int"), "confidence": p})


@query("full_analysis")
def _full(spark, sf):
    """Staged routing and all ten layers; the model is a stand-in (digit share), overridden by the pattern score."""
    from lurewatch.operators.analysis import full_analysis
    from lurewatch.plans import enrichment as E

    parts = corpus_parts(spark, sf)
    bad = fx.corpus(spark, sf).where("url_id % 50 = 0").select(R.url_hash(F.col("url")).alias("url_hash"))
    # the DNS days are numbered; domain age and the findings' freshness count up to a date
    out = full_analysis(parts, fx.brands(spark, sf), latest_facts(E.dns_snapshot(spark, sf)), E.whois_snapshot(spark, sf), E.reputation(spark, sf),
                        digit_model, F.lit(E.AS_OF).cast("date"), E.TTL, bad)
    return out.withColumn("reasoning", F.array_join("reasoning", "|"))


@query("verdict_report")
def _json(spark, sf):
    """Verdicts written as JSON lines and read back."""
    path = scratch_path(spark, "verdicts")
    write_verdict_report(U.fuse(evidence(spark, sf), fx.corpus(spark, sf)), path)
    back = spark.read.schema("url_id long, threat_level int, confidence double, is_phishing boolean, verdict string, reasoning array<string>").json(path)
    return back.withColumn("n_reasons", F.size("reasoning")).withColumn("reasoning", F.array_join("reasoning", "|"))


@query("weighted_threat_score")
def _weighted(spark, sf):
    """Model, services, safe browsing and indicators, each with the weight it has only where it says something."""
    from lurewatch.operators.analysis import threat_layers
    from lurewatch.plans import enrichment as E

    parts = corpus_parts(spark, sf)
    return U.weighted_threat(threat_layers(digit_model(parts), E.reputation(spark, sf), F.lit(E.AS_OF).cast("timestamp"), E.TTL), parts)


@query("pair_comparison")
def _pairs(spark, sf):
    """Neighbouring URLs compared by their pattern risk: the safer one of each pair."""
    s = materialize(R.pattern_score(corpus_parts(spark, sf)).select("url_id", "risk_score", "verdict"))
    pairs = fx.corpus(spark, sf).where("url_id % 2 = 0").select(F.col("url_id").alias("left_id"), (F.col("url_id") + 1).alias("right_id"))
    left = s.select(F.col("url_id").alias("left_id"), F.col("risk_score").alias("left_risk"), F.col("verdict").alias("left_verdict"))
    right = s.select(F.col("url_id").alias("right_id"), F.col("risk_score").alias("right_risk"), F.col("verdict").alias("right_verdict"))
    return pairs.join(left, "left_id").join(right, "right_id").withColumn("safer", F.when(
        F.col("left_risk") < F.col("right_risk"), "left").when(F.col("right_risk") < F.col("left_risk"), "right").otherwise("same"))
