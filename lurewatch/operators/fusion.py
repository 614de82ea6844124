"""Fusion of evidence into one verdict per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A-layer evidence -> (points, confidence; None = the layer's own confidence)
EVIDENCE = {
    ("domain", "absent_brand"): (25, 0.95), ("domain", "absent"): (12, 0.70), ("domain", "exists_suspicious"): (18, 0.75),
    ("domain", "exists"): (0, 0.85),
    ("lookalike", "critical"): (20, 0.95), ("lookalike", "high"): (16, 0.90), ("lookalike", "medium"): (10, 0.80),
    ("model", "phishing"): (25, None), ("model", "legitimate"): (0, None),
    ("pattern", "extreme"): (20, 0.90), ("pattern", "high"): (16, 0.80), ("pattern", "suspicious"): (8, 0.70),
    ("features", "high"): (10, 0.85), ("features", "elevated"): (6, 0.75),
    ("signatures", "phishing"): (15, None), ("signatures", "unclear"): (8, 0.7), ("signatures", "minor"): (4, 0.6),
    ("community", "confirmed"): (15, 0.95), ("community", "listed"): (10, 0.85),
    ("safe_browsing", "threat"): (25, 0.99), ("safe_browsing", "clean"): (0, 0.90),
    ("scanners", "many"): (20, 0.98), ("scanners", "several"): (15, 0.92), ("scanners", "some"): (10, 0.85), ("scanners", "clean"): (0, 0.88),
    ("sandbox", "malicious"): (10, 0.90), ("sandbox", "high_score"): (5, 0.80),
}
LAYERS = ["domain", "lookalike", "model", "pattern", "features", "signatures", "community", "safe_browsing", "scanners", "sandbox"]
# Threat-score layers -> weight in tenths (whole numbers keep the sums independent of row order)
LAYER_WEIGHTS = {"model": 4, "services": 3, "safe_browsing": 2, "indicators": 1}


def evidence_points(evidence: DataFrame) -> DataFrame:
    """Long evidence ``url_id, layer, outcome[, own_confidence]`` with its points and confidence."""
    key = F.concat_ws("/", "layer", "outcome")
    pts = F.create_map(*[F.lit(x) for (a, b), (p, _) in EVIDENCE.items() for x in (f"{a}/{b}", p)])
    conf = F.create_map(*[x for (a, b), (_, c) in EVIDENCE.items() for x in (F.lit(f"{a}/{b}"), F.lit(c).cast("double"))])
    own = F.col("own_confidence") if "own_confidence" in evidence.columns else F.lit(None).cast("double")
    return evidence.select("url_id", "layer", "outcome", F.try_element_at(pts, key).alias("points"),
                           F.coalesce(F.try_element_at(conf, key), own).alias("confidence")).where(F.col("points").isNotNull())


def _verdict(s: Column, confidence: Column, reasoning: Column) -> list[Column]:
    """Additive score, capped at 100, with bands 15/25/40/60; no evidence at all appears safe at confidence 0.5."""
    return [
        F.least(s, F.lit(100)).alias("threat_level"), F.coalesce(confidence, F.lit(0.5)).alias("confidence"),
        F.when(s >= 25, F.lit(True)).when(s < 15, F.lit(False)).alias("is_phishing"),
        F.when(s >= 60, "PHISHING_DETECTED").when(s >= 40, "LIKELY_PHISHING").when(s >= 25, "SUSPICIOUS")
        .when(s >= 15, "QUESTIONABLE").otherwise("APPEARS_SAFE").alias("verdict"), reasoning.alias("reasoning")]


def fuse_layers(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fusion of one wide row per URL (a column per layer with its outcome, ``<layer>_confidence`` where it has its own).

    A fixed array over the layers, no shuffle: ``url_id, threat_level, confidence, is_phishing (nullable), verdict, reasoning``
    and the columns ``keep``.
    """
    found = []
    for layer in [x for x in LAYERS if x in df.columns]:
        own = F.col(f"{layer}_confidence") if f"{layer}_confidence" in df.columns else F.lit(None)
        pts, conf = F.lit(None).cast("int"), F.lit(None).cast("double")
        for (name, outcome), (p, c) in EVIDENCE.items():
            if name == layer:
                hit = F.col(layer) == outcome
                pts, conf = F.when(hit, F.lit(p)).otherwise(pts), F.when(hit, F.lit(c) if c is not None else own.cast("double")).otherwise(conf)
        found.append(F.struct(pts.alias("p"), conf.alias("c"), F.concat_ws(":", F.lit(layer), F.col(layer)).alias("r")))
    df = df.select("url_id", *keep, F.filter(F.array(*found), lambda e: e["p"].isNotNull()).alias("e"))
    s = F.aggregate("e", F.lit(0), lambda a, e: a + e["p"])
    sure = F.filter("e", lambda e: e["c"].isNotNull())
    c = F.try_divide(F.aggregate(sure, F.lit(0.0), lambda a, e: a + e["c"]), F.size(sure))
    df = df.select("url_id", *keep, s.alias("s"), c.alias("c"), F.transform("e", lambda e: e["r"]).alias("rs"))
    return df.select("url_id", *_verdict(F.col("s"), F.col("c"), F.col("rs")), *keep)


def fuse(evidence: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Fusion of long evidence: ``threat_level, confidence, is_phishing (nullable), verdict, reasoning``.

    ``urls`` (``url_id``) are all URLs that need a verdict; those without evidence appear safe.  At most one row per
    layer and URL, so the collected reasoning is bounded by the number of layers.
    """
    e = evidence_points(evidence)
    order = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    g = e.groupBy("url_id").agg(
        F.sum("points").alias("s"), F.avg("confidence").alias("c"),
        F.sort_array(F.collect_list(F.struct(order.alias("o"), F.concat_ws(":", "layer", "outcome").alias("r")))).alias("rs"))
    if urls is not None:
        g = urls.select("url_id").join(g, "url_id", "left")
    reasons = F.coalesce(F.transform("rs", lambda r: r["r"]), F.array().cast("array<string>"))
    return g.select("url_id", *_verdict(F.coalesce("s", F.lit(0)), F.col("c"), reasons))


def pattern_outcome(risk: Column) -> Column:
    return F.when(risk >= 50, "extreme").when(risk >= 30, "high").when(risk >= 15, "suspicious")


def signature_outcome(is_phishing: Column, risk: Column) -> Column:
    return F.when(is_phishing, "phishing").when(is_phishing.isNull(), "unclear").when(risk >= 20, "minor")


def weighted_threat(layers: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Weighted mean of layer scores over the completed layers (``url_id, layer, score``), bands 10/30/50/70.

    ``urls`` without a completed layer score 0 with confidence 0.
    """
    w = F.create_map(*[F.lit(x) for kv in LAYER_WEIGHTS.items() for x in kv])
    g = layers.withColumn("w", F.try_element_at(w, F.col("layer"))).where(F.col("w").isNotNull() & F.col("score").isNotNull()).groupBy("url_id").agg(
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")), F.lit(0.0)).alias("t"), F.sum("w").alias("w"))
    if urls is not None:
        g = urls.select("url_id").join(g, "url_id", "left").fillna(0, ["t", "w"])
    t = F.round("t", 6)
    return g.select("url_id", F.round("t", 1).alias("threat_score"), F.least(F.col("w") / 10, F.lit(1.0)).alias("confidence"),
                    F.when(t >= 70, "dangerous").when(t >= 50, "suspicious").when(t >= 30, "questionable")
                    .when(t >= 10, "low_risk").otherwise("safe").alias("verdict"))


def majority_vote(votes: DataFrame, key: str = "url_id", threshold: float = 0.5) -> DataFrame:
    """Strict majority of the base models; confidence = highest probability, plus the winner's mean probability."""
    vote = (F.col("probability") >= threshold).cast("int")
    g = votes.groupBy(key).agg(F.sum(vote).alias("v"), F.count(F.lit(1)).alias("n"), F.max("probability").alias("max_probability"),
                               F.avg("probability").alias("m"))
    win = F.col("v") * 2 > F.col("n")
    return g.select(key, win.cast("int").alias("prediction"), F.col("v").alias("n_votes"), "max_probability",
                    F.when(win, F.col("m")).otherwise(1 - F.col("m")).alias("winner_mean"))


def pattern_override(predictions: DataFrame, patterns: DataFrame) -> DataFrame:
    """A pattern risk of 30 or more overrides the model: phishing, with the pattern's confidence."""
    j = predictions.join(patterns.select("url_id", "risk_score", F.col("confidence").alias("pattern_confidence")), "url_id", "left")
    hit = F.coalesce(F.col("risk_score") >= 30, F.lit(False))
    return j.select("url_id", F.when(hit, F.lit(1)).otherwise(F.col("prediction")).alias("prediction"),
                    F.when(hit, F.col("pattern_confidence")).otherwise(F.col("confidence")).alias("confidence"), hit.alias("overridden"))
