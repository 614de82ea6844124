"""Full analysis: staged routing of every URL, and one verdict each.

A chain of gates, each of which asks only for what the earlier ones left:

1. syntax: an invalid URL leaves with the verdict INVALID_URL;
2. domain: only valid URLs with a valid TLD look up DNS, and only names that exist there look up their age; a random name
   that does not exist leaves with the verdict RANDOM_GARBAGE;
3. all other URLs pass the scores, the model and the services, whose findings are fused into one verdict.

Gates 1 and 2 are one pass over the URL parts: a row that may not look up carries a join key that matches nothing.  The
routed table is written once; early exits and survivors are filters on it and come together in a union.  Scores that
follow from the URL alone are columns of one projection; joins are by registered domain, host, domain label and URL hash
only, never on the URL's id between projections of the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import enrich as E
from lurewatch.operators import fusion as U
from lurewatch.operators import rules as R
from lurewatch.operators import ultra_features as UF
from lurewatch.operators.brands import lookalike_hosts
from lurewatch.session import materialize

# Early exits, (classification, verdict, threat level, confidence); none of them is phishing
EXITS = [("INVALID_SYNTAX", "INVALID_URL", 0, 1.0), ("RANDOM_GARBAGE_NOT_ON_INTERNET", "RANDOM_GARBAGE", 5, 0.95)]
VERY_CLOSE, SIGNS_HIGH, SIGNS_SOME = 1, 4, 3  # fixed values: nearness to a brand, numbers of behaviour signs


def route(parts: DataFrame, dns: DataFrame, whois: DataFrame, as_of: Column) -> DataFrame:
    """``parts`` with ``classification, domain_threat, domain_confidence`` and ``exit_verdict`` (null: go on)."""
    df = R.garbage_score(R.with_validity(parts)).select(*parts.columns, "is_valid", "tld_valid", "is_garbage")
    df = E.with_dns(df, dns, as_of, asked=F.col("is_valid") & F.col("tld_valid"))
    df = E.classify_domains(E.with_domain_age(df, whois, as_of, asked=F.col("exists_in_dns")))
    bad = ~F.col("is_valid")
    df = df.withColumns({
        "classification": F.when(bad, "INVALID_SYNTAX").otherwise(F.col("classification")),
        "domain_threat": F.when(bad, 0).otherwise(F.col("threat_level")), "domain_confidence": F.when(bad, 1.0).otherwise(F.col("domain_confidence"))})
    verdict = F.lit(None).cast("string")
    for name, label, _, _ in EXITS:
        verdict = F.when(F.col("classification") == name, label).otherwise(verdict)
    return df.select(*parts.columns, "classification", "domain_threat", "domain_confidence", verdict.alias("exit_verdict"))


def early_verdicts(routed: DataFrame) -> DataFrame:
    """The verdicts of the rows that leave early."""
    pick = lambda i, kind: F.expr("CASE classification " + " ".join(f"WHEN '{e[0]}' THEN {e[i]}" for e in EXITS) + " END").cast(kind)
    return routed.where(F.col("exit_verdict").isNotNull()).select(
        "url_id", pick(2, "int").alias("threat_level"), pick(3, "double").alias("confidence"), F.lit(False).alias("is_phishing"),
        F.col("exit_verdict").alias("verdict"), F.array().cast("array<string>").alias("reasoning"), "classification", "domain_threat")


def domain_outcome() -> Column:
    absent = F.when(F.col("domain_threat") >= 80, "absent_brand").otherwise("absent")
    return F.when(F.col("classification") == "NOT_ON_INTERNET", absent).when(
        F.col("classification") == "EXISTS_BUT_SUSPICIOUS", "exists_suspicious").when(F.col("classification") == "REAL_DOMAIN_EXISTS", "exists")


def service_outcomes() -> dict[str, Column]:
    """Outcomes of the service layers from the columns of ``reputation_wide``.

    The community feed confirms what is verified or valid, and lists what it holds; scanners count as some from one
    malicious or three suspicious results; a URL that a service does not know says nothing.
    """
    found = lambda s: F.col(f"{s}_status") == "checked"
    hits = F.col("scanners_malicious")
    sure = F.coalesce("community_verified", F.lit(False)) | F.coalesce("community_valid", F.lit(False))
    return {
        "community": F.when(found("community") & F.col("community_flagged"), F.when(sure, "confirmed").otherwise("listed")),
        "safe_browsing": F.when(found("safe_browsing"), F.when(F.col("safe_browsing_flagged"), "threat").otherwise("clean")),
        "scanners": F.when(found("scanners"), F.when(hits >= 5, "many").when(hits >= 2, "several").when(
            (hits >= 1) | (F.col("scanners_suspicious") >= 3), "some").otherwise("clean")),
        "sandbox": F.when(found("sandbox"), F.when(F.col("sandbox_flagged"), "malicious").when(F.col("sandbox_score") >= 50, "high_score"))}


def scored(rows: DataFrame, known_bad: DataFrame | None = None) -> DataFrame:
    """Pattern, signature and behaviour outcomes as columns beside those of ``rows``: projections, and a look-up of known hashes."""
    columns = rows.columns
    df = rows.withColumn("_row", F.struct(*columns))
    df = R.pattern_score(df, keep=("_row",)).select("_row", F.struct("risk_score", "confidence").alias("_pattern"))
    df = R.signature_score(df.select("_row.url_id", "_row.url", "_row.netloc", "_row.path", "_row", "_pattern"), known_bad, keep=("_row", "_pattern"))
    df = df.select("_row", "_pattern", F.struct("is_phishing", "risk_score", "confidence").alias("_signatures"))
    df = UF.family(df.select("_row.*", "_row", "_pattern", "_signatures"), "behaviour", keep=("_row", "_pattern", "_signatures"))
    risk = F.col("_pattern.risk_score")
    return df.select(
        "_row.*", risk.alias("risk_score"), F.col("_pattern.confidence").alias("pattern_confidence"), U.pattern_outcome(risk).alias("pattern"),
        U.signature_outcome(F.col("_signatures.is_phishing"), F.col("_signatures.risk_score")).alias("signatures"),
        F.col("_signatures.confidence").alias("signatures_confidence"), F.col("ultra_suspicious_behavior_score").alias("behaviour"))


def analysis_layers(rows: DataFrame, brands: DataFrame, reputation: DataFrame, model: Callable[[DataFrame], DataFrame], as_of: Column | None = None,
                    ttl: dict[str, int] = E.SERVICE_TTL, known_bad: DataFrame | None = None) -> DataFrame:
    """One row per routed URL with the outcome of each layer (null: no finding) and the layers' own confidences.

    ``model`` adds ``prediction, confidence`` to rows of URL parts; a pattern risk of 30 or more overrides it.
    """
    look = lookalike_hosts(rows, brands).select("host", F.col("severity").alias("lookalike"))
    near = UF.lookalike_labels(rows.select("domain_label").distinct()).select("domain_label", F.col("typosquat_very_close").alias("near"))
    df = model(scored(rows, known_bad)).join(look, "host", "left").join(near, "domain_label", "left")
    df = E.reputation_wide(df.withColumn("url_hash", R.url_hash(F.col("url"))), reputation, as_of, ttl)
    over = F.coalesce(F.col("risk_score") >= 30, F.lit(False))
    return df.select(
        "url_id", "classification", "domain_threat", domain_outcome().alias("domain"), "lookalike",
        F.when(over | (F.col("prediction") == 1), "phishing").when(F.col("prediction").isNotNull(), "legitimate").alias("model"),
        F.when(over, F.col("pattern_confidence")).otherwise(F.col("confidence")).alias("model_confidence"), "pattern",
        F.when((F.col("behaviour") >= SIGNS_HIGH) | (F.col("near") == VERY_CLOSE), "high").when(F.col("behaviour") >= SIGNS_SOME, "elevated").alias("features"),
        "signatures", "signatures_confidence", *[c.alias(n) for n, c in service_outcomes().items()])


def full_analysis(parts: DataFrame, brands: DataFrame, dns: DataFrame, whois: DataFrame, reputation: DataFrame, model: Callable[[DataFrame], DataFrame],
                  as_of: Column, ttl: dict[str, int] = E.SERVICE_TTL, known_bad: DataFrame | None = None) -> DataFrame:
    """Verdict of every URL: ``url_id, threat_level, confidence, is_phishing, verdict, reasoning, classification, domain_threat``."""
    routed = materialize(route(parts, dns, whois, as_of))
    rest = routed.where(F.col("exit_verdict").isNull()).drop("exit_verdict")
    layers = analysis_layers(rest, brands, reputation, model, as_of, ttl, known_bad)
    return U.fuse_layers(layers, keep=("classification", "domain_threat")).unionByName(early_verdicts(routed))


def threat_layers(rows: DataFrame, reputation: DataFrame, as_of: Column | None = None, ttl: dict[str, int] = E.SERVICE_TTL) -> DataFrame:
    """Long layer scores ``url_id, layer, score`` for ``fusion.weighted_threat``; ``rows`` are URL parts with ``prediction, confidence``.

    Model: its confidence in hundredths where it says phishing, else 0.  Services: the share of the services that know
    the URL and flag it.  Safe browsing: 80 if flagged.  Layers without a finding are left out, and so is their weight.
    """
    wide = E.reputation_wide(rows.withColumn("url_hash", R.url_hash(F.col("url"))), reputation, as_of, ttl)
    asked = [s for s in E.SERVICES if s != "safe_browsing"]
    count = lambda of: sum((F.coalesce(of(s).cast("int"), F.lit(0)) for s in asked), F.lit(0))
    n = count(lambda s: F.col(f"{s}_status") == "checked")
    hits = count(lambda s: (F.col(f"{s}_status") == "checked") & F.col(f"{s}_flagged"))
    layers = {
        "model": F.when(F.col("prediction") == 1, F.col("confidence") * 100).when(F.col("prediction").isNotNull(), F.lit(0.0)),
        "services": F.try_divide(hits * 100.0, n),
        "safe_browsing": F.when(F.col("safe_browsing_status") == "checked", F.when(F.col("safe_browsing_flagged"), 80.0).otherwise(0.0)),
        "indicators": R.indicator_points().cast("double")}
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), v.alias("score")) for k, v in layers.items()]))
    return wide.select("url_id", found.alias("l")).select("url_id", "l.*")
