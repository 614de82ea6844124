"""DuckDB statements for evaluation tables, splits, votes and fusion."""

from __future__ import annotations

from lurewatch.operators.fusion import EVIDENCE, LAYER_WEIGHTS, LAYERS
from lurewatch.plans import fixtures as fx
from lurewatch.plans.evaluation import FEATURES
from oracles import brands as OB
from oracles import enrichment as OE
from oracles import ultra as UL
from oracles import rules as OR
from oracles.common import CORPUS, KNOWN, parts_cte
from oracles.features import ADVANCED, LEXICAL, PATTERNS, STATISTICAL, STRUCTURAL
from oracles.features import ORACLES as FEATURE_TABLES

BASE_TABLE = FEATURE_TABLES["base_feature_table"]
BASE_FEATURES = [*LEXICAL, *STRUCTURAL, *ADVANCED, *STATISTICAL, *PATTERNS, "brand_impersonation_score", "likely_brand_impersonation", "brand_in_subdomain",
                 "brand_with_hyphens", "punycode_length_diff", "idn_homograph_score", "is_idn_homograph", "punycode_brand_similarity"]

T = {"labels": "labels", "documents": "documents", "events": "events"}
S, V, LOG = fx.SCORED_SQL.format(**T), fx.VOTES_SQL.format(**T), fx.SCAN_LOG_SQL.format(**T)
CM = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn"


def dv(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 6)"


METRICS = f"{dv('tp + tn', 'n')} AS accuracy, {dv('tp', 'tp + fp')} AS precision, {dv('tp', 'tp + fn')} AS recall, {dv('2 * tp', '2 * tp + fp + fn')} AS f1"
CURVE = f"""s AS ({S}), g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g)"""
FEAT = f"""{parts_cte(f'SELECT url_id, url, CAST(technique_id > 0 AS INTEGER) AS label FROM ({KNOWN}) k')},
fe AS (SELECT url_id, label, {", ".join(f"CAST({LEXICAL[f][1]} AS DOUBLE) AS {f}" for f in FEATURES)} FROM p)"""
CORR = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, label), 6) + 0.0 AS r FROM fe" for f in FEATURES)
MODELS = f"""v AS (SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM ({V}) x), m AS (SELECT model, count(*) AS n, {CM}, avg(probability) AS tt FROM v GROUP BY model),
mm AS (SELECT model, {METRICS}, (tp + tn) / n AS acc, round(tt, 6) AS training_time, tt FROM m)"""
HIST = ["url_length", "domain_length", "dot_count", "digit_count"]
PREFIX = "substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8)"


def th(x: float) -> str:
    return f"'{int(round(x * 0xFFFFFFFF)):08x}'"


FOLD = "(" + " + ".join(f"CAST({PREFIX.format(k='doc_id')} >= {th(i / 5)} AS BIGINT)" for i in range(1, 5)) + ")"
EV = ", ".join(f"('{a}', '{b}', {p}, CAST({'NULL' if c is None else c} AS DOUBLE), {LAYERS.index(a) + 1})" for (a, b), (p, c) in EVIDENCE.items())
PATTERN_ONLY, SIGNATURE_ONLY = OR.PATTERN_CTE, OR.SIGNATURE_CTE.replace("CASE WHEN " + OR.URLHASH + " IN (SELECT h FROM bad) THEN 100 ELSE", "CASE WHEN false THEN 100 ELSE")
EVIDENCE_CTE = f"""pt AS (WITH {PATTERN_ONLY} SELECT url_id, 'pattern' AS layer, CASE WHEN risk_score >= 50 THEN 'extreme' WHEN risk_score >= 30 THEN 'high' WHEN risk_score >= 15 THEN 'suspicious' END AS outcome, CAST(NULL AS DOUBLE) AS own FROM pat),
sg AS (WITH {SIGNATURE_ONLY} SELECT url_id, 'signatures' AS layer, CASE WHEN is_phishing THEN 'phishing' WHEN is_phishing IS NULL THEN 'unclear' WHEN risk_score >= 20 THEN 'minor' END AS outcome, confidence AS own FROM sig),
lk AS (WITH {OB.hosts_cte()} SELECT url_id, 'lookalike' AS layer, {OB.SEVERITY} AS outcome, CAST(NULL AS DOUBLE) AS own FROM p JOIN look USING (host) WHERE look.brand IS NOT NULL),
ev(layer, outcome, points, conf, pos) AS (VALUES {EV}),
e AS (SELECT url_id, layer, outcome, points, coalesce(conf, own) AS conf, pos FROM (SELECT * FROM pt UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM lk) u JOIN ev USING (layer, outcome)),
fused AS (SELECT url_id, sum(points) AS s, avg(conf) AS c, string_agg(layer || ':' || outcome, '|' ORDER BY pos) AS reasoning FROM e GROUP BY url_id)"""

FUSED_ROWS = f"""SELECT url_id, CAST(least(coalesce(s, 0), 100) AS BIGINT) AS threat_level, round(coalesce(c, 0.5), 6) AS confidence, CASE WHEN s >= 25 THEN true WHEN s >= 15 THEN NULL ELSE false END AS is_phishing,
 CASE WHEN s >= 60 THEN 'PHISHING_DETECTED' WHEN s >= 40 THEN 'LIKELY_PHISHING' WHEN s >= 25 THEN 'SUSPICIOUS' WHEN s >= 15 THEN 'QUESTIONABLE' ELSE 'APPEARS_SAFE' END AS verdict,
 coalesce(reasoning, '') AS reasoning FROM (SELECT url_id FROM ({CORPUS}) ac) au LEFT JOIN fused USING (url_id)"""

EXIT = "classification IN ('INVALID_SYNTAX', 'RANDOM_GARBAGE_NOT_ON_INTERNET')"
ASKED = ["scanners", "sandbox", "community"]
ROUTED = f"""vd AS (WITH {OR.VALID_CTE} SELECT url_id, issues = '' AS ok FROM v5),
rt AS (WITH {OE.CLASS_CTE} SELECT url_id, CASE WHEN ok THEN classification ELSE 'INVALID_SYNTAX' END AS classification, CASE WHEN ok THEN CAST(threat_level AS BIGINT) ELSE 0 END AS domain_threat FROM c JOIN vd USING (url_id))"""
FOUND = f"rp AS (SELECT c.url_id, v.* FROM (SELECT url_id, {OR.URLHASH} AS h FROM ({CORPUS}) c0) c JOIN ({OE.PIVOTED}) v ON c.h = v.url_hash)"

ORACLES = {
    "confusion_matrix": f"WITH s AS ({S}) SELECT CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, count(*) AS n FROM s GROUP BY ALL",
    "class_metrics": f"WITH s AS ({S}), m AS (SELECT count(*) AS n, {CM} FROM s) SELECT n, tp, fp, fn, tn, {METRICS} FROM m",
    "class_report": f"""WITH s AS ({S}), m AS (SELECT {CM} FROM s), r AS (SELECT 1 AS class, tp AS hit, fp AS over, fn AS miss FROM m UNION ALL SELECT 0, tn, fn, fp FROM m)
SELECT class::BIGINT AS class, {dv('hit', 'hit + over')} AS precision, {dv('hit', 'hit + miss')} AS recall, {dv('2 * hit', '2 * hit + over + miss')} AS f1, hit + miss AS support FROM r""",
    "false_predictions": f"WITH s AS ({S}) SELECT doc_id, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM s WHERE label <> prediction",
    "roc_auc": f"""WITH s AS ({S}), r AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS rk FROM s),
a AS (SELECT sum(rk) FILTER (label = 1) AS sr, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r) SELECT round((sr - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM a""",
    "roc_curve": f"WITH {CURVE} SELECT round(score, 6) AS threshold, {dv('fp', 'nn')} AS fpr, {dv('tp', 'np')} AS tpr FROM c",
    "precision_recall_curve": f"WITH {CURVE} SELECT round(score, 6) AS threshold, {dv('tp', 'tp + fp')} AS precision, {dv('tp', 'np')} AS recall FROM c",
    "average_precision": f"WITH {CURVE} SELECT round(sum(CAST(pos AS DOUBLE) / np * tp / (tp + fp)), 6) AS average_precision FROM c",
    "feature_label_correlation": f"WITH {FEAT} {CORR}",
    "top_correlated_features": f"WITH {FEAT}, c AS ({CORR}) SELECT * FROM c ORDER BY abs(r) DESC, feature LIMIT 10",
    "feature_correlation_matrix": f"WITH {FEAT} " + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) + 0.0 AS r FROM fe" for a in FEATURES for b in FEATURES),
    "pairwise_correlation": f"WITH {FEAT}, ga AS (SELECT {', '.join(f'CASE WHEN url_id % {i + 3} <> 0 THEN {f} END AS {f}' for i, f in enumerate(FEATURES[:6]))} FROM fe) "
    + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, CASE WHEN isfinite(corr({a}, {b})) THEN round(corr({a}, {b}), 6) + 0.0 END AS r FROM ga" for a in FEATURES[:6] for b in FEATURES[:6]),
    "class_histograms": f"""WITH {FEAT}, l AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, label, {f} AS x FROM fe" for f in HIST)}), r AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature)
SELECT feature, CAST(label AS BIGINT) AS label, CAST(CASE WHEN hi > lo THEN least(29, floor((x - lo) / (hi - lo) * 30)) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM l JOIN r USING (feature) GROUP BY ALL""",
    "standardised_features": f"WITH fe AS (SELECT * FROM ({BASE_TABLE}) bt WHERE url_id BETWEEN 1000000000 AND 1999999999) " + " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS i, round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 6) AS std FROM (
          SELECT CASE WHEN min({f}) OVER () < max({f}) OVER () THEN ({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () ELSE 0.0::DOUBLE END AS z FROM fe) z{i}""" for i, f in enumerate(BASE_FEATURES)),
    "model_comparison": f"WITH {MODELS} SELECT model, accuracy, precision, recall, f1, training_time FROM mm",
    "best_model": f"WITH {MODELS} SELECT (SELECT model FROM mm ORDER BY acc DESC, model LIMIT 1) AS most_accurate, (SELECT model FROM mm ORDER BY tt, model LIMIT 1) AS fastest",
    "batch_summary": f"WITH l AS ({LOG}) SELECT count(*) AS total, count(*) FILTER (error IS NULL AND is_phishing) AS phishing, count(*) FILTER (error IS NULL AND NOT is_phishing) AS safe, count(*) FILTER (error IS NULL AND is_phishing IS NULL) AS unclear, count(*) FILTER (error IS NOT NULL) AS error FROM l",
    "train_test_split": f"SELECT url_id, {PREFIX.format(k='url')} < {th(0.8)} AS is_train FROM ({CORPUS}) c",
    "fold_assignment": f"WITH s AS ({S}) SELECT {FOLD} AS fold, CAST(label AS BIGINT) AS label, count(*) AS n FROM s GROUP BY ALL",
    "fold_accuracy": f"WITH s AS ({S}), a AS (SELECT {FOLD} AS fold, avg(CAST(label = prediction AS INTEGER)) AS a FROM s GROUP BY fold) SELECT count(*) AS folds, round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy FROM a",
    "selected_features": f"WITH {FEAT} SELECT url_id, 0.0::DOUBLE AS vendor_score, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM fe",
    "majority_vote": f"""WITH v AS ({V}), g AS (SELECT doc_id, count(*) FILTER (probability >= 0.5) AS v, count(*) AS n, max(probability) AS mx, avg(probability) AS m FROM v GROUP BY doc_id)
SELECT doc_id, CAST(v * 2 > n AS BIGINT) AS prediction, v AS n_votes, round(mx, 6) AS max_probability, round(CASE WHEN v * 2 > n THEN m ELSE 1 - m END, 6) AS winner_mean FROM g""",
    "pattern_override": f"""WITH {PATTERN_ONLY}, m AS (SELECT url_id, round(CAST(length(regexp_replace(url, '[^0-9]', '', 'g')) AS DOUBLE) / length(url), 6) AS c FROM p)
SELECT url_id, CASE WHEN risk_score >= 30 THEN 1 ELSE CAST(c >= 0.3 AS BIGINT) END AS prediction, CASE WHEN risk_score >= 30 THEN confidence ELSE c END AS confidence, risk_score >= 30 AS overridden FROM m JOIN pat USING (url_id)""",
    "fused_verdicts": f"WITH {EVIDENCE_CTE} {FUSED_ROWS}",
    "verdict_report": f"SELECT *, CAST(CASE WHEN reasoning = '' THEN 0 ELSE len(string_split(reasoning, '|')) END AS BIGINT) AS n_reasons FROM (WITH {EVIDENCE_CTE} {FUSED_ROWS}) f",
    "full_analysis": f"""WITH {EVIDENCE_CTE.split("ev(layer")[0].rstrip().rstrip(",").replace(SIGNATURE_ONLY, OR.SIGNATURE_CTE)},
md AS (WITH {PATTERN_ONLY}, m AS (SELECT url_id, CAST(length(regexp_replace(url, '[^0-9]', '', 'g')) * 100 // length(url) AS DOUBLE) / 100 AS c FROM p)
  SELECT url_id, 'model' AS layer, CASE WHEN risk_score >= 30 OR c >= 0.3 THEN 'phishing' ELSE 'legitimate' END AS outcome, CASE WHEN risk_score >= 30 THEN confidence ELSE c END AS own FROM m JOIN pat USING (url_id)),
{ROUTED},
dm AS (SELECT url_id, 'domain' AS layer, CASE classification WHEN 'NOT_ON_INTERNET' THEN CASE WHEN domain_threat >= 80 THEN 'absent_brand' ELSE 'absent' END
  WHEN 'EXISTS_BUT_SUSPICIOUS' THEN 'exists_suspicious' WHEN 'REAL_DOMAIN_EXISTS' THEN 'exists' END AS outcome, CAST(NULL AS DOUBLE) AS own FROM rt),
ft AS (WITH {UL.LOW} SELECT url_id, 'features' AS layer, CASE WHEN ({OR.BEH}) >= 4 OR {UL.MIN} BETWEEN 1 AND 2 THEN 'high' WHEN ({OR.BEH}) >= 3 THEN 'elevated' END AS outcome, CAST(NULL AS DOUBLE) AS own FROM q),
{FOUND},
rs AS (SELECT url_id, 'community' AS layer, CASE WHEN community_status = 'checked' AND community_flagged THEN CASE WHEN community_verified OR community_valid THEN 'confirmed' ELSE 'listed' END END AS outcome, CAST(NULL AS DOUBLE) AS own FROM rp
  UNION ALL SELECT url_id, 'safe_browsing', CASE WHEN safe_browsing_status = 'checked' THEN CASE WHEN safe_browsing_flagged THEN 'threat' ELSE 'clean' END END, NULL FROM rp
  UNION ALL SELECT url_id, 'scanners', CASE WHEN scanners_status = 'checked' THEN CASE WHEN scanners_malicious >= 5 THEN 'many' WHEN scanners_malicious >= 2 THEN 'several' WHEN scanners_malicious >= 1 OR scanners_suspicious >= 3 THEN 'some' ELSE 'clean' END END, NULL FROM rp
  UNION ALL SELECT url_id, 'sandbox', CASE WHEN sandbox_status = 'checked' THEN CASE WHEN sandbox_flagged THEN 'malicious' WHEN sandbox_score >= 50 THEN 'high_score' END END, NULL FROM rp),
ev(layer, outcome, points, conf, pos) AS (VALUES {EV}),
e AS (SELECT url_id, layer, outcome, points, coalesce(conf, own) AS conf, pos FROM (SELECT * FROM pt UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM lk UNION ALL SELECT * FROM md UNION ALL SELECT * FROM dm UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM rs) u JOIN ev USING (layer, outcome)),
fused AS (SELECT url_id, sum(points) AS s, avg(conf) AS c, string_agg(layer || ':' || outcome, '|' ORDER BY pos) AS reasoning FROM e GROUP BY url_id), fr AS ({FUSED_ROWS})
SELECT url_id, CASE classification WHEN 'INVALID_SYNTAX' THEN 0 WHEN 'RANDOM_GARBAGE_NOT_ON_INTERNET' THEN 5 ELSE threat_level END::BIGINT AS threat_level,
 CASE classification WHEN 'INVALID_SYNTAX' THEN 1.0 WHEN 'RANDOM_GARBAGE_NOT_ON_INTERNET' THEN 0.95 ELSE confidence END AS confidence,
 CASE WHEN {EXIT} THEN false ELSE is_phishing END AS is_phishing,
 CASE classification WHEN 'INVALID_SYNTAX' THEN 'INVALID_URL' WHEN 'RANDOM_GARBAGE_NOT_ON_INTERNET' THEN 'RANDOM_GARBAGE' ELSE verdict END AS verdict,
 CASE WHEN {EXIT} THEN '' ELSE reasoning END AS reasoning, classification, domain_threat FROM fr JOIN rt USING (url_id)""",
    "weighted_threat_score": f"""WITH {parts_cte()}, {FOUND}, w(layer, w) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in LAYER_WEIGHTS.items())}),
pm AS (SELECT *, CAST(length(regexp_replace(url, '[^0-9]', '', 'g')) * 100 // length(url) AS DOUBLE) / 100 AS c FROM p),
sv AS (SELECT url_id, {" + ".join(f"coalesce(CAST({s}_status = 'checked' AS INTEGER), 0)" for s in ASKED)} AS n, {" + ".join(f"coalesce(CAST({s}_status = 'checked' AND {s}_flagged AS INTEGER), 0)" for s in ASKED)} AS hits, safe_browsing_status, safe_browsing_flagged FROM rp),
l AS (SELECT url_id, 'indicators' AS layer, CAST({OR.points(*[(c, x) for c, x, _ in OR.IND])} AS DOUBLE) AS score FROM p UNION ALL SELECT url_id, 'model', CASE WHEN c >= 0.3 THEN c * 100 ELSE 0 END FROM pm
  UNION ALL SELECT url_id, 'services', hits * 100.0 / n FROM sv WHERE n > 0 UNION ALL SELECT url_id, 'safe_browsing', CASE WHEN safe_browsing_flagged THEN 80.0 ELSE 0.0 END FROM sv WHERE safe_browsing_status = 'checked'),
g AS (SELECT url_id, sum(w * score) / sum(w) AS t, sum(w) AS w FROM l JOIN w USING (layer) GROUP BY url_id)
SELECT url_id, round(round(t, 6), 1) AS threat_score, CAST(least(w / 10, 1.0) AS DOUBLE) AS confidence, CASE WHEN round(t, 6) >= 70 THEN 'dangerous' WHEN round(t, 6) >= 50 THEN 'suspicious' WHEN round(t, 6) >= 30 THEN 'questionable' WHEN round(t, 6) >= 10 THEN 'low_risk' ELSE 'safe' END AS verdict FROM g""",
    "pair_comparison": f"""WITH {PATTERN_ONLY}, pr AS (SELECT url_id AS left_id, url_id + 1 AS right_id FROM corpus WHERE url_id % 2 = 0)
SELECT left_id, right_id, a.risk_score AS left_risk, a.verdict AS left_verdict, b.risk_score AS right_risk, b.verdict AS right_verdict,
 CASE WHEN a.risk_score < b.risk_score THEN 'left' WHEN b.risk_score < a.risk_score THEN 'right' ELSE 'same' END AS safer FROM pr JOIN pat a ON a.url_id = left_id JOIN pat b ON b.url_id = right_id""",
}
