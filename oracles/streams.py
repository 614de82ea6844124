"""DuckDB statements for the streaming results."""

from __future__ import annotations

from oracles.corpus import FEEDS, NORM
from oracles.evaluation import LOG
from oracles import ultra as UL
from oracles.common import CORPUS
from oracles.rules import BEH, PATTERN_CTE, SIGNATURE_CTE, URLHASH

COUNTERS = f"""WITH l AS ({LOG}), g AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS s, count(*) AS total, count(*) FILTER (error IS NULL AND NOT is_phishing) AS safe, count(*) FILTER (error IS NULL AND is_phishing) AS phishing,
 count(*) FILTER (error IS NULL AND is_phishing IS NULL) AS questionable FROM l GROUP BY s)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, total, safe, phishing, questionable, round(phishing / total, 6) AS detection_rate FROM g"""
AUDIT = """WITH g AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS s, event_type, count(*) AS n_requests FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n_requests FROM g WHERE n_requests > 20"""
SUPPRESS = """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
k AS (SELECT key, min(sec) AS sec FROM e GROUP BY key
  UNION ALL SELECT k.key, (SELECT min(e.sec) FROM e WHERE e.key = k.key AND e.sec >= k.sec + 86400) AS sec FROM k WHERE k.sec IS NOT NULL)
SELECT key, sec FROM k WHERE sec IS NOT NULL"""
PER_USER = """WITH g AS (SELECT time_bucket(INTERVAL 60 SECONDS, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) // 8640 * 1000000)) AS s, user_id, count(*) AS n_requests FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, user_id, n_requests FROM g WHERE n_requests > {}"""
# the known hashes of the first batch (even ids) and of the second (odd ids)
KNOWN = f"CASE WHEN (url_id % 2 = 0 AND {URLHASH} IN (SELECT h FROM bad)) OR (url_id % 2 = 1 AND {URLHASH} IN (SELECT {URLHASH} FROM ({CORPUS}) c3 WHERE url_id % 3 = 0)) THEN 100 ELSE"
VERSIONED = SIGNATURE_CTE.replace(f"CASE WHEN {URLHASH} IN (SELECT h FROM bad) THEN 100 ELSE", KNOWN)
ORACLES = {
    "stream_scored_with_snapshots": f"""WITH a AS (WITH {PATTERN_CTE} SELECT url_id, risk_score FROM pat), b AS (WITH {VERSIONED} SELECT url_id, risk_score AS s, is_phishing FROM sig),
c AS (WITH {UL.LOW} SELECT url_id, CAST(({BEH}) AS BIGINT) AS behaviour FROM q)
SELECT url_id, risk_score, CASE WHEN risk_score >= 50 THEN 'extreme' WHEN risk_score >= 30 THEN 'high' WHEN risk_score >= 15 THEN 'suspicious' END AS pattern,
 CASE WHEN is_phishing THEN 'phishing' WHEN is_phishing IS NULL THEN 'unclear' WHEN s >= 20 THEN 'minor' END AS signatures, behaviour, CASE WHEN url_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS known_bad_version
FROM a JOIN b USING (url_id) JOIN c USING (url_id)""",
    "rate_audit_per_user": PER_USER.format(10), "stream_rate_audit_per_user": PER_USER.format(20),
    "stream_ingest_new_urls": f"WITH {FEEDS} SELECT {NORM} AS url_normalized, 1::BIGINT AS n FROM a GROUP BY 1",
    "stream_scored_urls": f"WITH {PATTERN_CTE} SELECT url_id, risk_score, verdict FROM pat",
    "scan_counters": COUNTERS, "stream_scan_counters": COUNTERS, "rate_audit": AUDIT, "stream_rate_audit": AUDIT,
    "suppressed_checks": SUPPRESS, "stream_suppressed_checks": SUPPRESS,
}
