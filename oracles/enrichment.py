"""DuckDB statements for enrichment joins."""

from __future__ import annotations

from lurewatch.plans import fixtures as fx
from lurewatch.plans.enrichment import AS_OF, EVENT_TTL, TTL
from oracles import rules as OR
from oracles.common import KNOWN, has_any, parts_cte
from lurewatch import refdata as R

DNS = "SELECT * FROM (" + fx.DNS_SQL.format(part="part").replace("array(", "list_value(") + ") dd QUALIFY row_number() OVER (PARTITION BY domain ORDER BY as_of DESC) = 1"
WHOIS = fx.WHOIS_SQL.format(part="part", orders="orders")
REP = fx.REPUTATION_SQL.format(part="part", lineitem="lineitem").replace("sha2(regexp_replace(lower(trim(url)), '/$', ''), 256)", OR.URLHASH)
KP = parts_cte(f"SELECT url_id, url FROM ({KNOWN}) k")
AGE = f"date_diff('day', CAST(created AS DATE), DATE '{AS_OF}')"
IPN = "regexp_full_match(ip, '[0-9]{1,3}([.][0-9]{1,3}){3}') AND len(list_filter(string_split(ip, '.'), lambda o: CAST(o AS INTEGER) <= 255)) = 4"
SERVICES = ["safe_browsing", "scanners", "sandbox", "community"]
FACTS = {"status": "status", "flagged": "flagged", "malicious": "CAST(malicious AS BIGINT)", "suspicious": "CAST(suspicious AS BIGINT)", "score": "CAST(score AS BIGINT)", "verified": "verified", "valid": "valid"}
ALIVE = " ".join(f"WHEN '{s}' THEN {t}" for s, t in TTL.items())
# the newest finding per URL and service that is not older than the service allows
NEWEST = f"""SELECT * FROM ({REP}) r0 WHERE status <> 'error' AND checked_at <= TIMESTAMP '{AS_OF}' AND epoch(TIMESTAMP '{AS_OF}') - epoch(checked_at) < CASE service {ALIVE} END
 QUALIFY row_number() OVER (PARTITION BY url_hash, service ORDER BY checked_at DESC, {", ".join(f"{c} DESC" for c in FACTS)}) = 1"""
PIVOT = ", ".join(f"any_value({e}) FILTER (service = '{s}') AS {s}_{c}" for s in SERVICES for c, e in FACTS.items())
PIVOTED = f"SELECT url_hash, {PIVOT} FROM ({NEWEST}) r1 GROUP BY url_hash"
EVENTS = fx.SERVICE_EVENTS_SQL.format(events="events")
EVENT_ALIVE = " ".join(f"WHEN '{s}' THEN {t}" for s, t in EVENT_TTL.items())
CLASS_CTE = f"""{parts_cte()}, {OR.GARBAGE_SQL}, dns AS ({DNS}), who AS ({WHOIS}),
d AS (SELECT g.*, garbage_score >= 50 AS gb, coalesce(has_a OR has_mx OR has_ns, false) AS ex, {AGE} AS age, {has_any('domain_label', R.ABSENT_DOMAIN_BRANDS)} AS br FROM g LEFT JOIN dns ON g.registered_domain = dns.domain LEFT JOIN who ON g.registered_domain = who.domain),
c AS (SELECT url_id, CASE WHEN NOT tld_valid THEN 'INVALID_TLD' WHEN gb AND NOT ex THEN 'RANDOM_GARBAGE_NOT_ON_INTERNET' WHEN NOT ex THEN 'NOT_ON_INTERNET' WHEN gb THEN 'EXISTS_BUT_SUSPICIOUS' ELSE 'REAL_DOMAIN_EXISTS' END AS classification,
 CASE WHEN NOT tld_valid THEN 5 WHEN gb AND NOT ex THEN 10 WHEN NOT ex AND br THEN 90 WHEN NOT ex THEN 60 WHEN gb THEN 70 WHEN age < 30 THEN 40 WHEN age < 180 THEN 20 ELSE 0 END AS threat_level,
 CASE WHEN NOT tld_valid THEN 0.0 WHEN gb AND NOT ex THEN 0.95 WHEN NOT ex THEN 0.90 WHEN gb THEN 0.75 ELSE 0.85 END AS conf FROM d)"""
CLASS = f"""WITH {CLASS_CTE}
SELECT classification, CAST(threat_level AS BIGINT) AS threat_level, count(*) AS n, round(CAST(max(conf) AS DOUBLE), 6) AS confidence FROM c GROUP BY ALL"""

ORACLES = {
    "asof_cached_verdicts": """WITH e AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id, event_type, value FROM events),
r AS (SELECT * FROM e WHERE event_type <> 'signup'), c AS (SELECT k, us AS cu, CASE WHEN value > 50 THEN 'phishing' ELSE 'clean' END AS verdict FROM e WHERE event_type = 'signup'),
j AS (SELECT event_id, us, cu, verdict FROM r ASOF LEFT JOIN c ON r.k = c.k AND r.us >= c.cu)
SELECT event_id, CASE WHEN us - cu < 86400000000 THEN verdict END AS verdict, CASE WHEN us - cu < 86400000000 THEN cu END AS checked_us, coalesce(us - cu < 86400000000, false) AS is_hit FROM j""",
    "dns_existence": f"""WITH {KP}, dns AS ({DNS}) SELECT url_id, registered_domain, coalesce(has_a, false) AS has_a, coalesce(has_mx, false) AS has_mx, coalesce(has_ns, false) AS has_ns,
 coalesce(has_a OR has_mx OR has_ns, false) AS exists_in_dns FROM p LEFT JOIN dns ON registered_domain = domain""",
    "domain_age": f"WITH {KP}, who AS ({WHOIS}) SELECT url_id, registered_domain, {AGE} AS domain_age_days, CAST(CASE WHEN {AGE} < 30 THEN 40 WHEN {AGE} < 180 THEN 20 ELSE 0 END AS BIGINT) AS age_threat FROM p LEFT JOIN who ON registered_domain = domain",
    "private_addresses": f"""WITH dns AS ({DNS}), i AS (SELECT domain, unnest(ips) AS ip FROM dns), o AS (SELECT domain, ip, list_transform(string_split(ip, '.'), lambda x: CAST(x AS INTEGER)) AS q FROM (SELECT * FROM i WHERE {IPN}) v)
SELECT domain, ip, CASE WHEN q[1] = 10 THEN '10.0.0.0' WHEN q[1] = 172 THEN '172.16.0.0' WHEN q[1] = 192 THEN '192.168.0.0' ELSE '127.0.0.0' END AS low FROM o
WHERE q[1] = 10 OR (q[1] = 172 AND q[2] BETWEEN 16 AND 31) OR (q[1] = 192 AND q[2] = 168) OR q[1] = 127""",
    "asof_service_findings": f"""WITH e AS ({EVENTS}), f AS (SELECT *, status AS st FROM e WHERE event_type IN ('signup', 'purchase') AND status <> 'error'
  QUALIFY row_number() OVER (PARTITION BY url_hash, service, checked_at ORDER BY {", ".join(f"{c} DESC" for c in FACTS)}) = 1),
a AS (SELECT url_hash, checked_at AS ts, event_id, unnest({SERVICES}) AS service FROM e WHERE event_type NOT IN ('signup', 'purchase')),
j AS (SELECT a.event_id, a.service, a.ts, f.checked_at, {", ".join(f"f.{c}" for c in FACTS)}, epoch_us(a.ts) - epoch_us(f.checked_at) < 1000000 * CAST(CASE a.service {EVENT_ALIVE} END AS BIGINT) AS ok
  FROM a ASOF LEFT JOIN f ON a.url_hash = f.url_hash AND a.service = f.service AND a.ts >= f.checked_at)
SELECT event_id, service, CASE WHEN ok THEN epoch_us(checked_at) END AS checked_us, {", ".join(f"CASE WHEN ok THEN {e} END AS {c}" for c, e in FACTS.items())} FROM j""",
    "reputation_by_service": f"WITH pv AS ({PIVOTED}) SELECT url_id, pv.* EXCLUDE (url_hash) FROM ({KNOWN}) k LEFT JOIN pv ON {OR.URLHASH} = url_hash",
    "flag_ratio": f"""WITH r AS ({REP}) SELECT url_hash, count(*) FILTER (status = 'checked') AS n_checked, count(*) FILTER (status = 'checked' AND flagged) AS n_flagged,
 round(coalesce(count(*) FILTER (status = 'checked' AND flagged) / nullif(count(*) FILTER (status = 'checked'), 0), 0.0), 6) AS flag_ratio FROM r GROUP BY url_hash""",
    "domain_classification": CLASS,
    "gated_enrichment": f"""WITH {OR.PATTERN_CTE}, dns AS ({DNS}) SELECT p.url_id, risk_score, risk_score >= 15 AS enriched, CASE WHEN risk_score >= 15 THEN coalesce(has_a OR has_mx OR has_ns, false) END AS exists_in_dns
FROM p JOIN pat ON p.url_id = pat.url_id LEFT JOIN dns ON p.registered_domain = dns.domain""",
}
