"""DuckDB statements for attack findings (brute force over brands) and the scorecard."""

from __future__ import annotations

from lurewatch import refdata as R
from lurewatch.operators.findings import TYPOS
from oracles.brands import BRANDS
from oracles.common import KNOWN, arr, lit, parts_cte
from oracles.rules import USER_TLD_FINDING, VALID_CTE

_T = R.confusables()
SRC, DST = lit("".join(c for c, _, _ in _T)), lit("".join(x for _, x, _ in _T))
NEAR = arr([k + n for k, ns in R.KEYBOARD.items() for n in ns])
LOOKS = arr([p for v in R.VISUAL_PAIRS for p in (v, v[::-1])])
LURE = "'" + "|".join(R.FINDING_KEYWORDS) + "'"
SCORE = "CASE t " + " ".join(f"WHEN '{t}' THEN CAST({s} AS DOUBLE)" for t, (s, _) in TYPOS.items()) + " END"
KIND = "CASE t " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (_, k) in TYPOS.items()) + " END"
DOTS = "CASE " + " ".join(f"WHEN contains(main, '{p}') THEN '{b}'" for p, b in R.FINDING_MISSING_DOT.items()) + " END"
REST = "replace(main, b, '')"


def _pick(cond: str) -> str:
    return f"list_filter(bl, lambda b: {cond})[1]"


ROWS = [
    (1, "strlen(dom) <> length(dom) AND odd_label", "HOMOGRAPH_ATTACK",
     r"CASE WHEN regexp_matches(main, '\p{Cyrillic}') THEN 'IDN_HOMOGRAPH_CYRILLIC' WHEN regexp_matches(main, '\p{Greek}') THEN 'IDN_HOMOGRAPH_GREEK' ELSE 'IDN_HOMOGRAPH_MIXED' END",
     "'CRITICAL'", "0.98", _pick("contains(folded, b)")),
    (2, "contains(dom, 'xn--')", "HOMOGRAPH_ATTACK", "'PUNYCODE_ATTACK'", "'CRITICAL'", "0.95", "CAST(NULL AS VARCHAR)"),
    (3, f"list_contains({arr(R.FINDING_SHORTENERS)}, replace(clean, 'www.', ''))", "URL_STRUCTURE_ABUSE", "'URL_SHORTENER_ABUSE'", "'HIGH'", "0.95", "CAST(NULL AS VARCHAR)"),
    (4, "typo_brand IS NOT NULL", "DOMAIN_MANIPULATION", "typo_type", "CASE WHEN typo_score >= 0.95 THEN 'CRITICAL' ELSE 'HIGH' END", "typo_score", "typo_brand"),
    (5, "combo IS NOT NULL", "BRAND_EXPLOITATION", "'COMBOSQUATTING'", "'HIGH'", "0.88", "combo"),
    (6, "lvl IS NOT NULL", "BRAND_EXPLOITATION", "'LEVELSQUATTING'", "'HIGH'", "0.92", "lvl"),
    (7, f"{DOTS} IS NOT NULL OR joined IS NOT NULL", "DOMAIN_MANIPULATION", "'DOPPELGANGER_DOMAIN'", "'HIGH'", f"CASE WHEN {DOTS} IS NOT NULL THEN 0.94 ELSE 0.93 END", f"coalesce({DOTS}, joined)"),
    (8, "ip IS NOT NULL", "TECHNICAL_DECEPTION", "ip", "'HIGH'", "0.90", "CAST(NULL AS VARCHAR)"),
    (9, "regexp_matches(dom, '%[0-9a-f]{2}')", "TECHNICAL_DECEPTION", "CASE WHEN regexp_matches(lower(url), '%25[0-9a-f]{2}') THEN 'DOUBLE_ENCODING' ELSE 'URL_ENCODING_ABUSE' END",
     "CASE WHEN regexp_matches(lower(url), '%25[0-9a-f]{2}') THEN 'CRITICAL' ELSE 'HIGH' END", "0.88", "CAST(NULL AS VARCHAR)"),
    (10, "regexp_matches(url, '[​‌‍⁠﻿]')", "VISUAL_DECEPTION", "'ZERO_WIDTH_CHARS'", "'CRITICAL'", "0.95", "CAST(NULL AS VARCHAR)"),
    (11, "contains(url, '‮')", "VISUAL_DECEPTION", "'RTLO_ATTACK'", "'CRITICAL'", "0.99", "CAST(NULL AS VARCHAR)"),
    (12, f"list_contains({arr(R.FINDING_TLDS)}, lst) AND stem_brand IS NOT NULL", "BRAND_EXPLOITATION", "'BRAND_TLD_SWAP'", "'HIGH'", "0.85", "stem_brand"),
    (13, "path_brand IS NOT NULL", "URL_STRUCTURE_ABUSE", "'PATH_MANIPULATION'", "'MEDIUM'", "0.80", "path_brand"),
]


def findings_cte(source: str | None = None) -> str:
    pre = f"{VALID_CTE},\n" + parts_cte("SELECT url_id, fixed_url AS url FROM v5") if source is None else parts_cte(source)
    union = "\nUNION ALL ".join(
        f"SELECT url_id, {no}::BIGINT AS check_no, '{cat}' AS category, {kind} AS attack_type, {sev} AS severity, CAST({conf} AS DOUBLE) AS confidence, {brand} AS brand FROM a WHERE {cond}"
        for no, cond, cat, kind, sev, conf, brand in ROWS)
    return f"""{pre},
brand AS (SELECT brand FROM ({BRANDS}) bb WHERE length(brand) >= 4),
bl AS (SELECT list(brand ORDER BY length(brand) DESC, brand) AS bl FROM brand),
b0 AS (SELECT url_id, url, registered_domain, lower(netloc) AS dom, lower(path) AS pa, regexp_replace(regexp_replace(lower(netloc), '^www\\.', ''), ':[0-9]+$', '') AS clean FROM p),
b1 AS (SELECT *, string_split(clean, '.') AS cs, string_split(clean, '.')[1] AS main, translate(clean, {SRC}, {DST}) AS folded, regexp_replace(dom, ':[0-9]+$', '') AS ho, string_split(dom, '.') AS ds FROM b0),
b2 AS (SELECT b1.*, bl, length(main) <> length(translate(main, {SRC}, repeat(chr(1), length({SRC})))) OR main <> translate(main, {SRC}, {DST}) AS odd_label, cs[len(cs)] AS lst, CASE WHEN len(cs) >= 2 THEN array_to_string(cs[1:len(cs) - 1], '.') END AS stem,
  CASE WHEN len(ds) >= 3 THEN ds[1:len(ds) - 2] ELSE [] END AS subs,
  CASE WHEN regexp_matches(ho, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}$') THEN 'IP_ADDRESS_URL' WHEN regexp_matches(ho, '^0x[0-9a-f]+(\\.0x[0-9a-f]+){{3}}$') THEN 'HEX_IP_ADDRESS'
    WHEN regexp_matches(ho, '^0[0-7]+(\\.0[0-7]+){{3}}$') THEN 'OCTAL_IP_ADDRESS' WHEN regexp_matches(ho, '^[0-9]{{8,10}}$') THEN 'IP_ADDRESS_URL' END AS ip FROM b1, bl),
tp AS (SELECT l, brand AS b, CASE WHEN length(l) = length(brand) THEN list_filter(range(1, length(brand) + 1), lambda i: substr(l, i, 1) <> substr(brand, i, 1)) END AS df
  FROM (SELECT DISTINCT main AS l FROM b2 WHERE main <> '') ml CROSS JOIN brand WHERE l NOT IN (SELECT brand FROM brand)),
tt AS (SELECT l, b, CASE
  WHEN length(l) = length(b) - 1 AND len(list_filter(range(1, length(b) + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = l)) > 0 THEN 'omission'
  WHEN length(l) = length(b) + 1 AND len(list_filter(range(1, length(l) + 1), lambda i: substr(l, 1, i - 1) || substr(l, i + 1) = b)) > 0 THEN 'insertion'
  WHEN len(df) = 2 AND df[2] = df[1] + 1 AND substr(l, df[1], 1) = substr(b, df[2], 1) AND substr(l, df[2], 1) = substr(b, df[1], 1) THEN 'transposition'
  WHEN len(df) = 1 AND list_contains({NEAR}, substr(b, df[1], 1) || substr(l, df[1], 1)) THEN 'keyboard'
  WHEN len(df) = 1 AND list_contains({LOOKS}, substr(b, df[1], 1) || substr(l, df[1], 1)) THEN 'visual'
  WHEN len(df) = 1 AND bit_count(xor(unicode(substr(l, df[1], 1)), unicode(substr(b, df[1], 1)))) = 1 AND regexp_matches(substr(l, df[1], 1), '^[\\p{{L}}\\p{{N}}]$') AND regexp_matches(substr(b, df[1], 1), '^[\\p{{L}}\\p{{N}}]$') THEN 'bitsquat'
  WHEN len(df) = 1 THEN 'substitution' END AS t FROM tp),
ty AS (SELECT l, b AS typo_brand, {SCORE} AS typo_score, {KIND} AS typo_type FROM tt WHERE t IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l ORDER BY {SCORE} DESC, length(b) DESC, b, {KIND}) = 1),
a AS (SELECT b2.*, typo_brand, typo_score, typo_type,
  {_pick(f"contains(main, b) AND main <> b AND registered_domain <> b || '.com' AND (regexp_matches({REST}, {LURE}) OR regexp_matches(pa, {LURE}) OR contains(main, '-') OR length({REST}) > 2)")} AS combo,
  {_pick("list_contains(subs, b)")} AS lvl, {_pick("main IN (b || 'com', b || 'net', b || 'org', b || 'co')")} AS joined, {_pick("contains(stem, b)")} AS stem_brand,
  {_pick("contains(pa, b) AND NOT contains(clean, b)")} AS path_brand FROM b2 LEFT JOIN ty ON main = l),
f AS ({union})"""


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
BEST = f"best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY {RANK} DESC, confidence DESC, check_no) = 1)"
ORACLES = {
    "attack_findings": f"WITH {findings_cte()} SELECT * FROM f",
    "strongest_finding": f"WITH {findings_cte()}, {BEST} SELECT * FROM best",
    "classified_urls": f"""WITH {findings_cte()}, {BEST} SELECT p.url_id, best.url_id IS NOT NULL AS is_attack, coalesce(category, 'LEGITIMATE') AS category, coalesce(attack_type, 'LEGITIMATE') AS attack_type,
 coalesce(severity, 'NONE') AS severity, coalesce(confidence, 0.9) AS confidence, brand FROM p LEFT JOIN best ON p.url_id = best.url_id""",
    "attack_scorecard": f"""WITH {findings_cte(KNOWN)},
c AS (SELECT url_id, technique_id > 0 AS expected, CASE WHEN technique_id = 0 THEN 'legitimate' WHEN technique_id <= 4 THEN 'typo' WHEN technique_id <= 7 THEN 'brand_name' WHEN technique_id = 8 THEN 'ip' WHEN technique_id = 9 THEN 'shortener' WHEN technique_id = 10 THEN 'path' ELSE 'missing_dot' END AS category,
  url_id IN (SELECT url_id FROM f) AS detected FROM ({KNOWN}) k)
SELECT category, count(*) FILTER (detected = expected) AS passed, count(*) FILTER (detected <> expected) AS failed, round(100.0 * count(*) FILTER (detected = expected) / count(*), 6) AS pass_percent,
 round(coalesce(count(*) FILTER (expected AND detected) / nullif(count(*) FILTER (expected), 0), 0.0), 6) AS detection_rate,
 round(coalesce(count(*) FILTER (NOT expected AND detected) / nullif(count(*) FILTER (NOT expected), 0), 0.0), 6) AS false_positive_rate FROM c GROUP BY category""",
}

# a user's keyboard, TLDs, shorteners and least brand lengths
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_USER_NEAR = arr([a + b for a, b in zip(_LETTERS, _LETTERS[1:])] + [b + a for a, b in zip(_LETTERS, _LETTERS[1:])])
_USER = findings_cte().replace(NEAR, _USER_NEAR).replace(arr(R.FINDING_TLDS), USER_TLD_FINDING).replace(
    f"list_contains({arr(R.FINDING_SHORTENERS)}, replace(clean, 'www.', ''))", f"replace(clean, 'www.', '') IN (SELECT brand || '.com' FROM ({BRANDS}) sb WHERE length(brand) % 4 = 0)").replace(
    "length(brand) >= 4)", "length(brand) >= CASE WHEN ascii(brand) % 2 = 0 THEN 8 ELSE 5 END)")
ORACLES["attack_findings_user_tables"] = f"WITH {_USER} SELECT * FROM f"
