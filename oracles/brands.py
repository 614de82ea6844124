"""DuckDB statements for brand look-alikes (brute force over all label/brand pairs)."""

from __future__ import annotations

from lurewatch import refdata as R
from lurewatch.operators.brands import SCORES
from oracles.common import BRANDS, KNOWN, has_any, lit, parts_cte

RULES = [(s, d) for s, ds in R.HOMOPHONES.items() for d in ds.split()]
HOMOPHONE = " OR ".join(f"(contains(b, '{s}') AND replace(b, '{s}', '{d}') = l)" for s, d in RULES)
# DuckDB's edit and Jaro functions compare bytes: stand in one ASCII character for each non-ASCII one
FLAT = r"regexp_replace(l, '[^\x00-\x7f]', '#', 'g')"


def matches_cte(source: str | None = None) -> str:
    base = parts_cte() if source is None else parts_cte(source)
    return f"""{base},
brand AS ({BRANDS}),
labels AS (SELECT DISTINCT host_label AS l FROM p WHERE NOT is_ip AND host_label <> '' AND n_labels >= 2),
pairs AS (SELECT l, brand AS b FROM labels CROSS JOIN brand WHERE l NOT IN (SELECT brand FROM brand)),
d AS (SELECT l, b, CASE WHEN length(l) = length(b) THEN list_filter(range(1, length(b) + 1), lambda i: substr(l, i, 1) <> substr(b, i, 1)) END AS df FROM pairs),
t AS (SELECT l, b, list_filter([
  CASE WHEN length(l) = length(b) - 1 AND len(list_filter(range(1, length(b) + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = l)) > 0 THEN 'omission' END,
  CASE WHEN length(l) = length(b) + 1 AND len(list_filter(range(1, length(l) + 1), lambda i: substr(l, 1, i - 1) || substr(l, i + 1) = b)) > 0 THEN 'insertion' END,
  CASE WHEN len(df) = 1 THEN 'substitution' END,
  CASE WHEN len(df) = 2 AND df[2] = df[1] + 1 AND substr(l, df[1], 1) = substr(b, df[2], 1) AND substr(l, df[2], 1) = substr(b, df[1], 1) THEN 'transposition' END,
  CASE WHEN {HOMOPHONE} THEN 'homophone' END,
  CASE WHEN contains(l, b) AND {has_any("replace(l, b, '')", R.COMBO_KEYWORDS)} THEN 'combosquatting' END,
  CASE WHEN len(df) = 1 AND bit_count(xor(unicode(substr(l, df[1], 1)), unicode(substr(b, df[1], 1)))) = 1
       AND regexp_matches(substr(l, df[1], 1), '^[\\p{{L}}\\p{{N}}-]$') THEN 'bitsquatting' END], lambda x: x IS NOT NULL) AS ts FROM d),
sc(technique, score) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SCORES.items())}),
tech AS (SELECT l AS label, b AS brand, arg_max(technique, score) AS technique, max(score) AS score
  FROM (SELECT l, b, unnest(ts) AS technique FROM t) u JOIN sc USING (technique) GROUP BY l, b),
sim AS (SELECT l AS label, b AS brand, 'high_similarity' AS technique, 0.75 * jaro_winkler_similarity({FLAT}, b) AS score FROM t
  WHERE len(ts) = 0 AND levenshtein({FLAT}, b) > 2 AND jaro_winkler_similarity({FLAT}, b) > 0.9 AND 0.75 * jaro_winkler_similarity({FLAT}, b) >= 0.70),
every AS (SELECT * FROM tech UNION ALL SELECT * FROM sim),
best AS (SELECT label, brand, technique, score FROM every QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, brand) = 1)"""


_T = R.confusables()
_SRC, _DST = "".join(c for c, _, _ in _T), "".join(x for _, x, _ in _T)


def hosts_cte(source: str | None = None) -> str:
    return f"""{matches_cte(source)},
hosts AS (SELECT DISTINCT host, host_label AS label FROM p WHERE NOT is_ip AND host_label <> '' AND n_labels >= 2),
homo AS (SELECT host, min(brand) AS h_brand FROM (SELECT host, translate(host, {lit(_SRC)}, {lit(_DST)}) AS folded FROM hosts WHERE strlen(host) <> length(host)) f
  JOIN brand ON contains(folded, brand) AND NOT contains(host, brand) GROUP BY host),
look AS (SELECT host, label, coalesce(h_brand, brand) AS brand, CASE WHEN h_brand IS NOT NULL THEN 'idn_homograph' ELSE technique END AS technique,
  CASE WHEN h_brand IS NOT NULL THEN 0.98 ELSE score END AS score FROM hosts LEFT JOIN best USING (label) LEFT JOIN homo USING (host))"""


SEVERITY = "CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.85 THEN 'high' ELSE 'medium' END"
NEAR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.VARIANT_KEYBOARD.items()) + "}"
LOOK = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.VARIANT_LOOKALIKE.items()) + "}"
VARIANTS = f"""pos AS (SELECT brand AS b, unnest(range(1, length(brand) + 1)) AS i FROM brand),
raw AS (SELECT b, 1 AS kind, i, substr(b, 1, i - 1) || substr(b, i + 1) AS v FROM pos
  UNION ALL SELECT b, 2, i, substr(b, 1, i - 1) || unnest(string_split({NEAR}[substr(b, i, 1)], '')) || substr(b, i + 1) FROM pos WHERE {NEAR}[substr(b, i, 1)] IS NOT NULL
  UNION ALL SELECT b, 3, i, substr(b, 1, i) || substr(b, i) FROM pos
  UNION ALL SELECT b, 4, i, substr(b, 1, i - 1) || substr(b, i + 1, 1) || substr(b, i, 1) || substr(b, i + 2) FROM pos WHERE i < length(b)
  UNION ALL SELECT b, 5, i, substr(b, 1, i - 1) || {LOOK}[substr(b, i, 1)] || substr(b, i + 1) FROM pos WHERE {LOOK}[substr(b, i, 1)] IS NOT NULL),
firsts AS (SELECT b, v, kind, i FROM raw WHERE v <> b QUALIFY row_number() OVER (PARTITION BY b, v ORDER BY kind, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY kind, i, v) AS rn FROM firsts),
names AS (SELECT b AS brand, ['omission', 'keyboard', 'doubling', 'swap', 'lookalike'][kind] AS kind, i AS position, v AS variant, rn FROM ranked)"""
OCC = f"SELECT url, min(url_id) AS url_id, count(*) AS n_seen FROM (SELECT k.* FROM lineitem l JOIN ({KNOWN}) k ON l.l_partkey = k.url_id) o GROUP BY url"
# letters ordered as in the pruning step are irrelevant here: pairs come from the full cross product
ORACLES = {
    "brand_edit_matches": f"WITH {matches_cte()} SELECT label, brand, technique, round(score, 6) AS score FROM tech",
    "brand_similarity_matches": f"WITH {matches_cte()} SELECT label, brand, technique, round(score, 6) AS score FROM sim",
    "best_brand_per_label": f"WITH {matches_cte()} SELECT label, brand, technique, round(score, 6) AS score FROM best",
    "lookalike_hosts": f"WITH {hosts_cte()} SELECT host, label, brand, technique, round(CAST(score AS DOUBLE), 6) AS score, {SEVERITY} AS severity FROM look WHERE brand IS NOT NULL",
    "imitated_brands": f"""WITH {hosts_cte(OCC)},
seen AS (SELECT host, count(*) AS n_urls, sum(n_seen) AS n_seen FROM p GROUP BY host)
SELECT technique, brand, CAST(sum(n_urls) AS BIGINT) AS n_urls, CAST(sum(n_seen) AS BIGINT) AS n_seen FROM look JOIN seen USING (host) WHERE brand IS NOT NULL GROUP BY ALL""",
    "brand_watch": f"""WITH {parts_cte()}, brand AS ({BRANDS}), labels AS (SELECT DISTINCT host_label AS label FROM p WHERE NOT is_ip AND host_label <> '' AND n_labels >= 2), {VARIANTS}
SELECT label, brand, kind, position FROM names JOIN labels ON variant = label""",
    "brand_variants": f"WITH brand AS ({BRANDS}), {VARIANTS} SELECT brand, kind, position, variant FROM names",
    "bitflip_neighbours": f"""WITH brand AS ({BRANDS}), used AS (SELECT c AS src, count(*) AS n_used FROM (SELECT unnest(string_split(brand, '')) AS c FROM brand) x GROUP BY c),
flips AS (SELECT src, bit, n_used, chr(CAST(xor(unicode(src), CAST(power(2, bit) AS INTEGER)) AS INTEGER)) AS dst FROM used, range(0, 8) r(bit))
SELECT src, bit, dst, n_used FROM flips WHERE regexp_matches(dst, '^([\\p{{L}}\\p{{N}}]|-)$')""",
    "sql_functions": f"""WITH brand AS ({BRANDS}), {VARIANTS}
SELECT b AS brand, ['omission', 'keyboard', 'doubling', 'swap', 'lookalike'][kind] AS kind, i AS position, v AS variant, round(jaro_winkler_similarity(b, v), 6) AS similarity, sha256(v) AS hash FROM firsts""",
    "jaro_winkler_pairs": f"""WITH {parts_cte()}, brand AS ({BRANDS}), labels AS (SELECT DISTINCT host_label AS l FROM p WHERE NOT is_ip AND n_labels >= 2 AND regexp_full_match(host_label, '[a-z0-9-]+'))
SELECT l AS label, brand, round(jaro_winkler_similarity(l, brand), 6) AS score FROM labels CROSS JOIN brand
WHERE levenshtein(l, brand) > 2 AND jaro_winkler_similarity(l, brand) >= 0.9333333334""",
}
