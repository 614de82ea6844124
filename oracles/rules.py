"""DuckDB statements for validity, rule scores, lexicon joins and reason codes."""

from __future__ import annotations

from lurewatch import refdata as R
from oracles import features as FE
from oracles import ultra as UL
from oracles.common import CORPUS, arr, count_of, count_re, ends_any, entropy, flag, has_any, hits, lit, parts_cte


def codes(*pairs) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in pairs) + "], lambda x: x IS NOT NULL), '|')"


def points(*pairs) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in pairs) + ")"


BADCH = """[<>"''{}|\\\\^`\\[\\]]"""
VALID_CTE = f"""v0 AS (SELECT url_id, url, trim(url, ' ') AS t FROM ({CORPUS}) c0),
v1 AS (SELECT *, CASE WHEN regexp_matches(t, '^(http|https|ftp)://') THEN t ELSE 'http://' || t END AS fixed_url FROM v0),
v2 AS (SELECT *, regexp_replace(fixed_url, '^[a-z]+://', '') AS r FROM v1),
v3 AS (SELECT *, regexp_extract(r, '^([^/?#]*)', 1, 's') AS nl, regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS pa FROM v2),
v4 AS (SELECT *, CASE WHEN regexp_matches(nl, '^\\[[0-9a-fA-F:.]+\\](:[0-9]+)?$') THEN 'v6' ELSE string_split(nl, ':')[1] END AS h FROM v3),
v5 AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN length(t) < 4 THEN 'too_short' ELSE {codes(
    ("nl = ''", "missing_domain"), ("contains(h, ' ')", "space_in_domain"), (f"regexp_matches(h, '{BADCH}')", "bad_character"), ("contains(h, '..')", "double_dot"),
    ("regexp_matches(h, '^[0-9.]+$') AND NOT (len(string_split(h, '.')) = 4 AND len(list_filter(string_split(h, '.'), lambda o: coalesce(try_cast(o AS INTEGER), 999) <= 255)) = 4)", "bad_ip"),
    ("contains(pa, chr(0))", "null_byte"))} END AS issues FROM v4)"""
VALID_PARTS = f"WITH {VALID_CTE},\n" + parts_cte("SELECT url_id, fixed_url AS url FROM v5 WHERE issues = ''")

DL = "domain_label"
VOW, LETS = count_re(DL, "[aeiou]"), count_re(DL, r"\p{L}")
GARBAGE = [
    (f"{VOW} = 0 AND length({DL}) > 4", 30, "no_vowels"), (f"{VOW} > 0 AND {LETS} - {VOW} > {VOW} * 5", 20, "many_consonants"),
    (f"length({DL}) > 0 AND {count_re(DL, chr(92) + 'p{Nd}')} * 10 > length({DL}) * 4", 25, "many_digits"),
    (f"{hits(DL, R.ODD_BIGRAMS)} >= 2", 20, "odd_bigrams"),
    (f"length({DL}) > 0 AND ({count_of(DL, '-')} + {count_of(DL, '_')}) * 10 > length({DL}) * 3", 15, "many_separators"),
    (f"length({DL}) > 10 AND NOT regexp_matches({DL}, '[a-z]{{3,}}')", 15, "no_words"),
    (has_any(DL, R.KEYBOARD_WALKS), 35, "keyboard_walk"), (f"{entropy(DL)} > 4.0", 10, "high_entropy"),
]
CATEGORY = ("CASE WHEN is_ip THEN 'ip' WHEN tld = '' THEN 'none' " + " ".join(
    f"WHEN list_contains({arr(ts)}, tld) THEN '{n}'" for n, ts in R.TLD_CATEGORIES.items())
    + f" WHEN list_contains({arr(R.VALID_TLDS)}, tld) THEN 'valid' ELSE 'unknown' END")
GARBAGE_SQL = f"""g AS (SELECT *, (is_ip OR list_contains({arr(R.VALID_TLDS)}, tld)) AS tld_valid, {CATEGORY} AS tld_category,
  CASE WHEN {DL} = '' THEN 100 ELSE {points(*[(c, w) for c, w, _ in GARBAGE])} END AS garbage_score,
  CASE WHEN {DL} = '' THEN 'empty_domain' ELSE {codes(*[(c, k) for c, _, k in GARBAGE])} END AS garbage_reasons FROM p)"""

KW = R.PATTERN_KEYWORDS
REPEAT = "regexp_matches(u, '" + "|".join(f"{c}{{4,}}" for c in "abcdefghijklmnopqrstuvwxyz") + "')"


def _struct_list(pairs, num=str) -> str:
    return "[" + ", ".join(f"{{'t': {lit(t)}, 'w': {num(w)}}}" for t, w in pairs) + "]"


PATTERN_CTE = f"""{parts_cte()},
s0 AS (SELECT url_id, scheme, lower(netloc) AS d, lower(path) AS pt, lower(url) AS u FROM p),
s1 AS (SELECT *, string_split(d, '.')[1] AS f, len(string_split(d, '.')) AS n_lab, {count_of('d', '-')} AS hy,
  list_filter({arr(R.PATTERN_BRANDS)}, lambda b: contains(d, b) OR contains(pt, b))[1] AS brand,
  list_filter({_struct_list(KW)}, lambda k: contains(u, k.t)) AS ks,
  coalesce(list_filter({_struct_list(R.PATTERN_TLDS)}, lambda k: ends_with(d, '.' || k.t))[1].w, 0) AS tr,
  CASE WHEN len(string_split(d, '.')) > 2 THEN array_to_string(string_split(d, '.')[1:len(string_split(d, '.')) - 2], '.') ELSE '' END AS sub FROM s0),
s2 AS (SELECT *, len(ks) AS n_kw, coalesce(list_sum(list_transform(ks, lambda k: k.w)), 0) AS kw, coalesce(contains(f, brand), false) AS inf, pt NOT IN ('', '/') AS rp,
  coalesce(contains(d, brand) AND d <> brand || '.com' AND d <> 'www.' || brand || '.com', false) AS ind,
  regexp_matches(f, '[a-z][0-9]|[0-9][a-z]') AND NOT {has_any('f', R.PATTERN_BRANDS)} AS mixed, {has_any('u', R.PATTERN_HTTP_WORDS)} AS sens,
  {has_any('sub', R.PATTERN_SUBDOMAIN_WORDS)} AS subw, len(list_filter(string_split(sub, '.'), lambda x: regexp_full_match(x, '[0-9]+'))) > 0 AS numsub,
  {has_any('d', R.PATTERN_SHORTENERS)} AS short FROM s1),
s3 AS (SELECT *, CASE WHEN ind THEN CASE WHEN {has_any('d', R.PATTERN_DOMAIN_WORDS)} THEN 25 WHEN contains(d, '-') AND inf THEN 20 WHEN inf THEN 15 ELSE 0 END
    + CASE WHEN d IN (brand || '.co.uk', brand || '.net', brand || '.org') THEN 0 ELSE 10 END ELSE 0 END AS br,
  regexp_matches(u, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') AS r1, contains(u, 'xn--') AS r2, contains(u, '--') AS r3, regexp_matches(u, '[0-9]{{5,}}') AS r4, {REPEAT} AS r5,
  rp AND {has_any('pt', R.PATTERN_PATH_WORDS)} AS pw, rp AND {ends_any('pt', R.PATTERN_BAD_EXTENSIONS)} AS ex, rp AND {count_of('pt', '%')} > 3 AS en, rp AND length(pt) > 100 AS lp,
  rp AND {count_of('pt', '.')} > 2 AS dd, rp AND regexp_matches(pt, '[a-z0-9]{{30,}}') AS rnd,
  brand IS NOT NULL AND n_kw >= 2 AND tr >= 3 AS c1, brand IS NOT NULL AND {has_any('u', R.PATTERN_AUTH_WORDS)} AND inf AS c2,
  {has_any('u', R.PATTERN_URGENCY_WORDS)} AND {has_any('u', R.PATTERN_SENSITIVE_WORDS)} AS c3 FROM s2),
s4 AS (SELECT *, br + kw + CASE WHEN n_kw >= 3 THEN 10 ELSE 0 END + CASE WHEN hy >= 3 THEN hy * 3 WHEN hy = 2 THEN 4 ELSE 0 END + tr + {points(
    ("n_lab > 3", 5), ("length(f) > 30", 5), ("mixed", 3), ("r1", 10), ("r2", 4), ("r3", 3), ("r4", 3), ("r5", 2), ("scheme = 'http' AND sens", 15),
    ("scheme = 'http' AND NOT sens", 5), ("subw AND brand IS NOT NULL", 15), ("subw AND brand IS NULL", 8), ("sub <> '' AND n_lab > 4", 10), ("numsub", 5), ("short", 8),
    ("ex", 20), ("en", 10), ("lp", 8), ("pw AND brand IS NOT NULL", 12), ("pw AND brand IS NULL", 5), ("dd", 15), ("rnd", 6), ("c1", 30), ("c2", 25), ("c3", 20))} AS s,
  list_filter([{", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in (
    ("br > 0", "brand_context"), ("n_kw >= 3", "many_keywords"), ("n_kw IN (1, 2)", "keywords"), ("n_lab > 3", "many_subdomains"), ("hy >= 3", "many_hyphens"),
    ("length(f) > 30", "long_label"), ("mixed", "digit_letter_mix"), ("tr > 0", "bad_tld"), ("r1", "ip_like"), ("r2", "punycode"), ("r3", "hyphen_run"), ("r4", "digit_run"),
    ("r5", "letter_repeat"), ("scheme = 'http' AND sens", "sensitive_http"), ("scheme = 'http' AND NOT sens", "plain_http"), ("subw", "subdomain_word"),
    ("sub <> '' AND n_lab > 4", "deep_subdomain"), ("numsub", "numeric_subdomain"), ("short", "shortener"), ("ex", "executable_path"), ("en", "encoded_path"), ("lp", "long_path"),
    ("pw AND brand IS NOT NULL", "sensitive_path"), ("dd", "many_extensions"), ("rnd", "random_path"), ("c1", "brand_keywords_bad_tld"), ("c2", "brand_auth"),
    ("c3", "urgency_and_sensitive")))}], lambda x: x IS NOT NULL) AS rs FROM s3),
pat AS (SELECT url_id, brand, CAST(n_kw AS BIGINT) AS n_keywords, CAST(least(s, 100) AS BIGINT) AS risk_score, s >= 15 AS is_suspicious, round(least(s / 50.0, 1.0), 6) AS confidence,
  array_to_string(rs, '|') AS reasons, rs, CASE WHEN s >= 50 THEN 'EXTREMELY_SUSPICIOUS' WHEN s >= 30 THEN 'HIGHLY_SUSPICIOUS' WHEN s >= 15 THEN 'SUSPICIOUS' WHEN s >= 10 THEN 'QUESTIONABLE' ELSE 'LOW_RISK' END AS verdict FROM s4)"""

SKW = [(k, round(w * 100)) for k, w in R.SIGNATURE_KEYWORDS]
URLHASH = "sha256(regexp_replace(lower(trim(url, ' ')), '/$', ''))"


def _brand_case() -> str:
    whens = []
    for b, vs in R.SIGNATURE_BRAND_VARIANTS.items():
        cond = f"({has_any('d', vs.split())} AND NOT contains(d, '{b}.com'))"
        if b in R.SIGNATURE_SUBDOMAIN_BRANDS:
            cond += f" OR (contains(d, '{b}') AND len(string_split(d, '.')) > 2 AND string_split(d, '.')[-2] || '.' || string_split(d, '.')[-1] <> '{b}.com')"
        whens.append(f"WHEN {cond} THEN '{b}'")
    return "CASE " + " ".join(whens) + " END"


SIGNATURE_CTE = f"""{parts_cte()},
g0 AS (SELECT url_id, url, lower(netloc) AS d, lower(path) AS pt, lower(url) AS u FROM p),
g1 AS (SELECT *, {" + ".join(flag(f"regexp_matches(u, {lit(r)})") for _, r in R.SIGNATURE_REGEXES)} AS n_rules, {hits('u', R.SIGNATURE_SUBSTRINGS)} AS n_substrings, {_brand_case()} AS brand,
  coalesce(list_sum(list_transform(list_filter({_struct_list(SKW)}, lambda k: contains(u, k.t)), lambda k: k.w)), 0) AS ksum,
  coalesce(list_max(list_transform(list_filter({_struct_list(SKW)}, lambda k: contains(u, k.t)), lambda k: k.w)), 0) AS kmax FROM g0),
g2 AS (SELECT *, CAST(least(10000, ksum * 30 + kmax * 70) * 20 // 10000 AS BIGINT) AS keyword_points, {points(
    (r"regexp_matches(d, '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')", 25), ("contains(u, '@')", 30), (count_of("d", ".") + " > 3", 15), ("length(d) > 50", 10),
    ("regexp_matches(d, '[a-z0-9]{15,}')", 20), ("regexp_matches(pt, '/(wp-|cgi-bin|tmp|temp)/')", 15), (r"regexp_matches(pt, '\.[a-z]{2,4}\.[a-z]{2,4}$')", 20),
    ("contains(d, ':') AND NOT ends_with(d, ':443') AND NOT ends_with(d, ':80')", 15), ("strlen(d) <> length(d)", 25), (has_any("d", R.SIGNATURE_SHORTENERS), 10))} AS structure_points FROM g1),
bad AS (SELECT DISTINCT {URLHASH} AS h FROM corpus WHERE url_id % 50 = 0),
g3 AS (SELECT *, CASE WHEN {URLHASH} IN (SELECT h FROM bad) THEN 100 ELSE n_rules * 30 + n_substrings * 40
   + CASE WHEN contains(d, '.') AND list_contains({arr(R.SIGNATURE_TLDS)}, string_split(d, '.')[-1]) THEN 15 ELSE 0 END + CASE WHEN brand IS NOT NULL THEN 35 ELSE 0 END + keyword_points + structure_points END AS s FROM g2),
sig AS (SELECT url_id, CAST(n_rules AS BIGINT) AS n_rules, CAST(n_substrings AS BIGINT) AS n_substrings, brand, keyword_points, CAST(structure_points AS BIGINT) AS structure_points,
  CAST(least(s, 100) AS BIGINT) AS risk_score, round(CAST(least(s / 100.0, 1.0) AS DOUBLE), 6) AS confidence, CASE WHEN s >= 50 THEN true WHEN s < 30 THEN false END AS is_phishing,
  CASE WHEN s >= 70 THEN 'high_confidence_match' WHEN s >= 50 THEN 'medium_confidence_match' WHEN s >= 30 THEN 'suspicious_indicators' ELSE 'no_match' END AS method FROM g3)"""

IND = [("NOT starts_with(url, 'https://')", 20, "no_https"), (r"regexp_matches(netloc, '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$')", 15, "ip_address"),
       (ends_any("netloc", ["." + t for t in R.INDICATOR_TLDS]), 10, "suspicious_tld"), ("length(url) > 100", 5, "long_url")]


def fe(spec: dict, name: str) -> str:
    return f"({spec[name][1]})"


S, A, L = FE.STRUCTURAL, FE.ADVANCED, FE.LEXICAL
BASE_CODES = codes(
    (fe(S, "is_suspicious_tld") + " = 1", "suspicious_tld"), (fe(S, "has_ip_address") + " = 1", "ip_address"), (fe(S, "has_at_symbol") + " = 1", "at_symbol"),
    (fe(L, "suspicious_keyword_count") + " > 0", "keywords"), (fe(A, "brand_with_suspicious_tld") + " = 1", "brand_on_bad_tld"), ("length(url) > 75", "long_url"),
    (fe(S, "subdomain_count") + " > 3", "many_subdomains"), (fe(A, "is_url_shortener") + " = 1", "shortener"), (fe(A, "has_hex_encoding") + " = 1", "hex_encoding"),
    ("scheme <> 'https'", "no_https"), (f"{entropy('url')} > 4.5", "high_entropy"), (fe(S, "has_port") + " = 1", "port"), ("h_idn = 1", "idn_homograph"),
    (fe(A, "has_unicode_chars") + " = 1", "non_ascii"), (fe(A, "mixed_scripts") + " = 1", "mixed_scripts"),
    *[(fe(FE.PATTERNS, n) + " = 1", k) for n, k in (("phishing_keyword_match", "known_keyword"), ("suspicious_pattern_match", "known_pattern"), ("typosquatting_detected", "known_typo"),
                                                    ("suspicious_port", "known_port"), ("suspicious_extension", "known_extension"), ("known_phishing_path", "known_path"))],
    ("imp = 1", "brand_impersonation"), ("imp_sub = 1", "brand_in_subdomain"), ("imp_hyp = 1", "brand_with_hyphens"))
BEH = UL.BEHAVIOUR["suspicious_behavior_score"][1]
ULTRA_CODES = codes(
    (f"{UL.MIN} BETWEEN 1 AND 2", "near_brand"), (f"({BEH}) >= 4", "behaviour_critical"), (f"({BEH}) = 3", "behaviour_warning"),
    *[(f"{spec[n][1]} = 1", k) for spec, n, k in (
        (UL.OBFUSCATION, "excessive_encoding", "excessive_encoding"), (UL.OBFUSCATION, "suspicious_redirect", "redirect"), (UL.LINGUISTIC, "brand_plus_action", "brand_and_action"),
        (UL.LINGUISTIC, "action_plus_urgency", "action_and_urgency"), (UL.BEHAVIOUR, "data_harvest", "data_harvest"), (UL.LINGUISTIC, "secure_in_http_url", "secure_word_without_https"),
        (UL.BEHAVIOUR, "account_threat", "account_threat"))])
IMP = FE.ORACLES["brand_impersonation_defaults"]
HOM = FE.ORACLES["homograph_features"]
LEX = [("signature_keyword", t, w) for t, w in R.SIGNATURE_KEYWORDS]
FULL_LEX = ([("pattern_keyword", t) for t, _ in KW] + [("signature_keyword", t) for _, t, _ in LEX] + [("signature_substring", t) for t in R.SIGNATURE_SUBSTRINGS]
            + [("finding_keyword", t) for t in R.FINDING_KEYWORDS] + [("combo_keyword", t) for t in R.COMBO_KEYWORDS]
            + [(f"ultra_{f}", t) for f, ts in R.ULTRA_WORDS.items() for t in ts.split()])
TLDW = dict(R.PATTERN_TLDS)
TLDC = {t: c for c, ts in R.TLD_CATEGORIES.items() for t in ts}
TLD_ROWS = ", ".join(f"('{t}', '{TLDC.get(t, 'valid' if t in R.VALID_TLDS else 'unknown')}', {TLDW.get(t, 0)}, {str(t in R.VALID_TLDS).lower()})"
                     for t in sorted(set(R.VALID_TLDS) | set(TLDW) | set(R.SIGNATURE_TLDS) | set(R.FINDING_TLDS)))

ORACLES = {
    "url_validity": f"WITH {VALID_CTE} SELECT url_id, fixed_url, issues = '' AS is_valid, issues FROM v5",
    "garbage_score": f"{VALID_PARTS},\n{GARBAGE_SQL} SELECT url_id, domain_label, tld_valid, tld_category, CAST(garbage_score AS BIGINT) AS garbage_score, garbage_score >= 50 AS is_garbage, garbage_reasons FROM g",
    "pattern_score": f"WITH {PATTERN_CTE} SELECT * EXCLUDE (rs) FROM pat",
    "top_reasons": f"WITH {PATTERN_CTE} SELECT url_id, array_to_string(rs[1:3], '|') AS reasons FROM pat WHERE is_suspicious",
    "signature_score": f"WITH {SIGNATURE_CTE} SELECT * FROM sig",
    "threat_indicators": f"WITH {parts_cte()} SELECT url_id, CAST({points(*[(c, w) for c, w, _ in IND])} AS BIGINT) AS risk_score, {codes(*[(c, k) for c, _, k in IND])} AS indicators FROM p",
    "merged_reasons": f"""WITH {PATTERN_CTE}, i AS (SELECT url_id, list_filter([{", ".join(f"CASE WHEN {c} THEN '{'plain_http' if k == 'no_https' else k}' END" for c, _, k in IND)}], lambda x: x IS NOT NULL) AS ind FROM p)
SELECT url_id, array_to_string(list_concat(list_reverse(list_filter(rs, lambda r: NOT list_contains(ind, r))), ind), '|') AS reasons FROM pat JOIN i USING (url_id)""",
    "lexicon_score": f"""WITH {parts_cte()}, lex(term, w) AS (VALUES {", ".join(f"('{t}', CAST({w} AS DOUBLE))" for _, t, w in LEX)})
SELECT url_id, count(term) AS n_terms, round(coalesce(sum(w), 0.0), 6) AS sum_weight, round(coalesce(max(w), 0.0), 6) AS max_weight FROM p LEFT JOIN lex ON contains(lower(url), term) GROUP BY url_id""",
    "lexicon_usage": f"""WITH corpus AS ({CORPUS}), lex(family, term) AS (VALUES {", ".join(f"('{f}', '{t}')" for f, t in FULL_LEX)}),
h AS (SELECT family, count(DISTINCT term) AS n_used, count(DISTINCT url_id) AS n_urls FROM corpus JOIN lex ON contains(lower(url), term) GROUP BY family)
SELECT family, count(*) AS n_terms, coalesce(any_value(n_used), 0) AS n_used, coalesce(any_value(n_urls), 0) AS n_urls FROM lex LEFT JOIN h USING (family) GROUP BY family""",
    "tld_dimension": f"""WITH {parts_cte()}, t(tld, cat, w, v) AS (VALUES {TLD_ROWS})
SELECT url_id, host, p.tld AS tld, cat AS tld_category, CAST(coalesce(w, 0) AS BIGINT) AS tld_weight, coalesce(v, false) AS tld_is_valid,
 list_contains({arr(R.FINDING_SHORTENERS)}, regexp_replace(host, '^www\\.', '')) AS is_shortener FROM p LEFT JOIN t ON p.tld = t.tld""",
    "known_bad_matches": f"""WITH u AS (SELECT url_id, CASE WHEN url_id % 2 = 0 THEN upper(url) ELSE ' ' || url || '/' END AS url FROM ({CORPUS}) c), bad AS (SELECT {URLHASH} AS h FROM ({CORPUS}) c WHERE url_id % 3 = 0)
SELECT url_id, {URLHASH} AS url_hash FROM u WHERE {URLHASH} IN (SELECT h FROM bad)""",
}
USER_LEX = """lex AS (SELECT term, CAST(max(w) AS INTEGER) AS w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS term, p_size % 5 + 1 AS w FROM part) x WHERE length(term) >= 3 GROUP BY term)"""
for _name in ("pattern_score_user_lexicon", "pattern_score_joined_lexicon"):
    ORACLES[_name] = f"WITH {USER_LEX}, {PATTERN_CTE.replace(_struct_list(KW), '(SELECT list({t: term, w: w}) FROM lex)')} SELECT * EXCLUDE (rs) FROM pat".replace("{t: term, w: w}", "{'t': term, 'w': w}")
ORACLES["signature_score_user_lexicon"] = f"WITH {USER_LEX}, {SIGNATURE_CTE.replace(_struct_list(SKW), '(SELECT list({t: term, w: w * 10}) FROM lex)')} SELECT * FROM sig".replace(
    "{t: term, w: w * 10}", "{'t': term, 'w': w * 10}").replace(f"CASE WHEN {URLHASH} IN (SELECT h FROM bad) THEN 100 ELSE", "CASE WHEN false THEN 100 ELSE")
# user tables: regexes, flag terms, TLDs
RULES_CTE = """urules AS (SELECT 'r_' || w || '_' || CAST(s AS VARCHAR) AS rule_id, length(w) % 4 + s + 1 AS weight,
 CASE s WHEN 0 THEN '^https?://[^/]*' || w WHEN 1 THEN w || '[a-z][a-z]+[.](com|tk)/' WHEN 2 THEN '(' || w || '|zz)[0-9]' WHEN 3 THEN w || '(-login)?[.]com/p' ELSE '[.-]' || w || '|' || w || '-' END AS regex
 FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part) y, (VALUES (0), (1), (2), (3), (4)) AS t(s))"""
RULE_HITS = """rh AS (SELECT url_id, count(*) AS rn, CAST(sum(weight) AS BIGINT) AS rw, list(rule_id ORDER BY rule_id) AS rids FROM {src}, urules WHERE regexp_matches(u, regex) GROUP BY url_id)"""
_MARK = ", ".join(f"CASE WHEN r{i} THEN '{k}' END" for i, k in enumerate(("ip_like", "punycode", "hyphen_run", "digit_run", "letter_repeat"), 1))
_POINTS = " + ".join(f"CASE WHEN r{i} THEN {w} ELSE 0 END" for i, w in enumerate((10, 4, 3, 3, 2), 1))
assert _MARK in PATTERN_CTE and _POINTS in PATTERN_CTE
_USER_PATTERN = (PATTERN_CTE.replace(_MARK, "'@'").replace(_POINTS, "coalesce(rw, 0)").replace("FROM s2),", "FROM s2 LEFT JOIN rh USING (url_id)),")
                 .replace("s1 AS (", RULE_HITS.format(src="s0") + ",\ns1 AS (", 1)
                 .replace("lambda x: x IS NOT NULL) AS rs FROM s3)", "lambda x: x IS NOT NULL) AS rs0 FROM s3)")
                 .replace("pat AS (SELECT", "s5 AS (SELECT *, flatten(list_transform(rs0, lambda x: CASE WHEN x = '@' THEN coalesce(rids, []) ELSE [x] END)) AS rs FROM s4),\npat AS (SELECT").replace("AS verdict FROM s4)", "AS verdict FROM s5)"))
ORACLES["pattern_score_user_rules"] = f"WITH {RULES_CTE}, {_USER_PATTERN} SELECT * EXCLUDE (rs) FROM pat"
ORACLES["pattern_score_indexed_rules"] = f"WITH {RULES_CTE}, {USER_LEX}, {_USER_PATTERN.replace(_struct_list(KW), '(SELECT list({t: term, w: w}) FROM lex)')} SELECT * EXCLUDE (rs) FROM pat".replace("{t: term, w: w}", "{'t': term, 'w': w}")
_SRULES = " + ".join(flag(f"regexp_matches(u, {lit(r)})") for _, r in R.SIGNATURE_REGEXES)
assert _SRULES in SIGNATURE_CTE and hits("u", R.SIGNATURE_SUBSTRINGS) in SIGNATURE_CTE
ORACLES["signature_score_user_tables"] = f"WITH {RULES_CTE}, {USER_LEX}, sl AS (SELECT list(term || '-') AS terms FROM lex), " + (
    SIGNATURE_CTE.replace(_SRULES, "coalesce(rn, 0)").replace(hits("u", R.SIGNATURE_SUBSTRINGS), "len(list_filter((SELECT terms FROM sl), lambda t: contains(u, t)))")
    .replace("g1 AS (", RULE_HITS.format(src="g0") + ",\ng1 AS (", 1).replace("AS kmax FROM g0),", "AS kmax FROM g0 LEFT JOIN rh USING (url_id)),")
    .replace(f"CASE WHEN {URLHASH} IN (SELECT h FROM bad) THEN 100 ELSE n_rules * 30", "CASE WHEN false THEN 100 ELSE coalesce(rw, 0)")) + " SELECT * FROM sig"
_FLAGS = f"""WITH {USER_LEX}, {RULES_CTE}, {parts_cte()}, q AS (SELECT url_id, lower(url) AS u, lower(netloc) AS d, lower(path) AS pt FROM p),
rh AS (SELECT DISTINCT url_id FROM q, urules WHERE regexp_matches(u, regex)), w AS (SELECT list(DISTINCT term) AS ws FROM lex)
SELECT url_id, CAST(len(list_filter(ws, lambda t: contains(u, t || '-l'))) > 0 AS BIGINT) AS phishing_keyword_match, CAST(url_id IN (SELECT url_id FROM rh) AS BIGINT) AS suspicious_pattern_match,
 CAST(len(list_filter(ws, lambda t: contains(d, t[1:2] || t[2:]))) > 0 AS BIGINT) AS typosquatting_detected, CAST(len(list_filter(ws, lambda t: contains(u, ':8' || CAST(length(t) AS VARCHAR)))) > 0 AS BIGINT) AS suspicious_port,
 CAST(len(list_filter(ws, lambda t: ends_with(u, t[-1] || '/q2'))) > 0 AS BIGINT) AS suspicious_extension, CAST(len(list_filter(ws, lambda t: contains(pt, '/' || t))) > 0 AS BIGINT) AS known_phishing_path FROM q, w"""
ORACLES["pattern_flags_user_tables"] = ORACLES["pattern_flags_indexed_tables"] = _FLAGS
_TLDS = sorted(set(R.VALID_TLDS) | set(TLDW) | set(R.SIGNATURE_TLDS) | set(R.FINDING_TLDS))


def _tlds_where(cond) -> str:
    return arr([t for t in _TLDS if cond(len(t) + ord(t[0]))])


USER_TLD_VALID, USER_TLD_ODD = _tlds_where(lambda n: n % 4 != 0), _tlds_where(lambda n: n % 3 == 0)
USER_TLD_INDICATOR, USER_TLD_FINDING = _tlds_where(lambda n: n % 5 < 2), _tlds_where(lambda n: n % 2 == 0)
_USER_CATEGORY = f"CASE WHEN is_ip THEN 'ip' WHEN tld = '' THEN 'none' WHEN list_contains({USER_TLD_ODD}, tld) THEN 'odd' WHEN list_contains({arr(_TLDS)}, tld) THEN 'even' ELSE 'unknown' END"
ORACLES["garbage_score_user_tlds"] = ORACLES["garbage_score"].replace(CATEGORY, _USER_CATEGORY).replace(f"list_contains({arr(R.VALID_TLDS)}, tld)", f"list_contains({USER_TLD_VALID}, tld)")
_USER_IND = [(f"contains(netloc, '.') AND list_contains({USER_TLD_INDICATOR}, string_split(netloc, '.')[-1])" if k == "suspicious_tld" else c, w, k) for c, w, k in IND]
ORACLES["threat_indicators_user_tlds"] = f"WITH {parts_cte()} SELECT url_id, CAST({points(*[(c, w) for c, w, _ in _USER_IND])} AS BIGINT) AS risk_score, {codes(*[(c, k) for c, _, k in _USER_IND])} AS indicators FROM p"
ORACLES["risk_factors"] = f"""WITH im AS (SELECT url_id AS i1, likely_brand_impersonation AS imp, brand_in_subdomain AS imp_sub, brand_with_hyphens AS imp_hyp FROM ({IMP}) z1),
ho AS (SELECT url_id AS i2, is_idn_homograph AS h_idn FROM ({HOM}) z2),
pp AS (WITH {parts_cte()} SELECT p.*, imp, imp_sub, imp_hyp, h_idn FROM p JOIN im ON p.url_id = i1 JOIN ho ON p.url_id = i2),
bc AS (SELECT url_id AS i3, {BASE_CODES} AS base_codes FROM pp),
uc AS (WITH {UL.LOW} SELECT url_id AS i4, {ULTRA_CODES} AS ultra_codes FROM q)
SELECT i3 AS url_id, base_codes, ultra_codes FROM bc JOIN uc ON i3 = i4"""
