"""DuckDB statements for URL parts and base features."""

from __future__ import annotations

from lurewatch import refdata as R
from oracles.common import (KNOWN, arr, chars, count_of, count_re, ends_any, entropy, flag, has_any, hits, lit,
                            longest, parts_cte, ratio, select_features, total_len)

DIGITS, LETTERS = count_re("url", r"\p{Nd}"), count_re("url", r"\p{L}")
LEXICAL = {
    "url_length": ("i", "length(url)"), "domain_length": ("i", "length(netloc)"), "path_length": ("i", "length(path)"),
    "query_length": ("i", "length(query)"), "dot_count": ("i", count_of("url", ".")), "slash_count": ("i", count_of("url", "/")),
    "hyphen_count": ("i", count_of("url", "-")), "underscore_count": ("i", count_of("url", "_")),
    "question_mark_count": ("i", count_of("url", "?")), "equal_count": ("i", count_of("url", "=")),
    "at_count": ("i", count_of("url", "@")), "ampersand_count": ("i", count_of("url", "&")),
    "digit_count": ("i", DIGITS), "letter_count": ("i", LETTERS),
    "special_char_count": ("i", f"length(url) - {DIGITS} - {LETTERS}"),
    "digit_ratio": ("d", ratio(DIGITS, "length(url)")), "letter_ratio": ("d", ratio(LETTERS, "length(url)")),
    "special_char_ratio": ("d", ratio(f"length(url) - {DIGITS} - {LETTERS}", "length(url)")),
    "url_entropy": ("d", entropy("url")), "domain_entropy": ("d", entropy("netloc")),
    "suspicious_keyword_count": ("i", hits("lower(url)", R.BASE_KEYWORDS)),
}
BAD_TLD = f"list_contains({arr(R.BASE_SUSPICIOUS_TLDS)}, lower(string_split(string_split(netloc, ':')[1], '.')[-1]))"
STRUCTURAL = {
    "is_https": ("i", flag("scheme = 'https'")), "has_http": ("i", flag("scheme IN ('http', 'https')")),
    "has_ip_address": ("i", flag(r"regexp_matches(string_split(netloc, ':')[1], '^([0-9]{1,3}\.){3}[0-9]{1,3}$') OR regexp_matches(netloc, '^\[[0-9a-fA-F:.]+\](:[0-9]+)?$')")),
    "has_at_symbol": ("i", flag("contains(url, '@')")),
    "subdomain_count": ("i", "greatest(0, len(string_split(netloc, '.')) - 2)"),
    "url_depth": ("i", "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"),
    "tld_length": ("i", "CASE WHEN netloc = '' THEN 0 ELSE 1 + length(string_split(trim(string_split(netloc, ':')[1], '.'), '.')[-1]) END"),
    "is_suspicious_tld": ("i", flag(BAD_TLD)),
    "has_port": ("i", flag("contains(netloc, ':') AND NOT contains(netloc, '@')")),
    "query_param_count": ("i", "len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda s: contains(s, '=') AND NOT ends_with(s[1:instr(s, '=')], s)), lambda s: string_split(s, '=')[1])))"),
    "has_fragment": ("i", flag("fragment <> ''")),
}
ADVANCED = {
    "is_url_shortener": ("i", flag(has_any("netloc", R.BASE_SHORTENERS))),
    "has_double_slash_in_path": ("i", flag("contains(path, '//')")), "has_double_dot": ("i", flag("contains(url, '..')")),
    "hex_char_count": ("i", count_re("url", "%[0-9a-fA-F]{2}")),
    "has_hex_encoding": ("i", flag(count_re("url", "%[0-9a-fA-F]{2}") + " > 0")),
    "brand_name_count": ("i", hits("lower(netloc)", R.BASE_BRANDS)),
    "brand_with_suspicious_tld": ("i", flag(f"{has_any('lower(netloc)', R.BASE_BRANDS)} AND {BAD_TLD}")),
    "has_punycode": ("i", flag("contains(netloc, 'xn--')")),
    "has_unicode_chars": ("i", flag("strlen(netloc) <> length(netloc)")),
    "mixed_scripts": ("i", flag("regexp_matches(netloc, '[A-Za-z]') AND regexp_matches(netloc, '[Ͱ-ϿЀ-ӿ]')")),
    "has_hyphen_in_domain": ("i", flag("contains(netloc, '-')")),
    "hyphen_domain_ratio": ("d", ratio(count_of("netloc", "-"), "length(netloc)")),
    "has_suspicious_extension": ("i", flag(ends_any("lower(url)", R.BASE_BAD_EXTENSIONS))),
}
VOWELS, LET = count_re("lower(netloc)", "[aeiou]"), count_re("lower(netloc)", r"\p{L}")
STATISTICAL = {
    "vowel_count": ("i", VOWELS), "consonant_count": ("i", f"{LET} - {VOWELS}"),
    "vowel_consonant_ratio": ("d", ratio(VOWELS, f"{LET} - {VOWELS}")),
    "longest_word_length": ("i", longest("url", "[a-zA-Z]+")),
    "average_word_length": ("d", ratio(total_len("url", "[a-zA-Z]+"), count_re("url", "[a-zA-Z]+"))),
    "token_count": ("i", count_re("url", r"[\p{L}\p{N}_]+")), "digit_sequence_count": ("i", count_re("url", r"\p{Nd}+")),
    "max_digit_sequence_length": ("i", longest("url", r"\p{Nd}+")),
    "max_consecutive_consonants": ("i", longest("lower(netloc)", "[bcdfghjklmnpqrstvwxyz]+")),
    "max_consecutive_digits": ("i", longest("url", "[0-9]+")),
}
PATTERNS = {
    "phishing_keyword_match": ("i", flag(has_any("lower(url)", R.TABLE_KEYWORDS))),
    "suspicious_pattern_match": ("i", flag(" OR ".join(f"regexp_matches(lower(url), {lit(r)})" for r in R.TABLE_REGEXES))),
    "typosquatting_detected": ("i", flag(has_any("lower(netloc)", R.TABLE_TYPOS))),
    "suspicious_port": ("i", flag(has_any("lower(url)", [":" + p for p in R.TABLE_PORTS]))),
    "suspicious_extension": ("i", flag(ends_any("lower(url)", R.TABLE_EXTENSIONS))),
    "known_phishing_path": ("i", flag(has_any("lower(path)", R.TABLE_PATHS))),
}

_TABLE = R.confusables()
_SRC, _DST = "".join(c for c, _, _ in _TABLE), "".join(x for _, x, _ in _TABLE)
FOLDED = f"translate(lower(netloc), {lit(_SRC)}, {lit(_DST)})"
MIXED = "(regexp_matches(netloc, '[A-Za-z]') AND regexp_matches(netloc, '[Ͱ-ϿЀ-ӿ]'))"


def _similarity() -> str:
    whens = []
    for b in R.IDN_BRANDS:
        r = f"(2.0 * {len(b)} / ({len(b)} + length(skeleton)))"
        whens.append(f"WHEN contains(skeleton, '{b}') AND NOT contains(lower(netloc), '{b}') THEN 1.0")
        whens.append(f"WHEN contains(skeleton, '{b}') AND CAST({r} AS DOUBLE) > 0.8 THEN CAST({r} AS DOUBLE)")
    return "CASE " + " ".join(whens) + " ELSE 0.0 END"


HOMOGRAPH_SQL = f"""WITH {parts_cte()},
h AS (SELECT url_id, netloc, {FOLDED} AS skeleton, len(list_filter({chars('netloc')}, lambda c: contains({lit(_SRC)}, c))) AS n_conf FROM p),
s AS (SELECT *, CAST({_similarity()} AS DOUBLE) AS sim FROM h),
r AS (SELECT *, least(1.0, least(2.0 * {ratio('n_conf', 'length(netloc)')}, 0.8) + CASE WHEN {MIXED} THEN 0.6 ELSE 0.0 END
   + CASE WHEN contains(lower(netloc), 'xn--') THEN 0.4 ELSE 0.0 END + 0.3 * sim) AS score FROM s)
SELECT url_id, CAST(n_conf AS BIGINT) AS confusable_count, skeleton, round(sim, 6) + 0.0 AS homograph_similarity,
 round(CAST(score AS DOUBLE), 6) + 0.0 AS idn_homograph_score, CAST(round(CAST(score AS DOUBLE), 9) > 0.5 AS BIGINT) AS is_idn_homograph FROM r"""


def _impersonation(brand_src: str) -> str:
    return f"""WITH {parts_cte()},
bd AS ({brand_src}),
h AS (SELECT p.url_id, lower(p.netloc) AS d, bd.brand, bool_or(ends_with(lower(p.netloc), bd.domain)) AS legit
  FROM p LEFT JOIN bd ON contains(lower(p.netloc), bd.brand) GROUP BY ALL),
f AS (SELECT *, coalesce(brand IS NOT NULL AND NOT legit, false) AS hit,
  CASE WHEN len(string_split(d, '.')) > 2 THEN array_to_string(string_split(d, '.')[1:len(string_split(d, '.')) - 2], '.') ELSE '' END AS sub FROM h),
g AS (SELECT *, hit AND contains(sub, brand) AS in_sub, hit AND (contains(d, '-' || brand) OR contains(d, brand || '-')) AS hyp FROM f)
SELECT url_id, round(CAST(least(1.0, sum(CASE WHEN hit THEN 0.5 ELSE 0.0 END + CASE WHEN in_sub THEN 0.3 ELSE 0.0 END + CASE WHEN hyp THEN 0.2 ELSE 0.0 END)) AS DOUBLE), 6) + 0.0 AS brand_impersonation_score,
 CAST(bool_or(hit) AS BIGINT) AS likely_brand_impersonation, CAST(coalesce(bool_or(in_sub), false) AS BIGINT) AS brand_in_subdomain,
 CAST(coalesce(bool_or(hyp), false) AS BIGINT) AS brand_with_hyphens FROM g GROUP BY url_id"""


_DEFAULT_DOMAINS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{b}', '{d}')" for b, ds in R.BRAND_DOMAINS.items() for d in ds.split()) + ") v(brand, domain)"

OCCURRENCES = f"SELECT l.l_orderkey, l.l_linenumber, k.* FROM lineitem l JOIN ({KNOWN}) k ON l.l_partkey = k.url_id"

ORACLES = {
    "url_parts": f"""WITH {parts_cte()} SELECT url_id, scheme, netloc, path, query, fragment, host, CAST(port AS BIGINT) AS port,
 CAST(n_labels AS BIGINT) AS n_labels, is_ip, tld, suffix, registered_domain, domain_label, subdomain, host_label FROM p""",
    "distinct_url_occurrences": f"""WITH occ AS ({OCCURRENCES}),
{parts_cte("SELECT url, min(url_id) AS url_id, count(*) AS n_seen FROM occ GROUP BY url")}
SELECT url_id, url, n_seen, registered_domain, tld FROM p""",
    "lexical_features": select_features(LEXICAL, parts_cte()),
    "structural_features": select_features(STRUCTURAL, parts_cte()),
    "obfuscation_base_features": select_features(ADVANCED, parts_cte()),
    "homograph_features": HOMOGRAPH_SQL,
    "statistical_features": select_features(STATISTICAL, parts_cte()),
    "pattern_table_flags": select_features(PATTERNS, parts_cte()),
    "brand_impersonation": _impersonation(f"SELECT DISTINCT replace(lower(p_name), ' ', '') AS brand, replace(lower(p_name), ' ', '') || '.com' AS domain FROM part"),
    "brand_impersonation_defaults": _impersonation(_DEFAULT_DOMAINS),
    "feature_summary": f"""WITH {parts_cte()}, e AS (SELECT *, {entropy('url')} AS ent FROM p)
SELECT url_id, CAST(length(url) AS VARCHAR) || ' characters' AS url_length_text, CAST(length(netloc) AS VARCHAR) || ' characters' AS domain_length_text,
 CASE WHEN scheme = 'https' THEN 'HTTPS' ELSE 'HTTP' END AS protocol, CASE WHEN {BAD_TLD} THEN 'Suspicious' ELSE 'Normal' END AS tld_type,
 CAST({STRUCTURAL['subdomain_count'][1]} AS BIGINT) AS subdomain_count, CAST({count_of('url', '.')} AS BIGINT) AS dots,
 CAST({count_of('url', '-')} AS BIGINT) AS hyphens, CAST({count_of('url', '_')} AS BIGINT) AS underscores,
 CAST({hits('lower(url)', R.BASE_KEYWORDS)} AS BIGINT) AS suspicious_keywords, round(ent, 2) AS url_entropy,
 CASE WHEN {STRUCTURAL['has_ip_address'][1]} = 1 THEN 'Yes' ELSE 'No' END AS has_ip FROM e""",
}

ORACLES["base_feature_table"] = f"""SELECT * EXCLUDE (confusable_count, skeleton, homograph_similarity), 0::BIGINT AS punycode_length_diff, 0.0::DOUBLE AS punycode_brand_similarity FROM """ + " JOIN ".join(
    f"({ORACLES[n]}) t{i}" + (" USING (url_id)" if i else "") for i, n in enumerate((
        "lexical_features", "structural_features", "obfuscation_base_features", "statistical_features", "pattern_table_flags", "brand_impersonation_defaults", "homograph_features")))
