"""DuckDB statements for the wide feature families."""

from __future__ import annotations

from lurewatch import refdata as R
from oracles.common import (arr, chars, count_of, count_re, ends_any, entropy, flag, has_any, hits, longest, parts_cte, ratio,
                            same_run, select_features, shortest, total_len)

LOW = parts_cte(extra=""",
q AS (SELECT * REPLACE (lower(netloc) AS netloc, lower(path) AS path, lower(query) AS query, lower(fragment) AS fragment),
  netloc AS raw_netloc, lower(url) AS u FROM p)""")
N, ND = "length(url)", "length(netloc)"
CONS = r"[^\P{L}aeiou]"
OTHER = r"[^\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]+"
ACTION, URGENCY, SENSITIVE = (R.ULTRA_WORDS[k].split() for k in ("action", "urgency", "sensitive"))
PARAMS = ("len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda s: regexp_matches(s, '^[^=]*=.')), "
          "lambda s: string_split(s, '=')[1])))")


def rx(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, '{pattern}')"


BASIC = {
    "url_total_length": ("i", N), "domain_length": ("i", ND), "path_length": ("i", "length(path)"),
    "query_length": ("i", "length(query)"), "fragment_length": ("i", "length(fragment)"),
    "is_https": ("i", flag("scheme = 'https'")), "has_www": ("i", flag("contains(netloc, 'www.')")),
    "subdomain_count": ("i", "greatest(0, len(string_split(netloc, '.')) - 2)"),
    "path_depth": ("i", "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"), "query_params_count": ("i", PARAMS),
    "has_fragment": ("i", flag("fragment <> ''")), "uses_standard_port": ("i", flag("NOT contains(netloc, ':')")),
    "has_at_symbol": ("i", flag("contains(url, '@')")),
    "domain_has_ip": ("i", flag(rx("netloc", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"))),
    "url_shortener": ("i", flag(has_any("netloc", R.ULTRA_SHORTENERS))), "domain_dots_count": ("i", count_of("netloc", ".")),
    "path_slashes_count": ("i", count_of("path", "/")), "query_ampersands_count": ("i", count_of("query", "&")),
    "total_special_chars": ("i", count_re("url", OTHER)), "scheme_length": ("i", "length(scheme)"),
}
LEXICAL = {
    "digit_ratio_url": ("d", ratio(count_re("url", r"\p{Nd}"), N)), "letter_ratio_url": ("d", ratio(count_re("url", r"\p{L}"), N)),
    "uppercase_ratio": ("d", ratio(count_re("url", r"\p{Lu}"), N)), "special_ratio": ("d", ratio(count_re("url", OTHER), N)),
    "domain_digit_ratio": ("d", ratio(count_re("netloc", r"\p{Nd}"), ND)),
    "domain_hyphen_ratio": ("d", ratio(count_of("netloc", "-"), ND)),
    "domain_underscore_ratio": ("d", ratio(count_of("netloc", "_"), ND)),
    "max_char_repeat": ("i", same_run("url")), "domain_max_char_repeat": ("i", same_run("netloc")),
    "max_consecutive_digits": ("i", longest("url", r"\p{Nd}+")), "max_consecutive_letters": ("i", longest("url", r"\p{L}+")),
    "max_consecutive_consonants": ("i", longest("netloc", CONS + "+")),
    "hex_percent_encoding_count": ("i", count_of("url", "%")), "has_excessive_encoding": ("i", flag(count_of("url", "%") + " > 3")),
    "dots_count": ("i", count_of("url", ".")), "hyphens_count": ("i", count_of("url", "-")),
    "underscores_count": ("i", count_of("url", "_")), "equals_count": ("i", count_of("url", "=")),
    "question_marks_count": ("i", count_of("url", "?")), "ampersands_count": ("i", count_of("url", "&")),
    "has_tilde": ("i", flag("contains(url, '~')")), "has_pipe": ("i", flag("contains(url, '|')")),
    "url_entropy": ("d", entropy("url")), "domain_entropy": ("d", entropy("netloc")), "path_entropy": ("d", entropy("path")),
    "domain_to_url_ratio": ("d", ratio(ND, N)), "path_to_url_ratio": ("d", ratio("length(path)", N)),
    "query_to_url_ratio": ("d", ratio("length(query)", N)),
}
NAME = "domain_label"
DOMAIN = {
    "tld_length": ("i", "length(suffix)"), "has_country_tld": ("i", flag("length(suffix) = 2")),
    "tld_is_com": ("i", flag("suffix = 'com'")),
    "tld_is_suspicious": ("i", flag(f"list_contains({arr(R.TLD_CATEGORIES['free_suspicious'])}, suffix)")),
    "domain_word_count": ("i", count_re(NAME, "[a-z]+")), "domain_has_brand_name": ("i", flag(has_any(NAME, R.ULTRA_BRANDS))),
    "domain_vowel_ratio": ("d", ratio(count_re(NAME, "[aeiou]"), f"length({NAME})")),
    "domain_consonant_clusters": ("i", f"coalesce(list_sum(list_transform(regexp_extract_all({NAME}, '{CONS}+'), lambda r: greatest(0, length(r) - 2))), 0)"),
    "has_subdomain": ("i", flag("subdomain <> ''")), "subdomain_length": ("i", "length(subdomain)"),
    "subdomain_levels": ("i", "CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END"),
    "subdomain_has_keyword": ("i", flag(has_any("subdomain", ["secure", "login", "verify"]))),
    "domain_contains_hyphen": ("i", flag(f"contains({NAME}, '-')")),
    "domain_starts_with_digit": ("i", flag(rx(NAME, r"^\p{Nd}"))), "domain_ends_with_digit": ("i", flag(rx(NAME, r"\p{Nd}$"))),
    "domain_has_doubled_chars": ("i", flag(same_run(NAME) + " >= 3")),
    "domain_number_letter_transitions": ("i", count_re(NAME, "[0-9][a-z]|[a-z][0-9]")),
    "domain_longest_word_length": ("i", longest(NAME, "[a-z]+")),
    "domain_average_word_length": ("d", ratio(total_len(NAME, "[a-z]+"), count_re(NAME, "[a-z]+"))),
    "registered_domain_length": ("i", "length(registered_domain)"),
    "fqdn_length": ("i", "CASE WHEN registered_domain = '' THEN 0 ELSE length(host) END"),
    "has_punycode": ("i", flag("contains(netloc, 'xn--')")), "punycode_segments": ("i", count_of("netloc", "xn--")),
    "resembles_ip": ("i", flag(rx("netloc", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"))),
}
PATH_QUERY = {
    "path_segments_count": ("i", "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"),
    "path_has_extension": ("i", flag(rx("path", r"\.[a-z]{2,4}$"))),
    "path_suspicious_extension": ("i", flag(rx("path", r"\.(exe|zip|rar|scr|bat|cmd|vbs)$"))),
    "path_double_extension": ("i", flag(f"{count_of('path', '.')} > 1 AND NOT ends_with(path, '.html')")),
    "path_longest_segment": ("i", "coalesce(list_max(list_transform(string_split(path, '/'), lambda s: length(s))), 0)"),
    "query_has_url": ("i", flag(rx("query", "https?://"))),
    "query_suspicious_params": ("i", hits("query", ["redirect", "url", "next", "continue", "return"])),
    "query_has_base64": ("i", flag("length(query) > 20 AND " + rx("query", "^[A-Za-z0-9+/]+=*$"))),
    "path_percent_encoded": ("i", count_of("path", "%")), "query_percent_encoded": ("i", count_of("query", "%")),
    "path_file_indicators": ("i", hits("path", [".php", ".asp", ".jsp", ".cgi"])),
    **{f"path_has_{w}": ("i", flag(f"contains(path, '{w}')")) for w in ("login", "admin", "verify", "account")},
    "query_equals_to_ampersand_ratio": ("d", ratio(count_of("query", "="), count_of("query", "&"))),
    "query_longest_value": ("i", "coalesce(list_max(list_transform(regexp_extract_all(query, '=([^&]*)', 1), lambda s: length(s))), 0)"),
    "path_digit_ratio": ("d", ratio(count_re("path", r"\p{Nd}"), "length(path)")),
    "path_special_char_ratio": ("d", ratio(count_re("path", r"[^\p{L}\p{N}/.?]"), "length(path)")),
}
WORDS = f"len(list_filter(regexp_extract_all(u, '{WORD}'), lambda s: regexp_full_match(s, '[a-z]{{3,}}')))"
CHUNKS = "greatest(len(regexp_extract_all(url, '\\S+')), 1)"
LINGUISTIC = {
    "has_action_words": ("i", hits("u", ACTION)), "action_word_in_domain": ("i", flag(has_any("netloc", ACTION))),
    "has_urgency_words": ("i", hits("u", URGENCY)), "urgency_in_path": ("i", flag(has_any("path", URGENCY))),
    "has_sensitive_words": ("i", hits("u", SENSITIVE)), "sensitive_in_domain": ("i", flag(has_any("netloc", SENSITIVE))),
    "brand_mention_count": ("i", hits("u", R.ULTRA_BRANDS)),
    "brand_in_subdomain": ("i", flag(has_any("string_split(netloc, '.')[1]", R.ULTRA_BRANDS))),
    "action_plus_urgency": ("i", flag(f"{has_any('u', ACTION)} AND {has_any('u', URGENCY)}")),
    "brand_plus_action": ("i", flag(f"{has_any('u', R.ULTRA_BRANDS)} AND {has_any('u', ACTION)}")),
    "sensitive_plus_action": ("i", flag(f"{has_any('u', SENSITIVE)} AND {has_any('u', ACTION)}")),
    "has_login_keywords": ("i", flag(has_any("u", ["login", "signin", "sign-in"]))),
    "has_verify_keywords": ("i", flag(has_any("u", ["verify", "validation", "confirm"]))),
    "has_security_keywords": ("i", flag(has_any("u", ["secure", "security", "protect"]))),
    "has_update_keywords": ("i", flag(has_any("u", ["update", "upgrade", "renew"]))),
    "security_action_combo": ("i", flag(f"{has_any('u', ['secure', 'security'])} AND {has_any('u', ['login', 'verify', 'update'])}")),
    "readable_words_count": ("i", WORDS), "readable_words_ratio": ("d", f"{WORDS} / {CHUNKS}"),
    "has_mixed_case_domain": ("i", flag("raw_netloc <> netloc")),
    "has_suspended_terms": ("i", flag(has_any("u", ["suspend", "locked", "blocked", "frozen"]))),
    "has_restore_terms": ("i", flag(has_any("u", ["restore", "recover", "unlock", "reactivate"]))),
    "has_billing_terms": ("i", flag(has_any("u", ["billing", "payment", "invoice", "charge"]))),
    "fake_https_in_domain": ("i", flag("contains(netloc, 'https') AND scheme = 'http'")),
    "secure_in_http_url": ("i", flag("contains(u, 'secure') AND scheme = 'http'")),
}
SIGNALS = [["password", "login"], ["urgent", "expire"], ["verify", "confirm"], ["suspend", "lock", "block"], ["update", "renew", "restore"]]
BEHAVIOUR = {
    "requests_credentials": ("i", flag(has_any("u", ["password", "login", "signin", "auth"]))),
    "promises_reward": ("i", flag(has_any("u", ["free", "win", "prize", "gift", "bonus"]))),
    "creates_urgency": ("i", flag(has_any("u", ["urgent", "expire", "limited", "now", "today"]))),
    "impersonates_authority": ("i", flag(has_any("u", ["gov", "official", "legal", "court", "police"]))),
    "financial_focus": ("i", flag(has_any("u", ["bank", "credit", "payment", "billing", "money"]))),
    "suspicious_behavior_score": ("i", " + ".join(flag(has_any("u", s)) for s in SIGNALS)),
    "tech_support_scam": ("i", flag(has_any("u", ["support", "help", "error", "warning", "virus"]))),
    "account_threat": ("i", flag(has_any("u", ["suspend", "lock", "close", "terminate"]))),
    "data_harvest": ("i", flag(f"{has_any('u', ['verify', 'confirm', 'update', 'validate'])} AND {has_any('u', ['account', 'profile', 'info'])}")),
    "redirect_to_external": ("i", flag("contains(query, 'redirect') AND contains(query, 'http')")),
}
OBFUSCATION = {
    "has_decimal_ip": ("i", flag(rx("netloc", "[0-9]{8,}"))), "has_hex_ip": ("i", flag(rx("u", "0x[0-9a-f]+"))),
    "has_octal_ip": ("i", flag(rx("netloc", "0[0-7]+"))), "excessive_encoding": ("i", flag(count_of("u", "%") + " > 5")),
    "encoded_slashes": ("i", flag(has_any("u", ["%2f", "%5c"]))), "encoded_dots": ("i", flag("contains(u, '%2e')")),
    "double_encoding": ("i", flag("contains(u, '%25')")), "has_unicode": ("i", flag("strlen(url) <> length(url)")),
    "zero_width_chars": ("i", flag("regexp_matches(url, '[​‌‍⁠]')")),
    "has_redirect_param": ("i", flag(has_any("query", ["redirect", "url", "goto", "next", "continue", "return", "redir"]))),
    "suspicious_redirect": ("i", flag(rx("query", "(redirect|url|goto)=https?://"))),
    "data_uri": ("i", flag("contains(u, 'data:')")), "javascript_uri": ("i", flag("contains(u, 'javascript:')")),
    "path_traversal": ("i", flag("contains(path, '../') OR contains(path, '..\\')")),
    "excessive_slashes": ("i", flag("contains(path, '//')")),
}
SEPS = count_re("url", r"[./\-_?&=]")
COMPLEXITY = {
    "total_tokens": ("i", count_re("url", WORD)), "avg_token_length": ("d", ratio(total_len("url", WORD), count_re("url", WORD))),
    "max_token_length": ("i", longest("url", WORD)), "min_token_length": ("i", shortest("url", WORD)),
    "nested_subdomains": ("i", "len(string_split(netloc, '.')) - 2"),
    "path_nesting_level": ("i", "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"),
    "total_separators": ("i", SEPS), "separator_density": ("d", ratio(SEPS, N)),
    "url_structure_score": ("d", "CASE WHEN scheme = 'https' THEN 10 ELSE 0 END + CASE WHEN netloc <> '' THEN 20 ELSE 0 END + CASE WHEN len(string_split(netloc, '.')) >= 2 THEN 20 ELSE 0 END + CASE WHEN length(path) > 1 THEN 15 ELSE 0 END"),
    "domain_structure_score": ("d", r"CASE WHEN len(string_split(netloc, '.')) >= 2 THEN 20 ELSE 0 END + CASE WHEN len(string_split(netloc, '.')) IN (2, 3) THEN 20 ELSE 0 END + CASE WHEN NOT regexp_matches(string_split(netloc, '.')[-1], '\p{Nd}') THEN 10 ELSE 0 END"),
    "has_file_extension": ("i", flag(rx("path", r"\.[a-z]{2,4}$"))),
    "suspicious_file_ext": ("i", flag(rx("path", r"\.(php|asp|jsp|cgi|exe|zip)$"))),
    "balanced_structure": ("i", flag(f"{ND} > 0 AND length(path) < {ND} * 3 AND length(query) < {ND} * 2")),
    "component_count": ("i", "len(list_filter([scheme, netloc, path, query, fragment], lambda s: s <> ''))"),
    "component_diversity": ("i", "len(list_distinct([scheme, netloc, path, query]))"),
}


def _complexity(s: str) -> str:
    n = f"length({s})"
    return (f"(CASE WHEN {n} > 0 THEN least(100.0, {entropy(s)} * 10 + {ratio(f'len(list_distinct({chars(s)}))', n)} * 20 "
            f"+ {ratio(count_re(s, OTHER), n)} * 30) ELSE 0.0 END)")


def _grams(k: int) -> str:
    return f"list_transform(range(1, length(url) - {k - 2}), lambda i: substr(url, i, {k}))"


TRANSITIONS = "len(list_filter(range(1, length(netloc)), lambda i: abs(unicode(substr(netloc, i, 1)) - unicode(substr(netloc, i + 1, 1))) > 5))"
LENS = "list_filter([length(scheme), length(netloc), length(path), length(query), length(fragment)], lambda x: x > 0)"
VOW = count_re("netloc", "[aeiou]")
STATISTICS = {
    "most_common_char_freq": ("d", ratio(f"coalesce(list_max(list_transform(list_distinct({chars('url')}), lambda c: length(url) - length(replace(url, c, '')))), 0)", N)),
    "unique_chars_ratio": ("d", ratio(f"len(list_distinct({chars('url')}))", N)),
    "bigram_entropy": ("d", f"coalesce(list_entropy({_grams(2)}), 0.0)"), "trigram_entropy": ("d", f"coalesce(list_entropy({_grams(3)}), 0.0)"),
    "url_length_category": ("i", f"CASE WHEN {N} < 20 THEN 0 WHEN {N} < 40 THEN 1 WHEN {N} < 60 THEN 2 WHEN {N} < 80 THEN 3 ELSE 4 END"),
    "domain_length_category": ("i", f"CASE WHEN {ND} < 20 THEN 0 WHEN {ND} < 40 THEN 1 WHEN {ND} < 60 THEN 2 WHEN {ND} < 80 THEN 3 ELSE 4 END"),
    "vowel_to_consonant_ratio": ("d", f"CAST({VOW} AS DOUBLE) / greatest({count_re('netloc', chr(92) + 'p{L}')} - {VOW}, 1)"),
    "alpha_to_digit_ratio": ("d", f"CAST({count_re('url', chr(92) + 'p{L}')} AS DOUBLE) / greatest({count_re('url', chr(92) + 'p{Nd}')}, 1)"),
    "url_complexity_score": ("d", _complexity("url")), "domain_complexity_score": ("d", _complexity("netloc")),
    "has_repeating_pattern": ("i", flag(f"len(list_filter(range(2, {ND} // 2), lambda k: repeat(substr(netloc, 1, k), {ND} // k) = substr(netloc, 1, ({ND} // k) * k))) > 0")),
    "character_diversity": ("i", f"len(list_distinct({chars('url')}))"),
    "digit_distribution": ("d", r"len(list_distinct(regexp_extract_all(url, '\p{Nd}'))) / 10.0"),
    "special_char_diversity": ("i", f"len(list_distinct(regexp_extract_all(url, '{OTHER}')))"),
    "structural_entropy": ("d", f"coalesce(-list_sum(list_transform({LENS}, lambda x: x / list_sum({LENS}) * log2(x / list_sum({LENS})))), 0.0)"),
    "lexical_density": ("d", f"CAST({count_re('u', '[a-z]{3,}')} AS DOUBLE) / {CHUNKS}"),
    "unique_bigrams": ("i", f"len(list_distinct({_grams(2)}))"), "unique_trigrams": ("i", f"len(list_distinct({_grams(3)}))"),
    "char_transition_score": ("d", f"CASE WHEN {ND} >= 2 THEN CAST({TRANSITIONS} AS DOUBLE) / ({ND} - 1) ELSE 0.0 END"),
    "looks_random": ("i", flag(f"{entropy('netloc')} > 4.0 AND {ratio(VOW, ND)} < 0.2")),
}
B = arr(R.ULTRA_BRANDS)
CONTAINED = has_any(NAME, R.ULTRA_BRANDS)
# these DuckDB functions compare bytes: stand in one ASCII character for each non-ASCII one
FLAT = r"regexp_replace(domain_label, '[^\x00-\x7f]', '#', 'g')"
DISTS = f"list_transform({B}, lambda b: levenshtein({FLAT}, b))"
NEAREST = f"length({B}[list_position({DISTS}, list_min({DISTS}))])"
MIN = f"(CASE WHEN {CONTAINED} THEN 0 ELSE list_min({DISTS}) END)"
LOOKALIKE = {
    "typosquat_min_distance": ("i", MIN),
    "typosquat_distance_ratio": ("d", f"CASE WHEN {CONTAINED} THEN 0.0 ELSE list_min({DISTS}) / {NEAREST} END"),
    "typosquat_very_close": ("i", flag(f"{MIN} BETWEEN 1 AND 2")), "typosquat_close": ("i", flag(f"{MIN} BETWEEN 3 AND 4")),
    "has_homoglyph_chars": ("i", flag(rx(NAME, "[01l]"))),
    "has_double_letter": ("i", flag(" OR ".join(f"contains({NAME}, '{c * 2}')" for c in "abcdefghijklmnopqrstuvwxyz"))),
    "missing_letter": ("i", flag(f"len(list_filter({B}, lambda b: contains({NAME}, b[1:length(b) - 1]) OR contains({NAME}, b[2:]))) > 0")),
    "has_digit_substitution": ("i", flag(rx(NAME, "[a-z][0-9]|[0-9][a-z]"))), "common_substitutions": ("i", hits(NAME, "0134578")),
    "extra_hyphen": ("i", flag(f"contains({NAME}, '-')")),
    "brand_with_suffix": ("i", flag(f"len(list_filter({B}, lambda b: contains({NAME}, b || '1') OR contains({NAME}, b || '2'))) > 0")),
    "brand_jaro_similarity": ("d", f"list_max(list_transform({B}, lambda b: jaro_similarity({FLAT}, b)))"),
    "brand_jaro_winkler": ("d", f"list_max(list_transform({B}, lambda b: jaro_winkler_similarity({FLAT}, b)))"),
    "brand_keyword_combo": ("i", flag(f"{CONTAINED} AND {has_any(NAME, ['secure', 'login', 'verify', 'account'])}")),
    "confusable_chars_count": ("i", count_re(NAME, "[o0l1i]")),
    "brand_wrong_tld": ("i", flag(f"{CONTAINED} AND {ends_any('netloc', ['.tk', '.ml', '.ga', '.cf', '.gq', '.xyz'])}")),
    "likely_transposition": ("i", flag(has_any(NAME, ["teh", "hte", "adn", "nda", "taht", "thta"]))),
    "plural_variation": ("i", flag(has_any(NAME, [b + "s" for b in R.ULTRA_BRANDS]))),
    "repeated_brand_chars": ("i", f"len(list_filter({B}, lambda b: len(list_filter(string_split(b, ''), lambda c: contains({NAME}, c || c))) > 0))"),
}


def _prefixed(*specs: dict) -> dict:
    return {f"ultra_{k}": v for spec in specs for k, v in spec.items()}


ORACLES = {
    "ultra_basic_lexical": select_features(_prefixed(BASIC, LEXICAL), LOW, "q"),
    "ultra_domain": select_features(_prefixed(DOMAIN), LOW, "q"),
    "ultra_path_query": select_features(_prefixed(PATH_QUERY), LOW, "q"),
    "ultra_linguistic_behaviour": select_features(_prefixed(LINGUISTIC, BEHAVIOUR), LOW, "q"),
    "ultra_lookalike": select_features(LOOKALIKE, LOW, "q"),
    "ultra_obfuscation_complexity": select_features(_prefixed(OBFUSCATION, COMPLEXITY), LOW, "q"),
    "ultra_statistics": select_features(_prefixed(STATISTICS), LOW, "q"),
}
ORACLES["wide_feature_table"] = "SELECT * FROM " + " JOIN ".join(
    f"({select_features(_prefixed(*specs), LOW, 'q')}) t{i}" + (" USING (url_id)" if i else "") for i, specs in enumerate((
        (BASIC, LEXICAL), (DOMAIN, PATH_QUERY), (LINGUISTIC, BEHAVIOUR), (OBFUSCATION, COMPLEXITY), (STATISTICS,), (LOOKALIKE,))))
