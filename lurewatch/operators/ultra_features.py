"""Wide ("ultra") feature table: 194 columns per URL in ten families.

Each family stays below the code-generation column limit and is narrow; the
brand-distance family is computed once per distinct domain label and joined
back.  Deviations on purpose: the mixed-case flag looks at the raw host, the
always-zero "parameters in path" flag is dropped, and n-gram entropies are
entropies of n-grams (not of their concatenated characters).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.functions.profile import PROFILE, string_profile
from lurewatch.functions.similarity import best_jaro
from lurewatch.session import settle

ACTION, URGENCY, SENSITIVE = (refdata.ULTRA_WORDS[k].split() for k in ("action", "urgency", "sensitive"))
LETTER, DIGIT, OTHER = r"\p{L}", r"\p{Nd}", r"[^\p{L}\p{N}]"


def lowered(parts: DataFrame) -> DataFrame:
    """Parts with lower-cased components (``u`` = lower-cased URL); the raw host stays in ``raw_netloc``."""
    low = {c: F.lower(c) for c in ("netloc", "path", "query", "fragment")}
    out = parts.withColumn("raw_netloc", F.col("netloc")).withColumns(low).withColumn("u", F.lower("url"))
    # all character and n-gram numbers come from one pass (unused, it is pruned)
    return out.withColumn("profile", string_profile(F.col("url"), F.col("netloc"), F.col("path")))


def basic() -> dict[str, Column]:
    url, d, p, q = (F.col(c) for c in ("url", "netloc", "path", "query"))
    pairs = F.filter(F.split(q, "&"), lambda kv: kv.rlike(r"^[^=]*=."))
    return {
        "url_total_length": F.length(url), "domain_length": F.length(d), "path_length": F.length(p),
        "query_length": F.length(q), "fragment_length": F.length("fragment"),
        "is_https": X.flag(F.col("scheme") == "https"), "has_www": X.flag(F.contains(d, F.lit("www."))),
        "subdomain_count": F.greatest(F.lit(0), X.count_of(d, ".") - 1), "path_depth": X.count_re(p, "[^/]+"),
        "query_params_count": F.size(F.array_distinct(F.transform(pairs, lambda kv: F.substring_index(kv, "=", 1)))),
        "has_fragment": X.flag(F.col("fragment") != ""), "uses_standard_port": X.flag(~F.contains(d, F.lit(":"))),
        "has_at_symbol": X.flag(F.contains(url, F.lit("@"))),
        "domain_has_ip": X.flag(d.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")),
        "url_shortener": X.flag(X.any_of("netloc", refdata.ULTRA_SHORTENERS)), "domain_dots_count": X.count_of(d, "."),
        "path_slashes_count": X.count_of(p, "/"), "query_ampersands_count": X.count_of(q, "&"),
        "total_special_chars": X.count_re(url, OTHER), "scheme_length": F.length("scheme"),
    }


def lexical() -> dict[str, Column]:
    url, d, p = F.col("url"), F.col("netloc"), F.col("path")
    n, nd = F.length(url), F.length(d)
    return {
        "digit_ratio_url": X.ratio(X.count_re(url, DIGIT), n), "letter_ratio_url": X.ratio(X.count_re(url, LETTER), n),
        "uppercase_ratio": X.ratio(X.count_re(url, r"\p{Lu}"), n), "special_ratio": X.ratio(X.count_re(url, OTHER), n),
        "domain_digit_ratio": X.ratio(X.count_re(d, DIGIT), nd), "domain_hyphen_ratio": X.ratio(X.count_of(d, "-"), nd),
        "domain_underscore_ratio": X.ratio(X.count_of(d, "_"), nd),
        "max_char_repeat": F.col("profile.url_run"), "domain_max_char_repeat": F.col("profile.host_run"),
        "max_consecutive_digits": X.longest_run(url, r"\p{Nd}+"), "max_consecutive_letters": X.longest_run(url, r"\p{L}+"),
        "max_consecutive_consonants": X.longest_run(d, r"[\p{L}&&[^aeiou]]+"),
        "hex_percent_encoding_count": X.count_of(url, "%"), "has_excessive_encoding": X.flag(X.count_of(url, "%") > 3),
        "dots_count": X.count_of(url, "."), "hyphens_count": X.count_of(url, "-"), "underscores_count": X.count_of(url, "_"),
        "equals_count": X.count_of(url, "="), "question_marks_count": X.count_of(url, "?"),
        "ampersands_count": X.count_of(url, "&"),
        "has_tilde": X.flag(F.contains(url, F.lit("~"))), "has_pipe": X.flag(F.contains(url, F.lit("|"))),
        "url_entropy": F.col("profile.url_entropy"), "domain_entropy": F.col("profile.host_entropy"), "path_entropy": F.col("profile.path_entropy"),
        "domain_to_url_ratio": X.ratio(nd, n), "path_to_url_ratio": X.ratio(F.length(p), n),
        "query_to_url_ratio": X.ratio(F.length("query"), n),
    }


def domain() -> dict[str, Column]:
    d, name, sfx, sub = (F.col(c) for c in ("netloc", "domain_label", "suffix", "subdomain"))
    words = X.tokens(name, "[a-z]+")
    runs = X.tokens(name, r"[\p{L}&&[^aeiou]]{3,}")
    return {
        "tld_length": F.length(sfx), "has_country_tld": X.flag(F.length(sfx) == 2), "tld_is_com": X.flag(sfx == "com"),
        "tld_is_suspicious": X.flag(sfx.isin(refdata.TLD_CATEGORIES["free_suspicious"])),
        "domain_word_count": F.size(words), "domain_has_brand_name": X.flag(X.any_of("domain_label", refdata.ULTRA_BRANDS)),
        "domain_vowel_ratio": X.ratio(X.count_re(name, "[aeiou]"), F.length(name)),
        "domain_consonant_clusters": X.sum_len(runs) - F.size(runs) * 2,
        "has_subdomain": X.flag(sub != ""), "subdomain_length": F.length(sub),
        "subdomain_levels": F.when(sub == "", F.lit(0)).otherwise(X.count_of(sub, ".") + 1),
        "subdomain_has_keyword": X.flag(X.any_of("subdomain", ["secure", "login", "verify"])),
        "domain_contains_hyphen": X.flag(F.contains(name, F.lit("-"))),
        "domain_starts_with_digit": X.flag(name.rlike(r"^\p{Nd}")), "domain_ends_with_digit": X.flag(name.rlike(r"\p{Nd}$")),
        "domain_has_doubled_chars": X.flag(name.rlike(r"(.)\1{2,}")),
        "domain_number_letter_transitions": X.count_re(name, "[0-9][a-z]|[a-z][0-9]"),
        "domain_longest_word_length": X.max_len(words),
        "domain_average_word_length": X.ratio(X.sum_len(words), F.size(words)),
        "registered_domain_length": F.length("registered_domain"),
        "fqdn_length": F.when(F.col("registered_domain") == "", F.lit(0)).otherwise(F.length("host")),
        "has_punycode": X.flag(F.contains(d, F.lit("xn--"))), "punycode_segments": X.count_of(d, "xn--"),
        "resembles_ip": X.flag(d.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
    }


def path_query() -> dict[str, Column]:
    p, q = F.col("path"), F.col("query")
    amps = X.count_of(q, "&")
    return {
        "path_segments_count": X.count_re(p, "[^/]+"), "path_has_extension": X.flag(p.rlike(r"\.[a-z]{2,4}$")),
        "path_suspicious_extension": X.flag(p.rlike(r"\.(exe|zip|rar|scr|bat|cmd|vbs)$")),
        "path_double_extension": X.flag((X.count_of(p, ".") > 1) & ~F.endswith(p, F.lit(".html"))),
        "path_longest_segment": X.longest_run(p, "[^/]+"),
        "query_has_url": X.flag(q.rlike("https?://")),
        "query_suspicious_params": X.hits_of("query", ["redirect", "url", "next", "continue", "return"]),
        "query_has_base64": X.flag((F.length(q) > 20) & q.rlike(r"^[A-Za-z0-9+/]+=*$")),
        "path_percent_encoded": X.count_of(p, "%"), "query_percent_encoded": X.count_of(q, "%"),
        "path_file_indicators": X.hits_of("path", [".php", ".asp", ".jsp", ".cgi"]),
        **{f"path_has_{w}": X.flag(F.contains(p, F.lit(w))) for w in ("login", "admin", "verify", "account")},
        "query_equals_to_ampersand_ratio": X.ratio(X.count_of(q, "="), amps),
        "query_longest_value": X.max_len(F.regexp_extract_all(q, F.lit("=([^&]*)"), F.lit(1))),
        "path_digit_ratio": X.ratio(X.count_re(p, DIGIT), F.length(p)),
        "path_special_char_ratio": X.ratio(X.count_re(p, r"[^\p{L}\p{N}/.?]"), F.length(p)),
    }


def linguistic() -> dict[str, Column]:
    u, d, p = F.col("u"), F.col("netloc"), F.col("path")
    first = F.substring_index(d, ".", 1)
    act, urg, sen, brand = (X.any_of("u", w) for w in (ACTION, URGENCY, SENSITIVE, refdata.ULTRA_BRANDS))
    http = F.col("scheme") == "http"
    words = X.count_re(u, r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])")
    return {
        "has_action_words": X.hits_of("u", ACTION), "action_word_in_domain": X.flag(X.any_of("netloc", ACTION)),
        "has_urgency_words": X.hits_of("u", URGENCY), "urgency_in_path": X.flag(X.any_of("path", URGENCY)),
        "has_sensitive_words": X.hits_of("u", SENSITIVE), "sensitive_in_domain": X.flag(X.any_of("netloc", SENSITIVE)),
        "brand_mention_count": X.hits_of("u", refdata.ULTRA_BRANDS),
        "brand_in_subdomain": X.flag(X.any_of("substring_index(netloc, '.', 1)", refdata.ULTRA_BRANDS)),
        "action_plus_urgency": X.flag(act & urg), "brand_plus_action": X.flag(brand & act),
        "sensitive_plus_action": X.flag(sen & act),
        "has_login_keywords": X.flag(X.any_of("u", ["login", "signin", "sign-in"])),
        "has_verify_keywords": X.flag(X.any_of("u", ["verify", "validation", "confirm"])),
        "has_security_keywords": X.flag(X.any_of("u", ["secure", "security", "protect"])),
        "has_update_keywords": X.flag(X.any_of("u", ["update", "upgrade", "renew"])),
        "security_action_combo": X.flag(X.any_of("u", ["secure", "security"]) & X.any_of("u", ["login", "verify", "update"])),
        "readable_words_count": words, "readable_words_ratio": X.ratio(words, F.greatest(X.count_re(u, r"\S+"), F.lit(1))),
        "has_mixed_case_domain": X.flag(F.col("raw_netloc") != d),
        "has_suspended_terms": X.flag(X.any_of("u", ["suspend", "locked", "blocked", "frozen"])),
        "has_restore_terms": X.flag(X.any_of("u", ["restore", "recover", "unlock", "reactivate"])),
        "has_billing_terms": X.flag(X.any_of("u", ["billing", "payment", "invoice", "charge"])),
        "fake_https_in_domain": X.flag(F.contains(d, F.lit("https")) & http),
        "secure_in_http_url": X.flag(F.contains(u, F.lit("secure")) & http),
    }


def behaviour() -> dict[str, Column]:
    u, q = F.col("u"), F.col("query")
    signals = [["password", "login"], ["urgent", "expire"], ["verify", "confirm"], ["suspend", "lock", "block"],
               ["update", "renew", "restore"]]
    return {
        "requests_credentials": X.flag(X.any_of("u", ["password", "login", "signin", "auth"])),
        "promises_reward": X.flag(X.any_of("u", ["free", "win", "prize", "gift", "bonus"])),
        "creates_urgency": X.flag(X.any_of("u", ["urgent", "expire", "limited", "now", "today"])),
        "impersonates_authority": X.flag(X.any_of("u", ["gov", "official", "legal", "court", "police"])),
        "financial_focus": X.flag(X.any_of("u", ["bank", "credit", "payment", "billing", "money"])),
        "suspicious_behavior_score": reduce(lambda a, b: a + b, [X.flag(X.any_of("u", s)) for s in signals]),
        "tech_support_scam": X.flag(X.any_of("u", ["support", "help", "error", "warning", "virus"])),
        "account_threat": X.flag(X.any_of("u", ["suspend", "lock", "close", "terminate"])),
        "data_harvest": X.flag(X.any_of("u", ["verify", "confirm", "update", "validate"])
                               & X.any_of("u", ["account", "profile", "info"])),
        "redirect_to_external": X.flag(F.contains(q, F.lit("redirect")) & F.contains(q, F.lit("http"))),
    }


def obfuscation() -> dict[str, Column]:
    u, d, p, q = (F.col(c) for c in ("u", "netloc", "path", "query"))
    return {
        "has_decimal_ip": X.flag(d.rlike("[0-9]{8,}")), "has_hex_ip": X.flag(u.rlike("0x[0-9a-f]+")),
        "has_octal_ip": X.flag(d.rlike("0[0-7]+")), "excessive_encoding": X.flag(X.count_of(u, "%") > 5),
        "encoded_slashes": X.flag(X.any_of("u", ["%2f", "%5c"])), "encoded_dots": X.flag(F.contains(u, F.lit("%2e"))),
        "double_encoding": X.flag(F.contains(u, F.lit("%25"))), "has_unicode": X.flag(F.col("url").rlike(r"[^\x00-\x7f]")),
        "zero_width_chars": X.flag(F.col("url").rlike("[​‌‍⁠]")),
        "has_redirect_param": X.flag(X.any_of("query", ["redirect", "url", "goto", "next", "continue", "return", "redir"])),
        "suspicious_redirect": X.flag(q.rlike("(redirect|url|goto)=https?://")),
        "data_uri": X.flag(F.contains(u, F.lit("data:"))), "javascript_uri": X.flag(F.contains(u, F.lit("javascript:"))),
        "path_traversal": X.flag(X.any_of("path", ["../", "..\\"])), "excessive_slashes": X.flag(F.contains(p, F.lit("//"))),
    }


def _complexity(s: Column, entropy: Column, distinct: Column) -> Column:
    n = F.length(s)
    score = entropy * 10 + X.ratio(distinct, n) * 20 + X.ratio(X.count_re(s, OTHER), n) * 30
    return F.when(n > 0, F.least(F.lit(100.0), score)).otherwise(F.lit(0.0))


def statistics() -> dict[str, Column]:
    url, d, u = F.col("url"), F.col("netloc"), F.col("u")
    n, nd, prof = F.length(url), F.length(d), {c.split()[0]: F.col(f"profile.{c.split()[0]}") for c in PROFILE.split(", ")}
    distinct = prof["url_distinct"]
    lengths = [F.length(c) for c in ("scheme", "netloc", "path", "query", "fragment")]
    total = reduce(lambda a, b: a + b, lengths)
    structural = reduce(lambda a, b: a + b, [
        F.when(ln > 0, -(ln / total) * F.log2(ln / total)).otherwise(F.lit(0.0)) for ln in lengths])
    vowels = X.count_re(d, "[aeiou]")
    return {
        "most_common_char_freq": X.ratio(prof["url_top"], n), "unique_chars_ratio": X.ratio(distinct, n),
        "bigram_entropy": prof["bigram_entropy"], "trigram_entropy": prof["trigram_entropy"],
        "url_length_category": X.length_band(n), "domain_length_category": X.length_band(nd),
        "vowel_to_consonant_ratio": vowels.cast("double") / F.greatest(X.count_re(d, LETTER) - vowels, F.lit(1)),
        "alpha_to_digit_ratio": X.count_re(url, LETTER).cast("double") / F.greatest(X.count_re(url, DIGIT), F.lit(1)),
        "url_complexity_score": _complexity(url, prof["url_entropy"], distinct), "domain_complexity_score": _complexity(d, prof["host_entropy"], prof["host_distinct"]),
        "has_repeating_pattern": X.flag(prof["host_repeats"]), "character_diversity": distinct,
        "digit_distribution": F.size(F.array_distinct(X.tokens(url, DIGIT))) / 10.0,
        "special_char_diversity": F.size(F.array_distinct(X.tokens(url, OTHER))),
        "structural_entropy": F.when(total > 0, structural).otherwise(F.lit(0.0)),
        "lexical_density": X.count_re(u, "[a-z]{3,}").cast("double") / F.greatest(X.count_re(url, r"\S+"), F.lit(1)),
        "unique_bigrams": prof["bigrams"], "unique_trigrams": prof["trigrams"],
        "char_transition_score": X.ratio(prof["host_jumps"], nd - 1),
        "looks_random": X.flag((prof["host_entropy"] > 4.0) & (X.ratio(vowels, nd) < 0.2)),
    }


def complexity() -> dict[str, Column]:
    url, d, p, q = (F.col(c) for c in ("url", "netloc", "path", "query"))
    toks = X.tokens(url, r"[\p{L}\p{N}_]+")
    n_lab = X.count_of(d, ".") + 1
    seps = X.count_re(url, r"[./\-_?&=]")
    comp = [F.col(c) for c in ("scheme", "netloc", "path", "query", "fragment")]
    tld = F.substring_index(d, ".", -1)
    return {
        "total_tokens": F.size(toks), "avg_token_length": X.ratio(X.sum_len(toks), F.size(toks)),
        "max_token_length": X.max_len(toks), "min_token_length": X.min_len(toks),
        "nested_subdomains": n_lab - 2, "path_nesting_level": X.count_re(p, "[^/]+"),
        "total_separators": seps, "separator_density": X.ratio(seps, F.length(url)),
        "url_structure_score": F.when(F.col("scheme") == "https", 10.0).otherwise(0.0) + F.when(d != "", 20.0).otherwise(0.0)
        + F.when(n_lab >= 2, 20.0).otherwise(0.0) + F.when(F.length(p) > 1, 15.0).otherwise(0.0),
        "domain_structure_score": F.when(n_lab >= 2, 20.0).otherwise(0.0) + F.when(n_lab.isin(2, 3), 20.0).otherwise(0.0)
        + F.when(~tld.rlike(DIGIT), 10.0).otherwise(0.0),
        "has_file_extension": X.flag(p.rlike(r"\.[a-z]{2,4}$")),
        "suspicious_file_ext": X.flag(p.rlike(r"\.(php|asp|jsp|cgi|exe|zip)$")),
        "balanced_structure": X.flag((F.length(d) > 0) & (F.length(p) < F.length(d) * 3) & (F.length(q) < F.length(d) * 2)),
        "component_count": reduce(lambda a, b: a + b, [X.flag(c != "") for c in comp]),
        "component_diversity": F.size(F.array_distinct(F.array(
            F.col("scheme"), d, p, q))),
    }


def lookalike_labels(labels: DataFrame, brands: list[str] = refdata.ULTRA_BRANDS) -> DataFrame:
    """Brand-distance features of distinct domain labels (column ``domain_label``)."""
    s = F.col("domain_label")
    contained = X.any_of("domain_label", brands)
    # the nearest brand, first in list order on ties; a contained brand counts as distance 0
    nearest = F.expr("least(" + ", ".join(
        f"struct(levenshtein(domain_label, '{b}') AS dist, {i} AS pos, {len(b)} AS len)" for i, b in enumerate(brands)) + ")")
    doubled = F.array_join(F.array_distinct(F.regexp_extract_all(s, F.lit(r"([a-z])\1"), F.lit(1))), "")
    labels = settle(labels.select("domain_label", nearest.alias("nearest"), doubled.alias("doubled")), ["nearest", "doubled"])
    dist, length = F.col("nearest.dist"), F.col("nearest.len")
    low = F.when(contained, F.lit(0)).otherwise(dist)
    sims = best_jaro(s, brands)
    cols = {
        "typosquat_min_distance": low,
        "typosquat_distance_ratio": F.when(contained, F.lit(0.0)).otherwise(dist.cast("double") / length),
        "typosquat_very_close": X.flag((low > 0) & (low <= 2)), "typosquat_close": X.flag((low > 2) & (low <= 4)),
        "has_homoglyph_chars": X.flag(s.rlike("[01l]")), "has_double_letter": X.flag(s.rlike(r"([a-z])\1")),
        "missing_letter": X.flag(X.any_of("domain_label", [b[:-1] for b in brands] + [b[1:] for b in brands])),
        "has_digit_substitution": X.flag(s.rlike("[a-z][0-9]|[0-9][a-z]")), "common_substitutions": X.hits_of("domain_label", "0134578"),
        "extra_hyphen": X.flag(F.contains(s, F.lit("-"))),
        "brand_with_suffix": X.flag(X.any_of("domain_label", [b + x for b in brands for x in "12"])),
        "brand_keyword_combo": X.flag(contained & X.any_of("domain_label", ["secure", "login", "verify", "account"])),
        "confusable_chars_count": X.count_re(s, "[o0l1i]"), "brand_contained": X.flag(contained),
        "likely_transposition": X.flag(X.any_of("domain_label", ["teh", "hte", "adn", "nda", "taht", "thta"])),
        "plural_variation": X.flag(X.any_of("domain_label", [b + "s" for b in brands])),
        "repeated_brand_chars": F.expr(" + ".join(
            f"CAST(length(translate('{b}', doubled, '')) < {len(b)} AS INT)" for b in brands)),
    }
    out = labels.select("domain_label", *[c.alias(n) for n, c in cols.items()])
    return out.withColumn("sims", sims).withColumns({
        "brand_jaro_similarity": F.col("sims.jaro"), "brand_jaro_winkler": F.col("sims.jaro_winkler")}).drop("sims")


def lookalike(parts: DataFrame, brands: list[str] = refdata.ULTRA_BRANDS) -> DataFrame:
    """Brand-distance family per URL: once per distinct domain label, joined back on the label."""
    low = parts.select("url_id", "domain_label", F.lower("netloc").alias("d"))
    per = lookalike_labels(low.select("domain_label").distinct(), brands)
    bad = X.ends_with_any("d", [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"])
    return (low.join(per, "domain_label")
            .withColumn("brand_wrong_tld", X.flag((F.col("brand_contained") == 1) & bad))
            .drop("domain_label", "d", "brand_contained"))


FAMILIES = {
    "basic": basic, "lexical": lexical, "domain": domain, "path_query": path_query, "linguistic": linguistic,
    "behaviour": behaviour, "obfuscation": obfuscation, "statistics": statistics, "complexity": complexity,
}


def family(parts: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``url_id``, the columns ``keep`` of ``parts``, and the columns of the named families (prefix ``ultra_``)."""
    cols = {n: c for f in names for n, c in FAMILIES[f]().items()}
    return lowered(parts).select("url_id", *keep, *[c.alias(f"ultra_{n}") for n, c in cols.items()])


def ultra_features(parts: DataFrame) -> DataFrame:
    """All families in one row per URL.

    The narrow families are stacked projections (two of them, each under the
    code-generation column limit); only the look-alike family adds a join.
    """
    low = lowered(parts)
    first = {n: c for f in ("basic", "lexical", "domain", "path_query") for n, c in FAMILIES[f]().items()}
    rest = {n: c for f in ("linguistic", "behaviour", "obfuscation", "statistics", "complexity") for n, c in FAMILIES[f]().items()}
    out = low.select("url_id", "url", "domain_label", "netloc",
                     *[c.alias(f"ultra_{n}") for n, c in {**first, **rest}.items()])
    sims = lookalike_labels(parts.select("domain_label").distinct())
    sims = sims.select("domain_label", *[F.col(c).alias(f"ultra_{c}") for c in sims.columns if c != "domain_label"])
    bad = X.ends_with_any("netloc", [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"])
    return (out.join(sims, "domain_label")
            .withColumn("ultra_brand_wrong_tld", X.flag((F.col("ultra_brand_contained") == 1) & bad))
            .drop("domain_label", "netloc", "ultra_brand_contained"))


def all_features(parts: DataFrame) -> DataFrame:
    """Base and wide features side by side, one row per URL (one narrow pass plus the look-alike join)."""
    from lurewatch.operators import base_features as B

    cols: dict[str, Column] = {}
    for fam in (B.lexical_columns(), B.structural_columns(), B.advanced_columns(), B.statistical_columns(), B.pattern_columns(),
                B.impersonation_columns()):
        cols.update(fam)
    homo = B.homograph_columns()
    cols.update({n: homo[n] for n in ("idn_homograph_score", "is_idn_homograph")})
    # stacked projections: base columns see the raw host, wide columns the lower-cased one
    step = parts.select("url_id", "url", "scheme", "netloc", "path", "query", "fragment", "host", "suffix", "subdomain",
                        "registered_domain", "domain_label", *[c.alias(f"base_{n}") for n, c in cols.items()])
    low = lowered(step)
    wide = {n: c for f in FAMILIES for n, c in FAMILIES[f]().items()}
    out = low.select("url_id", "domain_label", "netloc", *[F.col(f"base_{n}").alias(n) for n in cols],
                     *[c.alias(f"ultra_{n}") for n, c in wide.items()])
    sims = lookalike_labels(parts.select("domain_label").distinct())
    sims = sims.select("domain_label", *[F.col(c).alias(f"ultra_{c}") for c in sims.columns if c != "domain_label"])
    bad = X.ends_with_any("netloc", [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"])
    return (out.join(sims, "domain_label")
            .withColumn("ultra_brand_wrong_tld", X.flag((F.col("ultra_brand_contained") == 1) & bad))
            .drop("domain_label", "netloc", "ultra_brand_contained"))
