"""Rule scores: validity and garbage, pattern score, signature score, threat indicators, risk-factor codes.

All rules are weighted predicates over the URL parts, so one narrow projection
scores a URL; reference lists enter as literals while they are short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.functions.urlparts import IPV4_RE
from lurewatch.operators.containment import containment_weights, rule_points
from lurewatch.session import LITERAL_LIST_MAX, settle, sized_broadcast


def codes(*pairs: tuple[Column, str]) -> Column:
    """Ordered array of the codes whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def points(*pairs: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in pairs])


def first_of(conditions: dict[str, str]) -> Column:
    """First name, in order, whose SQL condition holds."""
    return F.expr("CASE " + " ".join(f"WHEN {c} THEN {X.sql_text(n)}" for n, c in conditions.items()) + " END")


# --- validity ---------------------------------------------------------------

def with_validity(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``fixed_url`` (trimmed, ``http://`` added when the scheme is missing), ``is_valid``, ``issues`` (codes).

    Split the result on ``is_valid`` for the valid and the quarantined output.
    """
    u = F.trim(F.col(url))
    fixed = F.when(u.rlike("^(http|https|ftp)://"), u).otherwise(F.concat(F.lit("http://"), u))
    df = urls.withColumn("fixed_url", fixed)
    rest = F.regexp_replace("fixed_url", "^[a-z]+://", "")
    netloc = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    v6 = netloc.rlike(r"^\[[0-9a-fA-F:.]+\](:[0-9]+)?$")
    host = F.when(v6, F.lit("v6")).otherwise(F.substring_index(netloc, ":", 1))
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    bad_ip = host.rlike(r"^[0-9.]+$") & ~((F.size(octets) == 4) & F.forall(octets, lambda o: o.isNotNull() & (o <= 255)))
    issues = F.when(F.col(url).isNull() | (u == ""), F.array(F.lit("empty"))).when(
        F.length(u) < 4, F.array(F.lit("too_short"))).otherwise(codes(
            (netloc == "", "missing_domain"), (F.contains(host, F.lit(" ")), "space_in_domain"),
            (host.rlike(r"""[<>"'{}|\\^`\[\]]"""), "bad_character"), (F.contains(host, F.lit("..")), "double_dot"),
            (bad_ip, "bad_ip"), (F.contains(path, F.lit("\x00")), "null_byte")))
    return df.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def garbage_terms(name: Column) -> list[tuple[Column, int, str]]:
    low = F.lower(name)
    n = F.length(name)
    vowels, letters = X.count_re(low, "[aeiou]"), X.count_re(low, r"\p{L}")
    return [
        ((vowels == 0) & (n > 4), 30, "no_vowels"),
        ((vowels > 0) & (letters - vowels > vowels * 5), 20, "many_consonants"),
        ((n > 0) & (X.count_re(name, r"\p{Nd}") * 10 > n * 4), 25, "many_digits"),
        (X.hits_of("domain_label", refdata.ODD_BIGRAMS) >= 2, 20, "odd_bigrams"),
        ((n > 0) & ((X.count_of(name, "-") + X.count_of(name, "_")) * 10 > n * 3), 15, "many_separators"),
        ((n > 10) & ~low.rlike("[a-z]{3,}"), 15, "no_words"),
        (X.any_of("domain_label", refdata.KEYBOARD_WALKS), 35, "keyboard_walk"),
        (X.entropy(name) > 4.0, 10, "high_entropy"),
    ]


def with_tld(df: DataFrame, tld: Column, tlds: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``columns`` of the user's TLD table (one row per TLD counts), NULL where it does not list the TLD."""
    rows = tlds.groupBy("tld").agg(*[F.max(c).alias(f"_{c}") for c in columns]).withColumnRenamed("tld", "_tld")
    return df.withColumn("_key", tld).join(sized_broadcast(rows, probe=tlds), F.col("_key") == F.col("_tld"), "left").drop("_key", "_tld")


def garbage_score(parts: DataFrame, tlds: DataFrame | None = None) -> DataFrame:
    """TLD validity and the garbage score of the domain label: ``tld_valid, tld_category, garbage_score, is_garbage``.

    ``tlds`` (``tld, category, is_valid``) replaces the listed TLDs.
    """
    terms = garbage_terms(F.col("domain_label"))
    tld = F.lower("tld")
    category = F.when(F.col("is_ip"), F.lit("ip")).when(tld == "", F.lit("none"))
    if tlds is not None:
        known = F.coalesce(F.col("_is_valid"), F.lit(False))
        category = category.otherwise(F.coalesce("_category", F.lit("unknown")))
        parts = with_tld(parts, tld, tlds, ["category", "is_valid"])
    else:
        known = tld.isin(refdata.VALID_TLDS)
        for name, listed in refdata.TLD_CATEGORIES.items():
            category = category.when(tld.isin(listed), F.lit(name))
        category = category.when(known, F.lit("valid")).otherwise(F.lit("unknown"))
    score = F.when(F.col("domain_label") == "", F.lit(100)).otherwise(points(*[(c, w) for c, w, _ in terms]))
    reasons = F.when(F.col("domain_label") == "", F.array(F.lit("empty_domain"))).otherwise(codes(*[(c, r) for c, _, r in terms]))
    return parts.select(
        "*", (F.col("is_ip") | known).alias("tld_valid"), category.alias("tld_category"),
        score.alias("garbage_score"), reasons.alias("garbage_reasons")).withColumn("is_garbage", F.col("garbage_score") >= 50).drop("_category", "_is_valid")


# --- pattern score ----------------------------------------------------------

def with_keywords(base: DataFrame, lexicon: DataFrame | None, default: list[tuple[str, float]], scale: int = 1,
                  literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """Add ``n_kw, kw, kw_max``: number, sum and maximum of the weights (times ``scale``, whole) of the terms in ``u``.

    ``lexicon``: a user table ``term, weight``.  Up to ``literal_max`` terms enter as literals, more meet the URLs in a
    containment join.
    """
    pairs = [(t, int(round(w * scale))) for t, w in default]
    if lexicon is not None:
        whole = lexicon.groupBy("term").agg(F.max(F.round(F.col("weight") * scale).cast("int")).alias("weight"))
        rows = whole.limit(literal_max + 1).collect()
        if len(rows) > literal_max:
            hits = containment_weights(base, "url_id", "u", whole, literal_max).select(
                "url_id", F.col("n_terms").cast("int").alias("n_kw"), F.col("sum_weight").cast("int").alias("kw"), F.col("max_weight").cast("int").alias("kw_max"))
            return base.join(hits, "url_id", "left").fillna(0, ["n_kw", "kw", "kw_max"])
        pairs = sorted((r.term, r.weight) for r in rows)
    return base.withColumns({"n_kw": X.hits_of("u", [t for t, _ in pairs]), "kw": X.weight_of("u", pairs), "kw_max": X.max_weight_of("u", [*pairs, ("", 0), ("", 0)])})


def with_rules(base: DataFrame, rules: DataFrame, literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """Add ``n_rules, rule_points, rule_ids`` of the user's regexes (``rule_id, regex, weight``) that occur in ``u``.

    Each distinct text is matched once and meets the rows again by its text.
    """
    found = rule_points(base.select("u").distinct(), "u", "u", rules, literal_max)
    none = F.array().cast("array<string>")
    return base.join(found, "u", "left").withColumns({
        "n_rules": F.coalesce("n_rules", F.lit(0)), "rule_points": F.coalesce("rule_points", F.lit(0)), "rule_ids": F.coalesce("rule_ids", none)})


def pattern_score(parts: DataFrame, lexicon: DataFrame | None = None, literal_max: int = LITERAL_LIST_MAX, keep: tuple[str, ...] = (),
                  rules: DataFrame | None = None) -> DataFrame:
    """Ten additive rule groups, capped at 100, with bands 10/15/30/50 and ordered reason codes.

    ``lexicon`` (``term, weight``) replaces the default keywords, ``rules`` (``rule_id, regex, weight``) the default regexes on
    the lower-cased URL (their ids are reason codes, in ascending order); the columns ``keep`` of ``parts`` come along.
    """
    base = parts.select("url_id", "url", "scheme", F.lower("netloc").alias("d"), F.lower("path").alias("p"),
                        F.lower("url").alias("u"), *keep)
    d, p, u = F.col("d"), F.col("p"), F.col("u")
    tlds = refdata.PATTERN_TLDS
    base = base.withColumns({
        "first": F.substring_index(d, ".", 1), "n_lab": X.count_of(d, ".") + 1, "hyphens": X.count_of(d, "-"),
        "brand": first_of({b: f"contains(d, '{b}') OR contains(p, '{b}')" for b in refdata.PATTERN_BRANDS}),
        "tld_risk": X.points_by("substring_index(d, '.', -1)", tlds),
        "sub": F.expr("CASE WHEN length(d) - length(replace(d, '.', '')) >= 2 THEN left(d, length(d) - length(substring_index(d, '.', -2)) - 1) ELSE '' END"),
    })
    base = with_keywords(base, lexicon, refdata.PATTERN_KEYWORDS, literal_max=literal_max)
    own_rules = ["rule_points", "rule_ids"] if rules is not None else []
    if rules is not None:
        base = with_rules(base, rules, literal_max).drop("n_rules")
    base = settle(base, ["d", "p", "u", "first", "n_lab", "hyphens", "brand", "n_kw", "kw", "tld_risk", "sub", *own_rules])
    first, brand, n_lab, hyphens, sub = (F.col(c) for c in ("first", "brand", "n_lab", "hyphens", "sub"))
    has_brand = brand.isNotNull()
    own = (d == F.concat(brand, F.lit(".com"))) | (d == F.concat(F.lit("www."), brand, F.lit(".com")))
    official = own | reduce(lambda a, b: a | b, [d == F.concat(brand, F.lit(x)) for x in (".co.uk", ".net", ".org")])
    in_domain = F.coalesce(F.contains(d, brand) & ~own, F.lit(False))
    in_first = F.coalesce(F.contains(first, brand), F.lit(False))
    brand_risk = F.when(in_domain, F.when(X.any_of("d", refdata.PATTERN_DOMAIN_WORDS), 25)
                        .when(F.contains(d, F.lit("-")) & in_first, 20).when(in_first, 15).otherwise(0)
                        + F.when(~official, 10).otherwise(0)).otherwise(0)
    mixed = first.rlike("[a-z][0-9]|[0-9][a-z]") & ~X.any_of("first", refdata.PATTERN_BRANDS)
    http = F.col("scheme") == "http"
    sensitive_http = X.any_of("u", refdata.PATTERN_HTTP_WORDS)
    sub_word = X.any_of("sub", refdata.PATTERN_SUBDOMAIN_WORDS)
    numeric_sub = sub.rlike(r"(^|\.)[0-9]+(\.|$)")
    shortener = X.any_of("d", refdata.PATTERN_SHORTENERS)
    real_path = ~p.isin("", "/")
    path_word = real_path & X.any_of("p", refdata.PATTERN_PATH_WORDS)
    rx = [] if own_rules else [(r, u.rlike(pattern), w) for r, pattern, w in refdata.PATTERN_REGEXES]
    auth = has_brand & X.any_of("u", refdata.PATTERN_AUTH_WORDS) & in_first
    bad_combo = has_brand & (F.col("n_kw") >= 2) & (F.col("tld_risk") >= 3)
    urgent = X.any_of("u", refdata.PATTERN_URGENCY_WORDS) & X.any_of("u", refdata.PATTERN_SENSITIVE_WORDS)
    executable = real_path & X.ends_with_any("p", refdata.PATTERN_BAD_EXTENSIONS)
    encoded, long_path = real_path & (X.count_of(p, "%") > 3), real_path & (F.length(p) > 100)
    dots, random = real_path & (X.count_of(p, ".") > 2), real_path & p.rlike("[a-z0-9]{30,}")
    many_hyphens = F.when(hyphens >= 3, hyphens * 3).when(hyphens == 2, F.lit(4)).otherwise(F.lit(0))
    score = (brand_risk + F.col("kw") + F.when(F.col("n_kw") >= 3, 10).otherwise(0) + many_hyphens + F.col("tld_risk")
             + points((n_lab > 3, 5), (F.length(first) > 30, 5), (mixed, 3), *[(c, w) for _, c, w in rx],
                      (http & sensitive_http, 15), (http & ~sensitive_http, 5), (sub_word & has_brand, 15),
                      (sub_word & ~has_brand, 8), ((sub != "") & (n_lab > 4), 10), (numeric_sub, 5), (shortener, 8),
                      (executable, 20), (encoded, 10), (long_path, 8), (path_word & has_brand, 12),
                      (path_word & ~has_brand, 5), (dots, 15), (random, 6), (bad_combo, 30), (auth, 25), (urgent, 20)))
    first_reasons = (
        (brand_risk > 0, "brand_context"), (F.col("n_kw") >= 3, "many_keywords"),
        (F.col("n_kw").isin(1, 2), "keywords"), (n_lab > 3, "many_subdomains"), (hyphens >= 3, "many_hyphens"),
        (F.length(first) > 30, "long_label"), (mixed, "digit_letter_mix"), (F.col("tld_risk") > 0, "bad_tld"),
        *[(c, r) for r, c, _ in rx])
    last_reasons = ((http & sensitive_http, "sensitive_http"), (http & ~sensitive_http, "plain_http"),
        (sub_word, "subdomain_word"), ((sub != "") & (n_lab > 4), "deep_subdomain"), (numeric_sub, "numeric_subdomain"),
        (shortener, "shortener"), (executable, "executable_path"), (encoded, "encoded_path"), (long_path, "long_path"),
        (path_word & has_brand, "sensitive_path"), (dots, "many_extensions"), (random, "random_path"),
        (bad_combo, "brand_keywords_bad_tld"), (auth, "brand_auth"), (urgent, "urgency_and_sensitive"))
    reasons = codes(*first_reasons, *last_reasons)
    if own_rules:
        score = score + F.col("rule_points")
        reasons = F.concat(codes(*first_reasons), "rule_ids", codes(*last_reasons))
    raw = base.select("url_id", brand.alias("brand"), F.col("n_kw").alias("n_keywords"), score.alias("raw_score"),
                      reasons.alias("all_reasons"), *keep)
    raw = settle(raw, ["n_keywords", "raw_score", "all_reasons"])
    s = F.col("raw_score")
    return raw.select(
        "url_id", "brand", "n_keywords", F.least(s, F.lit(100)).alias("risk_score"), (s >= 15).alias("is_suspicious"),
        F.least(s / 50.0, F.lit(1.0)).alias("confidence"), F.col("all_reasons").alias("reasons"),
        F.when(s >= 50, "EXTREMELY_SUSPICIOUS").when(s >= 30, "HIGHLY_SUSPICIOUS").when(s >= 15, "SUSPICIOUS")
        .when(s >= 10, "QUESTIONABLE").otherwise("LOW_RISK").alias("verdict"), *keep)


# --- signature score --------------------------------------------------------

def url_hash(url: Column) -> Column:
    """SHA-256 of the normalised URL (lower case, trimmed, one trailing slash removed)."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(url)), "/$", ""), 256)


def signature_brand(d: str = "d") -> Column:
    """First brand (table order) with a misspelling in the host outside its own domain, or misused as a subdomain."""
    def hit(b: str) -> str:
        typos = " OR ".join(f"contains({d}, '{v}')" for v in refdata.SIGNATURE_BRAND_VARIANTS[b].split())
        cond = f"(({typos}) AND NOT contains({d}, '{b}.com'))"
        if b in refdata.SIGNATURE_SUBDOMAIN_BRANDS:
            cond += (f" OR (contains({d}, '{b}') AND length({d}) - length(replace({d}, '.', '')) >= 2"
                     f" AND substring_index({d}, '.', -2) <> '{b}.com')")
        return cond

    return first_of({b: hit(b) for b in refdata.SIGNATURE_BRAND_VARIANTS})


def signature_score(parts: DataFrame, known_bad: DataFrame | None = None, lexicon: DataFrame | None = None, literal_max: int = LITERAL_LIST_MAX,
                    keep: tuple[str, ...] = (), rules: DataFrame | None = None, substrings: DataFrame | None = None) -> DataFrame:
    """Signature tables: 30 per regex, 40 per bad substring, TLD, brand, keywords, structure; known hash -> 100.

    The keyword part is computed in hundredths (integer arithmetic), so its
    truncation does not depend on floating-point order.  ``lexicon`` (``term, weight``) replaces the default keywords,
    ``rules`` (``rule_id, regex, weight``) the regexes with points of their own, ``substrings`` (``term``) the bad substrings;
    the columns ``keep`` of ``parts`` come along.
    """
    base = parts.select("url_id", "url", F.lower("netloc").alias("d"), F.lower("path").alias("p"), F.lower("url").alias("u"), *keep)
    d, p, u = F.col("d"), F.col("p"), F.col("u")
    if rules is not None:
        base = with_rules(base, rules, literal_max).drop("rule_ids")
    else:
        base = base.withColumn("n_rules", reduce(lambda a, b: a + b, [X.flag(u.rlike(r)) for _, r in refdata.SIGNATURE_REGEXES]))
    if substrings is not None:
        base = with_keywords(base, substrings.select("term", F.lit(1).alias("weight")), [], literal_max=literal_max)
        base = base.withColumnRenamed("n_kw", "n_substrings").drop("kw", "kw_max")
    else:
        base = base.withColumn("n_substrings", X.hits_of("u", refdata.SIGNATURE_SUBSTRINGS))
    base = base.withColumn("brand", signature_brand("d"))
    base = with_keywords(base, lexicon, refdata.SIGNATURE_KEYWORDS, 100, literal_max).withColumnRenamed("kw", "kw_sum").drop("n_kw")
    base = settle(base, ["d", "p", "u", "n_rules", "n_substrings", "brand", "kw_sum", "kw_max", *(["rule_points"] if rules is not None else [])])
    rule_score = F.col("rule_points") if rules is not None else F.col("n_rules") * 30
    kw = F.floor(F.least(F.lit(10000), F.col("kw_sum") * 30 + F.col("kw_max") * 70) * 20 / 10000).cast("int")
    structure = points(
        (d.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 25), (F.contains(u, F.lit("@")), 30),
        (X.count_of(d, ".") > 3, 15), (F.length(d) > 50, 10), (d.rlike("[a-z0-9]{15,}"), 20),
        (p.rlike("/(wp-|cgi-bin|tmp|temp)/"), 15), (p.rlike(r"\.[a-z]{2,4}\.[a-z]{2,4}$"), 20),
        (F.contains(d, F.lit(":")) & ~F.endswith(d, F.lit(":443")) & ~F.endswith(d, F.lit(":80")), 15),
        (d.rlike(r"[^\x00-\x7f]"), 25), (X.any_of("d", refdata.SIGNATURE_SHORTENERS), 10))
    bad_tld = F.contains(d, F.lit(".")) & F.substring_index(d, ".", -1).isin(refdata.SIGNATURE_TLDS)
    scored = base.select("url_id", "url", "n_rules", "n_substrings", "brand", *keep, kw.alias("keyword_points"),
                         structure.alias("structure_points"),
                         (rule_score + F.col("n_substrings") * 40 + points((bad_tld, 15), (F.col("brand").isNotNull(), 35))
                          + kw + structure).alias("score"))
    scored = settle(scored, ["keyword_points", "structure_points", "score"])
    if known_bad is not None:
        bad = sized_broadcast(known_bad.select("url_hash").distinct().withColumn("known", F.lit(True)), probe=known_bad)
        scored = scored.withColumn("url_hash", url_hash(F.col("url"))).join(bad, "url_hash", "left").withColumn(
            "score", F.when(F.col("known"), F.lit(100)).otherwise(F.col("score")))
    s = F.col("score")
    return scored.select(
        "url_id", "n_rules", "n_substrings", "brand", "keyword_points", "structure_points", F.least(s, F.lit(100)).alias("risk_score"),
        F.least(s / 100.0, F.lit(1.0)).alias("confidence"),
        F.when(s >= 50, F.lit(True)).when(s < 30, F.lit(False)).alias("is_phishing"),
        F.when(s >= 70, "high_confidence_match").when(s >= 50, "medium_confidence_match")
        .when(s >= 30, "suspicious_indicators").otherwise("no_match").alias("method"), *keep)


# --- threat indicators ------------------------------------------------------

def _indicator_terms() -> list[tuple[Column, int, str]]:
    return [(~F.startswith("url", F.lit("https://")), 20, "no_https"), (F.col("netloc").rlike(IPV4_RE), 15, "ip_address"),
            (X.ends_with_any("netloc", [f".{t}" for t in refdata.INDICATOR_TLDS]), 10, "suspicious_tld"), (F.length("url") > 100, 5, "long_url")]


def indicator_points() -> Column:
    return points(*[(c, w) for c, w, _ in _indicator_terms()])


def threat_indicators(parts: DataFrame, tlds: DataFrame | None = None) -> DataFrame:
    """No HTTPS +20, IP host +15, abused TLD +10, more than 100 characters +5.

    ``tlds`` (``tld, is_indicator``; single labels) replaces the abused TLDs.
    """
    if tlds is not None:
        parts = with_tld(parts, F.when(F.contains("netloc", F.lit(".")), F.substring_index("netloc", ".", -1)), tlds, ["is_indicator"])
        terms = [(F.coalesce("_is_indicator", F.lit(False)) if r == "suspicious_tld" else c, w, r) for c, w, r in _indicator_terms()]
        return parts.select("url_id", points(*[(c, w) for c, w, _ in terms]).alias("risk_score"), codes(*[(c, r) for c, _, r in terms]).alias("indicators"))
    return parts.select("url_id", indicator_points().alias("risk_score"), codes(*[(c, r) for c, _, r in _indicator_terms()]).alias("indicators"))


# --- risk-factor codes ------------------------------------------------------

def risk_factors(features: DataFrame) -> DataFrame:
    """Ordered risk codes (base features, then ``ultra_`` features) per URL."""
    f = F.col
    on = lambda n: f(n) == 1
    base = [(on("is_suspicious_tld"), "suspicious_tld"), (on("has_ip_address"), "ip_address"), (on("has_at_symbol"), "at_symbol"),
            (f("suspicious_keyword_count") > 0, "keywords"), (on("brand_with_suspicious_tld"), "brand_on_bad_tld"),
            (f("url_length") > 75, "long_url"), (f("subdomain_count") > 3, "many_subdomains"), (on("is_url_shortener"), "shortener"),
            (on("has_hex_encoding"), "hex_encoding"), (f("is_https") == 0, "no_https"), (f("url_entropy") > 4.5, "high_entropy"),
            (on("has_port"), "port"), (on("is_idn_homograph"), "idn_homograph"), (on("has_unicode_chars"), "non_ascii"),
            (on("mixed_scripts"), "mixed_scripts"), (on("phishing_keyword_match"), "known_keyword"),
            (on("suspicious_pattern_match"), "known_pattern"), (on("typosquatting_detected"), "known_typo"),
            (on("suspicious_port"), "known_port"), (on("suspicious_extension"), "known_extension"),
            (on("known_phishing_path"), "known_path"), (on("likely_brand_impersonation"), "brand_impersonation"),
            (on("brand_in_subdomain"), "brand_in_subdomain"), (on("brand_with_hyphens"), "brand_with_hyphens")]
    b = f("ultra_suspicious_behavior_score")
    ultra = [(on("ultra_typosquat_very_close"), "near_brand"), (b >= 4, "behaviour_critical"), (b == 3, "behaviour_warning"),
             (on("ultra_excessive_encoding"), "excessive_encoding"), (on("ultra_suspicious_redirect"), "redirect"),
             (on("ultra_brand_plus_action"), "brand_and_action"), (on("ultra_action_plus_urgency"), "action_and_urgency"),
             (on("ultra_data_harvest"), "data_harvest"), (on("ultra_secure_in_http_url"), "secure_word_without_https"),
             (on("ultra_account_threat"), "account_threat")]
    return features.select("url_id", codes(*base).alias("base_codes"), codes(*ultra).alias("ultra_codes"))


def lexicon_score(parts: DataFrame, lexicon: DataFrame, text: str = "url") -> DataFrame:
    """Lexicon containment over distinct URLs: number, sum and maximum of matching term weights (0 when none)."""
    hits = containment_weights(parts.withColumn("_t", F.lower(text)), "url_id", "_t", lexicon)
    return parts.select("url_id").join(hits, "url_id", "left").select(
        "url_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("sum_weight", F.lit(0.0)).alias("sum_weight"),
        F.coalesce("max_weight", F.lit(0.0)).alias("max_weight"))


def tld_dimension(parts: DataFrame, tlds: DataFrame, shorteners: DataFrame) -> DataFrame:
    """TLD and shortener dimension joins: ``tld_category, tld_weight, tld_is_valid, is_shortener``."""
    t = sized_broadcast(tlds.select(F.col("tld").alias("_tld"), F.col("category").alias("tld_category"),
                                    F.col("weight").alias("tld_weight"), F.col("is_valid").alias("tld_is_valid")))
    s = sized_broadcast(shorteners.select(F.col("host").alias("_host"), F.lit(True).alias("is_shortener")))
    clean = F.regexp_replace("host", r"^www\.", "")
    return parts.join(t, F.col("tld") == F.col("_tld"), "left").join(s, clean == F.col("_host"), "left").select(
        "url_id", "host", "tld", "tld_category", F.coalesce("tld_weight", F.lit(0)).alias("tld_weight"),
        F.coalesce("tld_is_valid", F.lit(False)).alias("tld_is_valid"), F.coalesce("is_shortener", F.lit(False)).alias("is_shortener"))
