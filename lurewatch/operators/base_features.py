"""Base feature table (69 columns per URL) over the URL parts.

Every family is a dictionary ``name -> Column``; ``base_features`` selects all
of them in one narrow projection (no shuffle).  Deviations from the historical
behaviour, on purpose: the brand-on-bad-TLD flag is a real conjunction, a
bracketed IPv6 authority counts as an IP host, only non-ASCII characters count
as look-alikes, and "Latin" means letters only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.operators.containment import any_contained, containment_hits, rule_hits
from lurewatch.session import LITERAL_LIST_MAX, sized_broadcast


def lexical_columns(keywords: list[str] = refdata.BASE_KEYWORDS) -> dict[str, Column]:
    u, d = F.col("url"), F.col("netloc")
    n, digits, letters = F.length(u), X.count_re(u, r"\p{Nd}"), X.count_re(u, r"\p{L}")
    return {
        "url_length": n, "domain_length": F.length(d), "path_length": F.length("path"), "query_length": F.length("query"),
        "dot_count": X.count_of(u, "."), "slash_count": X.count_of(u, "/"), "hyphen_count": X.count_of(u, "-"),
        "underscore_count": X.count_of(u, "_"), "question_mark_count": X.count_of(u, "?"),
        "equal_count": X.count_of(u, "="), "at_count": X.count_of(u, "@"), "ampersand_count": X.count_of(u, "&"),
        "digit_count": digits, "letter_count": letters, "special_char_count": n - digits - letters,
        "digit_ratio": X.ratio(digits, n), "letter_ratio": X.ratio(letters, n),
        "special_char_ratio": X.ratio(n - digits - letters, n),
        "url_entropy": X.entropy(u), "domain_entropy": X.entropy(d),
        "suspicious_keyword_count": X.hits_of("lower(url)", keywords),
    }


def _bad_tld(tlds: list[str]) -> Column:
    return F.lower(F.substring_index(F.substring_index("netloc", ":", 1), ".", -1)).isin(tlds)


def structural_columns(tlds: list[str] = refdata.BASE_SUSPICIOUS_TLDS) -> dict[str, Column]:
    d = F.col("netloc")
    bare = F.regexp_replace(F.substring_index(d, ":", 1), r"^\.+|\.+$", "")
    pairs = F.filter(F.split("query", "&"), lambda kv: kv.rlike(r"^[^=]*=."))
    return {
        "is_https": X.flag(F.col("scheme") == "https"),
        "has_http": X.flag(F.col("scheme").isin("http", "https")),
        "has_ip_address": X.flag(F.substring_index(d, ":", 1).rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
                                 | d.rlike(r"^\[[0-9a-fA-F:.]+\](:[0-9]+)?$")),
        "has_at_symbol": X.flag(F.contains(F.col("url"), F.lit("@"))),
        "subdomain_count": F.greatest(F.lit(0), X.count_of(d, ".") - 1),
        "url_depth": X.count_re(F.col("path"), r"[^/]+"),
        "tld_length": F.when(d == "", F.lit(0)).otherwise(F.length(F.substring_index(bare, ".", -1)) + 1),
        "is_suspicious_tld": X.flag(_bad_tld(tlds)),
        "has_port": X.flag(F.contains(d, F.lit(":")) & ~F.contains(d, F.lit("@"))),
        "query_param_count": F.size(F.array_distinct(F.transform(pairs, lambda kv: F.substring_index(kv, "=", 1)))),
        "has_fragment": X.flag(F.col("fragment") != ""),
    }


def advanced_columns(brands: list[str] = refdata.BASE_BRANDS, shorteners: list[str] = refdata.BASE_SHORTENERS,
                     tlds: list[str] = refdata.BASE_SUSPICIOUS_TLDS,
                     extensions: list[str] = refdata.BASE_BAD_EXTENSIONS) -> dict[str, Column]:
    u, d = F.col("url"), F.col("netloc")
    hexes = X.count_re(u, r"%[0-9a-fA-F]{2}")
    brand_hits = X.hits_of("lower(netloc)", brands)
    return {
        "is_url_shortener": X.flag(X.any_of("netloc", shorteners)),
        "has_double_slash_in_path": X.flag(F.contains(F.col("path"), F.lit("//"))),
        "has_double_dot": X.flag(F.contains(u, F.lit(".."))),
        "hex_char_count": hexes, "has_hex_encoding": X.flag(hexes > 0),
        "brand_name_count": brand_hits, "brand_with_suspicious_tld": X.flag((brand_hits > 0) & _bad_tld(tlds)),
        "has_punycode": X.flag(F.contains(d, F.lit("xn--"))),
        "has_unicode_chars": X.flag(d.rlike(r"[^\x00-\x7f]")),
        "mixed_scripts": X.flag(_mixed(d)),
        "has_hyphen_in_domain": X.flag(F.contains(d, F.lit("-"))),
        "hyphen_domain_ratio": X.ratio(X.count_of(d, "-"), F.length(d)),
        "has_suspicious_extension": X.flag(X.ends_with_any("lower(url)", extensions)),
    }


def _mixed(s: Column) -> Column:
    return s.rlike(r"[A-Za-z]") & s.rlike(r"[Ͱ-ϿЀ-ӿ]")


def homograph_columns(decoded: str = "netloc", brands: list[str] = refdata.IDN_BRANDS) -> dict[str, Column]:
    """Look-alike score of the (decoded) host: ratio of look-alike characters, script mixing, ``xn--``, folded brand."""
    table = refdata.confusables()
    src, dst = (X.sql_text("".join(row[i] for row in table)) for i in (0, 1))
    folded = f"translate(lower({decoded}), {src}, {dst})"
    n_conf = f"length({decoded}) - length(translate({decoded}, {src}, ''))"
    # the folded name is bound once (x.f), so each brand costs two comparisons
    cases = " ".join(
        f"WHEN contains(x.f, '{b}') AND NOT contains(x.l, '{b}') THEN 1D "
        f"WHEN contains(x.f, '{b}') AND {2.0 * len(b)}D / ({len(b)} + length(x.f)) > 0.8D THEN {2.0 * len(b)}D / ({len(b)} + length(x.f))"
        for b in brands)
    similarity = F.expr(f"transform(array(struct({folded} AS f, lower({decoded}) AS l)), x -> CASE {cases} ELSE 0D END)[0]")
    d = F.expr(decoded)
    score = F.least(F.lit(1.0), F.least(X.ratio(F.expr(n_conf), F.length(d)) * 2.0, F.lit(0.8)) + F.when(_mixed(d), 0.6).otherwise(0.0)
                    + F.when(F.contains(F.lower(d), F.lit("xn--")), 0.4).otherwise(0.0) + similarity * 0.3)
    return {"confusable_count": F.expr(n_conf), "skeleton": F.expr(folded), "homograph_similarity": similarity,
            "idn_homograph_score": score, "is_idn_homograph": X.flag(F.round(score, 9) > 0.5)}


def statistical_columns() -> dict[str, Column]:
    u, d = F.col("url"), F.lower("netloc")
    vowels, letters = X.count_re(d, "[aeiou]"), X.count_re(d, r"\p{L}")
    words, nums = X.tokens(u, "[a-zA-Z]+"), X.tokens(u, r"\p{Nd}+")
    return {
        "vowel_count": vowels, "consonant_count": letters - vowels, "vowel_consonant_ratio": X.ratio(vowels, letters - vowels),
        "longest_word_length": X.max_len(words), "average_word_length": X.ratio(X.sum_len(words), F.size(words)),
        "token_count": X.count_re(u, r"[\p{L}\p{N}_]+"),
        "digit_sequence_count": F.size(nums), "max_digit_sequence_length": X.max_len(nums),
        "max_consecutive_consonants": X.longest_run(d, "[bcdfghjklmnpqrstvwxyz]+"),
        "max_consecutive_digits": X.longest_run(u, "[0-9]+"),
    }


def pattern_columns(keywords=refdata.TABLE_KEYWORDS, regexes=refdata.TABLE_REGEXES, typos=refdata.TABLE_TYPOS,
                    ports=refdata.TABLE_PORTS, extensions=refdata.TABLE_EXTENSIONS,
                    paths=refdata.TABLE_PATHS) -> dict[str, Column]:
    u = F.lower("url")
    return {
        "phishing_keyword_match": X.flag(X.any_of("lower(url)", keywords)),
        "suspicious_pattern_match": X.flag(u.rlike("|".join(f"(?:{r})" for r in regexes))),
        "typosquatting_detected": X.flag(X.any_of("lower(netloc)", typos)),
        "suspicious_port": X.flag(X.any_of("lower(url)", [f":{p}" for p in ports])),
        "suspicious_extension": X.flag(X.ends_with_any("lower(url)", extensions)),
        "known_phishing_path": X.flag(X.any_of("lower(path)", paths)),
    }


def pattern_flags(parts: DataFrame, terms: DataFrame, rules: DataFrame, literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """The same flags from user tables of any size: ``terms`` (``family, term``; families keyword, typo, port, extension and
    path) and ``rules`` (``rule_id, regex, weight``).  Repeated and NULL entries change nothing, an empty family gives 0."""
    df = parts.select("url_id", F.lower("url").alias("u"), F.lower("netloc").alias("d"), F.lower("path").alias("p"))
    of = lambda family: terms.where(F.col("family") == family).select("term")
    found = rule_hits(df.select("u").distinct(), "u", "u", rules, literal_max).select("u").distinct().withColumn("suspicious_pattern_match", F.lit(1))
    ports = of("port").select(F.concat(F.lit(":"), "term").alias("term"))
    df = any_contained(df, "url_id", {
        "phishing_keyword_match": ("u", of("keyword"), False), "typosquatting_detected": ("d", of("typo"), False), "suspicious_port": ("u", ports, False),
        "suspicious_extension": ("u", of("extension"), True), "known_phishing_path": ("p", of("path"), False)}, literal_max)
    df = df.join(found, "u", "left").fillna(0, ["suspicious_pattern_match"])
    return df.select("url_id", "phishing_keyword_match", "suspicious_pattern_match", "typosquatting_detected", "suspicious_port", "suspicious_extension",
                     "known_phishing_path")


def _impersonation_parts(brand: Column, legit: Column) -> tuple[Column, Column, Column]:
    d = F.lower("netloc")
    n = X.count_of(d, ".") + 1
    sub = F.when(n > 2, F.expr("left(lower(netloc), length(netloc) - length(substring_index(netloc, '.', -2)) - 1)")).otherwise("")
    hit = F.contains(d, brand) & ~legit
    return (hit, hit & F.contains(sub, brand),
            hit & (F.contains(d, F.concat(F.lit("-"), brand)) | F.contains(d, F.concat(brand, F.lit("-")))))


def impersonation_columns(brand_domains: dict[str, str] = refdata.BRAND_DOMAINS) -> dict[str, Column]:
    """Literal form for a short brand list: +0.5 brand outside its own domains, +0.3 in the subdomain, +0.2 hyphenated."""
    d = "lower(netloc)"
    sub = ("CASE WHEN length(netloc) - length(replace(netloc, '.', '')) >= 2 THEN "
           "left(lower(netloc), length(netloc) - length(substring_index(netloc, '.', -2)) - 1) ELSE '' END")
    hit, inside, hyphen = [], [], []
    for b, ds in brand_domains.items():
        own = " OR ".join(f"endswith({d}, '{x}')" for x in ds.split())
        h = f"(contains({d}, '{b}') AND NOT ({own}))"
        hit.append(h)
        inside.append(f"({h} AND contains({sub}, '{b}'))")
        hyphen.append(f"({h} AND (contains({d}, '-{b}') OR contains({d}, '{b}-')))")

    def total(conds: list[str], w: str) -> str:
        return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0D END" for c in conds)

    return {"brand_impersonation_score": F.expr(f"least(1D, {total(hit, '0.5D')} + {total(inside, '0.3D')} + {total(hyphen, '0.2D')})"),
            **{n: X.flag(F.expr(" OR ".join(c))) for n, c in (
                ("likely_brand_impersonation", hit), ("brand_in_subdomain", inside), ("brand_with_hyphens", hyphen))}}


def brand_impersonation(parts: DataFrame, brand_domains: DataFrame, literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """The same features for a brand table of any size, computed once per distinct authority and joined back."""
    hosts = parts.select("netloc").distinct().withColumn("low", F.lower("netloc"))
    hits = containment_hits(hosts, "low", brand_domains, "brand", literal_max)
    hits = hits.join(sized_broadcast(brand_domains), "brand").groupBy("netloc", "low", "brand").agg(
        F.max(F.endswith("low", "domain")).alias("legit"))
    hit, sub, hyp = _impersonation_parts(F.col("brand"), F.col("legit"))
    per = hits.groupBy("netloc").agg(
        F.sum(F.when(hit, 0.5).otherwise(0.0) + F.when(sub, 0.3).otherwise(0.0) + F.when(hyp, 0.2).otherwise(0.0)).alias("s"),
        F.max(X.flag(hit)).alias("h"), F.max(X.flag(sub)).alias("b"), F.max(X.flag(hyp)).alias("y"))
    return parts.select("url_id", "netloc").join(per, "netloc", "left").select(
        "url_id", F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0))).alias("brand_impersonation_score"),
        F.coalesce("h", F.lit(0)).alias("likely_brand_impersonation"), F.coalesce("b", F.lit(0)).alias("brand_in_subdomain"),
        F.coalesce("y", F.lit(0)).alias("brand_with_hyphens"))


def family(parts: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``url_id`` plus one feature family."""
    return parts.select("url_id", *[c.alias(n) for n, c in columns.items()])


def base_feature_columns(decoded: str = "netloc", diff: Column | None = None, similarity: Column | None = None) -> dict[str, Column]:
    """All 69 base features as columns over URL parts."""
    cols: dict[str, Column] = {}
    for fam in (lexical_columns(), structural_columns(), advanced_columns(), statistical_columns(), pattern_columns(),
                impersonation_columns()):
        cols.update(fam)
    homo = homograph_columns(decoded)
    cols.update({"punycode_length_diff": F.lit(0) if diff is None else diff, "idn_homograph_score": homo["idn_homograph_score"],
                 "is_idn_homograph": homo["is_idn_homograph"], "punycode_brand_similarity": F.lit(0.0) if similarity is None else similarity})
    return cols


def base_features(parts: DataFrame, punycode: DataFrame | None = None) -> DataFrame:
    """All 69 base features in one narrow pass (plus ``url``, ``url_id``).

    ``punycode`` is the (small) table of decoded international hosts from
    ``homograph.punycode_features``; without it undecodable hosts keep their ``xn--`` form.
    """
    cols = base_feature_columns()
    if punycode is not None:
        extra = punycode.select("netloc", "decoded", "punycode_length_diff", "punycode_brand_similarity")
        parts = parts.join(extra, "netloc", "left")
        cols = base_feature_columns("coalesce(decoded, netloc)", F.coalesce("punycode_length_diff", F.lit(0)), F.coalesce("punycode_brand_similarity", F.lit(0.0)))
    return parts.select("url_id", "url", *[c.alias(n) for n, c in cols.items()])


def feature_summary(features: DataFrame) -> DataFrame:
    """Readable summary of the base features (11 columns)."""
    f = F.col
    return features.select(
        "url_id", F.concat(f("url_length").cast("string"), F.lit(" characters")).alias("url_length_text"),
        F.concat(f("domain_length").cast("string"), F.lit(" characters")).alias("domain_length_text"),
        F.when(f("is_https") == 1, "HTTPS").otherwise("HTTP").alias("protocol"),
        F.when(f("is_suspicious_tld") == 1, "Suspicious").otherwise("Normal").alias("tld_type"),
        "subdomain_count", f("dot_count").alias("dots"), f("hyphen_count").alias("hyphens"),
        f("underscore_count").alias("underscores"), f("suspicious_keyword_count").alias("suspicious_keywords"),
        F.round("url_entropy", 2).alias("url_entropy"),
        F.when(f("has_ip_address") == 1, "Yes").otherwise("No").alias("has_ip"))
