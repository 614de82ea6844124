"""Queries for validity, rule scores, lexicon joins and reason codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.operators import base_features as B
from lurewatch.operators import corpus as C
from lurewatch.operators import rules as R
from lurewatch.operators import ultra_features as U
from lurewatch.operators.parts import url_parts
from lurewatch.plans import fixtures as fx
from lurewatch.plans.features import corpus_parts
from lurewatch.plans.registry import query
from lurewatch.session import materialize, sized_broadcast
from lurewatch.sources.reference import read_reference


def joined(df, *cols):
    """Array columns as joined strings (stable across engines)."""
    return df.withColumns({c: F.array_join(c, "|") for c in cols})


def valid_parts(spark, sf):
    """Parts of the repaired URLs that pass validation."""
    checked = R.with_validity(fx.corpus(spark, sf)).where("is_valid")
    return url_parts(checked.select("url_id", F.col("fixed_url").alias("url")))


@query("url_validity")
def _validity(spark, sf):
    return joined(R.with_validity(fx.corpus(spark, sf)), "issues").select("url_id", "fixed_url", "is_valid", "issues")


@query("garbage_score")
def _garbage(spark, sf):
    return joined(R.garbage_score(valid_parts(spark, sf)), "garbage_reasons").select(
        "url_id", "domain_label", "tld_valid", "tld_category", "garbage_score", "is_garbage", "garbage_reasons")


@query("pattern_score")
def _pattern(spark, sf):
    return joined(R.pattern_score(corpus_parts(spark, sf)), "reasons")


def user_lexicon(spark, sf):
    """A lexicon of the user: words of the part names (at least three letters), weighed by the size of the parts."""
    w = fx.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"), (F.col("p_size") % 5 + 1).alias("weight"))
    return w.where(F.length("term") >= 3).groupBy("term").agg(F.max("weight").cast("double").alias("weight"))


@query("pattern_score_user_lexicon")
def _pattern_user(spark, sf):
    """Pattern score with a user's keywords, as literals."""
    return joined(R.pattern_score(corpus_parts(spark, sf), user_lexicon(spark, sf)), "reasons")


@query("pattern_score_joined_lexicon")
def _pattern_joined(spark, sf):
    """The same by the containment join, as for a lexicon beyond the literal bound."""
    return joined(R.pattern_score(materialize(corpus_parts(spark, sf)), user_lexicon(spark, sf), literal_max=0), "reasons")


@query("signature_score_user_lexicon")
def _signature_user(spark, sf):
    """Signature score with a user's keywords, tenths as weights."""
    lex = user_lexicon(spark, sf).withColumn("weight", F.col("weight") / 10)
    return R.signature_score(corpus_parts(spark, sf), lexicon=lex)


# a user's rules, one per word and shape: anchored host, word and digits, word or another, word and suffix, any order
USER_RULES_SQL = """
SELECT 'r_' || w || '_' || CAST(s AS STRING) AS rule_id, CAST(length(w) % 4 + s + 1 AS INT) AS weight,
 CASE s WHEN 0 THEN '^https?://[^/]*' || w WHEN 1 THEN w || '[a-z][a-z]+[.](com|tk)/' WHEN 2 THEN '(' || w || '|zz)[0-9]' WHEN 3 THEN w || '(-login)?[.]com/p' ELSE '[.-]' || w || '|' || w || '-' END AS regex
FROM (SELECT DISTINCT w FROM (SELECT {first} AS w FROM {part} UNION ALL SELECT {second} AS w FROM {part}) x) y
CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(s)
"""


def user_rules(spark, sf):
    sql = USER_RULES_SQL.replace("{first}", "split_part(lower(p_name), ' ', 1)").replace("{second}", "split_part(lower(p_name), ' ', 2)")
    return spark.sql(sql, part=fx.table(spark, sf, "part"))


@query("pattern_score_user_rules")
def _pattern_rules(spark, sf):
    """Pattern score with a user's regex table, as literals."""
    return joined(R.pattern_score(corpus_parts(spark, sf), rules=user_rules(spark, sf)), "reasons")


@query("pattern_score_indexed_rules")
def _pattern_indexed(spark, sf):
    """The same as for a table beyond the literal bound: regexes by required text, the others in blocks."""
    return joined(R.pattern_score(materialize(corpus_parts(spark, sf)), rules=user_rules(spark, sf), literal_max=0, lexicon=user_lexicon(spark, sf)), "reasons")


@query("signature_score_user_tables")
def _signature_tables(spark, sf):
    """Signature score with a user's regexes and bad substrings."""
    terms = user_lexicon(spark, sf).select(F.concat("term", F.lit("-")).alias("term"))
    return R.signature_score(corpus_parts(spark, sf), rules=user_rules(spark, sf), substrings=terms)


def user_flag_terms(spark, sf):
    """Words by family: keywords, misspellings (second letter doubled), paths, extensions and ports."""
    w = user_lexicon(spark, sf).select("term")
    kinds = [("keyword", F.concat("term", F.lit("-l"))), ("typo", F.concat(F.left("term", F.lit(2)), F.substr("term", F.lit(2)))),
             ("path", F.concat(F.lit("/"), "term")), ("extension", F.concat(F.right("term", F.lit(1)), F.lit("/q2"))), ("port", F.concat(F.lit("8"), F.length("term").cast("string")))]
    return w.select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), c.alias("term")) for f, c in kinds])).alias("t")).select("t.*")


@query("pattern_flags_user_tables")
def _flags_user(spark, sf):
    return B.pattern_flags(corpus_parts(spark, sf), user_flag_terms(spark, sf), user_rules(spark, sf))


@query("pattern_flags_indexed_tables")
def _flags_indexed(spark, sf):
    """The same by the anchor index, as for tables beyond the literal bound."""
    return B.pattern_flags(materialize(corpus_parts(spark, sf)), user_flag_terms(spark, sf), user_rules(spark, sf), literal_max=0)


def user_tlds(spark, sf):
    """A TLD table of the user over the listed TLDs: other categories and flags."""
    t = refdata.tlds_table(spark).select("tld")
    n = F.length("tld") + F.ascii("tld")
    return t.select("tld", F.when(n % 3 == 0, "odd").otherwise("even").alias("category"), (n % 4 != 0).alias("is_valid"), (n % 5 < 2).alias("is_indicator"), (n % 2 == 0).alias("is_finding"))


@query("garbage_score_user_tlds")
def _garbage_user(spark, sf):
    return joined(R.garbage_score(valid_parts(spark, sf), user_tlds(spark, sf)), "garbage_reasons").select(
        "url_id", "domain_label", "tld_valid", "tld_category", "garbage_score", "is_garbage", "garbage_reasons")


@query("threat_indicators_user_tlds")
def _threat_user(spark, sf):
    return joined(R.threat_indicators(corpus_parts(spark, sf), user_tlds(spark, sf)), "indicators")


@query("top_reasons")
def _reasons(spark, sf):
    """First three pattern reasons per suspicious URL."""
    s = R.pattern_score(corpus_parts(spark, sf)).where("is_suspicious")
    return s.select("url_id", F.array_join(F.slice("reasons", 1, 3), "|").alias("reasons"))


@query("signature_score")
def _signature(spark, sf):
    """Known-bad hashes: every 50th URL of the corpus."""
    parts = corpus_parts(spark, sf)
    bad = fx.corpus(spark, sf).where("url_id % 50 = 0").select(R.url_hash(F.col("url")).alias("url_hash"))
    return R.signature_score(parts, bad)


@query("threat_indicators")
def _threat(spark, sf):
    return joined(R.threat_indicators(corpus_parts(spark, sf)), "indicators")


@query("risk_factors")
def _risk(spark, sf):
    return joined(R.risk_factors(U.all_features(corpus_parts(spark, sf))), "base_codes", "ultra_codes")


@query("merged_reasons")
def _merged(spark, sf):
    """Pattern reasons in front of the indicator codes, without repeats."""
    parts = materialize(corpus_parts(spark, sf))
    pat = R.pattern_score(parts).select("url_id", "reasons")
    ind = R.threat_indicators(parts).select("url_id", F.transform("indicators", lambda x: F.when(
        x == "no_https", F.lit("plain_http")).otherwise(x)).alias("indicators"))
    return pat.join(ind, "url_id").select("url_id", F.array_join(C.merge_reasons(F.col("reasons"), F.col("indicators")), "|").alias("reasons"))


@query("lexicon_score")
def _lexicon(spark, sf):
    lex = read_reference(spark, "lexicon").where("family = 'signature_keyword'").select("term", "weight")
    return R.lexicon_score(corpus_parts(spark, sf), lex)


@query("lexicon_usage")
def _usage(spark, sf):
    """Per lexicon family: number of terms, and how many terms and URLs of the corpus meet."""
    from lurewatch.operators.containment import containment_hits

    lex = read_reference(spark, "lexicon").select("family", "term")
    urls = fx.corpus(spark, sf).select("url_id", F.lower("url").alias("u"))
    hits = containment_hits(urls, "u", lex.select("term"), "term").select("url_id", "term")
    used = hits.join(sized_broadcast(lex), "term").groupBy("family").agg(
        F.countDistinct("term").alias("n_used"), F.countDistinct("url_id").alias("n_urls"))
    return lex.groupBy("family").agg(F.count(F.lit(1)).alias("n_terms")).join(used, "family", "left").select(
        "family", "n_terms", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query("tld_dimension")
def _dims(spark, sf):
    return R.tld_dimension(corpus_parts(spark, sf), refdata.tlds_table(spark), refdata.shorteners_table(spark))


@query("known_bad_matches")
def _known(spark, sf):
    """Hash join of URL occurrences (mixed case, trailing slash) with a known-bad table."""
    urls = fx.corpus(spark, sf).select("url_id", F.when(F.col("url_id") % 2 == 0, F.upper("url")).otherwise(
        F.concat(F.lit(" "), "url", F.lit("/"))).alias("url"))
    bad = fx.corpus(spark, sf).where("url_id % 3 = 0").select(R.url_hash(F.col("url")).alias("url_hash")).distinct()
    return urls.select("url_id", R.url_hash(F.col("url")).alias("url_hash")).join(bad, "url_hash", "left_semi")
