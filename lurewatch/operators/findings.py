"""Attack findings: thirteen checks per URL, as a long table, and the strongest finding per URL.

Decisions where the historical behaviour depends on set order or over-matches:
a brand tie goes to the longest, then alphabetically first brand; brands shorter
than ``min_len`` never match; a brand's own domain is no combosquat; a label
equal to a protected brand is no typo of another brand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.functions.urlparts import IPV4_RE
from lurewatch.operators.brands import brand_keys, label_keys, unprotected_labels
from lurewatch.operators.containment import containment_hits
from lurewatch.session import bounded_values, settle, sized_broadcast, spread_left_join

# Typo technique -> (score, attack type)
TYPOS = {
    "omission": (0.95, "TYPOSQUATTING_OMISSION"), "transposition": (0.94, "TYPOSQUATTING_TRANSPOSITION"),
    "keyboard": (0.93, "TYPOSQUATTING_KEYBOARD"), "insertion": (0.92, "TYPOSQUATTING_INSERTION"),
    "visual": (0.92, "TYPOSQUATTING_SUBSTITUTION"), "bitsquat": (0.91, "BITSQUATTING"),
    "substitution": (0.90, "TYPOSQUATTING_SUBSTITUTION"),
}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def typo_labels(labels: DataFrame, brands: DataFrame, keyboard: DataFrame | None = None) -> DataFrame:
    """Best typo explanation per label: ``label, typo_brand, typo_score, typo_type``.

    ``keyboard`` (``key, neighbour``) replaces the listed neighbouring keys.
    """
    keys = brand_keys(brands).where(F.col("technique").isin("omission", "transposition", "insertion", "substitution"))
    probe = label_keys(unprotected_labels(labels, brands), brands).where(F.col("kt").isin("S", "D", "W"))
    hits = probe.join(sized_broadcast(keys), ["kt", "key"]).where(F.col("label") != F.col("brand"))
    at = F.substring_index("key", ":", 1).try_cast("int")
    mine, theirs = F.substr(F.col("label"), at, F.lit(1)), F.substr(F.col("brand"), at, F.lit(1))
    pair = F.concat(theirs, mine)
    if keyboard is not None:
        pairs = keyboard.select(F.concat("key", "neighbour").alias("_pair")).where("_pair IS NOT NULL").distinct()
        hits = hits.withColumn("_pair", pair).join(sized_broadcast(pairs.withColumn("_near", F.lit(True)), probe=keyboard), "_pair", "left")
        near = F.coalesce("_near", F.lit(False))
    else:
        near = pair.isin([k + n for k, ns in refdata.KEYBOARD.items() for n in ns])
    looks = pair.isin([p for v in refdata.VISUAL_PAIRS for p in (v, v[::-1])])
    flip = ((F.bit_count(F.ascii(mine).bitwiseXOR(F.ascii(theirs))) == 1) & mine.rlike(r"^[\p{L}\p{N}]$")
            & theirs.rlike(r"^[\p{L}\p{N}]$"))
    technique = F.when(F.col("kt") == "W", F.when(near, "keyboard").when(looks, "visual").when(flip, "bitsquat").otherwise(
        "substitution")).otherwise(F.col("technique"))
    score = F.create_map(*[F.lit(x) for t, (s, _) in TYPOS.items() for x in (t, s)])
    kind = F.create_map(*[F.lit(x) for t, (_, k) in TYPOS.items() for x in (t, k)])
    hits = hits.select("label", "brand", technique.alias("t")).select(
        "label", "brand", F.element_at(score, F.col("t")).alias("s"), F.element_at(kind, F.col("t")).alias("k"))
    best = hits.groupBy("label").agg(F.min_by(
        F.struct("brand", "s", "k"), F.struct(-F.col("s"), -F.length("brand"), "brand", "k")).alias("b"))
    return best.select("label", F.col("b.brand").alias("typo_brand"), F.col("b.s").alias("typo_score"), F.col("b.k").alias("typo_type"))


def preferred(listed: list[str]) -> str:
    """The brands as a literal array in SQL, the preferred ones first."""
    return f"CAST(array({', '.join(X.sql_text(b) for b in sorted(listed, key=lambda b: (-len(b), b)))}) AS array<string>)"


def attach_brand(df: DataFrame, out: str, brands: DataFrame, texts: list[str], condition: str, inside: str, among: str | None = None) -> DataFrame:
    """Add the preferred brand ``b`` with ``condition(b)`` (SQL over ``texts`` and ``b``) as column ``out``.

    Short brand lists are filtered as a literal array, or as the array column ``among`` of the brands in question, in the same
    order; a long list goes through the containment join on the distinct texts (``inside`` is the text that must contain the brand).
    """
    if among is not None:
        return df.withColumn(out, F.expr(f"get(filter({among}, b -> {condition}), 0)"))
    listed = bounded_values(brands, "brand")
    if listed is not None:
        return df.withColumn(out, F.expr(f"get(filter({preferred(listed)}, b -> {condition}), 0)"))
    hits = containment_hits(df.select(*texts).distinct(), inside, brands.select(F.col("brand").alias("b")), "b").where(condition)
    best = hits.groupBy(*texts).agg(F.min_by("b", F.struct(-F.length("b"), "b")).alias(out))
    return spread_left_join(df, best, texts, "url_id" if "url_id" in df.columns else texts[0])


def attack_columns(parts: DataFrame, brands: DataFrame, keyboard: DataFrame | None = None) -> DataFrame:
    """URL parts plus everything the checks need: clean host, first label, targets per check."""
    src, dst = (X.sql_text("".join(r[i] for r in refdata.confusables())) for i in (0, 1))
    base = parts.select("url_id", "url", "registered_domain", F.lower("netloc").alias("dom"), F.lower("path").alias("pa"))
    base = base.selectExpr(
        "*", r"regexp_replace(regexp_replace(dom, '^www[.]', ''), ':[0-9]+$', '') AS clean", "substring_index(clean, '.', 1) AS main",
        f"translate(clean, {src}, {dst}) AS folded",
        f"length(main) <> length(translate(main, {src}, '')) AS odd_label",
        "CASE WHEN length(dom) - length(replace(dom, '.', '')) >= 2 THEN slice(split(dom, '[.]'), 1, length(dom) - length(replace(dom, '.', '')) - 1) ELSE array() END AS subs",
        "CASE WHEN contains(clean, '.') THEN left(clean, length(clean) - length(substring_index(clean, '.', -1)) - 1) END AS stem",
        "substring_index(clean, '.', -1) AS last", r"concat_ws('\n', folded, dom, pa) AS _whole")
    base = settle(base, ["dom", "pa", "clean", "main", "folded", "odd_label", "subs", "stem", "last", "_whole"])
    labels = base.select(F.col("main").alias("label")).where("label <> ''").distinct()
    # every check asks for a brand within the folded host, the host or the path: the list is gone through once, not per check
    listed, among = bounded_values(brands, "brand"), None
    if listed is not None:
        among = "_among"
        base = settle(base.withColumn(among, F.expr(f"filter({preferred(listed)}, b -> contains(_whole, b))")), [among])
    lures = "|".join(refdata.FINDING_KEYWORDS)
    rest = "replace(main, b, '')"
    base = attach_brand(base, "fold_brand", brands, ["folded"], "contains(folded, b)", "folded", among)
    base = attach_brand(
        base, "combo_brand", brands, ["main", "pa", "registered_domain"],
        f"contains(main, b) AND main <> b AND registered_domain <> concat(b, '.com') AND "
        f"({rest} RLIKE '{lures}' OR pa RLIKE '{lures}' OR contains(main, '-') OR length({rest}) > 2)", "main", among)
    base = attach_brand(base, "level_brand", brands, ["dom", "subs"], "array_contains(subs, b)", "dom", among)
    base = attach_brand(base, "joined_brand", brands, ["main"],
                        "main IN (concat(b, 'com'), concat(b, 'net'), concat(b, 'org'), concat(b, 'co'))", "main", among)
    base = attach_brand(base, "stem_brand", brands, ["stem"], "contains(stem, b)", "stem", among)
    base = attach_brand(base, "path_brand", brands, ["pa", "clean"], "contains(pa, b) AND NOT contains(clean, b)", "pa", among)
    typos = typo_labels(labels, brands, keyboard)
    return spread_left_join(base, typos.withColumnRenamed("label", "main"), ["main"], "url_id")


def _finding(no: int, cond: Column, category: str, kind, severity, conf, brand: Column | None = None) -> Column:
    as_col = lambda v, t: v if isinstance(v, Column) else F.lit(v).cast(t)
    return F.when(cond, F.struct(
        F.lit(no).alias("check_no"), F.lit(category).alias("category"), as_col(kind, "string").alias("attack_type"),
        as_col(severity, "string").alias("severity"), as_col(conf, "double").alias("confidence"),
        (F.lit(None).cast("string") if brand is None else brand).alias("brand")))


def findings_array(parts: DataFrame, brands: DataFrame, min_len: int = 4, decoded: DataFrame | None = None, keyboard: DataFrame | None = None,
                   tlds: DataFrame | None = None, shorteners: DataFrame | None = None) -> DataFrame:
    """``url_id, findings``: the ordered findings of each URL (possibly empty).

    A brand shorter than its own ``min_len`` (where the table has the column, else than ``min_len``) never matches.  User
    tables replace the lists: ``keyboard`` (``key, neighbour``), ``tlds`` (``tld, is_finding``), ``shorteners`` (``host``).
    """
    least = F.coalesce("min_len", F.lit(min_len)) if "min_len" in brands.columns else F.lit(min_len)
    usable = brands.where(F.length("brand") >= least).select("brand").distinct()
    df = attack_columns(parts, usable, keyboard)
    bad_tld, short = F.col("last").isin(refdata.FINDING_TLDS), F.replace("clean", F.lit("www."), F.lit("")).isin(refdata.FINDING_SHORTENERS)
    if tlds is not None:
        bad = sized_broadcast(tlds.where("is_finding").select(F.col("tld").alias("last")).distinct().withColumn("_bad", F.lit(True)), probe=tlds)
        df, bad_tld = df.join(bad, "last", "left"), F.coalesce("_bad", F.lit(False))
    if shorteners is not None:
        listed = sized_broadcast(shorteners.select(F.col("host").alias("_host")).distinct().withColumn("_short", F.lit(True)), probe=shorteners)
        df, short = df.withColumn("_host", F.replace("clean", F.lit("www."), F.lit(""))).join(listed, "_host", "left"), F.coalesce("_short", F.lit(False))
    if decoded is not None:  # decoded international labels: brand named by the decoded text
        names = attach_brand(decoded.select("label", F.lower("decoded").alias("text")), "puny_brand", usable, ["text"],
                             "contains(text, b)", "text")
        df = df.join(names.select(F.col("label").alias("main"), "puny_brand"), "main", "left")
    else:
        df = df.withColumn("puny_brand", F.lit(None).cast("string"))
    dom, clean, main, pa, url = (F.col(c) for c in ("dom", "clean", "main", "pa", "url"))
    script = (F.when(main.rlike(r"\p{IsCyrillic}"), "IDN_HOMOGRAPH_CYRILLIC").when(main.rlike(r"\p{IsGreek}"), "IDN_HOMOGRAPH_GREEK")
              .otherwise("IDN_HOMOGRAPH_MIXED"))
    host = F.regexp_replace(dom, ":[0-9]+$", "")
    ip = (F.when(host.rlike(IPV4_RE), "IP_ADDRESS_URL").when(host.rlike(r"^0x[0-9a-f]+(\.0x[0-9a-f]+){3}$"), "HEX_IP_ADDRESS")
          .when(host.rlike(r"^0[0-7]+(\.0[0-7]+){3}$"), "OCTAL_IP_ADDRESS").when(host.rlike("^[0-9]{8,10}$"), "IP_ADDRESS_URL"))
    listed_dot = F.expr("CASE " + " ".join(f"WHEN contains(main, '{p}') THEN '{b}'" for p, b in refdata.FINDING_MISSING_DOT.items()) + " END")
    encoded, double = dom.rlike("%[0-9a-f]{2}"), F.lower(url).rlike("%25[0-9a-f]{2}")
    checks = [
        _finding(1, dom.rlike(r"[^\x00-\x7f]") & F.col("odd_label"), "HOMOGRAPH_ATTACK", script, "CRITICAL", 0.98, F.col("fold_brand")),
        _finding(2, F.contains(dom, F.lit("xn--")), "HOMOGRAPH_ATTACK", "PUNYCODE_ATTACK", "CRITICAL", 0.95, F.col("puny_brand")),
        _finding(3, short, "URL_STRUCTURE_ABUSE",
                 "URL_SHORTENER_ABUSE", "HIGH", 0.95),
        _finding(4, F.col("typo_brand").isNotNull(), "DOMAIN_MANIPULATION", F.col("typo_type"),
                 F.when(F.col("typo_score") >= 0.95, "CRITICAL").otherwise("HIGH"), F.col("typo_score"), F.col("typo_brand")),
        _finding(5, F.col("combo_brand").isNotNull(), "BRAND_EXPLOITATION", "COMBOSQUATTING", "HIGH", 0.88, F.col("combo_brand")),
        _finding(6, F.col("level_brand").isNotNull(), "BRAND_EXPLOITATION", "LEVELSQUATTING", "HIGH", 0.92, F.col("level_brand")),
        _finding(7, listed_dot.isNotNull() | F.col("joined_brand").isNotNull(), "DOMAIN_MANIPULATION", "DOPPELGANGER_DOMAIN", "HIGH",
                 F.when(listed_dot.isNotNull(), 0.94).otherwise(0.93), F.coalesce(listed_dot, "joined_brand")),
        _finding(8, ip.isNotNull(), "TECHNICAL_DECEPTION", ip, "HIGH", 0.90),
        _finding(9, encoded, "TECHNICAL_DECEPTION", F.when(double, "DOUBLE_ENCODING").otherwise("URL_ENCODING_ABUSE"),
                 F.when(double, "CRITICAL").otherwise("HIGH"), 0.88),
        _finding(10, url.rlike("[​‌‍⁠﻿]"), "VISUAL_DECEPTION", "ZERO_WIDTH_CHARS", "CRITICAL", 0.95),
        _finding(11, F.contains(url, F.lit("‮")), "VISUAL_DECEPTION", "RTLO_ATTACK", "CRITICAL", 0.99),
        _finding(12, bad_tld & F.col("stem_brand").isNotNull(), "BRAND_EXPLOITATION",
                 "BRAND_TLD_SWAP", "HIGH", 0.85, F.col("stem_brand")),
        _finding(13, F.col("path_brand").isNotNull(), "URL_STRUCTURE_ABUSE", "PATH_MANIPULATION", "MEDIUM", 0.80, F.col("path_brand")),
    ]
    return settle(df.select("url_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("findings")), ["findings"])


def attack_findings(parts: DataFrame, brands: DataFrame, **kw) -> DataFrame:
    """Long table: one row per finding."""
    return findings_array(parts, brands, **kw).select("url_id", F.explode("findings").alias("f")).select("url_id", "f.*")


def _strength(check_no: Column, severity: Column, confidence: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.struct(F.coalesce(F.try_element_at(rank, severity), F.lit(0)), confidence, -check_no)


def strongest_finding(findings: DataFrame) -> DataFrame:
    """Strongest finding per URL of a long table: severity, then confidence, then check order."""
    rest = [c for c in findings.columns if c != "url_id"]
    key = _strength(F.col("check_no"), F.col("severity"), F.col("confidence"))
    return findings.groupBy("url_id").agg(F.max_by(F.struct(*rest), key).alias("f")).select("url_id", "f.*")


def classify_urls(parts: DataFrame, brands: DataFrame, **kw) -> DataFrame:
    """One verdict per URL: its strongest finding, else LEGITIMATE .90 (narrow, no aggregation)."""
    best = F.array_max(F.transform("findings", lambda f: F.struct(
        _strength(f["check_no"], f["severity"], f["confidence"]).alias("k"), f.alias("f"))))["f"]
    df = findings_array(parts, brands, **kw).select("url_id", best.alias("f"))
    f = F.col("f")
    return df.select(
        "url_id", f.isNotNull().alias("is_attack"), F.coalesce(f["category"], F.lit("LEGITIMATE")).alias("category"),
        F.coalesce(f["attack_type"], F.lit("LEGITIMATE")).alias("attack_type"), F.coalesce(f["severity"], F.lit("NONE")).alias("severity"),
        F.coalesce(f["confidence"], F.lit(0.9)).alias("confidence"), f["brand"].alias("brand"))
