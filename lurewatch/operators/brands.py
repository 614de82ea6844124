"""Brand look-alike joins over distinct host labels.

No label is compared with every brand.  Edit-1 techniques meet through
exploded neighbourhood keys (equi join with a table of brand variants);
similarity candidates meet through the prefix-filter principle: a pair that can
reach the score shares two thirds of its characters and the first one, or four
fifths of them, hence a pair of its rarest ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.functions import variants as V
from lurewatch.functions.similarity import jaro_winkler
from lurewatch.operators.containment import containment_hits, substrings, term_lengths
from lurewatch.operators.parts import usable_label
from lurewatch.session import bounded_values, dealt, materialize, settle, sized_broadcast

# Technique scores and the detection threshold
SCORES = {"omission": 0.95, "insertion": 0.90, "substitution": 0.92, "transposition": 0.93, "homophone": 0.85,
          "idn_homograph": 0.98, "combosquatting": 0.87, "bitsquatting": 0.94}
SIMILARITY_WEIGHT, DETECTION, CRITICAL, HIGH = 0.75, 0.70, 0.95, 0.85
# letters from rare to frequent in host names; only the order of the pruning tokens depends on it
RARE_FIRST = "qzxjkvwybfgpmhducltsronaie"


def unprotected_labels(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Labels that are not themselves a protected brand (those are exempt for every brand)."""
    return labels.join(sized_broadcast(brands.select(F.col("brand").alias("label"))), "label", "left_anti")


def _score(technique: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), technique)


def _keyed(kt: str, arr: Column) -> Column:
    return F.transform(arr, lambda k: F.struct(F.lit(kt).alias("kt"), k.alias("key")))


def _rare_pairs(s: Column, sorted_chars: Column, tenths: Column | int) -> Column:
    """Pairs of the rarest characters (numbered per repetition): names that share at least ``tenths``/30 of each name's
    characters share two of each one's rarest ``n - needed + 2`` (prefix filter for two common tokens)."""
    n = F.length(s)
    keep = F.least(n, n - F.ceil(n * tenths / 30).cast("int") + 2)
    tokens = F.transform(V.positions(s, keep), lambda i: F.concat(
        F.get(sorted_chars, i - 1), (i - F.array_position(sorted_chars, F.get(sorted_chars, i - 1)).cast("int")).cast("string")))
    # the list is needed twice: bound once as the only element of an array
    return F.flatten(F.flatten(F.transform(F.array(tokens), lambda t: F.transform(t, lambda x, i: F.transform(
        F.slice(t, i + 2, F.lit(64)), lambda y: F.concat(x, y))))))


def _similarity_keys(s: Column, sorted_chars: Column) -> list[tuple[str, Column]]:
    """Keys under which two names meet if their Jaro-Winkler similarity can reach 14/15.

    ``A``: the first characters agree, which allows a Jaro similarity down to 8/9, so two thirds of the characters are
    common.  ``B``: without a common prefix the Jaro similarity itself is 14/15, so four fifths are.
    """
    first = F.substr(s, F.lit(1), F.lit(1))
    return [("A", F.transform(_rare_pairs(s, sorted_chars, 20), lambda k: F.concat(first, F.lit(":"), k))), ("B", _rare_pairs(s, sorted_chars, 24))]


def _sorted_chars(s: Column) -> Column:
    ranked = F.sort_array(F.transform(X.chars(s), lambda c: F.struct(F.instr(F.lit(RARE_FIRST), c).alias("r"), c.alias("c"))))
    return F.transform(ranked, lambda x: x["c"])


def brand_keys(brands: DataFrame, similar: bool = True) -> DataFrame:
    """Brand side of the key join: ``kt, key, technique, brand``.

    Key types: ``S`` a string the label must equal, ``D`` a string one of the
    label's deletions must equal, ``W`` a one-position wildcard, ``G`` a substring
    of the label; ``A`` and ``B`` (left out unless ``similar``) pairs of rare characters.
    """
    b = F.col("brand")
    rules = [(s, d) for s, ds in refdata.HOMOPHONES.items() for d in ds.split()]
    sounds = F.filter(F.array(*[F.when(F.contains(b, F.lit(s)), F.replace(b, F.lit(s), F.lit(d))) for s, d in rules]),
                      lambda v: v.isNotNull())

    def keys(kt: str, technique: str, arr: Column) -> Column:
        return F.transform(arr, lambda k: F.struct(F.lit(kt).alias("kt"), k.alias("key"), F.lit(technique).alias("technique")))

    every = F.concat(keys("S", "omission", V.deletions(b)), keys("S", "transposition", V.swaps(b)),
                     keys("S", "homophone", sounds), keys("D", "insertion", F.array(b)),
                     keys("W", "substitution", V.wildcards(b)), keys("G", "combosquatting", F.array(b)),
                     *[keys(kt, "candidate", arr) for kt, arr in (_similarity_keys(b, F.col("cs")) if similar else [])])
    return (brands.select("brand", _sorted_chars(b).alias("cs")).select("brand", F.explode(every).alias("k"))
            .select("k.*", "brand").distinct())


def label_keys(labels: DataFrame, brands: DataFrame, similar: bool = True) -> DataFrame:
    """Label side of the key join, one pass: ``label, kt, key``."""
    s = F.col("label")
    listed = bounded_values(brands, "brand")
    if listed is not None:
        inside = F.filter(F.array(*[F.lit(t) for t in listed]), lambda t: F.contains(s, t))
    else:
        inside = substrings(s, term_lengths(brands, "brand"))
    every = F.concat(_keyed("S", F.array(s)), _keyed("D", V.deletions(s)), _keyed("W", V.wildcards(s)),
                     _keyed("G", inside), *[_keyed(kt, arr) for kt, arr in (_similarity_keys(s, F.col("cs")) if similar else [])])
    return (labels.select("label", _sorted_chars(s).alias("cs")).select("label", F.explode(every).alias("k"))
            .select("label", "k.*"))


def _shared(a: Column, b: Column) -> Column:
    """At least as many as the characters that two names have in common: those that occur in the other name at all."""
    inside = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return F.least(inside(a, b), inside(b, a))


def _common(a: Column, b: Column) -> Column:
    """Characters that two names have in common, counted with repetition."""
    def numbered(s: Column) -> Column:
        nth = lambda i: i - F.length(F.replace(F.substr(s, F.lit(1), i), F.substr(s, i, F.lit(1)), F.lit("")))
        return F.transform(V.positions(s), lambda i: F.concat(F.substr(s, i, F.lit(1)), nth(i).cast("string")))

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _best_possible(a: Column, b: Column, common: Column) -> Column:
    """Jaro-Winkler similarity if all common characters (or a bound of their number) matched in order: an upper bound of the real one."""
    one = F.lit(1)
    n, m = F.length(a), F.length(b)
    prefix = sum((F.when((F.substr(a, one, F.lit(k)) == F.substr(b, one, F.lit(k))) & (F.least(n, m) >= k), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    jaro = (common / n + common / m + 1) / 3
    return jaro + prefix * 0.1 * (1 - jaro)


def compare_labels(labels: DataFrame, brands: DataFrame, keywords: list[str] = refdata.COMBO_KEYWORDS, similar: bool = True) -> DataFrame:
    """All label/brand pairs worth a look: ``label, brand, technique, score``.

    One scan of the labels, one key join, one aggregation.  Pairs without an edit technique that share a pair of rare
    characters are held, once each, against an upper bound of their similarity; those that pass stay with a NULL
    technique as (exact, pruned) similarity candidates.  Without ``similar`` none are made.
    """
    hits = label_keys(labels, brands, similar).join(sized_broadcast(brand_keys(brands, similar)), ["kt", "key"])
    hits = hits.where(F.col("label") != F.col("brand"))
    at = F.substring_index("key", ":", 1).try_cast("int")
    mine, theirs = F.substr(F.col("label"), at, F.lit(1)), F.substr(F.col("brand"), at, F.lit(1))
    flips = ((F.bit_count(F.ascii(mine).bitwiseXOR(F.ascii(theirs))) == 1) & mine.rlike(r"^[\p{L}\p{N}-]$")
             & theirs.rlike("^[a-z0-9-]$"))
    n, m = F.length("label"), F.length("brand")
    kt = F.col("kt")
    technique = (F.when((kt == "W") & flips, F.lit("bitsquatting"))
                 .when(kt == "G", F.when(X.any_of("replace(label, brand, '')", keywords), F.col("technique")))
                 .when(kt.isin("A", "B"), F.lit(None)).otherwise(F.col("technique")))
    # a cheap bound ends most key hits where they arise; those of one pair become one row before the close one is computed
    label, brand = F.col("label"), F.col("brand")
    reaches = lambda common: _best_possible(label, brand, common) * SIMILARITY_WEIGHT >= DETECTION - 1e-9
    alike = kt.isin("A", "B") & (F.least(n, m) * 3 >= F.greatest(n, m) * 2) & reaches(_shared(label, brand))
    hits = hits.select("label", "brand", technique.alias("technique"), alike.alias("alike")).where(F.col("technique").isNotNull() | F.col("alike"))
    pairs = hits.withColumn("score", _score(F.col("technique"))).groupBy("label", "brand").agg(
        F.max_by("technique", "score").alias("technique"), F.max("score").alias("score"))
    near = (F.levenshtein("label", "brand", 2) == -1) & reaches(_common(label, brand))
    return pairs.where(F.when(F.col("technique").isNotNull(), True).otherwise(near))


def ratio_candidates(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """All pairs of unequal names whose Ratcliff-Obershelp ratio can exceed 7/10: ``label, brand``.

    The ratio is 2M / (n + m) with M at most the number of common characters c (counted with repetition), and c is at
    most either length.  So c exceeds 7/13 of both lengths, hence two names of such a pair have at least two characters
    in common and, by the prefix filter, share two of each one's rarest ``n - ceil(8 n / 15) + 2``; 2c / (n + m) is then
    held against the bound before any ratio is computed.
    """
    def pruning(df: DataFrame, name: str) -> DataFrame:
        c, n = F.col("cs"), F.length(name)
        token = lambda i: F.concat(F.get(c, i - 1), (i - F.array_position(c, F.get(c, i - 1)).cast("int")).cast("string"))
        tokens = df.select(name, _sorted_chars(F.col(name)).alias("cs")).select(name, F.transform(V.positions(F.col(name)), token).alias("tokens"))
        rare = tokens.select(name, "tokens", F.slice("tokens", F.lit(1), F.least(n, n - F.ceil(n * 8 / 15).cast("int") + 2)).alias("rare"))
        keys = F.flatten(F.transform("rare", lambda x, i: F.transform(F.slice("rare", i + 2, F.greatest(F.size("rare"), F.lit(1))), lambda y: F.concat(x, y))))
        return rare.select(name, F.col("tokens").alias(f"{name}_tokens"), F.explode(keys).alias("key"))

    n, m = F.length("label"), F.length("brand")
    hits = pruning(labels.select("label").distinct(), "label").join(sized_broadcast(pruning(brands.select("brand").distinct(), "brand")), "key")
    hits = hits.where((F.col("label") != F.col("brand")) & (20 * F.least(n, m) > 7 * (n + m)))
    return hits.where(20 * F.size(F.array_intersect("label_tokens", "brand_tokens")) > 7 * (n + m)).select("label", "brand").distinct()


def technique_matches(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Pairs explained by a technique, best technique per (label, brand)."""
    return compare_labels(labels, brands, similar=False).where(F.col("technique").isNotNull())


def similarity_candidates(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Pairs without a technique that may still reach the similarity score."""
    return compare_labels(labels, brands).where(F.col("technique").isNull()).select("label", "brand")


def scored_pairs(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Technique and similarity detections: ``label, brand, technique, score``."""
    pairs = compare_labels(labels, brands)
    # pairs with a technique enter the similarity function as NULL and cost nothing there
    similar = jaro_winkler(F.when(F.col("technique").isNull(), F.col("label")), F.col("brand")) * SIMILARITY_WEIGHT
    return settle(pairs.withColumn("sim", similar), ["sim"]).where(F.col("technique").isNotNull() | (F.col("sim") >= DETECTION)).select(
        "label", "brand", F.coalesce("technique", F.lit("high_similarity")).alias("technique"),
        F.coalesce("score", "sim").alias("score"))


def similarity_matches(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Similarity detections of pairs without a technique."""
    return scored_pairs(labels, brands).where(F.col("technique") == "high_similarity")


def homograph_matches(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """Non-ASCII hosts whose folded form contains a brand: ``host, brand``."""
    table = refdata.confusables()
    src, dst = "".join(c for c, _, _ in table), "".join(latin for _, latin, _ in table)
    odd = hosts.where(F.col("host").rlike(r"[^\x00-\x7f]")).select("host").distinct().withColumn(
        "folded", F.translate("host", src, dst)).where(F.col("folded") != F.col("host"))
    return containment_hits(odd, "folded", brands, "brand").where(
        ~F.contains(F.col("host"), F.col("brand"))).select("host", "brand")


def best_brand_per_label(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Highest score per label; ties go to the alphabetically first brand."""
    every = scored_pairs(unprotected_labels(labels.select("label"), brands), brands)
    best = every.groupBy("label").agg(F.min_by(
        F.struct("brand", "technique", "score"), F.struct((-F.col("score")).alias("s"), "brand")).alias("b"))
    return best.select("label", "b.*")


def severity(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= HIGH, "high").otherwise("medium")


def lookalike_hosts(parts: DataFrame, brands: DataFrame) -> DataFrame:
    """Best imitated brand per host: ``host, label, brand, technique, score, severity`` (detected hosts only)."""
    hosts = usable_label(parts).select("host", F.col("host_label").alias("label")).distinct()
    return lookalikes_of(materialize(hosts), brands)


def lookalikes_of(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """The same for a (materialised) table of distinct ``host, label``."""
    labels = dealt(materialize(hosts.select("label").distinct()))  # short rows, much work on each
    by_label = best_brand_per_label(labels, brands)
    by_host = homograph_matches(hosts, brands).groupBy("host").agg(F.min("brand").alias("h_brand"))
    out = hosts.join(by_label, "label", "left").join(by_host, "host", "left")
    folded = F.col("h_brand").isNotNull()
    return out.select(
        "host", "label", F.coalesce("h_brand", "brand").alias("brand"),
        F.when(folded, F.lit("idn_homograph")).otherwise(F.col("technique")).alias("technique"),
        F.when(folded, F.lit(SCORES["idn_homograph"])).otherwise(F.col("score")).alias("score"),
    ).where(F.col("brand").isNotNull()).withColumn("severity", severity(F.col("score")))


def imitated_brands(parts: DataFrame, brands: DataFrame) -> DataFrame:
    """Which brands are imitated, how, and how often: ``technique, brand, n_urls, n_seen``."""
    # one pass over the URLs; everything after it works on distinct hosts
    seen = materialize(usable_label(parts).groupBy("host", F.col("host_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n_urls"), F.sum("n_seen").alias("n_seen")))
    return (lookalikes_of(seen.select("host", "label"), brands).join(seen.drop("label"), "host").groupBy("technique", "brand")
            .agg(F.sum("n_urls").alias("n_urls"), F.sum("n_seen").alias("n_seen")))


def watch_hits(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Observed labels that equal a generated variant of a brand."""
    vs = V.brand_variants(brands).withColumnRenamed("variant", "label")
    return labels.join(sized_broadcast(vs), "label").select("label", "brand", "kind", "position")
