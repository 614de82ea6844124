"""Matching many terms or regexes against texts, without comparing every text with every pattern.

Two exact forms.  Up to ``LITERAL_LIST_MAX`` patterns are tested as literals in one narrow pass.  A larger table is indexed
by *anchors*: every term is filed under the one of its three-character grams that the fewest terms of the table have (a
shorter term under itself).  A text emits each of its grams once, whatever the lengths of the terms, meets the terms of
that anchor in an ordinary (broadcast if counted small, else shuffled and skew-splittable) equi join, and ``contains``
decides.  A regex is filed under the longest piece of text that all its matches must hold; the few without such a piece
meet the texts in blocks.  No term, rule or text is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import text as X
from lurewatch.session import LITERAL_LIST_MAX, bounded_values, materialize, sized_broadcast

GRAM = 3


def term_lengths(terms: DataFrame, term: str) -> list[int]:
    """The distinct term lengths (a handful of integers, whatever the number of terms)."""
    return sorted(r[0] for r in terms.select(F.length(term).alias("n")).where("n IS NOT NULL").distinct().collect())


def substrings(s: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.when(F.length(s) >= n, F.transform(starts, lambda i: F.substr(s, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[of(n) for n in lengths]))


def anchors(terms: DataFrame, term: str) -> DataFrame:
    """``term, _anchor``: each distinct term and its rarest gram within the table (ties to the smaller gram)."""
    t = terms.select(term).where(F.col(term).isNotNull()).distinct()
    grams = t.withColumn("_g", F.explode(F.when(F.length(term) >= GRAM, substrings(F.col(term), [GRAM])).otherwise(F.array(term))))
    rarity = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    return grams.join(rarity, "_g").groupBy(term).agg(F.min(F.struct("_n", "_g")).alias("_a")).select(term, F.col("_a._g").alias("_anchor"))


def containment_hits(texts: DataFrame, text: str, terms: DataFrame, term: str,
                     literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """``texts`` x matching terms: all columns of ``texts`` plus ``term`` (inner).

    Each row of ``texts`` meets each distinct term once; NULL texts and terms match nothing, an empty term matches every text.
    """
    listed = bounded_values(terms, term, literal_max)
    if listed is not None:
        hits = F.filter(F.array(*[F.lit(t) for t in listed]).cast("array<string>"), lambda t: F.contains(F.col(text), t))
        return texts.withColumn(term, F.explode(hits))
    lengths = term_lengths(terms.select(F.substr(F.col(term), F.lit(1), F.lit(GRAM)).alias(term)), term)
    # one regex pass per length instead of a lambda per position (within a surrogate pair it also gives pieces that no term has)
    grams = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) for n in lengths]
    keyed = texts.withColumn("_anchor", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *grams))))
    index = sized_broadcast(anchors(terms, term), probe=terms)  # one row per distinct term
    return keyed.join(index, "_anchor").where(F.contains(F.col(text), F.col(term))).drop("_anchor")


def containment_weights(texts: DataFrame, key: str, text: str, lexicon: DataFrame, literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """Per key: number, sum and maximum weight of the lexicon terms contained in the text."""
    hits = containment_hits(texts.select(key, text), text, lexicon, "term", literal_max)
    return (hits.join(sized_broadcast(lexicon.select("term", "weight")), "term")
            .groupBy(key).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("sum_weight"),
                              F.max("weight").alias("max_weight")))


def any_contained(df: DataFrame, key: str, tests: dict[str, tuple[str, DataFrame, bool]], literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """Add 0/1 columns, ``out: (text, terms, at_end)``: whether any ``term`` is in the text (with ``at_end``: ends it).

    ``key`` must be unique.  Term tables beyond ``literal_max`` meet each text once, whatever the number of columns on it, and
    all that is found comes back in one join.
    """
    base, indexed = df, {}
    for out, (text, terms, at_end) in tests.items():
        listed = bounded_values(terms, "term", literal_max)
        if listed is None:
            indexed.setdefault(text, []).append(terms.select("term", F.lit(out).alias("_out"), F.lit(at_end).alias("_at_end")).where("term IS NOT NULL").distinct())
        else:
            test = X.ends_with_any if at_end else X.any_of
            df = df.withColumn(out, X.flag(test(f"`{text}`", listed)) if listed else F.lit(0))
    if not indexed:
        return df
    found = None
    for text, tables in indexed.items():
        index = reduce(DataFrame.unionByName, tables)
        hits = containment_hits(base.select(key, F.col(text).alias("_text")), "_text", index, "term", literal_max).join(sized_broadcast(index), "term")
        hits = hits.where(~F.col("_at_end") | F.endswith("_text", "term")).select(key, "_out")
        found = hits if found is None else found.unionByName(hits)
    outs = [out for out in tests if out not in df.columns]
    flags = found.groupBy(key).agg(*[F.max(X.flag(F.col("_out") == out)).alias(out) for out in outs])
    return df.join(flags, key, "left").fillna(0, outs)


# --- regex rules -------------------------------------------------------------

_BREAK = "\x01"  # stands for everything that is no fixed text


def required_texts(regex: Column) -> Column:
    """The texts that every match of the regex must contain, or NULL where none is certain.

    Works on the rule table, natively, and only ever errs by giving less: escapes, classes, groups, quantified and optional
    characters break the text; alternatives outside groups, inline flags and rare escapes give NULL.
    """
    unclear = regex.rlike(r"\(\?(?!:)") | regex.rlike(r"\\[^dDwWsSbB0-9pP\W_]") | regex.rlike(r"\\0") | F.contains(regex, F.lit(_BREAK))
    s = F.regexp_replace(regex, r"\\[pP]\{[^}]*\}|\\[pP].|\\.", _BREAK)
    for _ in range(3):  # nested classes, then nested groups
        s = F.regexp_replace(s, r"\[[^\[\]]*\]", _BREAK)
    for _ in range(4):
        s = F.regexp_replace(s, r"\([^()]*\)", _BREAK)
    s = F.regexp_replace(s, r".(?:[?*]|\{[^}]*\})[+?]?", _BREAK)
    unclear = unclear | s.rlike(r"[|()\[\]]")
    s = F.regexp_replace(s, r"[+.^$?*{}]", _BREAK)
    return F.when(~unclear, F.array_distinct(F.filter(F.split(s, _BREAK), lambda p: p != "")))


def longest_text(pieces: Column) -> Column:
    return F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def required_text(regex: Column) -> Column:
    """The longest text that every match of the regex must contain, or NULL where none is certain."""
    return longest_text(required_texts(regex))


def rule_hits(texts: DataFrame, key: str, text: str, rules: DataFrame, literal_max: int = LITERAL_LIST_MAX, block: int = 64, held: int = 128) -> DataFrame:
    """``key, rule_id, weight`` of every rule whose ``regex`` occurs in the text.

    ``rules``: ``rule_id, regex, weight``, one row per rule (repeated rows count once); rules and texts that are NULL match
    nothing; a regex that Java cannot compile fails the job.  Of a table beyond ``literal_max``, the regexes without required text
    go in blocks of ``block`` over some ``held`` texts at a time, so that each is compiled once for them.
    """
    rules = rules.select("rule_id", "regex", F.col("weight").cast("int").alias("weight")).where("rule_id IS NOT NULL AND regex IS NOT NULL").distinct()
    texts = texts.select(key, text)
    t = F.col(text)
    rows = rules.limit(literal_max + 1).collect()
    if len(rows) <= literal_max:
        tests = [F.when(t.rlike(r.regex), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.weight).cast("int").alias("weight"))) for r in rows]
        none = F.array().cast("array<struct<rule_id:string,weight:int>>")
        return texts.select(key, F.explode(F.filter(F.concat(none, F.array(*tests)) if tests else none, lambda x: x.isNotNull())).alias("r")).select(key, "r.*")
    rules = materialize(rules.withColumn("_all", required_texts(F.col("regex"))).withColumn("_must", longest_text(F.col("_all"))))  # read by both ways below
    texts = materialize(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL"))
    anchored, free = rules.where(F.length("_must") >= GRAM), rules.where("_must IS NULL OR length(_must) < 3")
    near = containment_hits(texts, "_text", anchored, "_must", literal_max=0).join(sized_broadcast(anchored), "_must")
    # a text that lacks another required piece needs no regex: one is compiled per text and rule here
    near = near.where(F.forall("_all", lambda p: F.contains("_text", p))).where(F.rlike("_text", "regex")).select(F.col("_key").alias(key), "rule_id", "weight")
    n_blocks = -(-free.count() // block)
    if not n_blocks:
        return near
    number = F.pmod(F.xxhash64("rule_id", "regex"), F.lit(n_blocks)).cast("int")
    blocks = free.groupBy(number.alias("_block")).agg(F.collect_list(F.struct("rule_id", "weight", "regex")).alias("_rules"))
    # rows that repeat are held once, with their number: the lists stay short
    few = texts.groupBy("_key", "_text").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("_key", "_text"), F.lit(-(-texts.count() // held) or 1))
    few = few.groupBy(part.alias("_part")).agg(F.collect_list(F.struct("_key", "_text", "_n")).alias("_texts"))
    met = few.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(sized_broadcast(blocks), "_block")
    # regexp_instr keeps the regex it compiled last, so the texts are the inner loop
    hit = lambda r: F.transform(F.filter("_texts", lambda x: F.regexp_instr(x["_text"], r["regex"]) > 0),
                                lambda x: F.struct(x["_key"].alias(key), x["_n"].alias("_n"), r["rule_id"].alias("rule_id"), r["weight"].alias("weight")))
    far = met.select(F.explode(F.flatten(F.transform("_rules", hit))).alias("r")).select("r.*")
    far = far.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(key, "rule_id", "weight")
    return near.unionByName(far)


def rule_points(texts: DataFrame, key: str, text: str, rules: DataFrame, literal_max: int = LITERAL_LIST_MAX) -> DataFrame:
    """Per key with a matching rule: ``n_rules, rule_points, rule_ids`` (ids in ascending order)."""
    return rule_hits(texts, key, text, rules, literal_max).groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("n_rules"), F.coalesce(F.sum("weight"), F.lit(0)).cast("int").alias("rule_points"),
        F.sort_array(F.collect_list("rule_id")).alias("rule_ids"))
