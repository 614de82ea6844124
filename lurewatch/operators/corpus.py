"""Corpus building: dedupe, merge, supplement, clean, balance, sample, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_url(url: Column) -> Column:
    return F.lower(F.trim(url))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``min_by`` combines on the map side, so a key holding a third of all rows
    costs one partial row per task (no sort of a huge group, as ``row_number`` needs).
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def merge_labelled(a: DataFrame, b: DataFrame, order: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Full outer merge of two labelled corpora on the normalised URL.

    Both sides are deduplicated first; conflicting labels become phishing (1);
    vendor features keep a side suffix; ``sources`` lists where the URL came from.
    """
    def side(df: DataFrame, sfx: str) -> DataFrame:
        d = keep_first(df.withColumn("url_normalized", normalized_url(F.col("url"))), ["url_normalized"], order)
        return d.select("url_normalized", *[F.col(c).alias(c + sfx) for c in d.columns if c not in ("url_normalized", *order)])

    sa, sb = suffixes
    m = side(a, sa).join(side(b, sb), "url_normalized", "full_outer")
    la, lb = F.col("label" + sa), F.col("label" + sb)
    feats = [c for c in m.columns if c not in ("url_normalized", "url" + sa, "url" + sb, "label" + sa, "label" + sb,
                                               "source" + sa, "source" + sb)]
    return m.select(
        "url_normalized", F.coalesce("url" + sa, "url" + sb).alias("url"),
        F.when(la.isNotNull() & lb.isNotNull() & (la != lb), F.lit(1)).otherwise(F.coalesce(la, lb)).alias("label"),
        F.filter(F.array("source" + sa, "source" + sb), lambda s: s.isNotNull()).alias("sources"), *feats)


def common_urls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised URLs present in both corpora (distinct)."""
    left = a.select(normalized_url(F.col("url")).alias("url_normalized")).distinct()
    right = b.select(normalized_url(F.col("url")).alias("url_normalized")).distinct()
    return left.join(right, "url_normalized", "left_semi")


def new_urls(supplement: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of the supplement whose normalised URL is not in the corpus."""
    held = corpus.select(normalized_url(F.col("url")).alias("_held")).distinct()
    return supplement.join(held, normalized_url(F.col("url")) == F.col("_held"), "left_anti")


def add_supplement(corpus: DataFrame, supplement: DataFrame) -> DataFrame:
    return corpus.unionByName(new_urls(supplement, corpus), allowMissingColumns=True)


def clean_labels(df: DataFrame, order: list[str]) -> DataFrame:
    """Drop missing URLs/labels, keep labels 0/1, deduplicate exact URLs (first in ``order``)."""
    ok = df.where(F.col("url").isNotNull()).withColumn("label", F.col("label").try_cast("int")).where(
        F.col("label").isin(0, 1))
    return keep_first(ok, ["url"], order)


def union_feeds(*feeds: DataFrame | None) -> DataFrame:
    """Union of the feeds that are there; missing columns become NULL."""
    present = [f for f in feeds if f is not None]
    out = present[0]
    for f in present[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_or_default(df: DataFrame, names: tuple[str, ...] = ("label", "Label"), default: int = 0) -> DataFrame:
    """``url, label`` with the first label column that exists, else the default."""
    name = next((n for n in names if n in df.columns), None)
    lab = F.col(name).try_cast("int") if name else F.lit(None).cast("int")
    return df.select("url", F.coalesce(lab, F.lit(default)).alias("label"))


def union_first_source(*feeds: DataFrame) -> DataFrame:
    """Union-distinct on the exact URL; an earlier feed wins over a later one."""
    tagged = [label_or_default(f).withColumn("_p", F.lit(i)) for i, f in enumerate(feeds)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return keep_first(out.where(F.col("url") != ""), ["url"], ["_p", "label"]).drop("_p")


def www_variants(seeds: DataFrame, first: int | None = None, order: str = "rank") -> DataFrame:
    """Seeds plus their www / non-www form (of the first ``first`` by ``order`` where given)."""
    u = F.col("url")
    other = F.when(F.contains(u, F.lit("www.")), F.replace(u, F.lit("www."), F.lit(""))).otherwise(
        F.concat(F.lit("https://www."), F.replace(u, F.lit("https://"), F.lit(""))))
    head = (seeds if first is None else seeds.orderBy(order).limit(first)).select(other.alias("url"), F.lit(True).alias("generated"))
    return seeds.select("url", F.lit(False).alias("generated")).unionByName(head)


def sample_hash(seed: int, url: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), url))


def hash_sample(df: DataFrame, n: int, seed: int = 42, url: str = "url") -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), repeatable: the smallest seeded hashes of distinct URLs.

    No global sort: rows are counted per 4-digit hash prefix (65,536 at most),
    prefixes below the boundary are kept whole, and only the boundary prefix
    is ordered.
    """
    h = df.withColumn("_h", sample_hash(seed, F.col(url))).withColumn("_b", F.substring("_h", 1, 4))
    counts = sorted((r["_b"], r["count"]) for r in h.groupBy("_b").count().collect())
    taken, boundary = 0, None
    for b, c in counts:
        if taken + c > n:
            boundary = b
            break
        taken += c
    if boundary is None:
        return df
    below = h.where(F.col("_b") < boundary)
    edge = h.where(F.col("_b") == boundary).orderBy("_h", url).limit(n - taken)
    return below.unionByName(edge).select(*df.columns)


def balance_classes(df: DataFrame, seed: int = 42) -> DataFrame:
    """All phishing rows plus as many legitimate rows as there are phishing rows (at most)."""
    n = {r["label"]: r["count"] for r in df.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    bad, good = df.where(F.col("label") == 1), df.where(F.col("label") == 0)
    return bad.unionByName(hash_sample(good, min(n.get(0, 0), n.get(1, 0)), seed))


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_urls"))


def corpus_statistics(df: DataFrame) -> DataFrame:
    """Totals, class counts and ratio, feature count, missing values, duplicate URLs (one pass over one shuffle)."""
    feats = [c for c in df.columns if c not in ("url", "label")]
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    per_url = df.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.sum(missing).alias("missing"))
    return per_url.agg(
        F.sum("n").alias("total_urls"), F.sum("good").alias("legitimate_urls"), F.sum("bad").alias("phishing_urls"),
        F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("phishing_ratio"),
        F.lit(len(feats)).alias("num_features"), F.sum("missing").alias("missing_values"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_urls"))


def merge_reasons(pattern: Column, risk: Column) -> Column:
    """Pattern reasons in front of the risk factors: each new one goes to the very front, repeats are skipped."""
    return F.concat(F.reverse(F.array_except(pattern, risk)), risk)
