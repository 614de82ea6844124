"""Native generators: string neighbourhoods, look-alike variants, bit flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import refdata


def cut(s: Column, i: Column) -> Column:
    """``s`` without its ``i``-th character (1-based)."""
    return F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))


def positions(s: Column, last: Column | None = None) -> Column:
    """``1..length`` (or ``1..last``) as an array; empty for empty strings."""
    n = F.length(s) if last is None else last
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def deletions(s: Column) -> Column:
    return F.array_distinct(F.transform(positions(s), lambda i: cut(s, i)))


def swap(s: Column, i: Column) -> Column:
    """``s`` with characters ``i`` and ``i+1`` exchanged."""
    one = F.lit(1)
    return F.concat(F.substr(s, one, i - 1), F.substr(s, i + 1, one), F.substr(s, i, one), F.substr(s, i + 2))


def swaps(s: Column) -> Column:
    return F.array_distinct(F.transform(positions(s, F.length(s) - 1), lambda i: swap(s, i)))


def wildcards(s: Column) -> Column:
    """``position:rest`` keys: two strings share one iff they have equal length and differ at most there."""
    return F.transform(positions(s), lambda i: F.concat(i.cast("string"), F.lit(":"), cut(s, i)))


def brand_variants(brands: DataFrame) -> DataFrame:
    """Look-alike names of each brand: ``brand, kind, position, variant``.

    Omission, neighbouring key, doubling, swap, digit look-alike; each name once, under its first (kind, position), the
    brand itself excluded.
    """
    b = F.col("brand")
    near = F.create_map(*[F.lit(x) for k, ns in refdata.VARIANT_KEYBOARD.items() for x in (k, ns)])
    looks = F.create_map(*[F.lit(x) for kv in refdata.VARIANT_LOOKALIKE.items() for x in kv])
    one = F.lit(1)

    def entry(kind: int, i: Column, v: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("position"), v.alias("variant"))

    def put(i: Column, c: Column) -> Column:
        return F.concat(F.substr(b, one, i - 1), c, F.substr(b, i + 1))

    keyed = F.flatten(F.transform(positions(b), lambda i: F.transform(
        F.filter(F.split(F.coalesce(F.element_at(near, F.substr(b, i, one)), F.lit("")), ""), lambda c: c != ""),
        lambda c: entry(2, i, put(i, c)))))
    looked = F.filter(
        F.transform(positions(b), lambda i: entry(5, i, put(i, F.element_at(looks, F.substr(b, i, one))))),
        lambda e: e["variant"].isNotNull())
    every = F.concat(
        F.transform(positions(b), lambda i: entry(1, i, cut(b, i))), keyed,
        F.transform(positions(b), lambda i: entry(3, i, F.concat(F.substr(b, one, i), F.substr(b, i)))),
        F.transform(positions(b, F.length(b) - 1), lambda i: entry(4, i, swap(b, i))), looked)
    rows = brands.select("brand", F.explode(every).alias("e")).select("brand", "e.*").where(F.col("variant") != b)
    first = rows.groupBy("brand", "variant").agg(F.min(F.struct("kind", "position")).alias("at"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("omission", "keyboard", "doubling", "swap", "lookalike")]), F.col("at.kind"))
    return first.select("brand", kinds.alias("kind"), F.col("at.position").alias("position"), "variant")


def bitflip_table(spark: SparkSession) -> DataFrame:
    """Printable letters, digits and hyphens one bit away from each host character: ``src, bit, dst``."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789-"
    src = F.explode(F.split(F.lit(alphabet), ""))
    rows = spark.range(1).select(src.alias("src")).where("src <> ''").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    flipped = F.char(F.ascii("src").bitwiseXOR(F.expr("shiftleft(1, bit)")))
    return rows.withColumn("dst", flipped).where(F.col("dst").rlike(r"^([\p{L}\p{N}]|-)$"))
