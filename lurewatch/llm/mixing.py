"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Within its source, documents are sorted by key in ranges of the key space (equal
ranges of a uniform hash hold equal numbers, so a hot source is cut into as many tasks as it needs); sums of the ranges
give each range its offset, a running sum inside the range gives each document its place on the source's line of words.
The source's budget is whole epochs and a rest: each document is taken once per epoch, and once more where the rest
covers it; the document at the cut is taken in part, so the budget is met exactly.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share the sum of all sizes; none gets
more than ``MAX_EPOCHS`` times its own size, and what is cut off goes to the others by weight.  With sources sorted by
cap over weight this is one pass of prefix sums over the table of sources.

Edge cases: null and blank texts have size 0 and are taken 0 times, also where a source has no others; null sources are one source; rows that share id,
source and size are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import WORD, small_batches, stored
from lurewatch.session import sized_broadcast

WEIGHTS, MAX_EPOCHS, SEED, RANGE_ROWS = (5, 2, 1), 3, "mix-1", 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_name(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("-"))


def _key(doc_id: Column, size: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")).cast("binary"))


def _range(key: Column) -> Column:
    """Which of its source's equal ranges of the key space a key is in."""
    return F.floor(F.conv(F.substr(key, F.lit(1), F.lit(8)), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)).cast("long")


def source_budgets(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``name, source_size, target, budget, ranges`` per source of ``rows`` (name, source, size)."""
    src = rows.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), nth + 1).cast("long")).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    scale = 1
    for w in WEIGHTS:
        scale *= w
    by_cap = Window.orderBy(F.expr(f"cap * ({scale} div w)"), "name")
    every = Window.partitionBy()
    src = src.withColumns({
        "all_size": F.sum("source_size").over(every),
        "capped_before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_from": F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    src = src.withColumn("capped", F.expr("(all_size - capped_before) * w > cap * w_from"))
    src = src.withColumns({"free_size": F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every),
                           "free_w": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)})
    return src.select(
        "name", "source_size", F.expr("CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(free_size * w AS DOUBLE) / CAST(free_w AS DOUBLE) END").alias("target"),
        F.expr("CASE WHEN capped THEN cap ELSE free_size * w div free_w END").alias("budget"), F.ceil(F.col("n") / range_rows).cast("long").alias("ranges"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row (and ``source_name`` to join back)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"))
    rows = stored(rows.withColumns({"key": _key(F.col("doc_id"), F.col("size")), "name": _source_name(F.col("source"))}), "sizes")
    budgets = stored(source_budgets(rows, range_rows), "budgets")
    rows = rows.join(budgets, "name").withColumn("range", _range(F.col("key")))
    sums = rows.groupBy("name", "range").agg(F.sum("size").alias("s"))
    before = sums.select("name", "range", (F.sum("s").over(Window.partitionBy("name").orderBy("range")) - F.col("s")).alias("offset"))
    within = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("upto", F.sum("size").over(within)).join(before, ["name", "range"])
    # division by zero is an error in ANSI mode, not NULL
    taken = F.expr("CASE WHEN source_size = 0 THEN 0L ELSE (budget div source_size) * size + greatest(0L, least(size, budget % source_size - (offset + upto - size))) END")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("name").alias("source_name"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """A row's source, size and key; the key goes on with a hash of the whole row (but maps), so that only equal rows share one."""
    size = word_count(F.col(f"`{text_col}`").cast("string"))
    whole = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    key = F.concat(_key(F.col(f"`{id_col}`").cast("long"), size), F.lpad(F.hex(F.xxhash64(*whole)), 16, "0"))
    return {"__name": _source_name(F.col(f"`{source_col}`").cast("string")), "__size": size, "__key": key}


def source_cuts(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each source of ``rows`` (name, source, size, key): whole epochs, and where the rest ends.

    ``name, epochs, cut, rest, ties``: rows with a key below ``cut`` are taken once more; those with that key (``ties``
    equal rows) share the ``rest`` words.  Only one range of a source is sorted, by distinct keys.
    """
    budgets = source_budgets(rows, range_rows).select("name", "ranges", F.expr("CASE WHEN source_size = 0 THEN 0L ELSE budget div source_size END").alias("epochs"),
                                                      F.expr("CASE WHEN source_size = 0 THEN 0L ELSE budget % source_size END").alias("left"))
    budgets = stored(budgets, "cut-budgets")
    ranged = rows.join(budgets, "name").withColumn("range", _range(F.col("key")))
    sums = ranged.groupBy("name", "range").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("name").orderBy("range"))
    sums = stored(sums.withColumn("before", upto - F.col("s")), "range-sums")
    hit = sums.join(budgets, "name").where("left > before AND left <= before + s").select("name", "range", "before", "left")
    # at most one range per source
    keys = ranged.drop("left").join(hit, ["name", "range"]).groupBy("name", "key").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("ties"), F.first("before").alias("before"), F.first("left").alias("left"))
    start = F.col("before") + F.sum("s").over(Window.partitionBy("name").orderBy("key")) - F.col("s")
    cut = keys.withColumn("start", start).where("left > start AND left <= start + s").select("name", F.col("key").alias("cut"), (F.col("left") - F.col("start")).alias("rest"), "ties")
    return budgets.select("name", "epochs").join(cut, "name", "left").fillna({"cut": "", "rest": 0, "ties": 0})


def _repeated(rows: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """Each row as often as its ``__taken`` words hold its text, the last time shortened to what is left."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = rows.where("__taken > 0").withColumn("__part", F.explode(F.expr("sequence(1L, CAST(ceil(__taken / __size) AS BIGINT))")))
    left = F.col("__taken") - (F.col("__part") - 1) * F.col("__size")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), "")
    rows = rows.withColumn("__text", F.when(left >= F.col("__size"), text).otherwise(cut))
    return rows.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, the one at a source's cut shortened.

    Only the table of cuts (a row per source) meets the texts, which stay where they are.  Where equal rows stand at the
    cut, as many of them as the rest holds are taken whole and one is shortened.
    """
    small_batches(docs.sparkSession)
    own = _sized(docs, id_col, text_col, source_col)
    rows = docs.select(own["__name"].alias("name"), F.col(f"`{source_col}`").cast("string").alias("source"), own["__size"].alias("size"), own["__key"].alias("key"))
    cuts = stored(source_cuts(stored(rows, "mix-keys"), range_rows), "cuts")
    cuts = cuts.select(*[F.col(c).alias(f"__{c}") for c in ("name", "epochs", "cut", "rest", "ties")])
    tagged = docs.withColumns({k: v for k, v in own.items() if k != "__name"}).join(sized_broadcast(cuts), own["__name"] == F.col("__name"))
    at_cut, shared = F.col("__key") == F.col("__cut"), F.col("__ties") > 1
    once_more = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(at_cut & ~shared, F.col("__rest")).otherwise(F.lit(0))
    out = _repeated(tagged.withColumn("__taken", F.col("__epochs") * F.col("__size") + once_more), text_col, docs.columns)
    if cuts.where(shared).isEmpty():
        return out
    # equal rows at a cut: one of them, as often as the rest takes it, in steps that are dealt to many tasks
    ties = tagged.where(at_cut & shared).groupBy("__name", "__size", "__rest").agg(*[F.any_value(f"`{c}`").alias(c) for c in docs.columns])
    step = F.col("__size") * F.lit(range_rows)
    steps = ties.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rest") - 1, step))).repartition("__name", "__from")
    steps = steps.withColumn("__taken", F.least(step, F.col("__rest") - F.col("__from")))
    return out.unionByName(_repeated(steps, text_col, docs.columns))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM rows GROUP BY source),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM src),
lined AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped_before,
    CAST(sum(w) OVER (ORDER BY cap * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_from FROM weighed),
marked AS (SELECT *, (total - capped_before) * w > cap * w_from AS capped FROM lined),
freed AS (
  SELECT *, CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS free_size,
    CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS free_w FROM marked),
budgets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(free_size * w AS DOUBLE) / CAST(free_w AS DOUBLE) END AS target,
    CASE WHEN capped THEN cap ELSE free_size * w // free_w END AS budget FROM freed),
placed AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.budget,
    CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY md5('mix-1:' || coalesce(CAST(r.doc_id AS VARCHAR), 'null') || ':' || CAST(r.size AS VARCHAR)), r.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - r.size AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
