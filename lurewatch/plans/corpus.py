"""Queries for sources, sinks and corpus building."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import corpus as C
from lurewatch.plans import fixtures as fx
from lurewatch.plans.registry import query
from lurewatch.session import scratch_path
from lurewatch.sources import feeds, sinks


def _flat(df):
    """Array columns as joined strings."""
    return df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


@query("labelled_csv_feed")
def _csv(spark, sf):
    path = scratch_path(spark, "feed-b")
    fx.feed_b(spark, sf).select(F.col("url").alias("URL"), F.col("label").alias("ClassLabel"), "ord", "f1").write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return feeds.read_labelled_csv(spark, path, "URL string, ClassLabel string, ord bigint, f1 double", "vendor_b",
                                   "URL", "ClassLabel")


@query("line_feed")
def _lines(spark, sf):
    path = scratch_path(spark, "lines")
    fx.corpus(spark, sf).select(F.when(F.col("url_id") % 10 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit(" "), "url", F.lit(" ")))).write.text(path)
    return feeds.read_line_feed(spark, path, 1, "open_list")


@query("url_list")
def _list(spark, sf):
    path = scratch_path(spark, "list")
    fx.known_urls(spark, sf).select("url").write.text(path)
    return feeds.read_line_feed(spark, path, None, None)


@query("json_feed")
def _json(spark, sf):
    path = scratch_path(spark, "json")
    fx.known_urls(spark, sf).select(F.when(F.col("url_id") % 7 > 0, F.col("url")).alias("url"), "brand").write.json(path)
    return feeds.read_json_feed(spark, path, "json_feed", multi_line=False)


@query("json_array_feed")
def _json_array(spark, sf):
    """The array form: one document per file, here one file per brand."""
    path = scratch_path(spark, "json-array")
    rows = fx.known_urls(spark, sf).groupBy("brand").agg(F.to_json(F.collect_list(F.struct(F.when(F.col("url_id") % 7 > 0, F.col("url")).alias("url"))),
                                                                   {"ignoreNullFields": "false"}).alias("value"))
    rows.repartition("brand").write.option("maxRecordsPerFile", 1).partitionBy("brand").text(path)
    return feeds.read_json_feed(spark, path, "json_array", multi_line=True).select("url", "label", "source")


@query("partitioned_feed")
def _partitioned(spark, sf):
    """Newest partition of a feed that is partitioned by day."""
    path = scratch_path(spark, "partitioned")
    rows = fx.known_urls(spark, sf).select("url_id", "url", F.when(F.col("url_id") % 3 == 0, "2024-03-15").otherwise("2024-01-01").alias("snapshot_date"))
    rows.write.partitionBy("snapshot_date").parquet(path)
    out = feeds.read_partitioned_latest(spark, path, "url_id bigint, url string, snapshot_date string")
    return out.select("url_id", "url", "snapshot_date")


@query("commented_csv_feed")
def _commented(spark, sf):
    path = scratch_path(spark, "commented")
    k = fx.known_urls(spark, sf)
    line = F.when(F.col("url_id") % 5 == 0, F.concat(F.lit("# note "), F.col("url_id").cast("string"))).when(
        F.col("url_id") % 7 == 0, F.concat(F.lit('"'), F.col("url_id").cast("string"), F.lit('","day","nan","online"'))).otherwise(
        F.concat(F.lit('"'), F.col("url_id").cast("string"), F.lit('","day","'), "url", F.lit('","online"')))
    k.select(line).write.text(path)
    return feeds.read_commented_csv(spark, path, "id string, added string, address string, status string")


@query("ranked_domains")
def _ranked(spark, sf):
    path = scratch_path(spark, "ranked")
    fx.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("rank"), F.concat(F.lit("site"), F.col("o_custkey").cast("string"), F.lit(".com")).alias("domain")
    ).write.csv(path)
    return feeds.first_ranked(feeds.read_ranked_domains(spark, path), 10_000)


def _lifecycle_rows(spark, sf):
    o, k = fx.table(spark, sf, "orders"), fx.known_urls(spark, sf)
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return o.join(k, o.o_custkey == k.url_id).select(
        F.col("o_orderkey").cast("string").alias("phish_id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("url")).alias("url"),
        F.lit("detail").alias("phish_detail_url"), stamp.alias("submission_time"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("verified"), stamp.alias("verification_time"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("online"), F.col("brand").alias("target"))


def _show_lifecycle(df):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("phish_id", "url", day("submission_time"), "verified", day("verification_time"), "online", "target", "label",
                     *[c for c in df.columns if c == "snapshot_date"])


@query("lifecycle_feed")
def _lifecycle(spark, sf):
    path = scratch_path(spark, "lifecycle")
    _lifecycle_rows(spark, sf).write.csv(path, header=True)
    return _show_lifecycle(feeds.read_lifecycle_feed(spark, path))


@query("latest_lifecycle_snapshot")
def _latest(spark, sf):
    root = scratch_path(spark, "snapshots")
    rows = _lifecycle_rows(spark, sf)
    rows.where("online = 'no'").write.csv(f"{root}/feed_20240101.csv", header=True)
    rows.where("online = 'yes'").write.csv(f"{root}/feed_20240315.csv", header=True)
    return _show_lifecycle(feeds.read_latest_lifecycle(spark, root))


@query("corpus_sink_roundtrip")
def _sink(spark, sf):
    """Cleaned corpus written by label and read back: rows per partition."""
    path = scratch_path(spark, "corpus")
    clean = C.clean_labels(fx.feed_a(spark, sf), ["ord", "f1"]).withColumn("source", F.lit("vendor_a"))
    sinks.write_corpus(clean.select("url", "label", "source", "f1"), path, "csv", ("source", "label"))
    back = spark.read.schema("url string, f1 double, source string, label int").csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"),
                                               F.sum("f1").alias("sum_f1"), F.sum(F.length("url")).alias("n_chars"))


@query("keep_first_dedupe")
def _first(spark, sf):
    df = fx.feed_a(spark, sf).withColumn("url_normalized", C.normalized_url(F.col("url")))
    return C.keep_first(df, ["url_normalized"], ["ord", "f1", "label"])


def _merged(spark, sf):
    a = fx.feed_a(spark, sf).withColumn("source", F.lit("a"))
    b = fx.feed_b(spark, sf).withColumn("source", F.lit("b"))
    return C.merge_labelled(
        a.withColumn("f", F.col("f1")), b.withColumn("f", F.col("f1")), ["ord", "f1"])


@query("merged_corpus")
def _merge(spark, sf):
    return _flat(_merged(spark, sf))


@query("common_urls")
def _common(spark, sf):
    return C.common_urls(fx.feed_a(spark, sf), fx.feed_b(spark, sf)).agg(F.count(F.lit(1)).alias("n_common"))


@query("common_url_set")
def _common_set(spark, sf):
    return C.common_urls(fx.feed_a(spark, sf), fx.feed_b(spark, sf))


@query("supplemented_corpus")
def _supplement(spark, sf):
    a = fx.feed_a(spark, sf).select("url", "label")
    return C.add_supplement(a, fx.feed_b(spark, sf).select("url", "label")).groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))


@query("urls_not_held")
def _except(spark, sf):
    held = fx.feed_a(spark, sf)
    return C.new_urls(fx.feed_b(spark, sf).select("url").distinct(), held)


@query("cleaned_corpus")
def _clean(spark, sf):
    return C.clean_labels(fx.feed_b(spark, sf), ["ord", "f1", "label"])


@query("feed_union")
def _union(spark, sf):
    a = fx.feed_a(spark, sf).select("url", "label").withColumn("source", F.lit("a"))
    p = fx.table(spark, sf, "pages").select("url").withColumn("source", F.lit("pages"))
    return C.union_feeds(a, None, p).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))


@query("first_source_union")
def _first_source(spark, sf):
    b = fx.feed_b(spark, sf).select("url", F.lit(1).alias("label"))
    return C.union_first_source(b, fx.feed_a(spark, sf).select("url", F.col("label").alias("Label")), fx.table(spark, sf, "pages").select("url"))


@query("www_variants")
def _www(spark, sf):
    seeds = fx.known_urls(spark, sf).select("url", F.col("url_id").alias("rank"))
    return C.www_variants(seeds)


@query("seeded_sample")
def _sample(spark, sf):
    return C.hash_sample(fx.corpus(spark, sf).select("url_id", "url"), 1000)


@query("balanced_classes")
def _balanced(spark, sf):
    df = fx.known_urls(spark, sf).select("url", F.when(F.col("technique_id").isin(1, 2, 3), 1).otherwise(0).alias("label"))
    return C.balance_classes(df)


@query("label_distribution")
def _labels(spark, sf):
    return C.label_distribution(_merged(spark, sf))


@query("corpus_statistics")
def _stats(spark, sf):
    return C.corpus_statistics(fx.feed_a(spark, sf))
