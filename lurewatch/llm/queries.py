"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import line_dedup, merkle, mixing, topk
from lurewatch.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op4_source_mixing": mixing.ORACLE, "op5_uniform_threshold_topk": topk.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_merkle_intervals": merkle.ORACLE}


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file (installed on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of at least 0.9."""
    from lurewatch.llm.signature_join import signature_components

    return signature_components(documents(spark, sf_dir), n=3, pct=90)


@query
def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, line labels by a conditional random field, and whether the document is kept."""
    from lurewatch.llm.line_quality import fit_on_labels, judge_documents

    docs = documents(spark, sf_dir)
    return judge_documents(docs, fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by weighted hash draws down a tree, and where each row goes with a ninth."""
    from lurewatch.llm.hash_tree import SHARDS, layout, shard_documents

    return shard_documents(documents(spark, sf_dir), layout(SHARDS), layout(SHARDS + 1))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    from lurewatch.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).drop("source_name")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and a digest of what stays, per document."""
    from pyspark.sql import functions as F

    from lurewatch.llm.line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products for every hundredth vector."""
    from lurewatch.llm.topk import integer_vectors, top_k

    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


@query
def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word unigram base score and marginal subword lattice score of every document."""
    from lurewatch.llm.lattice_lm import score_documents

    return score_documents(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and expressions of every document."""
    from lurewatch.llm.license_scan import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


@query
def op9_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    from lurewatch.llm.packing import best_fit

    return best_fit(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from lurewatch.llm.secret_scan import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


@query
def op13_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, in which the contract's rule plants some, and the text without their repeats."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from lurewatch.llm.maximal_pairs import find_runs

    def planted(doc_id, n):
        h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
        if h % 10 or not n:
            return None
        g = h // 10
        a = g % n
        at = np.arange(n)
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
        return at

    out = find_runs(documents(spark, sf_dir), reorder=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumns({"best": best, "lines": lines})
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op11_merkle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document; the line ends of every second one are tampered with."""
    from pyspark.sql import functions as F

    docs = documents(spark, sf_dir)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    m = merkle.build_manifest(docs, altered={"text": F.when(picked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    root = F.lit(m.root).cast("string")
    return merkle.checked(merkle.proofs(m)).withColumns({"root": root, "verified": F.col("folded_root") == root}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in windows of 2048 tokens that mirror the sources' shares."""
    from lurewatch.llm.deficit_packing import pack_by_deficit

    return pack_by_deficit(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).drop("source")
