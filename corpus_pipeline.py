"""A corpus pipeline: quality, line dedup, near-duplicates, source mix, packing; each stage is one operator of ``lurewatch.llm``.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``.  Every stage's result is written as Parquet into the shared
folder (``spark.checkpoint.dir``) and read again as the next stage's documents, so a lost executor costs one stage's tasks
at most.  All stages but the last return the columns of ``documents``; the last returns the packed pieces.

Nulls and other edge cases are those of the operators: a null text fails the quality rules and goes; an empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import stored
from lurewatch.llm.line_dedup import dedup_lines
from lurewatch.llm.line_quality import fit_on_labels, keep_good
from lurewatch.llm.mixing import mixed_documents
from lurewatch.llm.packing import best_fit
from lurewatch.llm.queries import tokenizer_path
from lurewatch.llm.signature_join import keep_first_of_groups


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text, where the documents have it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    return keep_good(docs, fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in one of them; every document stays, if need be with an empty text."""
    return _with_length(dedup_lines(docs).drop("__n_lines", "__n_dropped"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return keep_first_of_groups(docs, n=5, pct=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _with_length(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return best_fit(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

# shingle components, the fitted field and tokenizer ids have no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
