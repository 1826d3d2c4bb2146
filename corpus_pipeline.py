"""Corpus pipeline: language ID, quality, near duplicates, benchmark
decontamination, byte-pair encoding.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of
``documents``; the last returns each kept document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import bpe_cuts, hd_langid, jaccard_regions, quality_rules, simhash_decontam
from panelcast.llm.common import prepare, staged, table
from panelcast.llm.queries import vocabulary


#: Five words to a shingle, links at 0.8 (op8's own contract has three and 0.9).
NEAR = jaccard_regions.Rule(words=5, num=80, den=100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or in no learned language."""
    prepare(spark)
    return hd_langid.keep_known(docs, hd_langid.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose rule score is below the cut."""
    prepare(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of linked documents:
    five-word shingles, Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return jaccard_regions.keep_first(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    prepare(spark)
    return simhash_decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids."""
    prepare(spark)
    path = vocabulary("byte_bpe_50k.json")
    return bpe_cuts.digests(bpe_cuts.round_trip(docs, path), keep=("doc_id", "ids")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: The stages iterate and learn; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
