"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe_cuts, chat_grammar, dac_files, fptree_search, hd_langid, jaccard_regions, label_shards, quality_rules,
               secret_battery, simhash_decontam, source_divergence, srs_search, warc_source)
from .common import prepare, table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_forced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = vocabulary("byte_bpe_50k.json")
    return bpe_cuts.digests(bpe_cuts.round_trip(table(spark, sf_dir, "documents"), path))


def op3_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return srs_search.search(table(spark, sf_dir, "embeddings"))


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return label_shards.assign(table(spark, sf_dir, "documents"))


def op5_language_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return hd_langid.identify(docs, hd_langid.learn(docs))


def op6_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat_grammar.read_back(chat_grammar.format_conversations(rows.unionByName(more)))


def op7_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    files = dac_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return dac_files.read(files)


def op8_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_regions.components(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    files = warc_source.write(table(spark, sf_dir, "pages"))
    return warc_source.digests(spark, files._folder)


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_fptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fptree_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_battery.secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_bpe_forced_cuts, op3_stable_projections, op4_label_propagation_shards,
    op5_language_hyperdimensional, op6_chat_grammar, op7_token_dac, op8_jaccard_regions, op9_warc,
    op10_simhash_decontamination, op11_source_divergence, op12_fptree_search, op13_secret_battery,
)}

#: DuckDB SQL where it can express a query; the others are tested against
#: brute-force versions, exact round trips or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {"op11_source_divergence": source_divergence.SQL, "op12_fptree_search": fptree_search.SQL}
