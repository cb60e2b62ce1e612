"""The registered queries of this package: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import conversations, embeddings, exact, lines, mixing, neardup, packing, pii, search, sharding, tokencounts, toxicity, whitening
from millrace.llm.common import read, stage
from millrace.llm.oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_tokenizer())


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.document_token_counts(read(spark, sf_dir, "documents"), word_tokenizer())


def op4_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op6_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op7_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_fast_similarity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("rid", "source_key")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.quantised(read(spark, sf_dir, "embeddings"))
    return search.top_k(rows, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(read(spark, sf_dir, "embeddings"))
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(read(spark, sf_dir, "conversations"))
    return conversations.repair(rows).drop("repaired")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 finds by the base rules alone, which SQL can say."""
    kinds = [f"n_{k}" for k in pii.KINDS]
    return op2_weak_supervision_pii(spark, sf_dir).select("doc_id", *kinds, "base_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's sizes and targets, and whether what each source gives lies within ten words of its target."""
    rows = mixing.sources_near(stage(mixing.mix(read(spark, sf_dir, "documents")), "mix"))
    return rows.select("doc_id", "size", "source_size", (F.round("target", 4) + F.lit(0.0)).alias("target"), "near")


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12's whole numbers, and whether the whitened covariance is the identity to four digits."""
    rows = op12_embedding_whitening(spark, sf_dir)
    return rows.select("vec_id", "component", "n", "deviation", (F.col("identity_error") <= 1e-4).alias("identity"))


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_weak_supervision_pii": op2_weak_supervision_pii,
        "op3_separator_scan": op3_separator_scan,
        "op4_int8_embedding_dedup": op4_int8_embedding_dedup,
        "op5_hilbert_sharding": op5_hilbert_sharding,
        "op6_radix_exact_dedup": op6_radix_exact_dedup,
        "op7_suffix_line_dedup": op7_suffix_line_dedup,
        "op8_toxicity_chain": op8_toxicity_chain,
        "op9_fast_similarity_dedup": op9_fast_similarity_dedup,
        "op10_subset_sum_mixing": op10_subset_sum_mixing,
        "op11_exact_top_k": op11_exact_top_k,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_conversation_repair": op13_conversation_repair,
        "pii_base_spans": pii_base_spans,
        "whitening_deviations": whitening_deviations,
        "mixing_targets": mixing_targets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
