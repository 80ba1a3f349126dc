"""The queries of this subpackage: one per operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nighspark.llm.common import small_batches, table


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.sharding import shard_layout

    return shard_layout(table(spark, sf_dir, "documents"), 40)


def _bucket(modulus: int):
    """crc32 of doc_id as text, modulo `modulus`: who is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op3_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.langid import identify, train

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(_bucket(5) != 0).select("text", "lang"))
    held = docs.select("doc_id", (_bucket(5) == 0).alias("held_out"), "text")
    return identify(held, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_paragraph_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.substring import repeated_spans

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(docs)
    return spans.select(F.col("id").alias("doc_id"), F.col("start").alias("first_word"), "n_words", "cluster_id", "removed")


def op5_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.neardup import near_duplicates

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2, percent=80)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.lmscore import score_texts

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, "doc_id", "text", _bucket(10) == 0)


def op7_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.linededup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = dedup_lines(docs.withColumn("n_lines", n_lines), n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    from nighspark.llm.packing import added_tokens, pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    added = added_tokens(_tokenizer("byte_bpe_50k.json"))
    out = pack_documents(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.nndescent import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.tokencount import count_tokens

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens", F.round("token_score", 6).alias("token_score"))


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nighspark.llm.decontam import contamination, judged

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(contamination(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jump_sharding": op1_jump_sharding,
        "op2_swap_packing": op2_swap_packing,
        "op3_viterbi_language": op3_viterbi_language,
        "op4_paragraph_passages": op4_paragraph_passages,
        "op5_minmax_neardup": op5_minmax_neardup,
        "op6_context_mixing": op6_context_mixing,
        "op7_template_lines": op7_template_lines,
        "op8_nn_descent": op8_nn_descent,
        "op9_trie_tokens": op9_trie_tokens,
        "op10_suffix_decontamination": op10_suffix_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """Training, packing, passages and token counts are not SQL's; tests/llm hold those against plain versions."""
    from nighspark.llm import oracles

    sql = {"op1_jump_sharding": oracles.OP1, "op5_minmax_neardup": oracles.OP5, "op7_template_lines": oracles.OP7, "op8_nn_descent": oracles.OP8, "op10_suffix_decontamination": oracles.OP10}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
