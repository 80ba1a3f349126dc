"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Defined cases are those of the operators; a stage's docs may be empty
and may have further columns of any name, which go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nighspark.llm.common import boxed, drop_written, small_batches, table, unboxed, written
from nighspark.llm.decontam import decontaminate
from nighspark.llm.langid import UNKNOWN, identify, train
from nighspark.llm.linededup import dedup_lines
from nighspark.llm.neardup import keep_one
from nighspark.llm.packing import added_tokens, pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels teach; those without any letter (und) go."""
    small_batches(spark)
    model = train(docs.select("text", "lang"))
    found = identify(boxed(docs), model, text="__ns_all.text")
    return unboxed(found.where(F.col("lang_pred") != UNKNOWN))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs; n_chars counts what is left."""
    out = dedup_lines(docs, n_dropped="__ns_dropped")
    return out.withColumn("n_chars", F.when(F.col("__ns_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest doc_id) of each group of near duplicates: five words, similarity 0.8."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences of 1024."""
    small_batches(spark)
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The first stage is a trained model, which SQL can't express; tests/llm compares all stages with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
