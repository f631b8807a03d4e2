"""A corpus pipeline: rules, near duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents`` (the last one: packed pieces).
``run`` writes every stage's rows to the shared folder and reads them again.

Edge cases, for every stage. Further columns, whatever their names, come along
(but for the last stage, which returns pieces). An empty table gives an empty
result. Quality rules: a null or empty text fails; copies are judged alike.
Near duplicates: rows that share an id are one document, of which one row stays; rows
without an id are told apart by their text. Repeated strings: a null text becomes empty; of equal
texts the one with the smallest id keeps its bytes. Mixing: a source without
words gives nothing; a null source is a source. Packing: an empty text is its end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.common import materialize, row_key
from seqspark.llm.ngram_join import keyed_components
from seqspark.llm.packing import pack_documents
from seqspark.llm.quality_rules import quality_filter
from seqspark.llm.source_mix import mix_documents
from seqspark.llm.suffix_dedup import suffix_dedup_documents

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    return _measured(quality_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 of five-word shingles the document with the smallest id (where none has one, one of them)."""
    groups = keyed_components(docs, size=5, num=4, den=5)
    stay = groups.where(F.col("key") == F.col("root")).select(F.col("key").alias("stays"), "no_id").distinct()
    # the row travels as one column, so that no name of the input clashes
    whole = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").isNull().alias("nameless"), F.xxhash64("text").alias("turn"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = whole.join(stay, (F.col("key") == F.col("stays")) & (F.col("nameless") == F.col("no_id")), "left_semi")
    # of rows that share a key (an id, or equal texts without one) one stays
    once = left.groupBy("key", "nameless").agg(F.min_by("row", "turn").alias("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document holds."""
    return _measured(suffix_dedup_documents(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("suffix-array dedup", repeated_strings), ("source mixing", mixing), ("best-fit packing", packing)]
#: Near-duplicate components, suffix order and bin completion are not expressible in SQL; ``test_pipeline_against_brute_force`` holds the first three stages and the pieces of ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
