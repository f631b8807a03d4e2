"""Alignment over streams of pairs. No state is needed: every micro-batch is aligned by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators.local import align_sw
from seqspark.operators.pairwise import edit_distance_column

PAIRS = "batch_id long, ord long, pattern string, text string, smax int, with_cigar boolean"


def read_pair_stream(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_edit_distance(pairs: DataFrame) -> DataFrame:
    """Adds ``edit_distance`` with each row's own ``smax`` as its bound (a stream has no whole batches)."""
    out = pairs.withColumn("edit_distance", edit_distance_column("smax").cast("int"))
    return out.withColumn("resolved", F.col("edit_distance") >= 0)


def stream_local_alignment(pairs: DataFrame, **scheme) -> DataFrame:
    return align_sw(pairs, **scheme)
