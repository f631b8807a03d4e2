"""Tab-separated inputs and scheme files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pattern``, ``text`` of a two-column file; blank lines, ``#`` lines and the header are skipped, short rows raise."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cols = F.split("value", "\t")
    rows = lines.select(cols.alias("c")).where(F.col("c")[0] != "pattern")
    whole = F.when(F.size("c") >= 2, F.col("c")).otherwise(F.raise_error(F.lit("a pair needs two columns")))
    return rows.select(whole.alias("c")).select(F.col("c")[0].alias("pattern"), F.col("c")[1].alias("text"))


def read_results(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows with at least ``len(names)`` columns, as strings, with their ``file``; the header row is skipped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.input_file_name().alias("file"))
    rows = rows.where((F.size("c") >= len(names)) & (F.col("c")[0] != names[0]))
    return rows.select("file", *[F.col("c")[k].alias(n) for k, n in enumerate(names)])


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """``gene``, ``first``, ``last`` of lines such as ``DNA, gene = 1-300``."""
    line = r"^\s*\w+\s*,\s*(\S+)\s*=\s*(\d+)\s*-\s*(\d+)"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("gene"), F.regexp_extract("value", line, 2).cast("long").alias("first"), F.regexp_extract("value", line, 3).cast("long").alias("last"))


def read_charsets(spark: SparkSession, path: str) -> DataFrame:
    """``subset``, ``ranges`` of NEXUS ``charset name = ...;`` lines."""
    line = r"(?i)^\s*charset\s+(\S+)\s*=\s*([^;]*);"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("subset"), F.trim(F.regexp_extract("value", line, 2)).alias("ranges"))


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)
