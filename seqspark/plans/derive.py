"""Sequence tables derived from the driver's tables, in Spark and in DuckDB SQL alike. Every row and every whole text takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.sequence import LETTERS, as_dna, letters

BASES = ("ACGT" * 7)[:26]
GAPPED = ("ACGT-" * 6)[:26]
OPS = ("MXID" * 7)[:26]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_letters(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def sql_map(x: str, to: str = BASES) -> str:
    return f"translate({sql_letters(x)}, '{LETTERS}', '{to}')"


def mapped(col, to: str):
    return F.translate(letters(col), LETTERS, to)


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a part's name and type; a brand is a batch."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("batch_id"), F.col("p_partkey").cast("long").alias("ord"), as_dna(F.col("p_name")).alias("pattern"), as_dna(F.col("p_type")).alias("text"),
        (F.col("p_size") % 12 + 3).cast("int").alias("smax"), F.lit(True).alias("with_cigar"),
    )


SQL_PAIRS = f"""pairs AS (
  SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS batch_id, CAST(p_partkey AS BIGINT) AS ord, {sql_map('p_name')} AS pattern, {sql_map('p_type')} AS text, CAST(p_size % 12 + 3 AS INTEGER) AS smax FROM part)"""


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", to: str = BASES) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("seq_id"), mapped(F.col("text"), to).alias("sequence"))


def sql_sequences(name: str = "documents", key: str = "doc_id", to: str = BASES) -> str:
    return f"s AS (SELECT CAST({key} AS BIGINT) AS seq_id, {sql_map('text', to)} AS sequence FROM {name})"


def groups(spark: SparkSession, sf_dir: str, to: str = BASES, column: str = "sequence") -> DataFrame:
    """Benchmark items, eight to a group."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.floor(F.col("item_id") / 8).cast("long").alias("msa_id"), F.col("item_id").cast("long").alias("ord"), F.col("item_id").cast("string").alias("seq_id"), mapped(F.col("text"), to).alias(column))


def sql_groups(to: str = BASES, column: str = "sequence") -> str:
    return f"g AS (SELECT CAST(item_id // 8 AS BIGINT) AS msa_id, CAST(item_id AS BIGINT) AS ord, {sql_map('text', to)} AS {column} FROM benchmark)"


def heap_tree(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """Suppliers as a binary tree: node k has the children 2k and 2k + 1 (``turned``: of the last inner nodes' leaves each is swapped with its mirror image)."""
    k = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("long").alias("node"))
    n = k.agg((F.max("node") - (F.max("node") + 1) % 2).alias("n"))  # odd, so that every inner node has two children
    rows = k.join(F.broadcast(n), on=F.lit(True)).where("node <= n")  # n is one row
    inner = F.col("node") * 2 + 1 <= F.col("n")
    first = (F.col("n") + 1) / 2
    leaf = lambda c: F.when(F.lit(turned) & (c >= first), F.col("n") + first.cast("long") - c).otherwise(c)
    return rows.select(F.lit(0).cast("long").alias("msa_id"), leaf(F.col("node")).alias("node"), F.when(inner, leaf(F.col("node") * 2)).otherwise(-1).alias("left"), F.when(inner, leaf(F.col("node") * 2 + 1)).otherwise(-1).alias("right"))


def sql_heap(name: str = "t", turned: bool = False) -> str:
    leaf = (lambda c: f"(CASE WHEN {c} >= (n + 1) // 2 THEN n + (n + 1) // 2 - ({c}) ELSE {c} END)") if turned else (lambda c: c)
    return f"""{name} AS (
  SELECT {leaf('node')} AS node, CASE WHEN node * 2 + 1 <= n THEN {leaf('node * 2')} ELSE -1 END AS l, CASE WHEN node * 2 + 1 <= n THEN {leaf('node * 2 + 1')} ELSE -1 END AS r
  FROM (SELECT CAST(s_suppkey + 1 AS BIGINT) AS node FROM supplier), (SELECT CAST(max(s_suppkey) + 1 - (max(s_suppkey) + 2) % 2 AS BIGINT) AS n FROM supplier) WHERE node <= n)"""
