"""Scores of alignments (``msa_id``, ``ord``, ``aligned``) against a reference, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns_of(aligned: DataFrame) -> DataFrame:
    """``msa_id``, ``ord``, ``col``, ``letter`` of every cell."""
    cells = F.posexplode(F.split("aligned", ""))
    return aligned.where(F.length("aligned") > 0).select("msa_id", "ord", cells.alias("col", "letter")).where("letter <> ''")


def residues(aligned: DataFrame) -> DataFrame:
    """``msa_id``, ``ord``, ``k`` (ordinal of the letter in its row, from 1), ``col``, ``letter``; gaps are ``-`` and ``!``."""
    w = Window.partitionBy("msa_id", "ord").orderBy("col")
    return columns_of(aligned).where(~F.col("letter").isin("-", "!")).withColumn("k", F.row_number().over(w)).select("msa_id", "ord", "k", "col", "letter")


def column_counts(aligned: DataFrame) -> DataFrame:
    """``msa_id``, ``col``, ``rows``, ``gaps``, ``a``, ``c``, ``g``, ``t``."""
    one = lambda x: F.count_if(F.upper("letter") == x)
    return columns_of(aligned).groupBy("msa_id", "col").agg(F.count("*").alias("rows"), one("-").alias("gaps"), one("A").alias("a"), one("C").alias("c"), one("G").alias("g"), one("T").alias("t"))


def pair_score(test: DataFrame, truth: DataFrame) -> DataFrame:
    """``msa_id``, ``kept``, ``pairs``, ``sps``: residue pairs of the true columns that the test puts in one column too.

    Per true column the letters are counted by their test column, so pairs are
    counted, never listed.
    """
    t = residues(truth).select("msa_id", "ord", "k", F.col("col").alias("true_col"))
    g = residues(test).select("msa_id", "ord", "k", F.col("col").alias("got_col"))
    both = t.join(g, ["msa_id", "ord", "k"], "left")
    cells = both.groupBy("msa_id", "true_col", "got_col").agg(F.count("*").alias("n"))
    n2 = F.col("n") * (F.col("n") - 1) / 2
    cols = cells.groupBy("msa_id", "true_col").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("got_col").isNotNull(), n2).otherwise(0)).alias("kept"))
    out = cols.groupBy("msa_id").agg(F.sum("kept").cast("long").alias("kept"), F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("pairs"))
    return out.withColumn("sps", F.when(F.col("pairs") > 0, F.col("kept") / F.col("pairs")).otherwise(F.lit(1.0)))


def column_score(test: DataFrame, truth: DataFrame) -> DataFrame:
    """``msa_id``, ``intact``, ``cols``, ``tc``: true columns of two letters or more that are one test column, all letters present."""
    t = residues(truth).select("msa_id", "ord", "k", F.col("col").alias("true_col"))
    g = residues(test).select("msa_id", "ord", "k", F.col("col").alias("got_col"))
    both = t.join(g, ["msa_id", "ord", "k"], "left")
    cols = both.groupBy("msa_id", "true_col").agg(F.count("*").alias("m"), F.min("got_col").alias("lo"), F.max("got_col").alias("hi"), F.count("got_col").alias("here")).where("m >= 2")
    out = cols.groupBy("msa_id").agg(F.count_if((F.col("lo") == F.col("hi")) & (F.col("here") == F.col("m"))).alias("intact"), F.count("*").alias("cols"))
    return out.withColumn("tc", F.col("intact") / F.col("cols"))


def triplet_purity(aligned: DataFrame) -> DataFrame:
    """``msa_id``, ``pure``, ``blocks``: width-3 blocks that are all gap or gap-free in every row."""
    cells = columns_of(aligned).withColumn("block", F.floor(F.col("col") / 3)).groupBy("msa_id", "ord", "block").agg(F.count_if(F.col("letter") == "-").alias("gaps"), F.count("*").alias("n"))
    blocks = cells.where("n = 3").groupBy("msa_id", "block").agg(F.bool_and((F.col("gaps") == 0) | (F.col("gaps") == 3)).alias("pure"))
    return blocks.groupBy("msa_id").agg(F.count_if("pure").alias("pure"), F.count("*").alias("blocks"))
