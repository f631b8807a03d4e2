"""k-mer distances, neighbours and set operations over groups of sequences (``msa_id``, ``ord``, ``sequence``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions.sequence import kmer_set


def kmer_distances(seqs: DataFrame, k: int = 5, alphabet: str = "ACGT") -> DataFrame:
    """``msa_id``, ``i``, ``j`` (i < j), ``shared``, ``d``: 1 - shared / smaller set (1 if a set is empty).

    Sharing pairs come from an equi-join on the k-mer (an inverted index);
    pairs that share nothing are filled in by a range join on the order.
    """
    sets = seqs.select("msa_id", "ord", kmer_set(F.col("sequence"), k, alphabet).alias("kmers")).withColumn("n", F.size("kmers"))
    words = sets.select("msa_id", "ord", F.explode("kmers").alias("w"))
    a, b = words.alias("a"), words.alias("b")
    shared = (
        a.join(b, (F.col("a.msa_id") == F.col("b.msa_id")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.ord") < F.col("b.ord")))
        .groupBy(F.col("a.msa_id").alias("g"), F.col("a.ord").alias("oi"), F.col("b.ord").alias("oj")).agg(F.count("*").alias("shared"))
    )
    size = sets.select("msa_id", "ord", "n")
    x, y = size.alias("x"), size.alias("y")
    pairs = x.join(y, (F.col("x.msa_id") == F.col("y.msa_id")) & (F.col("x.ord") < F.col("y.ord"))).select(F.col("x.msa_id").alias("msa_id"), F.col("x.ord").alias("i"), F.col("y.ord").alias("j"), F.least("x.n", "y.n").alias("least"))
    out = pairs.join(shared, (F.col("msa_id") == F.col("g")) & (F.col("i") == F.col("oi")) & (F.col("j") == F.col("oj")), "left")
    s = F.coalesce("shared", F.lit(0))
    d = F.when(F.col("least") == 0, F.lit(1.0)).otherwise(1.0 - s / F.col("least"))
    return out.select("msa_id", "i", "j", s.cast("long").alias("shared"), d.cast("float").alias("d"))


def nearest_neighbours(edges: DataFrame, k: int = 3) -> DataFrame:
    """``msa_id``, ``i``, ``rank``, ``j``, ``d``: the k nearest of each sequence, ties by id."""
    both = edges.select("msa_id", "i", "j", "d").union(edges.select("msa_id", F.col("j"), F.col("i"), "d"))
    w = Window.partitionBy("msa_id", "i").orderBy("d", "j")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("msa_id", "i", "rank", "j", "d")
