"""Affine local alignment over tables of pairs.

Input: ``batch_id``, ``ord``, ``text``, ``pattern``, ``match``, ``mismatch``,
``gap_open``, ``gap_extend`` (positive penalties), ``with_cigar``. A batch has
one scheme; a bad or mixed scheme refuses the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.kernels import local_align
from seqspark.tables import MOST_CELLS

#: Cells of padded tables computed together.
CELLS = 1 << 22


def scheme_error() -> Column:
    """Null for a valid scheme, else the first rule that it breaks."""
    return (
        F.when(F.col("match") <= 0, "match must be positive")
        .when(F.col("mismatch") >= F.col("match"), "mismatch must be below match")
        .when((F.col("gap_open") <= 0) | (F.col("gap_extend") <= 0), "gap costs must be positive")
        .when(F.col("with_cigar") & (F.col("gap_extend") > F.col("gap_open")), "gap_extend must not exceed gap_open")
    )


def scheme_status(pairs: DataFrame) -> DataFrame:
    """``batch_id``, ``status``, ``error`` of each batch."""
    scheme = F.struct("match", "mismatch", "gap_open", "gap_extend")
    out = pairs.groupBy("batch_id").agg(F.min(F.when(scheme_error().isNotNull(), F.struct("ord", scheme_error().alias("why"))))["why"].alias("why"), (F.min(scheme) != F.max(scheme)).alias("mixed"))
    error = F.coalesce("why", F.when(F.col("mixed"), "mixed schemes in one batch"))
    return out.select("batch_id", F.when(error.isNull(), "ok").otherwise("invalid_argument").alias("status"), error.alias("error"))


def too_large() -> Column:
    return (F.length("text").cast("long") + 1) * (F.length("pattern").cast("long") + 1) > MOST_CELLS


def align_sw(pairs: DataFrame, match: int = 2, mismatch: int = -3, gap_open: int = 5, gap_extend: int = 2, cigars: bool = True) -> DataFrame:
    """Adds ``sw_score``, ``start_i``, ``start_j``, ``end_i``, ``end_j`` (0-based, inclusive, -1 for none), ``cigar``, ``resolved``, ``too_large``.

    Without ``cigars`` only the score and the end come out. Pairs are sorted by
    size within each batch of rows, so that few cells are padding.
    """
    names = ["sw_score", "start_i", "start_j", "end_i", "end_j", "cigar"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cells = [(len(t) + 1) * (len(p) + 1) if t is not None and p is not None else 0 for t, p in zip(pdf["text"], pdf["pattern"], strict=True)]
            got: list[tuple] = [(-1, -1, -1, -1, -1, "")] * len(pdf)
            todo = sorted((k for k in range(len(pdf)) if 0 < cells[k] and not (cigars and cells[k] > MOST_CELLS)), key=lambda k: cells[k])
            at = 0
            while at < len(todo):
                stop = at + 1
                while stop < len(todo) and (stop - at + 1) * cells[todo[stop]] <= CELLS:
                    stop += 1
                part = todo[at:stop]
                for k, r in zip(part, local_align([pdf["text"].iloc[k] for k in part], [pdf["pattern"].iloc[k] for k in part], match, mismatch, gap_open, gap_extend, cigars), strict=True):
                    got[k] = r
                at = stop
            yield pdf.assign(**{n: [g[c] for g in got] for c, n in enumerate(names)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    out = pairs.mapInPandas(run, f"{kinds}, sw_score int, start_i int, start_j int, end_i int, end_j int, cigar string")
    out = out.withColumn("resolved", F.col("sw_score") >= 0)
    return out.withColumn("too_large", F.coalesce(too_large(), F.lit(False)) & F.lit(cigars))


def align_to_reference(seqs: DataFrame, reference: DataFrame, **scheme) -> DataFrame:
    """Every sequence (``seq_id``, ``sequence``) against one reference row, scheme 1, -1, 2, 1 unless told otherwise."""
    scheme = {"match": 1, "mismatch": -1, "gap_open": 2, "gap_extend": 1, "cigars": False} | scheme
    one = F.broadcast(reference.select(F.col("sequence").alias("pattern")).limit(1))  # one row
    return align_sw(seqs.withColumnRenamed("sequence", "text").join(one, how="inner", on=F.lit(True)), **scheme)
