"""Bounded edit distance over tables of pairs.

Input: ``batch_id``, ``ord``, ``pattern``, ``text``, ``smax``, ``with_cigar``.
A batch has one bound, the least ``smax`` of its pairs, and is refused as a
whole if a pair is invalid. A pair further apart than the bound is unresolved
(distance -1); if one side is empty the distance is the other's length, bound
or not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from seqspark.functions.cigar import global_check
from seqspark.tables import MOST_SMAX


def invalid_reason() -> Column:
    """Null for a valid pair, else why it is refused."""
    return (
        F.when(F.col("pattern").isNull() | F.col("text").isNull(), "null sequence")
        .when(F.col("smax").isNull() | (F.col("smax") < 0) | (F.col("smax") > MOST_SMAX), f"smax must be in [0, {MOST_SMAX}]")
    )


def batch_facts(pairs: DataFrame) -> DataFrame:
    """One row for each batch: ``batch_smax``, ``any_cigar``, ``status``, ``error``. Partial aggregates, so a hot batch is no single task."""
    reason = invalid_reason()
    out = pairs.groupBy("batch_id").agg(F.min("smax").alias("batch_smax"), F.bool_or("with_cigar").alias("any_cigar"), F.min(F.when(reason.isNotNull(), F.struct("ord", reason.alias("why"))))["why"].alias("error"))
    return out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("invalid_argument"))


def wavefront_cigar(pattern: str, text: str, bound: int) -> str | None:
    """The CIGAR of one pair by furthest-reaching wavefronts, or None beyond the bound.

    A wavefront holds, for each diagonal, the furthest text position that s
    operations reach. Walking back, a mismatch is taken unless an insertion
    reaches further, and that unless a deletion does.
    """
    m, n = len(pattern), len(text)
    if not m or not n:
        return "I" * n + "D" * m
    if abs(n - m) > bound:
        return None
    none = -(m + n + 5)
    width = 2 * bound + 3
    zero = bound + 1
    waves: list[list[int]] = []

    def reach(k: int, h: int) -> int:
        v = h - k
        while v < m and h < n and pattern[v] == text[h]:
            v += 1
            h += 1
        return h

    def options(s: int, k: int) -> tuple[int, str]:
        prev = waves[s - 1]
        best, op = prev[zero + k] + 1, "X"
        if prev[zero + k - 1] + 1 > best:
            best, op = prev[zero + k - 1] + 1, "I"
        if prev[zero + k + 1] > best:
            best, op = prev[zero + k + 1], "D"
        return best, op

    goal = n - m
    for s in range(bound + 1):
        wave = [none] * width
        if s == 0:
            wave[zero] = reach(0, 0)
        else:
            for k in range(max(-s, -m), min(s, n) + 1):
                h, _ = options(s, k)
                if h >= 0 and h >= k:
                    h = min(h, n, m + k)
                    wave[zero + k] = reach(k, h)
        waves.append(wave)
        if wave[zero + goal] >= n:
            break
    else:
        return None
    out: list[str] = []
    k, h = goal, n
    for s in range(len(waves) - 1, 0, -1):
        best, op = options(s, k)
        best = min(best, n, m + k)
        out.append("M" * (h - best) + op)
        h = best
        if op == "X":
            h -= 1
        elif op == "I":
            h, k = h - 1, k - 1
        else:
            k += 1
    out.append("M" * h)
    return "".join(reversed([o[::-1] for o in out]))


@pandas_udf(StringType())
def edit_cigar(pattern: pd.Series, text: pd.Series, bound: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None or pd.isna(b) else wavefront_cigar(p, t, int(b)) for p, t, b in zip(pattern, text, bound, strict=True)], dtype=object)


def edit_distance_column(bound: str = "batch_smax") -> Column:
    """Built-in banded distance; -1 beyond the bound."""
    p, t = F.length("pattern"), F.length("text")
    return F.when((p == 0) | (t == 0), F.greatest(p, t)).when(F.abs(p - t) > F.col(bound), -1).otherwise(F.expr(f"levenshtein(pattern, text, {bound})"))


def align_edit(pairs: DataFrame, cigars: bool = False) -> DataFrame:
    """Adds ``batch_smax``, ``status``, ``edit_distance``, ``resolved`` (and, with ``cigars``, ``cigar``, ``rescore_ok``, ``wellformed_ok``)."""
    facts = batch_facts(pairs).select(F.col("batch_id").alias("_b"), "batch_smax", "any_cigar", "status")
    out = pairs.join(facts, F.col("batch_id").eqNullSafe(F.col("_b"))).drop("_b")
    out = out.withColumn("edit_distance", F.when(F.col("status") == "ok", edit_distance_column()).otherwise(-1).cast("int"))
    out = out.withColumn("resolved", F.col("edit_distance") >= 0)
    if not cigars:
        return out.drop("any_cigar")
    wanted = F.col("resolved") & F.col("any_cigar")
    # with an empty side the bound does not matter
    made = edit_cigar("pattern", "text", F.greatest("batch_smax", "edit_distance"))
    out = out.withColumn("cigar", F.when(wanted, F.coalesce(made, F.lit(""))).otherwise(F.lit("")))
    check = global_check(F.col("cigar"), F.col("pattern"), F.col("text"), F.col("edit_distance"))
    return out.withColumn("_c", check).withColumn("rescore_ok", F.col("_c.rescore_ok")).withColumn("wellformed_ok", F.col("_c.wellformed_ok")).drop("_c", "any_cigar")


def batch_summary(results: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``batch_id``, ``resolved_count``, ``unresolved_count``, ``status`` of the rows of ``align_edit``."""
    return results.groupBy("batch_id", "status").agg(F.count_if("resolved").alias("resolved_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))


def levenshtein_dp(a: str, b: str) -> int:
    """Plain dynamic programming, for tests."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, y in enumerate(b, 1):
            new[j] = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row[-1])
