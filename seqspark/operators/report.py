"""Reports over result rows."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_statistics(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, ``n``, ``mean``, ``median``, ``least``, ``most``; NaN counts in none."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return results.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))


def win_tie_loss(results: DataFrame, case: list[str], tool: str, value: str, a, b) -> DataFrame:
    """``wins``, ``ties``, ``losses`` of tool ``a`` against ``b`` on the cases that both have."""
    x = results.where(F.col(tool) == a).select(*case, F.col(value).alias("va"))
    y = results.where(F.col(tool) == b).select(*case, F.col(value).alias("vb"))
    j = x.join(y, case)
    return j.agg(F.count_if(F.col("va") > F.col("vb")).alias("wins"), F.count_if(F.col("va") == F.col("vb")).alias("ties"), F.count_if(F.col("va") < F.col("vb")).alias("losses"))


def recall_at(ranks: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """``k``, ``recall``: the share of ranks (from 0) below each k."""
    shares = [F.struct(F.lit(k).alias("k"), F.avg((F.col(rank) < k).cast("int")).alias("recall")) for k in ks]
    return ranks.agg(F.array(*shares).alias("all")).select(F.explode("all").alias("r")).select("r.k", "r.recall")


def bootstrap_mean(results: DataFrame, key: str, value: str, resamples: int = 10_000) -> DataFrame:
    """``key``, ``n``, ``mean``, ``low``, ``high``: percentile bootstrap of the mean (95 %), seeded; one value gives itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sorted(float(x) for x in pdf[value].dropna())
        n = len(v)
        if n == 0:
            return pd.DataFrame({"key": [str(pdf[key].iloc[0])], "n": [0], "mean": [float("nan")], "low": [float("nan")], "high": [float("nan")]})
        rng = random.Random(0)
        means = sorted(sum(rng.choice(v) for _ in v) / n for _ in range(resamples)) if n > 1 else [v[0]] * resamples
        at = lambda share: means[min(int(share * resamples), resamples - 1)]
        return pd.DataFrame({"key": [str(pdf[key].iloc[0])], "n": [n], "mean": [sum(v) / n], "low": [at(0.025)], "high": [at(0.975)]})

    return results.select(key, value).groupBy(key).applyInPandas(run, "key string, n long, mean double, low double, high double")
