"""Operator 7: mixing sources to target weights by systematic sampling.

Method. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the words of all documents; a target stops at ``cap`` times its source's
words and the excess is shared again by weight until none is above. Every
document of a source then expects ``target / source words`` copies. Within a
source the expected copies are summed up in the order of the sizes (of equal
ones by a hash of the id), one random offset, drawn from the seed and the source, is added, and a
document is taken once for each integer that its share of the sum crosses. As
sums of copies never stray by one from what is expected, and sizes rise along
the order, a source's words stray from its target by less than its largest document.

Scale. Words are counted in the scan. The running sum is two passes over
ranges of (source, size, hash, id), so a source with a third of all documents is
spread over many tasks. The table of sources stays distributed; only sums over
it reach the driver, once for each round of sharing.

Edge cases. A null or wordless text has size 0 and counts in the sum. A source
without words has target 0. A null source is a source. Repeated rows are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import materialize, running_total

WEIGHTS = (5, 2, 1)


def shared_targets(sources: DataFrame, cap: float) -> DataFrame:
    """Adds ``target`` to a table of ``source_size`` and ``weight``: all sizes shared by weight, at most ``cap`` times a source's own."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        if capped < 0:
            above = F.lit(False)
        free, kept, n = sources.agg(
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)), F.count(F.when(above, 1))
        ).first()
        if n == capped or free == 0:
            break
        level, capped = (total - kept) / free, n
    return sources.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), F.lit(float(cap)) * F.col("source_size")).cast("double"))


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: int, carry: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("turn"), F.xxhash64(text).alias("tie"),
        F.lit(1).cast("long").alias("one"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )
    ordered = running_total(rows, ["size", "turn", "doc_id", "tie"], "one", "before", by="source")
    ordered = materialize(ordered, "mixed")
    sources = ordered.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_name", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(sources, ["no_name", "source"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    targets = materialize(shared_targets(materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources"), cap), "targets")
    out = ordered.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)

    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 52)) / float(1 << 52)
    crossed = F.floor((F.col("before") + 1) * F.col("rate") + offset) - F.floor(F.col("before") * F.col("rate") + offset)
    return out.withColumn("copies", F.least(crossed, F.lit(cap)).cast("int"))


def mix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """One row for each row: the id, ``size`` (words), ``source_size``, ``target`` (its source's) and ``taken`` (words, repeats counted)."""
    out = _mixed(df, id_col, text_col, source_col, weights, cap, seed, carry=False)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """The mix: each row as often as it is taken, with its columns as they were."""
    out = _mixed(df, id_col, text_col, source_col, weights, cap, seed, carry=True)
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
