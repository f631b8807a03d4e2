"""Guide trees: neighbour joining, levels, Newick, splits and their distance.

A tree is a table ``msa_id``, ``node``, ``left``, ``right`` (leaves have -1, -1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqspark.kernels import neighbour_joining


def nj_tree(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Neighbour joining of each group; ``edges`` has i, j (positions) and d, ``sizes`` has ``msa_id``, ``n``. A group is one task's dense matrix."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        d = np.zeros((n, n), np.float32)
        real = pdf[pdf["i"] >= 0]
        place = np.unique(real[["i", "j"]].to_numpy())  # positions may have holes
        d[np.searchsorted(place, real["i"]), np.searchsorted(place, real["j"])] = real["d"]
        made = neighbour_joining(d + d.T)
        rows = [(k, -1, -1) for k in range(n)] + [(n + k, a, b) for k, (a, b) in enumerate(made)]
        return pd.DataFrame({"msa_id": pdf["msa_id"].iloc[0], "node": [r[0] for r in rows], "left": [r[1] for r in rows], "right": [r[2] for r in rows]})

    s = sizes.select(F.col("msa_id").alias("m"), "n")
    full = s.join(edges, F.col("m") == F.col("msa_id"), "left").select(F.col("m").alias("msa_id"), F.coalesce("i", F.lit(-1)).cast("int").alias("i"), F.coalesce("j", F.lit(-1)).cast("int").alias("j"), F.coalesce("d", F.lit(0.0)).cast("float").alias("d"), "n")
    return full.groupBy("msa_id").applyInPandas(build, "msa_id long, node int, left int, right int")


def _tour(pdf: pd.DataFrame) -> tuple[list[tuple], list]:
    """(node, left, right, first and end place of its leaves) of each node, children before parents, and the leaves in that order. No recursion: depth has no limit."""
    kids = {n: (a, b) for n, a, b in zip(pdf["node"].tolist(), pdf["left"].tolist(), pdf["right"].tolist(), strict=True)}
    below = {c for pair in kids.values() for c in pair}
    out, leaves, span = [], [], {}
    stack = [(n, False) for n in sorted(kids, reverse=True) if n not in below]
    while stack:
        node, seen = stack.pop()
        left, right = kids[node]
        if left < 0:
            span[node] = len(leaves), len(leaves) + 1
            leaves.append(node)
        elif not seen:
            stack += [(node, True), (right, False), (left, False)]
            continue
        else:
            span[node] = span[left][0], span[right][1]
        out.append((node, left, right, *span[node]))
    return out, leaves


def _each(tree: DataFrame, build, columns: str) -> DataFrame:
    """``build`` over the rows of each tree; a tree is one task, as neighbour joining makes it."""
    return tree.groupBy("msa_id").applyInPandas(build, f"msa_id {tree.schema['msa_id'].dataType.simpleString()}, {columns}")


def tree_levels(tree: DataFrame) -> DataFrame:
    """``msa_id``, ``node``, ``level``: 0 for leaves, else one more than the deeper child."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        level: dict = {}
        for node, left, right, _, _ in _tour(pdf)[0]:
            level[node] = 0 if left < 0 else 1 + max(level[left], level[right])
        return pd.DataFrame({"msa_id": pdf["msa_id"].iloc[0], "node": list(level), "level": list(level.values())})

    return _each(tree, build, f"node {tree.schema['node'].dataType.simpleString()}, level int")


def splits(tree: DataFrame) -> DataFrame:
    """``msa_id``, ``split``: the non-trivial bipartitions, each by its smaller side (of equal ones the lesser list), as a sorted array."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, leaves = _tour(pdf)
        found = set()
        for _, _, _, lo, hi in nodes:
            inside = hi - lo
            if inside > 1 and len(leaves) - inside > 1:
                side = sorted(leaves[lo:hi]) if 2 * inside <= len(leaves) else None
                other = sorted(leaves[:lo] + leaves[hi:]) if 2 * inside >= len(leaves) else None
                found.add(tuple(other if side is None else side if other is None else min(side, other)))
        return pd.DataFrame({"msa_id": pd.Series([pdf["msa_id"].iloc[0]] * len(found), dtype=pdf["msa_id"].dtype), "split": pd.Series([list(x) for x in found], dtype=object)})

    return _each(tree, build, f"split array<{tree.schema['node'].dataType.simpleString()}>")


def project_splits(split_rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Splits restricted to the leaves in ``taxa`` (``msa_id``, ``leaf``), for trees that share only some of theirs; those that become trivial go."""
    every = taxa.groupBy(F.col("msa_id").alias("_m")).agg(F.array_sort(F.collect_set("leaf")).alias("every"))
    both = split_rows.join(every, F.col("msa_id") == F.col("_m"))
    both = both.withColumn("side", F.array_sort(F.array_intersect("split", "every"))).withColumn("other", F.array_sort(F.array_except("every", "split")))
    least = F.when(F.struct(F.size("side"), "side") < F.struct(F.size("other"), "other"), F.col("side")).otherwise(F.col("other"))
    return both.where((F.size("side") > 1) & (F.size("other") > 1)).select("msa_id", least.alias("split")).distinct()


#: Pairs of leaves that a part of a tree's distances has, but for one leaf with more; pairs in a batch.
PART_PAIRS, BATCH_PAIRS = 1 << 22, 1 << 17
_STEP = np.dtype([("node", "<i8"), ("lo", "<i4"), ("mid", "<i4"), ("hi", "<i4"), ("length", "<f8")])


def _meets(steps: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf, later leaf, path length) of all pairs whose first leaf has a place from ``begin`` to ``end``, a few at a time; ``steps`` is a tour with ``mid`` 0 at leaves."""
    leaf = steps["node"][steps["mid"] == 0]
    depth = np.zeros(len(leaf))  # length from each leaf up to the node that is looked at
    for _, lo, mid, hi, length in steps[steps["hi"] > begin].tolist():
        if mid:
            first, stop = max(lo, begin), min(mid, end)
            while first < stop:
                last = min(stop, first + max(1, BATCH_PAIRS // (hi - mid)))
                for at in range(mid, hi, BATCH_PAIRS):
                    to = min(hi, at + BATCH_PAIRS)
                    yield np.repeat(leaf[first:last], to - at), np.tile(leaf[at:to], last - first), np.add.outer(depth[first:last], depth[at:to]).ravel()
                first = last
        depth[lo:hi] += length


def patristic_distances(tree: DataFrame) -> DataFrame:
    """``msa_id``, ``i``, ``j`` (leaves, i < j) and ``d``, the path length between them; ``tree`` also has ``length``, each node's branch to its parent (null: 0).

    One task tours a tree; its pairs, the square of its leaves, are dealt out in parts that stream.
    """

    def tour(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, leaves = _tour(pdf)
        length = dict(zip(pdf["node"].tolist(), pdf["length"].fillna(0.0).tolist(), strict=True))
        ends = {node: hi for node, _, _, _, hi in nodes}
        steps = np.array([(node, lo, ends[left] if left >= 0 else 0, hi, length[node]) for node, left, _, lo, hi in nodes], dtype=_STEP)
        later = np.arange(len(leaves) - 1, -1, -1, dtype=np.int64)
        begins = np.flatnonzero(np.diff((np.cumsum(later) - later) // PART_PAIRS, prepend=-1)).tolist()
        parts = list(zip(begins, [*begins[1:], len(leaves)], strict=True))
        return pd.DataFrame({"msa_id": pdf["msa_id"].iloc[:1].to_numpy(), "steps": [steps.tobytes()], "begins": [[x for x, _ in parts]], "ends": [[x for _, x in parts]]}).astype({"msa_id": pdf["msa_id"].dtype})

    node_type, id_type = (to_arrow_type(tree.schema[c].dataType) for c in ("node", "msa_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                msa, held, n = b.column(0)[k].as_py(), [], 0

                def joined() -> pa.RecordBatch:
                    x, y, d = (np.concatenate([h[c] for h in held]) for c in range(3))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(msa, id_type), len(d)), pa.array(np.minimum(x, y)).cast(node_type), pa.array(np.maximum(x, y)).cast(node_type), pa.array(d)], names=["msa_id", "i", "j", "d"])  # noqa: B023

                for meet in _meets(np.frombuffer(b.column(1)[k].as_py(), _STEP), b.column(2)[k].as_py(), b.column(3)[k].as_py()):
                    held.append(meet)
                    n += len(meet[2])
                    if n >= BATCH_PAIRS:
                        yield joined()
                        held, n = [], 0
                if held:
                    yield joined()

    kind = tree.schema["node"].dataType.simpleString()
    parts = _each(tree, tour, "steps binary, begins array<int>, ends array<int>").select("msa_id", "steps", F.explode(F.arrays_zip("begins", "ends")).alias("part"))
    dealt = parts.select("msa_id", "steps", F.col("part.begins").alias("begin"), F.col("part.ends").alias("end"))
    dealt = dealt.repartition(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), "msa_id", "begin")
    return dealt.mapInArrow(run, f"msa_id {tree.schema['msa_id'].dataType.simpleString()}, i {kind}, j {kind}, d double")


def robinson_foulds(a: DataFrame, b: DataFrame) -> DataFrame:
    """``msa_id``, ``shared``, ``rf``, ``rf_norm`` of two tables of splits."""
    x, y = a.withColumn("in_a", F.lit(1)), b.withColumn("in_b", F.lit(1))
    both = x.join(y, ["msa_id", "split"], "full_outer")
    out = both.groupBy("msa_id").agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("rf"), F.count("*").alias("n"))
    total = F.col("n") + F.col("shared")
    return out.select("msa_id", "shared", "rf", F.when(total == 0, F.lit(0.0)).otherwise(F.col("rf") / total).alias("rf_norm"))


def to_newick(tree: DataFrame, names: DataFrame) -> DataFrame:
    """``msa_id``, ``newick`` (topology only); ``names`` has ``msa_id``, ``node``, ``name``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        text: dict[int, str] = {}
        for node, left, right, name in sorted(zip(pdf["node"], pdf["left"], pdf["right"], pdf["name"], strict=True), key=lambda r: r[0]):
            if left < 0:
                plain = name or ""
                text[node] = "'" + plain.replace("'", "''") + "'" if any(c in " \t()[]':;," for c in plain) else plain
            else:
                text[node] = f"({text[left]},{text[right]})"
        return pd.DataFrame({"msa_id": [pdf["msa_id"].iloc[0]], "newick": [text[max(text)] + ";"]})

    n = names.select(F.col("msa_id").alias("_m"), F.col("node").alias("_n"), "name")
    rows = tree.join(n, (F.col("msa_id") == F.col("_m")) & (F.col("node") == F.col("_n")), "left").drop("_m", "_n")
    return rows.groupBy("msa_id").applyInPandas(build, "msa_id long, newick string")
