"""Operator 6: nearest neighbours by inner product, with vantage-point trees on shards.

Method. With every vector x extended by ``sqrt(M**2 - |x|**2)`` (M the largest
norm) and every query by 0, the largest inner product is the least Euclidean
distance, a metric. Each shard of the vectors becomes a vantage-point tree: a
node holds a vector and the median distance to it, its children hold the nearer
and the farther half. A query skips a child when the triangle inequality
puts all of it beyond the k-th distance found so far; ``relax`` scales
that bound. ``relax`` 1 is exact, a smaller one skips more and may miss some.
Queries go through a tree in blocks, so every step is a few numpy operations
over all queries that are still at a node; each first visits the leaf that it
falls into.

Candidates are ranked by the double-precision inner product of the original
vectors, summed in order of the components, ties by the smaller id. Of a shard
every row stays a candidate that rounding may put among the k best; equal
vectors are one class there, which stands for its smallest ids.

Scale. Vectors are dealt to shards by a hash of their id, a bounded number to each, and shuffle once; a shard's tree is built
once, and the blocks of queries (a stated query set against all rows) stream through it.
A shard's answer is k rows for each query, merged on the map side before the
final top k. Nothing is collected or broadcast.

Edge cases. Vectors that are null, zero, or hold a null, NaN or infinity take
no part, as query or candidate. Vectors of another length than the most common
one do not compare; they take no part. Repeated rows are candidates of their own; a query
skips only rows with its own id. Fewer candidates than k: all are returned. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import materialize, released

#: Vectors in a shard and queries in a block, about; and vectors in a leaf.
SHARD, BLOCK, LEAF = 1 << 14, 1 << 11, 512
#: Candidates that a search holds before it drops what the k best so far leave behind.
PAIRS = 1 << 18


class Tree:
    """A vantage-point tree over rows of ``points``; nodes in arrays, leaves as spans of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.norms = (points * points).sum(axis=1)
        self.order = np.arange(len(points))
        #: (begin, end, vantage point or -1, inner radius bounds, outer radius bounds, children)
        self.nodes: list[tuple] = []
        self._build(0, len(points))

    def _far(self, rows: np.ndarray, p: int) -> np.ndarray:
        d = self.norms[rows] + self.norms[p] - 2.0 * (self.points[rows] @ self.points[p])
        return np.sqrt(np.maximum(d, 0.0))

    def _build(self, lo: int, hi: int) -> int:
        k = len(self.nodes)
        self.nodes.append(())
        if hi - lo <= self.leaf:
            self.nodes[k] = (lo, hi, -1)
            return k
        span = self.order[lo:hi]
        centre = self.points[span].mean(axis=0)
        p = int(span[np.argmax(((self.points[span] - centre) ** 2).sum(axis=1))])  # far out: distances to it spread most
        d = self._far(span, p)
        mid = (hi - lo) // 2
        by = np.argpartition(d, mid)
        self.order[lo:hi], d = span[by], d[by]
        near = self._build(lo, lo + mid)
        far = self._build(lo + mid, hi)
        self.nodes[k] = (lo, hi, p, float(d[:mid].min()), float(d[:mid].max()), float(d[mid:].min()), float(d[mid:].max()), near, far)
        return k

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int, relax: float, cut: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) with all rows whose inner product may be among the query's k largest, ties included; ``own``: rows to skip.

        The last component of points and queries only makes the metric. ``cut``
        says which pairs to hold, by exact score and id, where very many tie.
        """
        n, dim = len(queries), self.points.shape[1]
        top = np.full((n, k), -np.inf)  # the k largest lower bounds of inner products; the first is the least
        qn = (queries * queries).sum(axis=1)
        skip = np.repeat(np.arange(n), [len(o) for o in own]), np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        done = [np.zeros(n, bool) for _ in self.nodes]
        held: list[list[np.ndarray]] = [[], [], []]  # queries, rows, upper bounds of inner products
        many = 0
        # rounding of an inner product for each unit of both norms, and of a squared distance
        unit = 4 * (dim + 8) * np.finfo(float).eps
        most = float(self.norms.max()) if len(self.points) else 0.0
        slack = 4 * unit * (most + qn)
        lengths = np.sqrt((self.points[:, :-1] ** 2).sum(axis=1))

        def settle(exact: bool) -> None:
            nonlocal many
            at, r, up = (np.concatenate(x) for x in held) if held[0] else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            live = ~(up < top[at, 0])
            at, r, up = at[live], r[live], up[live]
            if exact and len(at) > PAIRS // 2:
                live = cut(at, r)
                at, r, up = at[live], r[live], up[live]
            held[0], held[1], held[2] = [at], [r], [up]
            many = len(at)

        def visit(node: tuple, q: np.ndarray) -> None:
            nonlocal many
            span = self.order[node[0] : node[1]]
            s = queries[q, :-1] @ self.points[span, :-1].T
            off = unit * np.sqrt(qn[q])[:, None] * lengths[span][None, :] + np.finfo(float).tiny
            i, r = skip[0][np.isin(skip[0], q)], skip[1][np.isin(skip[0], q)]
            at = place[r] - node[0]
            here = (at >= 0) & (at < len(span))
            line = np.empty(n, np.int64)
            line[q] = np.arange(len(q))
            s[line[i[here]], at[here]] = -np.inf
            # only queries that gain something are merged
            gain = ~((s + off).max(axis=1) < top[q, 0])
            q, s, off = q[gain], s[gain], off[gain]
            if len(q) == 0:
                return
            low = s - off
            if low.shape[1] > k:
                low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            top[q] = np.sort(np.concatenate([top[q], low], axis=1), axis=1)[:, -k:]
            up = s + off
            i, j = np.nonzero(~(up < top[q, :1]) & ~(s == -np.inf))
            for x, y in zip(held, (q[i], span[j], up[i, j]), strict=True):
                x.append(y)
            many += len(i)
            if many > PAIRS:
                settle(True)

        def home(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if node[2] < 0:
                visit(node, q)
                done[at][q] = True
                return
            d = np.sqrt(np.maximum(qn[q] + self.norms[node[2]] - 2.0 * (queries[q] @ self.points[node[2]]), 0.0))
            near = d < (node[4] + node[5]) / 2
            for side, child in ((near, node[7]), (~near, node[8])):
                if side.any():
                    home(child, q[side])

        def descend(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if node[2] < 0:
                q = q[~done[at][q]]
                if len(q):
                    visit(node, q)
                return
            d = np.maximum(qn[q] + self.norms[node[2]] - 2.0 * (queries[q] @ self.points[node[2]]), 0.0)
            least, largest = np.sqrt(np.maximum(d - slack[q], 0.0)), np.sqrt(d + slack[q])
            for lo, hi, child in ((node[3], node[4], node[7]), (node[5], node[6], node[8])):
                gap = np.maximum(np.maximum(np.sqrt(np.maximum(lo * lo - slack[q], 0.0)) - largest, least - np.sqrt(hi * hi + slack[q])), 0.0)
                reach = np.maximum(most + qn[q] - 2.0 * top[q, 0], 0.0)
                live = ~(gap * gap > relax * relax * reach + slack[q])
                if live.any():
                    descend(child, q[live])

        if n and len(self.points):
            home(0, np.arange(n))
            descend(0, np.arange(n))
        settle(False)
        return held[0][0], held[1][0]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def classes(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors as classes: a row of each, where its ids begin, and the ids in order.

    Of one id k copies and of one class 2 * k ids stay: the k smallest that are not a query's own are among them.
    """
    if len(x) == 0:
        return np.empty(0, np.int64), np.zeros(1, np.int64), ids
    _, first, cls = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.lexsort((ids, cls))
    for same, most in (((cls, ids), k), ((cls,), 2 * k)):
        start = np.ones(len(by), bool)
        start[1:] = np.any([key[by][1:] != key[by][:-1] for key in same], axis=0)
        at = np.arange(len(by))
        by = by[at - np.maximum.accumulate(np.where(start, at, 0)) < most]
    return first, np.searchsorted(cls[by], np.arange(len(first) + 1)), ids[by]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8") if len(column) else np.empty(0)


def nearest(df: DataFrame, k: int = 20, every: int = 20, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest rows of each row whose id is divisible by ``every``."""
    v = F.col(vector_col)
    fine = F.coalesce(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return df.sparkSession.createDataFrame([], result)
    size, count, largest = shape
    largest *= 1 + 1e-12
    shards, blocks = -(-count // shard), -(-count // (every * block))
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("v")
            data = values.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(values), size)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in data], pa.binary())], names=["id", "x"])

    packed = materialize(rows.where(F.size("v") == size).mapInArrow(pack, "id long, x binary"), "vectors")
    # every vector goes to its shard, once and ahead of the queries; every query goes to all shards, in blocks
    data = packed.withColumn("shard", hashed(shards)).withColumn("block", F.lit(-1))
    asks = packed.where(F.pmod("id", F.lit(every)) == 0).withColumn("block", hashed(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = data.select("shard", "block", "id", "x").union(asks.select("shard", "block", "id", "x"))

    class Shard:
        """The tree over one shard's classes of equal vectors; built once, asked with one block of queries after another."""

        def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
            ids, x = (np.concatenate([p[j] for p in parts]) for j in range(2)) if parts else (np.empty(0, np.int64), np.empty((0, size)))
            first, self.begin, self.ids = classes(x, ids, k)
            self.x = x[first]
            extra = np.sqrt(np.maximum(largest - (self.x * self.x).sum(axis=1), 0.0))
            self.tree = Tree(np.concatenate([self.x, extra[:, None]], axis=1))
            # a query skips the classes that hold no id but its own
            least, most = (f.reduceat(self.ids, self.begin[:-1]) if len(first) else self.ids for f in (np.minimum, np.maximum))
            only = np.flatnonzero(least == most)
            self.only = only[np.argsort(least[only], kind="stable")]
            self.only_id = least[self.only]

        def solve(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            q_ids, q = (np.concatenate([p[j] for p in parts]) for j in range(2))
            x, begin, ids = self.x, self.begin, self.ids
            lo, hi = np.searchsorted(self.only_id, q_ids, "left"), np.searchsorted(self.only_id, q_ids, "right")
            own = [self.only[a:b] for a, b in zip(lo, hi, strict=True)]

            def ranked(at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
                """Of pairs of a query and a class: query, id, score and pair of the k best rows, by exact score, then id."""
                score = np.concatenate([in_order(q[at[c : c + PAIRS // 8]], x[cls[c : c + PAIRS // 8]]) for c in range(0, len(at), PAIRS // 8)] or [np.empty(0)])
                n = begin[cls + 1] - begin[cls]
                pair = np.repeat(np.arange(len(at)), n)
                hit = ids[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[cls], n)]
                other = hit != q_ids[at[pair]]
                pair, hit = pair[other], hit[other]
                best = np.lexsort((hit, -score[pair], at[pair]))
                pair, hit = pair[best], hit[best]
                a = at[pair]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                return a[keep], hit[keep], score[pair[keep]], pair[keep]

            at, hit, score, _ = ranked(*self.tree.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), own, k, relax, lambda at, cls: np.unique(ranked(at, cls)[3])))
            return pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(hit), pa.array(score)], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, parts = None, None, []
        for b in batches:
            key = np.stack([b.column("shard").to_numpy(zero_copy_only=False), b.column("block").to_numpy(zero_copy_only=False)], axis=1)
            if len(key) == 0:
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ids = b.column("id").to_numpy(zero_copy_only=False)
            x = _matrix(b.column("x")).reshape(len(ids), size)
            for s in np.split(np.arange(len(ids)), cuts):
                k_ = tuple(key[s[0]].tolist())
                if k_ != now:
                    if now is not None:
                        if now[1] >= 0:
                            yield tree.solve(parts)
                        if k_[0] != now[0]:
                            tree = None
                        if k_[1] >= 0 and tree is None:  # the shard's rows, which come first, are all here
                            tree = Shard(parts if now[0] == k_[0] else [])
                    elif k_[1] >= 0:
                        tree = Shard([])
                    now, parts = k_, []
                parts.append((ids[s], x[s]))
        if now is not None and now[1] >= 0:
            yield tree.solve(parts)

    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = met.repartition(min(n, shards), "shard").sortWithinPartitions("shard", "block").mapInArrow(released(search), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
