"""Operator 2: self-join of documents on the Jaccard similarity of word n-grams, by T-occurrence search.

Method. Two sets of similarity t share at least T tokens. ``Index.link`` answers
"who shares T tokens with this set" with DivideSkip: of the query's inverted
lists the L longest are set aside, the short ones are merged and candidates
counted, and a candidate with at least T - L hits is completed by binary
search in the long lists. T is exact in integers, so no link is lost.

Which sets meet in one index is found the same way, with L = T - 1: only the
``n - T + 1`` rarest tokens of a set are merged, and sets that share none of
them cannot reach T. Rare is by a count sketch of all tokens, whose counters
grow with the text (2**21 to 2**27; any common order is right, a good one keeps
frequent passages out). Sets in one token's list are chained into candidate groups where their
bitmaps of token hashes, which bound the overlap from above, let them
reach T (lists longer than 1024 are chained unseen). A bitmap has more bits than
its set has tokens, so that long texts are told apart as well as short ones. Within a group all links come from the index; sets that are already connected are not
compared again, so a group of k copies costs about k comparisons, not k**2.

Scale. Texts shuffle once, and only to fetch the candidates. Equal sets fold
into one class before any comparison. Tokens are combined on the map side, so
a token of a third of all documents arrives as a few rows for each task. A
group of more than ``GROUP_SHINGLES`` tokens (or 1/2048 of all) is dealt into blocks that meet
around one pivot; only sets not linked to the pivot then visit the other
blocks. Groups, links and components stay distributed; the driver sees counts
and the sketch.

Edge cases. A null or wordless text has no tokens, links with nothing and is
its own component. A text with fewer words than n is one token. Repeated rows
each get their result; rows that share an id count as one node. A row without an id is a node
of its own (with the equal texts without one); a component without any id has a null id. Texts of any
length are taken whole. An empty table gives an empty result. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import discard, materialize, mix64, released, row_key
from seqspark.llm.graph import components
from seqspark.llm.words import hashed

#: Least and most counters of the sketch, and those of a block, as powers of 2; bytes of text for each counter.
SKETCH_BITS, MOST_BITS, BLOCK_BITS, COUNTER_BYTES = 21, 27, 16, 256
#: Positions in the sketch that a task sorts at a time.
COUNTED = 1 << 22
#: Tokens that one task compares at once; a larger group is dealt into blocks. A block grows with the input, to the second number.
GROUP_SHINGLES, MOST_SHINGLES = 1 << 16, 1 << 20
#: Least and most bits of a set's bitmap.
LEAST_MAP, MOST_MAP = 1 << 8, 1 << 17
#: Prefix tokens that a map task combines at a time.
COMBINED = 1 << 19
#: Longer lists of sets with a common token are joined unseen; shorter ones are pruned first.
LISTED = 1024
#: DivideSkip's weight of a merge step against a probe.
MU = 0.0085


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of the n-grams of a text, given by its words' hashes."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    out = mix64(words[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(out)


def bitmap(tokens: np.ndarray) -> bytes:
    """Which values the low bits of the tokens take; bits enough for at least 1.25 a token, but for very long texts."""
    m = LEAST_MAP
    while 4 * m < 5 * len(tokens) and m < MOST_MAP:
        m *= 2
    seen = np.zeros(m, dtype=bool)
    seen[(tokens & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of fewer low bits."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def spanning(maps: list[bytes], sizes: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links (by position) that connect all sets which, by their bitmaps, may be of similarity num / den, directly or through others.

    A bit that only one of two maps has is a token that the other set lacks.
    """
    n, words = np.array(sizes, dtype=np.int64), np.array([len(x) // 8 for x in maps])
    rows = {w: np.stack([np.frombuffer(x, "<u8") for x in maps if len(x) == 8 * w]) for w in set(words.tolist())}
    place = np.empty(len(maps), dtype=np.int64)
    for w in rows:
        place[words == w] = np.arange(len(rows[w]))
    out, rest = [], np.arange(len(maps))
    while len(rest) > 1:
        edge, rest = [int(rest[0])], rest[1:]
        while edge and len(rest):
            f = edge.pop()
            alike = den * np.minimum(n[rest], n[f]) >= num * np.maximum(n[rest], n[f])
            for w in set(words[rest[alike]].tolist()):
                at = np.flatnonzero(alike & (words[rest] == w))
                k = rest[at]
                least = min(w, int(words[f]))
                x, y = _folded(rows[int(words[f])][place[f]][None, :], least), _folded(rows[w][place[k]], least)
                shared = np.minimum(n[f] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[k] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                alike[at] = (num + den) * shared >= num * (n[f] + n[k])
            found = rest[alike].tolist()
            out.extend((f, k) for k in found)
            edge.extend(found)
            rest = rest[~alike]
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of ``n`` must share with any set of similarity num / den."""
    return -(-n * num // den)


class Index:
    """Inverted lists over the sets of one group, ordered by size."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[k]) for k in self.order], dtype=np.int64)
        m = len(sets)
        tokens = np.concatenate([sets[k] for k in self.order]) if m else np.empty(0, np.uint64)
        _, ids = np.unique(tokens, return_inverse=True)
        docs = np.repeat(np.arange(m), self.sizes)
        self.m, self.ids, self.ends = m, ids, np.cumsum(self.sizes)
        #: (token, doc) keys: all inverted lists, one after another, each in order
        self.keys = np.sort(ids * m + docs)
        self.starts = np.searchsorted(self.keys, np.arange(ids.max() + 1 if len(ids) else 0) * m)

    def candidates(self, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets before ``x`` with enough hits in x's short lists, those hits, and x's long lists' tokens."""
        n = int(self.sizes[x])
        tokens = self.ids[self.ends[x] - n : self.ends[x]]
        begin = self.starts[tokens]
        length = np.searchsorted(self.keys, tokens * self.m + x) - begin  # sets before x
        t = least_overlap(n, self.num, self.den)
        rank = np.argsort(length, kind="stable")
        longest = int(length[rank[-1]])
        if longest == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), tokens
        skip = min(t - 1, int(t / (MU * np.log2(longest + 1) + 1)))
        short, long_ = rank[: n - skip], tokens[rank[n - skip :]]
        short = short[length[short] > 0]
        if len(short) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), long_
        begin, length = begin[short], length[short]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
        found, hits = np.unique(self.keys[at] % self.m, return_counts=True)
        keep = (hits >= t - skip) & (self.sizes[found] >= t)
        return found[keep], hits[keep], long_

    def overlap(self, found: np.ndarray, hits: np.ndarray, long_: np.ndarray) -> np.ndarray:
        """The hits, completed by binary search in the long lists."""
        keys = (long_[:, None] * self.m + found[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return hits + (self.keys[at] == keys).reshape(len(long_), len(found)).sum(axis=0)

    def link(self, parent: list[int]) -> list[int]:
        """Unites linked sets in ``parent`` (a union-find forest over positions in ``order``)."""

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for x in range(self.m):
            if self.sizes[x] == 0:
                continue
            found, hits, long_ = self.candidates(x)
            best = np.argsort(-hits, kind="stable")
            found, hits = found[best], hits[best]
            step = 1
            while len(found):
                own = root(x)
                apart = np.array([root(int(y)) != own for y in found], dtype=bool)
                found, hits = found[apart], hits[apart]
                part, had = found[:step], hits[:step]
                if len(part) == 0:
                    break
                both = self.overlap(part, had, long_)
                for y in part[self.den * both >= self.num * (self.sizes[x] + self.sizes[part] - both)]:
                    parent[root(int(y))] = root(x)
                found, hits, step = found[step:], hits[step:], 64
        return [root(k) for k in range(self.m)]


def link_sets(sets: list[np.ndarray], num: int, den: int, labels: list | None = None) -> list[int]:
    """For each set the position of its connected class's representative; equal ``labels`` are connected from the start."""
    index = Index(sets, num, den)
    parent, first = list(range(len(sets))), {}
    if labels:
        for pos, k in enumerate(index.order):
            parent[pos] = first.setdefault(labels[k], pos)
    roots = index.link(parent)
    out = [0] * len(sets)
    for pos, k in enumerate(index.order):
        out[k] = int(index.order[roots[pos]])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _survey(df: DataFrame, size: int, bits: int) -> DataFrame:
    """Of each row its id, set size, 128-bit set hash and bitmap; of each task the places of its tokens in a sketch of 2**bits counters, in compressed blocks."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "s1", "s2", "map", "block", "counts", "no_id"]
        held, n_held = [], 0

        def counted() -> pa.RecordBatch:
            nonlocal held, n_held
            at = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint32)
            held, n_held = [], 0
            block = (at >> np.uint32(BLOCK_BITS)).astype(np.int64)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            steps = np.diff(at, prepend=np.uint32(0)).astype("<u2")
            steps[first] = at[first].astype("<u2")  # the place in its block, then steps
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(steps, first[1:])] if len(at) else []
            none = pa.nulls(len(first), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(first), pa.binary()), pa.array(block[first], pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(first), pa.bool_())], names=names)

        for b in batches:
            n, s, maps = [], [], []
            for words in hashed(b.column(1), lower=True):
                x = shingles(words, size)
                n.append(len(x))
                maps.append(bitmap(x))
                s.append(xxh3_128_digest(x.tobytes()))
                held.append((x >> np.uint64(64 - bits)).astype(np.uint32))
                n_held += len(x)
            halves = np.frombuffer(b"".join(s), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(maps, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), b.column(2)], names=names
            )
            if n_held > COUNTED:
                yield counted()
        yield counted()

    return df.mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, map binary, block int, counts binary, no_id boolean")


def _levels(survey: DataFrame, bits: int, partitions: int) -> np.ndarray:
    """A byte for each of the 2**bits counters of the sketch: the logarithm of how often its tokens occur."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.bincount(np.cumsum(np.frombuffer(zlib.decompress(c), dtype="<u2"), dtype=np.int64), minlength=1 << BLOCK_BITS).astype(np.uint32)
                sums[k] = sums[k] + x if k in sums else x
        out = {k: zlib.compress((4 * np.log2(v + 1.0)).astype(np.uint8).tobytes(), 1) for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["block", "levels"])

    levels = np.zeros(1 << bits, dtype=np.uint8)
    merged = survey.where("block is not null").select("block", "counts").repartition(min(partitions, 1 << (bits - BLOCK_BITS)), "block").mapInArrow(add, "block int, levels binary")
    for r in merged.collect():
        levels[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r.levels), dtype=np.uint8)
    return levels


def _prefixes(df: DataFrame, size: int, num: int, den: int, levels, bits: int) -> DataFrame:
    """(token, class) of every class's rarest tokens, and (null, class, class) where a task has joined classes itself."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        tokens, owners, n_held, seen = [], [], 0, set()

        def combined() -> Iterator[pa.RecordBatch]:
            if not tokens:
                return
            t, o = np.concatenate(tokens), np.repeat(np.array([x for x, _ in owners], np.int64), [k for _, k in owners])
            by = np.argsort(t, kind="stable")
            t, o = t[by], o[by]
            new = np.ones(len(t), dtype=bool)
            new[1:] = t[1:] != t[:-1]
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(t)))
            hot = np.repeat(count > LISTED, count)
            stay = new | ~hot
            head = np.repeat(o[heads], count)
            pairs = np.unique(np.stack([head[~stay], o[~stay]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([_signed(t[stay]), pa.array(o[stay]), pa.nulls(int(stay.sum()), pa.int64()), pa.array(hot[stay])], names=["token", "s1", "other", "hot"])
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none.cast(pa.bool_())], names=["token", "s1", "other", "hot"])
            tokens.clear()
            owners.clear()

        for b in batches:
            for words in hashed(b.column(0), lower=True):
                x = shingles(words, size)
                if len(x) == 0:
                    continue
                key = int.from_bytes(xxh3_128_digest(x.tobytes())[:8], "little", signed=True)
                if key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                k = len(x) - least_overlap(len(x), num, den) + 1
                tokens.append(x[np.argsort(level[(x >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:k]])
                owners.append((key, k))
                n_held += k
                if n_held >= COMBINED:
                    n_held = 0
                    yield from combined()
        yield from combined()

    return df.mapInArrow(released(run), "token long, s1 long, other long, hot boolean")


def _pruned(lists: DataFrame, sets: DataFrame, num: int, den: int, partitions: int) -> DataFrame:
    """(s1, other): spanning links of the sets in each list whose bitmaps let them reach the similarity, directly or through others of the list."""
    members = materialize(lists.select(F.xxhash64("list").alias("id"), F.explode("list").alias("m")), "lists")
    need = members.select(F.col("m").alias("s1")).distinct()
    facts = sets.join(need, "s1", "left_semi").dropDuplicates(["s1", "s2"]).select("s1", "n", "map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, maps = None, [], [], []

        def links() -> list[tuple[int, int]]:
            return [(ids[a], ids[b]) for a, b in spanning(maps, sizes, num, den)] if len(ids) > 1 else []

        def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = list(dict.fromkeys(out))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["s1", "other"])

        for b in batches:
            out: list[tuple[int, int]] = []
            for key, m, n, x in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if key != now:
                    out += links()
                    now, ids, sizes, maps = key, [], [], []
                ids.append(m)
                sizes.append(n)
                maps.append(x)
            yield told(out)
        yield told(links())

    rows = members.join(facts, F.col("m") == F.col("s1")).select("id", "m", "n", "map")
    return rows.repartition(partitions, "id").sortWithinPartitions("id").mapInArrow(released(run), "s1 long, other long")


def _grouped_links(members: DataFrame, keys: list[str], size: int, num: int, den: int, partitions: int) -> DataFrame:
    """(doc_id, root) of the members of each group of ``keys``; ``members`` has doc_id, text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, labels = None, [], [], []

        def linked() -> pa.RecordBatch:
            roots = link_sets(sets, num, den, labels)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[r] for r in roots], pa.int64())], names=["doc_id", "root"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in keys]
            for *key, doc, label, words in zip(*cols, b.column("doc_id").to_pylist(), b.column("label").to_pylist(), hashed(b.column("text"), lower=True), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield linked()
                    now, ids, sets, labels = key, [], [], []
                ids.append(doc)
                sets.append(shingles(words, size))
                labels.append(label)
        if len(ids) > 1:
            yield linked()

    members = members.select(*keys, "doc_id", "label", "text")
    return members.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(released(run), "doc_id long, root long")


def ngram_jaccard_components(df: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", group_shingles: int | None = None) -> DataFrame:
    """One row for each row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links of similarity num / den or more)."""
    out = keyed_components(df, size, num, den, id_col, text_col, group_shingles)
    return out.select(F.when(~F.col("no_id"), F.col("key")).alias("doc_id"), "n_shingles", F.when(~F.col("root_no_id"), F.col("root")).alias("component_id"))


def keyed_components(df: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", group_shingles: int | None = None) -> DataFrame:
    """One row for each row: ``key`` (``row_key``), ``no_id``, ``n_shingles``, ``root`` (a key of its component: the smallest id, else the smallest key), ``root_no_id``."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(row_key(F.col(id_col), F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"))
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MOST_BITS, max(SKETCH_BITS, (text_bytes // COUNTER_BYTES).bit_length()))
    survey = materialize(_survey(docs, size, bits), "survey")
    sets = survey.where("block is null").select("doc_id", "n", "s1", "s2", "no_id")
    docs = docs.drop("no_id")
    levels = spark.sparkContext.broadcast(_levels(survey, bits, partitions))
    if group_shingles is None:
        group_shingles = min(MOST_SHINGLES, max(GROUP_SHINGLES, (sets.agg(F.sum("n")).first()[0] or 0) >> 11))
    rows = materialize(_prefixes(docs.select("text"), size, num, den, levels, bits), "prefixes")
    levels.unpersist()

    by_token = Window.partitionBy("token")
    shared = rows.where("token is not null").select("token", "s1", F.min("s1").over(by_token).alias("other"), F.count("*").over(by_token).alias("c"), F.max("hot").over(by_token).alias("hot")).where("c > 1")
    shared = materialize(shared, "shared")
    long_ = (F.col("c") > LISTED) | F.col("hot")
    lists = shared.where(~long_).groupBy("token").agg(F.array_sort(F.collect_set("s1")).alias("list")).where(F.size("list") > 1).select("list").distinct()
    near = _pruned(lists, survey.where("block is null"), num, den, partitions)
    stars = shared.where(long_ & (F.col("s1") != F.col("other"))).select("s1", "other")
    groups = components(rows.where("token is null").select("s1", "other").union(stars).union(near), "s1", "other")
    discard(rows, shared)

    # a class of equal sets stands by its smallest id
    classes = materialize(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    held = groups.join(classes, F.col("node") == F.col("s1")).select(F.col("root").alias("grp"), F.col("rep").alias("doc_id"), "n")
    held = held.groupBy("doc_id").agg(F.min("grp").alias("grp"), F.max("n").alias("n"))
    sizes = held.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("docs"), F.min("doc_id").alias("pivot")).where("docs > 1")
    held = held.join(sizes.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).drop("_g")
    held = held.withColumn("blocks", F.ceil(F.col("total") / group_shingles).cast("int"))
    held = held.join(docs.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).drop("_d")
    held = materialize(held.select("grp", "doc_id", "blocks", "pivot", "text"), "candidates")

    # each group at once, or in blocks that all hold the pivot
    own = F.when(F.col("doc_id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")))
    first = held.withColumn("block", F.explode(own)).withColumn("label", F.col("doc_id"))
    links = materialize(_grouped_links(first, ["grp", "block"], size, num, den, partitions), "first")
    large = held.where("blocks > 1")
    roots = components(links.where("doc_id <> root"), "doc_id", "root")
    if large.limit(1).count():
        # sets that are not with their pivot visit the other blocks
        known = large.join(roots.withColumnRenamed("root", "label"), F.col("doc_id") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "doc_id"))
        core = known.where("doc_id = pivot").select(F.col("grp").alias("_g"), F.col("label").alias("core"))
        known = materialize(known.join(core, F.col("grp") == F.col("_g")).drop("_g"), "known")
        rest = known.where("label <> core")
        parts = rest.groupBy("grp").agg(F.ceil(F.sum(F.length("text")) / (4 * group_shingles)).cast("int").alias("parts")).withColumnRenamed("grp", "_g")
        known = known.join(parts, F.col("grp") == F.col("_g")).drop("_g")
        all_blocks, all_parts = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
        hashed = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n).cast("long")).cast("int")
        at_home = known.withColumn("block", hashed("blocks")).withColumn("part", F.explode(all_parts))
        away = known.where("label <> core").withColumn("part", hashed("parts")).withColumn("block", F.explode(all_blocks))
        met = at_home.select("grp", "block", "part", "doc_id", "label", "text").union(away.where(F.col("block") != hashed("blocks")).select("grp", "block", "part", "doc_id", "label", "text"))
        more = _grouped_links(met, ["grp", "block", "part"], size, num, den, partitions)
        links = links.union(materialize(more, "second"))
        roots = components(links.where("doc_id <> root"), "doc_id", "root")

    discard(held)
    classes = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("root", "rep").alias("component_id"))
    out = sets.join(classes, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") > 0), "left")
    out = out.select(F.col("doc_id").alias("key"), "no_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("root"))
    if not sets.where("no_id").limit(1).count():
        return out.withColumn("root_no_id", F.lit(False))
    out = materialize(out, "keyed")
    ids = out.groupBy(F.col("root").alias("_r")).agg(F.min(F.when(~F.col("no_id"), F.col("key"))).alias("_least"))
    out = out.join(ids, F.col("root") == F.col("_r"))
    return out.select("key", "no_id", "n_shingles", F.coalesce("_least", "root").alias("root"), F.col("_least").isNull().alias("root_no_id"))
