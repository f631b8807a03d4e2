"""Operator 8: removal of byte strings that an earlier document holds, by blockwise suffix sorting with a difference cover.

Method. Suffixes are sorted one bucket at a time. Within a bucket ``suffix_order``
sorts by the first 16 bytes; ties are resolved by precomputed ranks of a sample
of suffixes, those at positions in a difference cover modulo 16: any two tied
suffixes have a shift below 16 that takes both to sample positions, where their
ranks decide. Memory is a few words for each suffix of one bucket, however long
the ties. Neighbours in suffix order that agree in 50 bytes form a group; in a
group every string of a document other than the smallest goes.

Buckets are made so that equal strings meet: a suffix belongs to the bucket of
its minimiser, the least-hashed 20-gram of its first 50 bytes. Runs of suffixes with
one minimiser travel as one segment of text (about 4 bytes a suffix). Strings
whose minimiser no other document has cannot repeat; a key exchange
(``exchange``) finds the others first, so only text around shared minimisers
is sorted at all.

Copies of a text form a class; its smallest document stands for it, the others
lose everything. Equal segments are combined on the map side, and again before
a bucket is sorted: all but the smallest document's are settled there. So a passage of a third of all
documents arrives once for each buffer, is sorted once, and no pairs are formed.

A text travels twice: to its shared minimisers, and to the spans that it loses;
what a step no longer needs is deleted.

Edge cases. A null text is empty. Texts under 50 bytes keep all. Matches within one document, or
between rows that share an id, do not count. A row without an id comes after those
that have one, in the order of a hash of its text; equal texts without an id share it. Repeated rows get the same result. Texts of any length
are taken whole, as UTF-8 bytes; a cut may fall inside a character
(``kept_text`` drops such a character's rest). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm import exchange as x
from seqspark.llm import words as w
from seqspark.llm.common import discard, materialize, mix64, released, row_key
from seqspark.llm.substring_dedup import candidates, is_cover, with_class

WIDTH, GRAM = 50, 20
#: A difference cover modulo 16.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Zero bytes after each segment, so that ranks may look past its end.
PAD = 32
#: Suffixes sorted at a time.
BLOCK = 1 << 21
#: Bytes of segments that a map task combines at a time.
HELD = 1 << 23
#: Exchanged minimisers keep 48 bits: a filter, not a verdict.
MASK = np.uint64(0xFFFFFFFFFFFF0000)

assert is_cover(COVER, PERIOD)
_IN = np.isin(np.arange(PERIOD), COVER)
#: _SHIFT[r, s]: the least shift that takes positions of residues r and s into the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(r + d) % PERIOD] and _IN[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian integer (the text must end in 8 bytes of padding)."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,)).astype(np.uint64)


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of one key."""
    by = np.argsort(key)
    s = key[by]
    new = np.zeros(len(by), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(by), np.uint64)
    out[by] = np.cumsum(new) + 1
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks below 2**32."""
    return dense((a << np.uint64(32)) | b)


def cover_ranks(words: np.ndarray, size: int, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each position in the cover the rank of its suffix among the cover's positions; 0 elsewhere.

    Suffixes lie between ``begins`` and ``ends`` and end in padding; positions
    further than a period past an end hold padding and are not ranked. Ranks
    are doubled in length until no two are equal, or the longest segment is
    spanned (what is still equal then are equal segments).
    """
    at = _cover_positions(begins, ends + PERIOD)
    longest = int((ends - begins).max()) if len(ends) else 0
    rank = np.zeros(size + 2 * max(longest, 64), np.uint64)
    rank[at] = paired(dense(words[at]), dense(words[at + 8]))
    span = PERIOD
    asked = _cover_positions(begins, ends - WIDTH + PERIOD)  # where a shift below the period can take a suffix
    while span < longest and len(at) and int(rank[at].max()) < len(at):
        # of twice the length: at + span is in the cover too; the last doubling is for what is asked only
        at = at if 2 * span < longest else asked
        rank[at] = paired(rank[at], rank[at + span])
        span *= 2
    return rank


def _cover_positions(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions of the cover in ``begins`` .. ``ends``, rounded to whole periods."""
    lo, hi = begins // PERIOD, ends // PERIOD + 1
    count = hi - lo
    row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return (np.unique(row)[:, None] * PERIOD + np.array(COVER)[None, :]).ravel()


def suffix_order(text: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> Iterator[np.ndarray]:
    """``starts`` in the order of the suffixes there (to at least ``WIDTH`` bytes), one bucket after another.

    No two suffixes that share their first bytes are in different buckets.
    ``text`` consists of segments ``begins`` .. ``ends`` with ``PAD`` zero bytes after each.
    """
    if len(starts) == 0:
        return
    words = words_at(text)
    rank = cover_ranks(words, len(text), ends, begins)
    head = words[starts]
    if len(starts) > block:
        edges = np.unique(np.sort(head)[block::block])
        bucket = np.searchsorted(edges, head, side="right")
        buckets = [np.flatnonzero(bucket == k) for k in range(len(edges) + 1)]
    else:
        buckets = [np.arange(len(starts))]
    for b in buckets:
        if len(b) == 0:
            continue
        at = starts[b]
        own = rank[at + _SHIFT[at % PERIOD, at % PERIOD]]
        prefix = paired(dense(words[at]), dense(words[at + 8]))
        by = np.argsort((prefix << np.uint64(32)) | own)
        at, prefix = at[by], prefix[by]
        new = np.ones(len(at), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        heads = np.flatnonzero(new)
        residue = at % PERIOD
        mixed = (np.minimum.reduceat(residue, heads) != np.maximum.reduceat(residue, heads))[np.cumsum(new) - 1]
        at[mixed] = _merged(at[mixed], np.cumsum(new)[mixed], rank)
        yield at


def _merged(tied: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes in groups that agree in their first 16 bytes, each group in order.

    The suffixes of one residue are in order already. A suffix's place is the number
    of suffixes before it, counted in each residue's list by the ranks at
    the shift that takes both residues into the cover.
    """
    group = group.astype(np.uint64) << np.uint64(32)
    residue = tied % PERIOD
    by = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    place = np.zeros(len(tied), np.int64)
    for r in range(PERIOD):
        if len(by[r]) == 0:
            continue
        place[by[r]] += np.arange(len(by[r]))
        for s in range(PERIOD):
            if s != r and len(by[s]):
                d = int(_SHIFT[r, s])
                mine, other = group[by[r]] | rank[tied[by[r]] + d], group[by[s]] | rank[tied[by[s]] + d]
                place[by[r]] += np.searchsorted(other, mine, "left" if s > r else "right")
    return tied[np.lexsort((place, group))]


def repeated_groups(text: np.ndarray, order: np.ndarray, words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Group number of each suffix in ``order``: neighbours that agree in ``width`` bytes share one."""
    same = np.ones(len(order) - 1, bool)
    for d in [*range(0, width - 7, 8), width - 8]:
        v = words[order + d]
        same &= v[1:] == v[:-1]
    return np.concatenate(([0], np.cumsum(~same)))


def minimisers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each 20-gram, least hash in each 50-byte window, running sums of the bytes' polynomial)."""
    buf = np.frombuffer(data, np.uint8)
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    value = w._VALUE[buf]
    value *= w._powers(w._R, n)
    np.cumsum(value, out=sums[1:])
    grams = max(0, n - GRAM + 1)
    h = mix64((sums[GRAM:] - sums[:grams]) * w._powers(w._INVERSE, n + 1)[:grams]) if grams else np.empty(0, np.uint64)
    least, span, want = h, 1, WIDTH - GRAM + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want and len(least) > want - span:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    return h, least, sums


def spread(least: np.ndarray) -> np.ndarray:
    """Minimisers as even keys: being minima they crowd at small values, which would make the first buckets large."""
    return mix64(least ^ np.uint64(0x5DEECE66D1234567))


def _pieces(column: pa.Array) -> Iterator[tuple[list[tuple[int, int, bytes]], np.ndarray, bytes]]:
    """Pieces (row, place in its text, bytes), where each begins in the joined bytes, and these.

    A long text comes in pieces that overlap by a window less one byte, so no
    window is lost and what is computed at a time stays bounded.
    """
    held, total = [], 0

    def joined():
        return held, np.cumsum([0, *[len(t) + 1 for _, _, t in held]]), b"\n".join([t for _, _, t in held])

    for row, text in enumerate(column.cast(pa.large_binary())):
        text = text.as_py() or b""
        for at in range(0, max(1, len(text) - WIDTH + 1), w.SLICE):
            piece = text[at : at + w.SLICE + WIDTH - 1]
            if held and total + len(piece) > w.SLICE:
                yield joined()
                held, total = [], 0
            held.append((row, at, piece))
            total += len(piece) + 1
    if held:
        yield joined()


SEGMENTS = "bucket int, doc binary, owner binary, start binary, size binary, turn binary, data binary, grp int, owners binary, keys binary, naming boolean"
_NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def _windows(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Removed windows first..last as 16-byte values."""
    return np.ascontiguousarray(np.stack([first, last], axis=1).astype("<i8")).view("V16").ravel()


def later_copies(doc: np.ndarray, size: np.ndarray, turn: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments that equal one of a smaller document, and the other segments; ``data`` holds their bytes one after another."""
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(begin, size)
    ident = mix64(np.add.reduceat(w._VALUE[data] * w._powers(w._R, int(size.max()))[place], begin))
    by = np.lexsort((doc, turn, size, ident))
    new = np.ones(len(by), bool)
    new[1:] = (ident[by][1:] != ident[by][:-1]) | (size[by][1:] != size[by][:-1]) | (turn[by][1:] != turn[by][:-1])
    first = doc[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return by[doc[by] > first], np.sort(by[doc[by] == first])


def _segments(cand: DataFrame, buckets: int) -> DataFrame:
    """Packed segments by bucket, and spans that a task settles itself."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, owner, start, size, turn, key, ident = (np.concatenate([np.broadcast_to(h[k], h[2].shape) for h in held]) for k in range(7))
            data = np.concatenate([np.frombuffer(h[7], np.uint8) for h in held])
            held.clear()
            at = np.cumsum(size) - size
            # of equal segments only the smallest document's is sent on
            by = np.lexsort((doc, ident, size, key))
            new = np.ones(len(by), bool)
            for f in (key, size, ident):
                s = f[by]
                new[1:] &= s[1:] == s[:-1]
            new[1:] = ~new[1:]
            first = doc[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            later = by[doc[by] > first]
            settled = x.reply_batch(owner[later], _windows(start[later], start[later] + size[later] - WIDTH), max(1, buckets // 16))
            none = pa.nulls(settled.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([settled.column("grp"), *[none] * 6, *settled.columns], names=_NAMES)
            stay = np.setdiff1d(np.arange(len(by)), later)
            b = (key[stay] >> shift).astype(np.int64)
            stay, b = stay[np.argsort(b, kind="stable")], np.sort(b)
            cut = np.searchsorted(b, np.arange(buckets + 1))
            cols: list[list] = [[] for _ in range(7)]
            for k in np.flatnonzero(np.diff(cut)):
                s = stay[cut[k] : cut[k + 1]]
                sizes = size[s]
                take = np.repeat(at[s] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                for c, v in zip(cols, (int(k), x.planes(doc[s]), x.planes(owner[s]), x.planes(start[s]), x.planes(sizes), turn[s].tobytes(), data[take].tobytes()), strict=True):
                    c.append(v)
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], names=_NAMES)

        for b in batches:
            docs, owners, keys = b.column("doc_id").to_pylist(), b.column("t1").to_pylist(), b.column("keys").to_pylist()
            mine, live_keys = -1, None
            for held_pieces, at, data in _pieces(x.unzipped(b.column("text"))):
                h, least, sums = minimisers(data)
                inverse = w._powers(w._INVERSE, len(data) + 1)
                for d, (k, place_in_text, piece) in enumerate(held_pieces):
                    n = len(piece) - WIDTH + 1
                    if n <= 0:
                        continue
                    if k != mine:
                        mine, live_keys = k, x.key_set(keys[k])
                    m = least[at[d] : at[d] + n]
                    edge = np.ones(n + 1, bool)
                    edge[1:n] = m[1:] != m[:-1]
                    cut = np.flatnonzero(edge)
                    key = spread(m[cut[:-1]])
                    use = np.isin(key & MASK, live_keys)
                    first, last, key = cut[:-1][use], cut[1:][use] - 1, key[use]
                    if len(first) == 0:
                        continue
                    size = last - first + WIDTH
                    place = last + h[(at[d] + last)[:, None] + np.arange(WIDTH - GRAM + 1)].argmin(axis=1)
                    lo, hi = at[d] + first, at[d] + last + WIDTH
                    ident = mix64((sums[hi] - sums[lo]) * inverse[lo])
                    take = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    held.append((np.int64(docs[k]), np.int64(owners[k]), first.astype(np.int64) + place_in_text, size.astype(np.int64), ((place - first) % PERIOD).astype(np.uint8), key, ident, np.frombuffer(data, np.uint8)[take].tobytes()))
                    total += int(size.sum())
                    if total > HELD:
                        total = 0
                        yield from flush()
        yield from flush()

    return cand.mapInArrow(released(run), SEGMENTS)


def _sorted_out(rows: DataFrame, partitions: int, buckets: int) -> DataFrame:
    """Replies: to each owner its windows whose string a smaller document holds, from the packed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out_ = None, [], x.Replies(buckets)

        def solve() -> Iterator[pa.RecordBatch]:
            doc, owner, start, size = (np.concatenate([x.unplanes(p[k], "<i8") for p in parts]) for k in range(4))
            turn = np.frombuffer(b"".join(p[4] for p in parts), np.uint8).astype(np.int64)
            data = np.frombuffer(b"".join(p[5] for p in parts), np.uint8)
            later, stay = later_copies(doc, size, turn, data)
            yield from out_.add(owner[later], _windows(start[later], start[later] + size[later] - WIDTH))
            source = np.cumsum(size) - size
            data = data[np.repeat(source[stay] - (np.cumsum(size[stay]) - size[stay]), size[stay]) + np.arange(int(size[stay].sum()))]
            doc, owner, start, size, turn = (v[stay] for v in (doc, owner, start, size, turn))
            # each segment's minimiser comes to a multiple of the period, so equal strings have equal residues
            room = -(-(size + PAD + PERIOD) // PERIOD) * PERIOD
            base = np.cumsum(room) - room + (-turn) % PERIOD
            text = np.zeros(int(room.sum()) + PAD, np.uint8)
            source = np.cumsum(size) - size
            text[np.repeat(base - source, size) + np.arange(len(data))] = data
            count = size - WIDTH + 1
            segment = np.repeat(np.arange(len(size)), count)
            starts = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            owns = np.zeros(len(text), np.int32)
            owns[starts] = segment
            gone = np.zeros(len(text), bool)
            words = words_at(text)
            for order in suffix_order(text, starts, base, base + size):
                group = repeated_groups(text, order, words)
                docs = doc[owns[order]]
                heads = np.flatnonzero(np.diff(group, prepend=-1))
                gone[order] = docs > np.minimum.reduceat(docs, heads)[group]
            out = gone[starts]
            edge = np.ones(len(out) + 1, bool)
            edge[1:-1] = (out[1:] != out[:-1]) | (segment[1:] != segment[:-1])
            cut = np.flatnonzero(edge)
            first, last = cut[:-1], cut[1:] - 1
            keep = out[first]
            first, last = first[keep], last[keep]
            s = segment[first]
            yield from out_.add(owner[s], _windows(start[s] + starts[first] - base[s], start[s] + starts[last] - base[s]))

        for b in batches:
            settled = b.column("grp").is_valid()
            yield b.filter(settled).select(["grp", "owners", "keys", "naming"])
            b = b.filter(pa.compute.invert(settled))
            for bucket, *part in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                if bucket != now:
                    if parts:
                        yield from solve()
                    now, parts = bucket, []
                parts.append(part)
        if parts:
            yield from solve()
        yield from out_.flush()

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(released(run), x.REPLY)


def cut_out(text: bytes, spans: bytes) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the bytes left) when the windows of the spans go."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + WIDTH)
    new = np.ones(len(pairs), bool)
    new[1:] = begin[1:] > end[:-1]
    lo = begin[new]
    hi = end[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]
    kept, at = [], 0
    for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.append(text[at:a])
        at = z
    kept.append(text[at:])
    return int((hi - lo).sum()), len(lo), b"".join(kept)


def suffix_dedup_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns as they were, but for the text, of which the repeated strings are gone (a null text becomes empty)."""
    out = suffix_dedup(df, id_col, text_col, kept_text=True)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """One row for each row: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, the text left, and ``row``, the input's other columns)."""
    spark = df.sparkSession
    partitions, buckets = int(spark.conf.get("spark.sql.shuffle.partitions")), x.buckets_for(spark)
    docs = with_class(df, id_col, text_col, carry=kept_text).withColumn("given", F.col("doc_id")).withColumn("doc_id", row_key(F.col("given"), F.col("text")))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def keys_of(b: pa.RecordBatch):
            owners = b.column("t1").to_pylist()
            now, parts = -1, []
            for pieces, at, data in _pieces(b.column("text")):
                _, least, _ = minimisers(data)
                for d, (k, _, piece) in enumerate(pieces):
                    if k != now:
                        if parts:
                            yield owners[now], np.unique(spread(np.concatenate(parts)) & MASK), None
                        now, parts = k, []
                        if owners[k] in seen:
                            now = -1
                            continue
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(owners[k])
                    n = len(piece) - WIDTH + 1
                    if n > 0:
                        m = least[at[d] : at[d] + n]
                        parts.append(m[np.concatenate(([True], m[1:] != m[:-1]))])
            if parts:
                yield owners[now], np.unique(spread(np.concatenate(parts)) & MASK), None

        yield from x.packed(batches, keys_of, buckets, within=False)

    replies = x.repeated(docs.select("t1", "text").mapInArrow(released(fingerprints), x.PACKED), partitions, buckets, within=False)
    classes = docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"))
    cand = candidates(docs.select("doc_id", "text", "t1", "t2"), replies, classes)
    spans = x.by_owner(_sorted_out(_segments(cand, buckets), partitions, buckets), partitions, width=16).withColumnRenamed("owner", "_o").withColumnRenamed("keys", "spans")
    spans = materialize(spans, "spans")
    discard(cand)
    # classes with copies, and classes that lose something
    verdicts = docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).withColumnRenamed("t1", "_c1").withColumnRenamed("t2", "_c2")
    verdicts = verdicts.join(spans, F.col("_c1") == F.col("_o"), "left").where(F.col("spans").isNotNull() | (F.col("first") < F.col("last"))).drop("_o", "last")
    # texts travel once more, to meet their spans
    out = x.zipped(docs).join(verdicts, (F.col("t1") == F.col("_c1")) & (F.col("t2") == F.col("_c2")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "row"] if kept_text else [])]
    fields = [T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in names[1:4]], T.StructField("kept_sha256", T.StringType())]
    if kept_text:
        fields += [T.StructField("kept", T.StringType()), docs.schema["row"]]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts: list[list] = [[], [], [], [], []]
            for text, own, first, s in zip(x.unzipped(b.column("text")), b.column("doc_id").to_pylist(), b.column("first").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                n = len(text)
                if first is not None and own > first and n >= WIDTH:
                    got = (n, n, 1, nothing, "")
                else:
                    gone, runs, kept = cut_out(text, s) if s else (0, 0, text)
                    got = (n, gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if kept_text else None)
                for c, v in zip(facts, got, strict=True):
                    c.append(v)
            cols = [b.column("given"), *[pa.array(c, pa.int64()) for c in facts[:3]], pa.array(facts[3], pa.string())]
            if kept_text:
                cols += [pa.array(facts[4], pa.string()), b.column("row")]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    wanted = ["given", "doc_id", "first", "spans", "text", *(["row"] if kept_text else [])]
    return out.select(*wanted).mapInArrow(released(remove), T.StructType(fields))
