"""Which 64-bit keys occur more than once over all documents, without a row for each key.

Map tasks pack their keys into one binary row for each bucket of the key space
(keys and owners as byte planes, which compress), after combining equal keys,
so that a key that a third of all documents hold arrives once for each buffer
of ``BUFFER`` keys. Reduce tasks take one bucket at a time, sort it with numpy,
and reply to the owners with their repeated keys; replies travel packed too, by
groups of owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqspark.llm.common import released

BUFFER = 1 << 19
REPLY = "grp int, owners binary, keys binary, naming boolean"
_REPLY = ["grp", "owners", "keys", "naming"]


def buckets_for(spark) -> int:
    """Buckets of the key space: a power of two, some for each shuffle partition."""
    n = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(5, (n - 1).bit_length())


def planes(x: np.ndarray) -> bytes:
    """Little-endian integers with their first bytes together, then their second bytes, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def replies(owners: np.ndarray, values: np.ndarray, groups: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Values for owners, as one (group, owners, values) for each group of owners; a value is one item of ``values`` (any item size)."""
    if len(owners) == 0:
        return [], [], []
    g = owners & (groups - 1)
    by = np.argsort(g, kind="stable")
    owners, values, g = owners[by], values[by], g[by]
    cut = np.flatnonzero(g[1:] != g[:-1]) + 1
    return g[np.concatenate(([0], cut))].tolist(), [planes(o) for o in np.split(owners, cut)], [v.tobytes() for v in np.split(values, cut)]


def packed(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray | None]]], buckets: int, within: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, h, h2, o, many) of packed keys, and replies for keys found repeated here.

    ``keys_of`` yields (owner, keys, further key bits or None). ``within``: a
    key twice in one owner counts as repeated.
    """
    held: list[tuple[int, np.ndarray, np.ndarray | None]] = []
    total = 0
    # owners travel as numbers that count up within the task and compress well; their names follow once
    task, number, names = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0, 0, []
    groups = max(1, buckets // 16)
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h = np.concatenate([k for _, k, _ in held])
        two = held[0][2] is not None
        h2 = np.concatenate([k for _, _, k in held]) if two else np.zeros(len(h), np.uint32)
        o = np.repeat(np.array([x for x, _, _ in held], np.int64), [len(k) for _, k, _ in held])
        held.clear()
        by = np.lexsort((h2, h)) if two else np.argsort(h, kind="stable") if within else np.lexsort((o, h))
        h, h2, o = h[by], h2[by], o[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(h)))
        many = size > 1 if within else o[heads] != o[heads + size - 1]
        again = many[group]
        for r in (reply_batch(o[again], h[again], groups), reply_batch(np.array([k for k, _ in names], np.int64), np.array([v for _, v in names], np.int64), groups, naming=True)):
            none = pa.nulls(r.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([r.column("grp"), none, none, none, none, *r.columns], names=_PACKED)
        names.clear()
        h, h2, o = h[heads], h2[heads], o[heads]
        b = (h >> shift).astype(np.int64)
        cut = np.searchsorted(b, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        spans = [slice(cut[k], cut[k + 1]) for k in full]
        none = pa.nulls(len(full), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([planes(h[s]) for s in spans], pa.binary()), pa.array([planes(h2[s]) if two else b"" for s in spans], pa.binary()), pa.array([planes(o[s]) for s in spans], pa.binary()), pa.array([np.packbits(many[s]).tobytes() for s in spans], pa.binary()), pa.nulls(len(full), pa.int32()), none, none, pa.nulls(len(full), pa.bool_())],
            names=_PACKED,
        )

    for b in batches:
        for owner, keys, more in keys_of(b):
            if len(keys) == 0:
                continue
            held.append((task + number, keys, more))
            names.append((task + number, owner))
            number += 1
            total += len(keys)
            if total >= BUFFER:
                total = 0
                yield from flush()
    yield from flush()


PACKED = "bucket int, h binary, h2 binary, o binary, many binary, grp int, owners binary, keys binary, naming boolean"
_PACKED = [c.split()[0] for c in PACKED.split(", ")]


def repeated(rows: DataFrame, partitions: int, buckets: int, within: bool = True) -> DataFrame:
    """Replies: to each owner the keys that occur elsewhere too.

    ``rows`` come from ``packed``. Without ``within`` only another owner counts as elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out = None, [], Replies(buckets)

        def solve() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([p[0] for p in parts])
            h2 = np.concatenate([p[1] for p in parts])
            o = np.concatenate([p[2] for p in parts])
            many = np.concatenate([p[3] for p in parts])
            by = np.lexsort((h2, h)) if within and h2.any() else np.argsort(h, kind="stable") if within else np.lexsort((o, h2, h))
            h, h2, o, many = h[by], h2[by], o[by], many[by]
            same = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
            heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
            size = np.diff(np.append(heads, len(h)))
            again = size > 1 if within else (o[heads] != o[heads + size - 1]) | np.logical_or.reduceat(many, heads)
            twice = np.repeat(again, size) & ~many  # the others have their reply already
            yield from out.add(o[twice], h[twice])

        for b in batches:
            settled = b.column("grp").is_valid()
            yield b.filter(settled).select(_REPLY)
            b = b.filter(pa.compute.invert(settled))
            for bucket, h, h2, o, many in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if bucket != now:
                    if parts:
                        yield from solve()
                    now, parts = bucket, []
                keys = unplanes(h, "<u8")
                parts.append((keys, unplanes(h2, "<u4") if h2 else np.zeros(len(keys), np.uint32), unplanes(o, "<i8"), np.unpackbits(np.frombuffer(many, np.uint8), count=len(keys)).astype(bool)))
        if parts:
            yield from solve()
        yield from out.flush()

    # what the map side has settled passes through, so that the rows are made once
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(released(run), REPLY)


def by_owner(rows: DataFrame, partitions: int, width: int = 8) -> DataFrame:
    """Replies gathered: ``owner``, ``keys`` (its values of ``width`` bytes, as one binary); an owner that several tasks met has a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, names = None, [], []

        def solve() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            owners = np.concatenate([unplanes(o, "<i8") for o, _ in parts])
            values = np.frombuffer(b"".join(v for _, v in parts), f"V{width}")
            by = np.argsort(owners, kind="stable")
            owners, values = owners[by], values[by]
            cut = np.flatnonzero(owners[1:] != owners[:-1]) + 1
            heads = owners[np.concatenate(([0], cut))]
            if names:
                number, name = np.concatenate([unplanes(o, "<i8") for o, _ in names]), np.frombuffer(b"".join(v for _, v in names), "<i8")
                by = np.argsort(number)
                heads = name[by][np.searchsorted(number[by], heads)]
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array([v.tobytes() for v in np.split(values, cut)], pa.binary())], names=["owner", "keys"])

        for b in batches:
            for grp, owners, values, naming in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if grp != now:
                    yield from solve()
                    now, parts, names = grp, [], []
                (names if naming else parts).append((owners, values))
        yield from solve()

    return rows.repartition(partitions, "grp").sortWithinPartitions("grp").mapInArrow(released(run), "owner long, keys binary")


def reply_batch(owners: np.ndarray, values: np.ndarray, groups: int, naming: bool = False) -> pa.RecordBatch:
    grp, who, what = replies(owners, values, groups)
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(who, pa.binary()), pa.array(what, pa.binary()), pa.array([naming] * len(grp), pa.bool_())], names=_REPLY)


def zipped(docs: DataFrame) -> DataFrame:
    """The rows with ``text`` as zstd bytes: what is shuffled and written shrinks by a third against lz4."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        at = docs_names.index("text")
        for b in batches:
            z = pa.array([squeeze(t or b"") for t in b.column(at).cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if k == at else c for k, c in enumerate(b.columns)], names=docs_names)

    docs_names = docs.columns
    return docs.mapInArrow(released(run), schema)


def unzipped(column: pa.Array) -> pa.Array:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(z) for z in column.to_pylist()], pa.large_binary())


class Replies:
    """Replies of one task, held until there are many."""

    def __init__(self, buckets: int):
        self.groups, self.owners, self.values, self.total = max(1, buckets // 16), [], [], 0

    def add(self, owners: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.owners.append(owners)
        self.values.append(values)
        self.total += len(owners)
        if self.total > BUFFER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.total:
            yield reply_batch(np.concatenate(self.owners), np.concatenate(self.values), self.groups)
        self.owners, self.values, self.total = [], [], 0


def key_set(keys: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(keys, "<u8")) if keys else np.empty(0, np.uint64)
