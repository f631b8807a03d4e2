"""Operator 5: token ids in a content-addressed binary store.

Method. A rolling hash over the last ids cuts each document's id stream into
chunks, at places that depend on content only, so equal passages become equal
chunks. A chunk is stored once, under the SHA-256 of its bytes, as
little-endian 16-bit (or 32-bit) ids, compressed. Documents are recipes:
their chunks' digests in order, in files by ascending document id. A manifest
holds the Merkle root of every recipe file (over its documents' ids, starts,
lengths and roots, which are over their chunks' digests) and one root over
these; reading checks every chunk against its digest and every recipe against
the manifest. ``read_store`` without ``ids`` rebuilds no stream: it proves
lengths and crcs, chunk by chunk; with ``ids`` it rebuilds them all.

Files (Parquet, so that any store Spark can write to will do): ``data/kind=chunk``
(digest, n, ids), ``recipes`` (doc_id, start, n_tokens, digests, file), ``manifest``.

Scale. One tokenising pass; chunks are combined on the map side, so the chunk of a
group of copies arrives once for each task, and shuffle once, compressed, to be
stored once. Recipes are range-partitioned by id; only one root for each file
reaches the driver. Reading decodes each stored chunk once, where it lies, and
joins its length and crc to the recipes; a document's crc is combined from its
chunks' crcs, so no ids are shuffled.

Edge cases. A null text is empty: its stream is the end id alone. Repeated rows
are stored as documents of their own; rows with one id are ordered by a hash of
their chunks, so that reruns agree. Texts
of any length are taken whole. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.bpe import load
from seqspark.llm.common import mix64, powers, running_total

#: Ids that the rolling hash sees, and chunk sizes in ids: least, usual, most.
ROLL, LEAST, USUAL, MOST = 16, 128, 1024, 8192


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = _mixed(int(ids.max()))[ids]
    # a polynomial over ROLL ids in a row, from running sums
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    acc = mix64((sums[ROLL:] - sums[: n - ROLL + 1]) * down[: n - ROLL + 1])
    marks = np.flatnonzero((acc >> np.uint64(64 - (USUAL - 1).bit_length())) == 0) + ROLL
    ends, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST or m == n:
            if m > at:
                ends.append(m)
            at = m
    return ends


_table: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _mixed(most: int) -> np.ndarray:
    """A hash of every id up to ``most`` at least."""
    if len(_table[0]) <= most:
        _table[0] = mix64(np.arange(1, most + 2, dtype=np.uint64))
    return _table[0]


_BASE = 0x5851F42D4C957F2D
_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse; enough for usual documents are kept."""
    if n > 1 << 15:
        return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    if not _kept:
        _kept.extend((powers(_BASE, 1 << 15), powers(pow(_BASE, -1, 1 << 64), 1 << 15)))
    return _kept[0][:n], _kept[1][:n]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def crc32_combine(a: int, b: int, size: int) -> int:
    """The crc32 of two byte strings together, from theirs and the second's length."""
    if size == 0:
        return a

    def times(m: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v >>= 1
            k += 1
        return out

    # the operator that appends one zero bit, squared into 2**k zero bytes
    for m in _zero_bytes():
        if size & 1:
            a = times(m, a)
        size >>= 1
        if not size:
            break
    return a ^ b


_operators: list[list[int]] = []


def _zero_bytes() -> list[list[int]]:
    if not _operators:

        def square(m: list[int]) -> list[int]:
            out = []
            for v in m:
                r, k = 0, 0
                while v:
                    if v & 1:
                        r ^= m[k]
                    v >>= 1
                    k += 1
                out.append(r)
            return out

        m = [0xEDB88320, *[1 << k for k in range(31)]]
        for _ in range(3):
            m = square(m)
        for _ in range(48):
            _operators.append(m)
            m = square(m)
    return _operators


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of a table of documents to ``path``."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, end, seen = load(tokenizer), int(end_id).to_bytes(4, "little"), set()
        small = max(bpe.library.get_vocab_size(), end_id + 1) <= 1 << 16
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            docs, counts, recipes, chunks = [], [], [], []
            for doc, made in zip(b.column(0).to_pylist(), bpe.encode_many(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(made + end, "<u4")
                raw = ids.astype("<u2") if small else ids
                at, recipe = 0, []
                for stop in boundaries(ids):
                    piece = raw[at:stop].tobytes()
                    digest = hashlib.sha256(piece).digest()
                    recipe.append(digest)
                    if digest not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(digest)
                        chunks.append((digest, stop - at, squeeze(piece)))
                    at = stop
                docs.append(doc)
                counts.append(len(ids))
                recipes.append(recipe)
            k, c = len(docs), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*docs, *[None] * c], pa.int64()), pa.array([*counts, *[m for _, m, _ in chunks]], pa.int64()), pa.array([*recipes, *[None] * c], pa.list_(pa.binary())), pa.array([*[None] * k, *[d for d, _, _ in chunks]], pa.binary()), pa.array([*[None] * k, *[z for _, _, z in chunks]], pa.binary())],
                names=["doc_id", "n", "digests", "digest", "ids"],
            )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    made = source.mapInArrow(encode, "doc_id long, n long, digests array<binary>, digest binary, ids binary")

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keep = []
            for d in b.column("digest").to_pylist():
                keep.append(d is None or d != last)
                last = d
            yield b.filter(pa.array(keep, pa.bool_()))

    # one shuffle and one write: chunks meet by digest, recipes come along
    made = made.withColumn("kind", F.when(F.col("digest").isNull(), "recipe").otherwise("chunk"))
    made = made.repartition(partitions, F.when(F.col("digest").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("digest"))).sortWithinPartitions("kind", "digest")
    made.mapInArrow(first_of, made.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    # (a table without rows has no folder of its kind)
    recipes = spark.read.schema(made.schema).parquet(f"{path}/data").where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "digests", F.xxhash64("digests").alias("_tie"))
    recipes = running_total(recipes, ["doc_id", "_tie"], "n_tokens", "start").drop("_tie").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "start")
    recipes.withColumn("file", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    roots = file_roots(spark, path)
    files = [(r.file, r.root) for r in roots.orderBy("file").collect()]  # one for each recipe file
    top = merkle([r for _, r in files])
    spark.createDataFrame([*files, (-1, bytearray(top))], "file int, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def file_roots(spark: SparkSession, path: str) -> DataFrame:
    """The Merkle root of each recipe file, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, out = None, [], []
        for b in batches:
            for file, doc, start, n, digests in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if file != now:
                    if leaves:
                        out.append((now, merkle(leaves)))
                    now, leaves = file, []
                leaves.append(repr((doc, start, n)).encode() + merkle(digests))
        if leaves:
            out.append((now, merkle(leaves)))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())], names=["file", "root"])

    recipes = spark.read.parquet(f"{path}/recipes").select("file", "doc_id", "start", "n_tokens", "digests")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartition(n, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "start")
    return ordered.mapInArrow(run, "file int, root binary")


def verify_store(spark: SparkSession, path: str) -> bool:
    """Whether the recipes match the manifest (chunks are checked whenever they are read)."""
    manifest = {r.file: bytes(r.root) for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = {r.file: bytes(r.root) for r in file_roots(spark, path).collect()}
    top = manifest.pop(-1)
    return manifest == found and top == merkle([manifest[k] for k in sorted(manifest)])


def _decoded(chunks: DataFrame, ids: bool) -> DataFrame:
    """Of each stored chunk its digest, length, crc32 (of 32-bit ids) and, if asked for, its ids; raises if it is not what its digest says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor().decompress
        for b in batches:
            crcs, data = [], []
            for digest, n, z in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                piece = unsqueeze(z)
                if hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                wide = np.frombuffer(piece, "<u2" if len(piece) == 2 * n else "<u4").astype("<u4").tobytes()
                crcs.append(zlib.crc32(wide))
                data.append(wide if ids else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64()), pa.array(data, pa.binary())], names=["_digest", "_n", "_crc", "_ids"])

    return chunks.select("digest", "n", "ids").mapInArrow(run, "_digest binary, _n long, _crc long, _ids binary")


def read_store(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``, little-endian 32-bit) of each document, from the files."""
    if not verify_store(spark, path):
        raise ValueError(f"{path}: the recipes do not match the manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("k", "digest"))
    decoded = _decoded(spark.read.schema("digest binary, n long, ids binary, kind string").parquet(f"{path}/data").where("kind = 'chunk'"), ids)
    joined = parts.join(decoded if ids else decoded.drop("_ids"), F.col("digest") == F.col("_digest"), "left")
    item = F.struct("k", "_n", "_crc", *(["_ids"] if ids else []))
    grouped = joined.groupBy("start", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(item)).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, data = [], []
            for n, parts_ in zip(b.column("n_tokens").to_pylist(), b.column("parts").to_pylist(), strict=True):
                crc, total = 0, 0
                for p in parts_:
                    if p["_n"] is None:
                        raise ValueError("a chunk is missing")
                    crc, total = crc32_combine(crc, p["_crc"], 4 * p["_n"]), total + p["_n"]
                if total != n:
                    raise ValueError("a document is incomplete")
                crcs.append(crc)
                data.append(b"".join([p["_ids"] for p in parts_]) if ids else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    out = grouped.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if ids else out.drop("ids")
