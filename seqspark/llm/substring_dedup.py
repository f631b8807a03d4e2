"""Operator 4: removal of repeated word windows, by difference-cover anchors.

Method. Let D be a difference cover modulo v: every difference modulo v is one
of two elements of D. Two equal windows at positions i and j of any documents
then have a common shift d < v with (i + d) mod v and (j + d) mod v both in D,
so if only the sub-windows of ``window - v + 1`` words at positions in D modulo
v are hashed (5 of 21), every long match still shares an anchor. Repeated anchors
are extended: only windows around one are candidates, and those are compared as
wholes, by 96 bits of hash. A window is repeated if its words also start
anywhere else; words covered by a repeated window go.

Texts that occur twice or more are classes: all their windows are repeated, and
one member stands for the class when other texts are compared.

Scale. Two key exchanges (``exchange``): anchors, then candidate windows;
equal keys are combined on the map side and reduced one bucket at a time, so
neither a passage that a third of all documents share nor a large group of
copies meets in one task, and no pairs are formed. Texts shuffle once, to fetch the candidates.

Edge cases. A null or wordless text has 0 words and the digest of nothing. Texts
shorter than the window keep all words. Repeated rows are copies of each other (their windows start
elsewhere). Texts of any length are taken whole; overlapping windows all count;
windows are judged on the input. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import exchange as x
from seqspark.llm.common import discard, materialize, mix64, powers, released
from seqspark.llm.words import hashed

#: A difference cover modulo 21 (a perfect difference set).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_B, _C = 0xD6E8FEB86659FD93, 0xCF1BBCDCB7A56463


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, base: int = _B) -> np.ndarray:
    """Hashes of the windows of ``width`` words that start at ``at``, from running sums of a polynomial over the word hashes."""
    if len(at) == 0:
        return np.empty(0, np.uint64)
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), out=sums[1:])
    return mix64((sums[at + width] - sums[at]) * powers(pow(base, -1, 1 << 64), n)[at])


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the sub-windows at cover positions."""
    width = window - PERIOD + 1
    last = len(words) - width
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = (np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    at = at[at <= last]
    return window_hashes(words, at, width), at


def around(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at ``at`` at a shift under the period."""
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - window + 1] > 0)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window that starts at one of ``starts``."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + window, n), -1)
    return np.cumsum(mark)[:n] > 0


def with_class(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (never null) and ``t1``, ``t2``, a 128-bit hash of the text (and ``row``, the input's other columns)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row")] if carry else []
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row)
    return out.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), F.col("text")))


def candidates(docs: DataFrame, replies: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each class with replies: t1, t2, doc_id (the smallest), text (zstd), keys.

    ``classes`` has t1, t2, rep. The text is fetched by the smallest id, which
    no number of copies makes a hot key (copies that all lack an id share a key;
    AQE splits that join).
    """
    r = materialize(x.by_owner(replies, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumnRenamed("owner", "_o"), "replies")
    want = classes.join(r, F.col("t1") == F.col("_o")).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "rep", "keys")
    want = want.dropDuplicates(["_t1", "_t2"])  # of a class that several tasks met, all got the same
    got = x.zipped(docs).join(want, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
    # (equal rows with the smallest id stand for each other)
    got = materialize(got.select("doc_id", "t1", "t2", "text", "keys").dropDuplicates(["doc_id", "t1", "t2"]), "candidates")
    discard(r)
    return got


def word_window_dedup(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """One row for each row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept``, the kept words joined by one space)."""
    if window <= PERIOD:
        raise ValueError(f"windows must have more than {PERIOD} words")
    spark = df.sparkSession
    partitions, buckets = int(spark.conf.get("spark.sql.shuffle.partitions")), x.buckets_for(spark)
    docs = with_class(df, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, whole = [], [], []
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                words = text.split()  # of bytes: at 0x20 and 0x09-0x0D
                kept = b" ".join(words)
                counts.append(len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                whole.append(kept.decode() if kept_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(whole, pa.string())], names=["doc_id", "t1", "t2", "n_words", "sha", "whole"])

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def keys_of(b: pa.RecordBatch):
            owners, k = b.column("t1").to_pylist(), 0
            for words in hashed(b.column("text")):
                if owners[k] not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(owners[k])
                    yield owners[k], anchors(words, window)[0], None
                k += 1

        yield from x.packed(batches, keys_of, buckets, within=True)

    facts = materialize(docs.select("doc_id", "text", "t1", "t2").mapInArrow(released(measure), "doc_id long, t1 long, t2 long, n_words long, sha string, whole string"), "facts")
    replies = x.repeated(docs.select("t1", "text").mapInArrow(released(anchored), x.PACKED), partitions, buckets)
    classes = facts.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    cand = candidates(docs, replies, classes)

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(b: pa.RecordBatch):
            owners, keys, k = b.column("t1").to_pylist(), b.column("keys").to_pylist(), 0
            for words in hashed(x.unzipped(b.column("text"))):
                key, at = anchors(words, window)
                starts = around(at[np.isin(key, x.key_set(keys[k]))], len(words), window)
                yield owners[k], window_hashes(words, starts, window), (window_hashes(words, starts, window, _C) >> np.uint64(32)).astype(np.uint32)
                k += 1

        yield from x.packed(batches, keys_of, buckets, within=True)

    found = x.by_owner(x.repeated(cand.mapInArrow(released(whole_windows), x.PACKED), partitions, buckets), partitions).withColumnRenamed("owner", "_o").withColumnRenamed("keys", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, kept_ = [], [], []
            texts = x.unzipped(b.column("text"))
            for text, keys, words in zip(texts, b.column("found").to_pylist(), hashed(texts), strict=True):
                starts = np.flatnonzero(np.isin(window_hashes(words, np.arange(len(words) - window + 1), window), x.key_set(keys))) if len(words) >= window else np.empty(0, np.int64)
                gone = covered(starts, len(words), window)
                kept = b" ".join([w for w, g in zip(text.as_py().split(), gone.tolist(), strict=True) if not g])
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_.append(kept.decode() if kept_text else None)
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(n, pa.int64()), pa.array(sha), pa.array(kept_, pa.string())], names=["_t1", "_t2", "_n", "_sha", "_kept"])

    changed = cand.join(found, F.col("t1") == F.col("_o")).select("t1", "t2", "text", "found").mapInArrow(released(remove), "_t1 long, _t2 long, _n long, _sha string, _kept string")
    copied = classes.where("copies > 1").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.lit(True).alias("copied"))
    changed = materialize(changed, "changed")
    discard(cand)
    verdicts = changed.withColumn("copied", F.lit(False))
    verdicts = verdicts.join(copied.select("_t1", "_t2"), ["_t1", "_t2"], "left_anti").select("_t1", "_t2", "_n", "_sha", "_kept", "copied")
    verdicts = verdicts.union(copied.select("_t1", "_t2", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "copied"))
    all_gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= window)
    out = facts.join(verdicts, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    cols = [
        F.col("doc_id").alias(id_col), "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(all_gone, F.lit("")).otherwise(F.coalesce("_kept", "whole")).alias("kept")] if kept_text else []))
