"""What several operators of this subpackage share.

Conventions that hold for all of them:

* a null text counts as an empty text, a null key column as its own value;
* repeated rows (same id) are rows of their own, each with its own result;
* operators never join back on an id where the text can travel with the row.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker looks at together; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where the session names none a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's switch that deletes a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet into the shared folder and reads them again; the shuffles that made them are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the folders of materialized rows that no later step reads."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def free_memory() -> None:
    """Gives memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task that frees its memory at its end: Python workers live on beside the tasks of later stages."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return go


def row_key(id_: Column, text: Column) -> Column:
    """The id; of a row without one a hash of its text, from 2**62 up, so after usual ids. Equal texts without an id share it."""
    return F.coalesce(id_.cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit("no id"), F.coalesce(text, F.lit(""))), 2))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about ``most`` bytes together."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, dtype=np.uint64)
    out[0:1] = 1
    b = np.uint64(base)
    have = 1
    while have < n:
        more = min(have, n - have)
        step = out[have - 1 : have] * b
        out[have : have + more] = out[:more] * step
        have += more
    return out


def running_total(df: DataFrame, order: list[str], value: str, out: str, by: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order`` (within ``by``, which then leads the order).

    Two passes and no global window: the rows are dealt into ranges of the
    order and summed up there while they stream by, each range's totals are
    gathered (one row for each range and value of ``by``), and each row adds
    what stands before its range. A hot value of ``by`` is spread over as many
    ranges as it needs, as the rest of ``order`` tells its rows apart.
    ``value`` must be a long without nulls.
    """
    spark = df.sparkSession
    cols = [F.col(k).asc_nulls_first() for k in ([by] if by else []) + order]
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(v) == 0:
                continue
            start = np.zeros(len(v), dtype=bool)
            if by:
                keys = pa.compute.dictionary_encode(b.column(by), null_encoding="encode")
                codes = keys.indices.to_numpy(zero_copy_only=False)
                start[1:] = codes[1:] != codes[:-1]
                first = b.column(by)[0].as_py()
                start[0] = (first,) != last
                last = (b.column(by)[len(v) - 1].as_py(),)
            sums = np.cumsum(v) - v
            at = np.maximum.accumulate(np.where(start, np.arange(len(v)), -1))
            local = sums - np.where(at >= 0, sums[at], -total)
            total = int(local[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "_local"])

    ranged = materialize(ranged.mapInArrow(add, schema), "ranges")
    key = F.col(by) if by else F.lit(0)
    totals = ranged.groupBy(F.col("_part").alias("_p"), key.alias("_k")).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # ranges + groups rows; written, so that the join below knows its size
    before = materialize(totals.select("_p", "_k", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before")), "before")
    on = (F.col("_part") == F.col("_p")) & key.eqNullSafe(F.col("_k"))
    return ranged.join(before, on).withColumn(out, F.col("_before") + F.col("_local")).drop("_p", "_k", "_part", "_local", "_before")
