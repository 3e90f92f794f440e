"""What the operators of this package share: reading, staging, bounded Arrow batches, words as arrays."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the contracts take as white space: blank, and tab to carriage return.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same class as a Java regular expression.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
#: UTF-8 bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 2 << 20

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True

#: What is staged within alone().
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table named `table` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, if unset, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="capstride-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def stage(df: DataFrame, name: str = "stage", codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: this cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    if (made := _MADE.get()) is not None:
        made.append(back)
    return back


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of staged tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        if df is not None and "_staged_at" in df.__dict__:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_staged_at"])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def alone(make: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """Stage what make() gives, and remove all else that was staged for it."""
    token = _MADE.set(made := [])
    try:
        out = stage(make(), name)
        made.pop()
    finally:
        _MADE.reset(token)
        discard(*made)
    if (outer := _MADE.get()) is not None:
        outer.append(out)
    free(out.sparkSession)
    return out


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of staged tables now, not when the driver happens to collect its garbage."""
    # Python lets go of plans a moment before the JVM may
    for pause in (0.2, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have `limit` bytes or are one row."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i in range(n):
        if total and total + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null counts as empty) and n + 1 offsets into them."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    if col.offset or not len(col):
        col = pa.concat_arrays([col, pa.array([], pa.large_binary())])
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    begins = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return begins, ends, np.searchsorted(begins, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that sums of products become evenly spread hashes."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _rng_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)


_BYTE = _rng_table(11, 256)
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, _U))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.full(1 << int(n - 1).bit_length(), 0x9E3779B97F4A7C15, _U))
    return _POWER


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span (at least one byte each); `fold` lower-cases A-Z first."""
    if not len(begins):
        return np.zeros(0, _U)
    size = ends - begins
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
    chars = raw[pos + np.repeat(begins, size)]
    if fold:
        chars = _FOLD[chars]
    return mix(np.add.reduceat(_BYTE[chars] * _powers(int(size.max()))[pos], at))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive words (as many as len(words) - k + 1, not below 0)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = np.zeros(n, _U)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def arrow_schema(ddl: str) -> tuple[str, pa.Schema]:
    """A flat DDL schema and the same for Arrow; needs no session, so that workers can import it."""
    fields = [x.split() for x in ddl.split(",")]
    return ddl, pa.schema([pa.field(name, _ARROW[kind]) for name, kind in fields])


def word_count(text) -> F.Column:
    """Number of words of a text column (null: 0), natively."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return (F.length(spaced) - F.length(F.translate(spaced, "x", ""))).cast("long")


def global_rank(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Number the rows of `df` from 0 in the order of `keys`, without gathering them in one task.

    Rows are range-partitioned and staged; only one count for each partition reaches the driver.
    """
    spark = df.sparkSession
    spark_part = f"__{name}_part"
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = stage(
        ranged.withColumn(f"__{name}_id", F.monotonically_increasing_id()).withColumn(spark_part, F.spark_partition_id()),
        name,
    )
    counts = dict(numbered.groupBy(spark_part).count().collect())
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    if not before:
        return numbered.drop(spark_part).withColumnRenamed(f"__{name}_id", name)
    starts = spark.createDataFrame(list(before.items()), f"{spark_part} int, __{name}_start long")
    low = F.col(f"__{name}_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(starts), spark_part)
        .withColumn(name, low + F.col(f"__{name}_start"))
        .drop(spark_part, f"__{name}_id", f"__{name}_start")
    )
