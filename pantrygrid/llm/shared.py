"""What the operators of this folder share: written tables, sized Arrow batches and byte kernels.

Bytes are handled a batch at a time with numpy: a text column arrives as one buffer with offsets, and every
kernel here works on that buffer, so that no Python loop runs over rows, words or bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch. Texts differ in length by four orders of magnitude.
BATCH_ROWS = 512
#: Bytes of text that a kernel handles at once.
SLICE_BYTES = 1 << 20

U = np.uint64
_GOLDEN = U(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run on one machine, the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends, its size is known, and a lost executor loses nothing.

    The table goes when the session ends.
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark).rstrip('/')}/pantrygrid/{uuid.uuid4().hex}"
    df.write.parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; null texts are empty."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows, in order, of at most limit bytes together (a longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit word for every byte value, and an odd base with its inverse, for rolling hashes modulo 2**64.
BYTE_WORD = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
BASE = U(0x5851F42D4C957F2D)
BASE_INVERSE = U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(name: str, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1); name is "up" for BASE and "down" for its inverse."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        base, m = (BASE if name == "up" else BASE_INVERSE), max(n, SLICE_BYTES + 4096)
        have = np.full(m, base, U)
        have[0] = U(1)
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of word(data[k]) * BASE ** k over i <= k < j."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_WORD[data] * powers("up", len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the spans [start, stop), the same for equal bytes wherever they lie."""
    return mix((prefix[stop] - prefix[start]) * powers("down", len(prefix))[start] + (stop - start).astype(U) * _GOLDEN)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def lower_ascii_column(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[] for _ in schema], schema.types)], schema=schema)
