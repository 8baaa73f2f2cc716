"""What the operators of this subpackage share: tables in the shared folder, byte views of Arrow columns, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
TEXTS = 1000  # rows to an Arrow batch
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, local mode), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sparrowgrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors. Not
    compressed: the compressors' buffers lie outside the heap and are only freed when the heap is collected, which many
    small tables put off."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "none").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._stash_path = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to; what is written there is deleted when the program ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def unstash(df: DataFrame) -> None:
    """Deletes a table that stash() wrote, once what followed from it has been written itself."""
    path = getattr(df, "_stash_path", None)
    if path:
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            fs, p = _path(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Many small queries leave broadcasts, plans and buffers outside the heap, which
    are only given back when the heap is collected; a heap that is not full puts that off."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession) -> None:
    """Texts may be long: where the session has Spark's own limit of rows to an Arrow batch, it is lowered to TEXTS, which
    bounds the buffers on both sides of a Python worker. A limit that the user has set stays."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(limit) == "10000":
        spark.conf.set(limit, str(TEXTS))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; idle workers stay beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is another
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes in `column`; a longer row comes alone."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(n) // limit
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(at, at[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row begins (one more entry than rows). Null: empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on an array of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node of the component.

    Alternates large-star and small-star steps; each is one aggregation over the edges, and a hot node's
    neighbours stay rows throughout. Rounds are logarithmic in the size of a component; they end once each node has one
    smaller neighbour that has none itself."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(low, "u")
        if large:
            out = j.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).union(j.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    e = stash(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), name)

    def done(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("x"), F.lit(2).alias("role"), (F.col("a") < F.col("b")).alias("up")).union(e.select(F.col("b"), F.lit(0), F.lit(False)))
        per = ends.groupBy("x").agg(F.sum("role").alias("lower"), F.min("role").alias("least"), F.max("up").alias("up"))
        return per.filter("lower > 2 OR (lower = 2 AND least = 0) OR up").isEmpty()

    while not done(e):
        nxt = stash(star(star(e, True), False), name)
        unstash(e)
        e = nxt
        settle(e.sparkSession)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
