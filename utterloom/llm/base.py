"""What the corpus operators share: tables, the shared folder, lineage cuts, null-safe text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that str.split and bytes.split treat alike and that bounds a word.
MASK64 = (1 << 64) - 1
ROW_GROUP = 8 << 20  # bytes
#: Spark's setting that shuffle files go with the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only a session without that setting whose driver is its only executor (tests) gets a
    temporary folder, the same for every caller; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="utterloom-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as soon as each is done."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: computed once, survives lost executors; free() deletes it.

    The table is compressed, in row groups small enough to be read by tasks of their own,
    and the write's shuffle files go as soon as it is done.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "cut")
    with shuffles_freed(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete the tables of cut() that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._written)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver forget frames that are gone, so that Spark deletes their shuffle files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete path through its own file system; a stopped session leaves it to the cluster."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put(spark: SparkSession, path: str, data) -> None:
    """Write bytes, which may be a mapped file's, to the shared folder through its own file system, a few MB at a time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 4 << 20):
            out.write(bytearray(data[i : i + (4 << 20)]))
    finally:
        out.close()


def constant(spark: SparkSession, rows: list[tuple], schema: str, bound: int = 20_000) -> DataFrame:
    """A plan's rows, made on the driver, as a table; with a broadcast hint up to bound rows, else the join decides."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= bound else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession) -> None:
    """Batches small enough for tables of long texts, in readers and on the way to Python; the session keeps these settings, since results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def trim() -> None:
    """Give the memory that a worker has freed back to the system; at the end of a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about chars characters each; a longer text is alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > chars:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of long, double, boolean, string, binary, int and arrays of long."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as a record batch."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
