"""What the operators share: shipping the package, shared tables and packed rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words, as the body of a regex class.
SPACE = r"\x20\x09-\x0D"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern_package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, str(source.relative_to(package.parent)))
        context.addPyFile(str(target))
    context._quern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode where none is set."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        configured = context.getConf().get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quern-checkpoints-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Whole texts that go to a Python worker at a time.
TEXT_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps survive lost executors.
    arrow_rows: the rows that go to a Python worker at a time while df is made, where they hold whole
    texts; the session's own number is put back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(arrow_rows or before))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows. createDataFrame([]) is an RDD of Python's, whose workers are of another
    kind than those of queries and stay beside them."""
    return spark.range(0).select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in T.StructType.fromDDL(schema)))


def release() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, then release: a worker stays for later tasks and would keep the most
    that it has ever held, beside an executor's other workers."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    whole.__annotations__ = dict(run.__annotations__)
    return whole


def spare(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of an operator's own that df does not have, whatever its columns are called."""
    taken, found = {x.lower() for x in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


#: Bytes of texts that a Python worker turns into lists of its own at a time.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows whose strings have `most` bytes at most, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and total + size > most:
            yield start, k - start
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions_for(df: DataFrame, partition_bytes: int = 32 << 20) -> int:
    """The session's shuffle partitions, or more where the input asks for them."""
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, input_bytes(df) // partition_bytes)))
