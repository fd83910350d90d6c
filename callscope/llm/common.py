"""Shared plumbing of the training-data operators: tables, shared folder, batches."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the session runs in one process a temporary folder of our own is used; a cluster
    without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="callscope-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _inside:
        _inside[-1].append(path)
    return path


#: Paths made inside each open ``discarding``.
_inside: list[list[str]] = []


@contextlib.contextmanager
def discarding(spark: SparkSession):
    """Tables materialised inside are deleted at the end, but those passed to the function that it gives.

    For steps whose result is written: nothing reads the others again, also not after a
    loss of executors. The shuffle files of those tables go with them, once the driver's
    garbage is collected.
    """
    _inside.append([])
    held = set()
    try:
        yield lambda df: held.add(df.path_of_table) or df
    finally:
        for path in _inside.pop():
            if path in held:
                if _inside:
                    _inside[-1].append(path)
            else:
                _delete(spark, path)
        _collect_garbage(spark)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _collect_garbage(spark: SparkSession) -> None:
    """Shuffle files stay until the driver collects what stands for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(table_read: DataFrame) -> None:
    """Delete a materialised table that nothing reads again."""
    _delete(table_read.sparkSession, table_read.path_of_table)
    _collect_garbage(table_read.sparkSession)


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what came before,
    and several readers share one evaluation.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    table_read = df.sparkSession.read.schema(df.schema).parquet(path)
    table_read.path_of_table = path
    return table_read


#: Bytes of an Arrow batch, so that a worker's memory does not hang on how long the texts are.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends them to Python in batches of at most ``BATCH_BYTES`` (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def bit_table(values: DataFrame, column: str, bits: int) -> bytes:
    """A bit for each value of a long column, modulo ``bits`` (bit i is byte i // 8, i % 8); of that size whatever the rows."""
    # Spark numbers bitmap values from 1: value v is bit v - 1.
    place = F.pmod(column, F.lit(bits)) + 1
    parts = values.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(bits // 8)
    for row in parts:
        at = (row["bucket"] - 1) * len(row["bits"])
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


def text_or_empty(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def windows(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about ``chars`` characters each, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
