"""What the operators share: tables in the shared folder, size-checked broadcasts, batches of text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a side of a few small columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python worker handles at once (one document may be larger).
PIECE_BYTES = 2 << 20


#: Folders of our own, by application, where spark.checkpoint.dir is unset.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder. Where neither is
    set, a local session has a folder of its own; a cluster would lose files there, so that's an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, _own[app][7:], ignore_errors=True)
        root = _own[app]
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def digest(text: Column) -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def without_rows(docs: DataFrame, dropped: DataFrame, text: Column | None = None) -> DataFrame:
    """The rows of docs whose doc_id (null like any other) and digest of text aren't among those of dropped (two columns, any names)."""
    gone = dropped.toDF("__id", "__gone").distinct()
    own = docs.withColumn("__own", digest(F.col("text") if text is None else text))
    return own.join(small(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__gone")), "left_anti").drop("__own")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One that's a single file has few row groups, and so few tasks: its rows are dealt out to all cores."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df = spark.read.parquet(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return df.repartition(spark.sparkContext.defaultParallelism) if one else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """Slices of Arrow batches with some limit bytes of text at most (or one row)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.binary_length(col.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (null: empty) laid end to end, and the offsets of its rows in them."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
