"""What the operators of this subpackage share: table access, the shared work folder, Arrow batch helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafquery.ship import ship

#: Rows in an Arrow batch that goes to a Python worker. Texts may be very long, so batches stay short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; on a cluster, whose machines do not see each other's folders, it is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='leafquery-')}"
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, removed when the driver's Python ends."""
    at = f"{shared_dir(spark)}/leafquery-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, at)
    return at


def _remove(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended already; the folder then goes with the cluster's scratch space
        pass


def materialize(df: DataFrame, label: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. Survives a lost executor.

    done: materialized tables that nothing reads any more once df is written; their folders go at once."""
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    df.write.parquet(at)
    release(*done)
    out = spark.read.schema(df.schema).parquet(at)
    _folders[id(out)] = (out, at)
    return out


_folders: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Remove the folders of materialized tables that nothing reads any more."""
    for df in tables:
        if id(df) in _folders:
            _remove(df.sparkSession, _folders.pop(id(df))[1])


def short_batches(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches short, so that a batch of very long texts still fits into a Python worker."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; a null counts as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
