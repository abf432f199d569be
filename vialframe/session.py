"""The session's shared folder, and the package for the Python workers, so that it need not be installed on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: hand the package's modules to the Python workers through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vialframe-")) / f"{root.name}-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)


def release_memory() -> None:
    """Give memory that was freed back to the system (where the C library can)."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        got = "file://" + tempfile.mkdtemp(prefix="vialframe-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


#: Rows of a task, where a query deals its rows out itself.
TASK_ROWS = 150_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` over as many tasks as ``rows`` ask for, so that a task's memory does not grow with the table.

    Spark puts small shuffled parts together by their packed bytes, until there are no more tasks than cores.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *by)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vialframe_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_vialframe_path", None)
    if path:
        remove(df.sparkSession, path)
