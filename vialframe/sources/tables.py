"""Table sources and sinks: parquet tables, count-checked sync (SRC-14), schema widening (SRC-22), remembered picks (SRC-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import needs_sync
from .keyed import KeyedTable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-22: bring an older table to a schema: missing columns null, others cast; unknown columns go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def migrate(df: DataFrame, steps: dict[int, T.StructType], version: int = 0) -> tuple[DataFrame, int]:
    """SRC-22: an older table brought through the schemas of the later versions, in order, with the version it then has.

    Version 0 is a table of before there were versions. A column that a step does not name is handed on, never dropped.
    """
    for number in sorted(n for n in steps if n > version):
        schema = steps[number]
        df = conform(df, T.StructType([*schema.fields, *[f for f in df.schema.fields if f.name not in schema.names]]))
        version = number
    return df, version


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """SRC-22: a table with its version in its columns' place in the folder, so that a reader knows it before it reads."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_versioned(spark: SparkSession, path: str, steps: dict[int, T.StructType]) -> DataFrame:
    """SRC-22: the newest version of a table, brought up to date."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    newest = max((int(n.split("=", 1)[1]) for n in names if n.startswith("version=")), default=None)
    if newest is None:
        return migrate(spark.read.parquet(path), steps)[0]
    return migrate(spark.read.parquet(f"{path}/version={newest}"), steps, newest)[0]


def learned_picks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: the remembered picks (key, loinc_num, source, confidence); an absent table is an empty one.

    They are joined, not held: Spark sends the table to the executors only while it lies below its own size limit.
    """
    shape = "key string, loinc_num string, source string, confidence double"
    try:
        return spark.read.schema(shape).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], shape)


def resident(df: DataFrame) -> DataFrame:
    """SRC-12: a table that many searches read, kept by the executors (on their disks where memory ends)."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def sync(source: DataFrame, path: str, key: str = "loinc_num") -> bool:
    """SRC-14: rewrite the stored terminology if its counts of codes or aliases differ from the source's; was it rewritten?

    The stored copy is a keyed table, so readers have the old one until the new one is whole.
    """
    spark = source.sparkSession
    if has_files(spark, f"{path}/pointers"):
        table = KeyedTable.open(spark, path)
        if not needs_sync(source, table.read()).first()["rewrite"]:
            return False
        table.replace(source)
    else:
        KeyedTable.create(source, path, (key,))
    return True


def has_files(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_observations(rows: DataFrame, path: str) -> None:
    """SRC-16: append, one folder per extraction source so that scans can prune."""
    from ..operators.store import clipped

    clipped(rows).write.mode("append").partitionBy("extraction_source").parquet(path)
