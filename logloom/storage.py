"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage, survives the loss of an executor, and lets the readers of it prune
columns and push filters down, which a checkpointed RDD does not. A table goes when its last reader is known to
have run (discard), and the rest with the process that wrote them, since results are read after a query has
returned.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is set only where none is (tests, one machine)."""
    folder = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logloom-shared-")
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


_written: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read any more. Other tables are left alone."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path and _written.pop(path, None) is not None:
            _remove(table.sparkSession, path)


@atexit.register
def _leave() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM has gone before us
            return


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a fresh folder of the shared space and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table
