"""Session settings, and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent

#: What every query of the engine relies on; none of it depends on the data's size.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("logloom")
    settings = RUNTIME | {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else os.cpu_count()),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options and make this package importable on all executors, once per application."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(app)
    return spark


def _archive() -> str:
    """The package as a zip on the driver's disk; Spark's file server hands it to the executors."""
    target = Path(tempfile.mkdtemp(prefix="logloom-ship-")) / "logloom_ship.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*")):
            if path.suffix in (".py", ".yaml"):
                z.write(path, path.relative_to(PACKAGE.parent))
    return str(target)
