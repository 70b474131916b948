"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.lru_cache(maxsize=8)
def _archive(application: str) -> str:
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="cellforge-"), "cellforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return path


@functools.lru_cache(maxsize=8)
def _shipped(application: str) -> set[str]:
    return set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a session, for those that don't have it installed."""
    context = spark.sparkContext
    done = _shipped(context.applicationId)
    if not done:
        context.addPyFile(_archive(context.applicationId))
        done.add("cellforge")
    return spark


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and benchmarks use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cellforge")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
