"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, wherever the driver runs from.

    Batches to them are of 1000 rows where nothing else is set: 10,000 texts at once, twice
    an executor and on both sides, are more than a small one has beside its heap.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if getattr(context, "_claimlens_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="claimlens-src-")) / "claimlens_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    p = Path(top) / n
                    z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    context._claimlens_shipped = True


def local_session(cpus: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings that the plans here expect: UTC, adaptive execution, few partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
