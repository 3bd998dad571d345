"""Sessions: a builder for local work, and shipping of this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC time, adaptive execution and zstd tables."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("talewright").config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = f"{tempfile.mkdtemp(prefix='talewright-')}/talewright_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"{ROOT.name}/{p.relative_to(ROOT)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
