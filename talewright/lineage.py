"""Cutting of lineage: a frame is written to the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session in one process gets a temporary folder; a cluster's is told to name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if where is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own[sc.applicationId] = tempfile.mkdtemp(prefix="talewright-cut-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: plans that use it several times stay small, and a lost executor costs nothing
    that was done before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: tuple, build: Callable[[str], object]) -> object:
    """What build(folder) makes in a folder of the shared one, made once for an application and key."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _kept:
        _kept[own] = build(f"{shared_dir(spark)}/{key[0]}-{uuid.uuid4().hex}")
    return _kept[own]
