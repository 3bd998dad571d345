"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import shared_dir

#: ASCII white space, the word separators of the word-based operators.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one Arrow batch that are worked on at a time inside a Python worker.
SLICE_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str:
    """File-system path of a folder on a mounted share; other schemes need a mount of their own."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: archive files need a shared folder that is mounted as a file system")
    return uri


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one (see lineage.shared_dir); it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        if path.startswith(("file:", "/")):
            shutil.rmtree(local_path(path), ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)

    if path.startswith(("file:", "/")):
        atexit.register(drop)
    else:
        drop()  # at the end of the driver's JVM
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later passes don't repeat its
    work, and a lost executor costs nothing that was done before."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in low])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that the texts of each stay under `most` bytes (or are one row)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def with_arrow(df: DataFrame, column: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns `fields`, which work() makes of the text column, slice by slice.

    Columns of df with those names are replaced; all others stay as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = without(df, *[f.name for f in fields])
    source = "__text"
    while source in kept.columns:
        source += "_"
    kept_names = list(kept.columns)
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    into = df.select(*[quoted(c) for c in kept_names], text_of(column).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, source):
            k = part.schema.get_field_index(source)
            made = work(part.column(k))
            cols = [c for i, c in enumerate(part.columns) if i != k]
            new = [a.cast(arrow.field(len(cols) + i).type) for i, a in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=arrow.names)

    return into.mapInArrow(run, schema)


def row_key(*cols: Column) -> Column:
    """128 bits that stand for the given values: the first half of a SHA-256."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def env_int(name: str, default: int) -> int:
    return int(os.environ.get(name, default))
