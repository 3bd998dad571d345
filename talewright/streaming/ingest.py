"""Continuous import: new files of a folder are classified against the archive, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..archive import Archive
from ..sources import ingest


def stream(spark: SparkSession, folder: str, archive: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Import files that appear in `folder` into an archive: events, observations, conflicts and accounts, a run for each batch.

    A batch that is repeated after a failure adds nothing: its run is published as a whole or not at all, and published runs are passed over.
    """

    def batch(files: DataFrame, number: int) -> None:
        own, run = Archive(spark, archive), f"batch-{number:09d}"
        if run not in own.runs():
            own.take(ingest.drafts(files), run=run)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
