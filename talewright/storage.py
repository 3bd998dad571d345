"""Files and folders of an archive by way of Hadoop's file systems, so that it may lie on any shared one."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder and what the driver does with it: names only, never its data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, rel: str) -> str:
        return f"{self.path}/{rel}"

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self._path(self.at(rel)))

    def names(self, rel: str) -> list[str]:
        """Names in a folder below, sorted; none where it isn't there."""
        if not self.exists(rel):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(rel))))

    def drop(self, rel: str) -> None:
        self.fs.delete(self._path(self.at(rel)), True)

    def move(self, old: str, new: str) -> None:
        """Rename; the new name's folder is made, what stood there goes."""
        target = self._path(self.at(new))
        self.fs.mkdirs(target.getParent())
        self.fs.delete(target, True)
        if not self.fs.rename(self._path(self.at(old)), target):
            raise OSError(f"{self.at(old)} can't be renamed to {self.at(new)}")

    def write(self, rel: str, text: str) -> None:
        """A small file, whole or not at all."""
        part = f"{rel}.part"
        stream = self.fs.create(self._path(self.at(part)), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(part, rel)

    def read(self, rel: str) -> str:
        stream = self.fs.open(self._path(self.at(rel)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
