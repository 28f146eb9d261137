"""Files of a table through Hadoop's file systems, so any URI that Spark reads will do.

Commits need a store whose rename is atomic and never replaces (local disks, HDFS and stores with a hierarchical namespace); on
others, let one writer at a time commit.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kvspark.errors import IoFailure


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def is_folder(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getLen()

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a new file; False if there is one of this name already."""
        if self.exists(name):
            return False
        hidden = f"{name.rpartition('/')[0]}/.{name.rpartition('/')[2]}.{id(data)}.tmp".lstrip("/")
        stream = self.fs.create(self._path(hidden), True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        # a rename never replaces: of two writers one gets the name
        if not self.exists(name) and self.fs.rename(self._path(hidden), self._path(name)):
            return True
        self.fs.delete(self._path(hidden), False)
        return False

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise IoFailure(f"cannot move {name} to {to}")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)
