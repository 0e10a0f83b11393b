"""Small files beside a table: its log. Works on whatever file system Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI. Names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def local_path(self) -> str:
        """The path alone, without the file system's name."""
        return self._fs.makeQualified(self._path("")).toUri().getPath()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Entries of a folder; none if it does not exist."""
        return sorted(s.getPath().getName() for s in self._statuses(name))

    def folders(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._statuses(name) if s.isDirectory())

    def modified(self, name: str) -> float:
        """Seconds since 1970."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def _statuses(self, name: str) -> list:
        return list(self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file appear whole, or not at all if the name is taken. The text is written
        under a hidden name and renamed, which a distributed file system refuses to do onto a file."""
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(hidden), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = not self.exists(name) and self._fs.rename(self._path(hidden), self._path(name))
        if not done:
            self.delete(hidden)
        return done

    def move(self, name: str, path: str) -> None:
        """Move a file of this folder to a path of the same file system."""
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(name), target):
            raise OSError(f"{self.path}/{name} was not moved to {path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
