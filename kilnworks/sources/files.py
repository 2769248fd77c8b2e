"""Files of any store that Spark reaches, by its own file system classes: listing, atomic publishing, copies."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Status:
    name: str
    folder: bool
    size: int
    mtime_ns: int


class Files:
    """Paths are strings; one without a scheme is in Spark's default file system. A failing store raises OSError."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def _try(self, f, *args):
        try:
            return f(*args)
        except Py4JJavaError as e:
            name = e.java_exception.getClass().getSimpleName()
            kind = {"FileNotFoundException": FileNotFoundError, "FileAlreadyExistsException": FileExistsError, "ParentNotDirectoryException": NotADirectoryError}.get(name, OSError)
            raise kind(f"{name}: {e.java_exception.getMessage()}") from None

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return bool(self._try(fs.exists, p))

    def mkdirs(self, path: str) -> None:
        p, fs = self._at(path)
        if not self._try(fs.mkdirs, p):
            raise OSError(f"no folder made: {path}")

    def list(self, path: str) -> list[Status]:
        """What lies in a folder, by name; checksum files are not listed."""
        p, fs = self._at(path)
        found = self._try(fs.listStatus, p)
        return sorted((Status(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime() * 10**6) for s in found), key=lambda s: s.name)

    def mtime_ns(self, path: str) -> int:
        p, fs = self._at(path)
        return self._try(fs.getFileStatus, p).getModificationTime() * 10**6

    def touch(self, path: str, ns: int) -> None:
        p, fs = self._at(path)
        self._try(fs.setTimes, p, ns // 10**6, -1)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = self._try(fs.open, p)
        try:
            return self._try(self.jvm.org.apache.commons.io.IOUtils.toString, stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, replace: bool = False) -> None:
        """Write a new file; FileExistsError if one is there."""
        p, fs = self._at(path)
        stream = self._try(fs.create, p, replace)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a file beside its place and move it there, over what was there."""
        staged = f"{path}.tmp-{uuid.uuid4().hex}"
        self.create(staged, text)
        self.rename(staged, path, replace=True)

    def rename(self, source: str, target: str, replace: bool = False) -> None:
        """Atomic where the store's rename is; FileExistsError if target is there, unless it is a file to be replaced."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        p, fs = self._at(source)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        self._try(context.rename, fs.makeQualified(p), fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(target)), options)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        self._try(fs.delete, p, True)

    def copy(self, source: str, target: str) -> None:
        """A file or folder, between stores if need be."""
        (p, here), (q, there) = self._at(source), self._at(target)
        if not self._try(self.jvm.org.apache.hadoop.fs.FileUtil.copy, here, p, there, q, False, self.conf):
            raise OSError(f"not copied: {source}")
