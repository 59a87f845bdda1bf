"""Small files of the commit log through Hadoop's file system, so that any store Spark reaches will do. Driver only."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class LogFiles:
    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        # Each step of a dotted Java name is a call of its own, so names used again and again are looked up once.
        self.new_path, self.all_bytes = self.jvm.org.apache.hadoop.fs.Path, self.jvm.org.apache.commons.io.IOUtils.toByteArray
        self.path = self.new_path(folder)
        self.fs = self.path.getFileSystem(self.conf)
        self.fs.mkdirs(self.path)
        self.local = self.fs.makeQualified(self.path).toUri().getPath() if self.fs.getScheme() == "file" else None

    def _at(self, name: str):
        return self.new_path(self.path, name)

    def create(self, name: str, text: str) -> bool:
        """Writes a new file whole; False if the name is taken.

        Written aside under a hidden name, then moved by an operation that never overwrites. That move is the only commit
        point: a writer that dies before it leaves a file that nobody reads and that stands in nobody's way."""
        target = self._at(name)
        if self.fs.exists(target):
            return False
        aside = self._at(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            return self._moved(aside, target, self.local is not None)
        finally:
            self.fs.delete(aside, False)

    def _moved(self, source, target, local: bool) -> bool:
        if local:  # a hard link fails if the name is there
            try:
                os.link(*(f"{self.local}/{p.getName()}" for p in (source, target)))
            except FileExistsError:
                return False
            return True
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.NONE  # no overwriting
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(self.fs.makeQualified(source), self.fs.makeQualified(target), how)
        except Exception:
            if self.fs.exists(target):
                return False
            raise
        return True

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._at(name)))

    def names(self) -> list[str]:
        return sorted(n for s in self.fs.listStatus(self.path) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.all_bytes(stream)).decode()
        finally:
            stream.close()
