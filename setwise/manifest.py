"""Versioned descriptions of what a folder holds, each published in one step.

A folder's versions are files named by consecutive numbers. A version is written
aside and then renamed to its number, which fails where that number is taken: of
two writers one wins, and a reader sees the version before or the one after, never
half of either.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Versions that stay for readers that still hold them.
KEEP = 10


class Manifest:
    """The versions in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> tuple[int, dict]:
        """(number, content) of the newest version; (0, {}) where there is none."""
        have = self.versions()
        if not have:
            return 0, {}
        jvm = self.spark.sparkContext._jvm
        stream = self.fs.open(self._path(f"{self.folder}/{have[-1]:012d}"))
        try:
            return have[-1], json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> bool:
        """Make content the version of that number; False where another writer was first."""
        jvm = self.spark.sparkContext._jvm
        self.fs.mkdirs(self._path(self.folder))
        aside = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        target = self._path(f"{self.folder}/{version:012d}")
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(aside, target, options)
        except Exception as e:  # noqa: BLE001 - py4j wraps the Java exception
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        for old in self.versions()[:-KEEP]:
            self.fs.delete(self._path(f"{self.folder}/{old:012d}"), False)
        return True

    def update(self, change: Callable[[dict], dict]) -> dict:
        """Publish change(content) of the newest version, again where another writer comes first."""
        while True:
            version, content = self.latest()
            new = change(json.loads(json.dumps(content)))
            if self.publish(version + 1, new):
                return new
