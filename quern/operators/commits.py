"""A log of numbered commits in a folder: a commit fails where its number is taken."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first; read again and repeat the change."""


class CommitLog:
    """Files ``<number>.json`` below ``path``, each made once.

    ``create`` without overwriting is atomic on HDFS; stores without such a
    call need a committer that has one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:012d}.json")

    def numbers(self) -> list[int]:
        root, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs()[1].open(self._file(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> None:
        """Raises ``Conflict`` if ``number`` is taken."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs()[1].create(self._file(number), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.path}: {number} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
