"""A store of versioned tables: each write is a new Parquet folder, each read the newest complete one."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from shelfmark.schema import conform, schema


class Store:
    """Tables below ``root``, a path of any file system Spark knows. Readers see a whole version or the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and done(s.getPath()))

    def token(self, name: str) -> str:
        """Names the version that a read would see; it changes with every write."""
        return f"{name}@{max(self._versions(name), default=0)}"

    def read(self, name: str) -> DataFrame:
        """The newest version, in the declared schema whatever it was written with; empty if there is none."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema(name))
        return conform(self.spark.read.parquet(f"{self.root}/{name}/v={versions[-1]}"), name)

    def write(self, name: str, df: DataFrame, expected: str | None = None) -> str:
        """Writes the next version; refuses if ``expected`` isn't the token any more, or another writer came first.

        The rows go to a folder of their own, which is then renamed; a rename never replaces a version that exists.
        """
        before = self.token(name)
        if expected is not None and expected != before:
            raise ValueError(f"{name} has changed")
        version, made = int(before.rsplit("@", 1)[1]) + 1, f"{self.root}/{name}/.{uuid.uuid4().hex}"
        conform(df, name).write.parquet(made)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        source, target = hadoop.Path(made), hadoop.Path(f"{self.root}/{name}/v={version}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        never = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf).rename(source, target, never)
        except Py4JJavaError as failed:
            source.getFileSystem(conf).delete(source, True)
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            raise ValueError(f"{name} has changed") from failed
        return f"{name}@{version}"

    def vacuum(self, name: str, keep: int = 2, abandoned: float = 86_400) -> list[int]:
        """Removes all versions but the newest ``keep``, for readers still at work; returns the ones removed.

        Folders that a writer left behind, unfinished for ``abandoned`` seconds, go too.
        """
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        old = self._versions(name)[:-keep] if keep > 0 else []
        for version in old:
            path = hadoop.Path(f"{self.root}/{name}/v={version}")
            path.getFileSystem(conf).delete(path, True)
        table = hadoop.Path(f"{self.root}/{name}")
        fs = table.getFileSystem(conf)
        for s in fs.listStatus(table) if fs.exists(table) else []:
            if s.getPath().getName().startswith(".") and s.isDirectory() and time.time() - s.getModificationTime() / 1000 >= abandoned:
                fs.delete(s.getPath(), True)
        return old
