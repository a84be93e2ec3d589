"""A table in hash buckets of its key: a merge rewrites the buckets that its rows fall in, and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schema import TABLES, conform, schema
from shelfmark.sources import folders
from shelfmark.sources.tables import checkpointed


class Buckets:
    """The table ``name`` below ``root``, in ``count`` folders by the hash of ``key``; one writer at a time.

    A batch is merged in two steps. What its buckets become is written beside the table first; then these buckets are
    replaced (dynamic partition overwrite). A batch that is repeated after a crash between or within the steps takes up
    what is written and replaces the same buckets by the same rows; one that was merged to its end changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "samples", key: str = "path", count: int = 64):
        self.spark, self.root, self.name, self.key, self.count = spark, root.rstrip("/"), name, key, count
        self.path = f"{self.root}/{name}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table in its declared schema, or some of its buckets; only their folders are read."""
        if not folders.exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema(self.name))
        rows = self.spark.read.schema(f"{TABLES[self.name]}, bucket int").parquet(self.path)
        return conform(rows if buckets is None else rows.where(F.col("bucket").isin(buckets)), self.name)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "batch", batch: int | None = None) -> list[int]:
        """Replaces the buckets that ``rows`` (one row a key) fall in by ``combine(their rows, rows)``; returns them.

        ``combine`` may add and change rows, but not remove a bucket's last one. ``batch`` numbers grow within a
        ``stream``; without one, the merge can't be recognised when it is repeated.
        """
        work = f"{self.root}/.merges/{self.name}-{stream}"
        pending = f"{work}/pending-{'once' if batch is None else batch}"
        if batch is not None and any(int(n.removeprefix("done-")) >= batch for n in folders.names(self.spark, work) if n.startswith("done-")):
            return []
        if batch is None or not folders.exists(self.spark, f"{pending}/_SUCCESS"):
            dealt = checkpointed(rows.withColumn("bucket", self.bucket()))
            touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # ``count`` at most
            after = conform(combine(self.read(touched), dealt.drop("bucket")), self.name).withColumn("bucket", self.bucket())
            after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(pending)
        changed = sorted(int(n.removeprefix("bucket=")) for n in folders.names(self.spark, pending) if n.startswith("bucket="))
        if changed:
            ready = self.spark.read.schema(f"{TABLES[self.name]}, bucket int").parquet(pending)
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        if batch is not None:
            folders.mark(self.spark, f"{work}/done-{batch}")
            for old in folders.names(self.spark, work):
                if old.startswith("done-") and int(old.removeprefix("done-")) < batch:
                    folders.remove(self.spark, f"{work}/{old}")
        folders.remove(self.spark, pending)
        return changed
