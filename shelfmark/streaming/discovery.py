"""Incremental discovery and embedding: micro-batches that can be repeated without harm."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.catalog import changed_files, upsert, with_hints
from shelfmark.schema import conform
from shelfmark.sources import folders
from shelfmark.sources.buckets import Buckets
from shelfmark.sources.store import Store


def _stream(checkpoint: str) -> str:
    """Names a stream in what it writes: batches are numbered anew with every checkpoint location."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def discover_stream(files: DataFrame, store: Store | Buckets, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of (path, mtime, size) into the samples; stops when what is there has been taken.

    A path that comes twice in a batch counts with its latest mtime. In ``Buckets`` a batch rewrites the buckets of
    files that are new, changed or back, and a repeated batch changes nothing; a ``Store``, for small catalogs, writes
    a new version of the whole table, and a repeated batch another one like it.
    """
    name = _stream(checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("path").agg(F.max_by(F.struct("mtime", "size"), "mtime").alias("f")).select("path", "f.mtime", "f.size")
        hinted = lambda found: with_hints(found).select("path", "mtime", "size", "path_instrument")
        if isinstance(store, Buckets):
            store.merge(hinted(changed_files(latest, store.read(), trust_known=False)), upsert, name, number)
        else:
            store.write("samples", upsert(store.read("samples"), hinted(latest)))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What an embedding job leaves of each file: its vector, or why it has none.
OUTCOME = "path string, model string, vec array<float>, ok boolean, error string"


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """The rows (``OUTCOME``) of all batches below ``out`` that were written to their end."""
    done = folders.finished(spark, out)
    return spark.read.schema(OUTCOME).parquet(*done) if done else spark.createDataFrame([], OUTCOME)


def embedded(spark: SparkSession, out: str) -> DataFrame:
    """The features among the outcomes, in the table's schema."""
    return conform(outcomes(spark, out).where("ok"), "features")


def embed_stream(files: DataFrame, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, retry: bool = False) -> StreamingQuery:
    """Embeds a stream of files (path, …) batch by batch; ``embed`` gives ``OUTCOME`` rows, a failure with its error.

    Each batch is a folder of its own below ``out``, named by stream and number: a batch that is repeated after a crash
    replaces what it had begun, and readers see finished folders only. Files that an earlier batch has done, of this or
    of another stream, aren't embedded again (``retry``: only those it has embedded), so a path counts once whatever the
    restarts. Size batches at the source, by ``maxFilesPerTrigger``.
    """
    spark, name = files.sparkSession, _stream(checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        target = f"{out}/{name}-{number:09d}"
        earlier = [d for d in folders.finished(spark, out) if d != target]
        fresh = rows.dropDuplicates(["path"])
        if earlier:
            before = spark.read.schema(OUTCOME).parquet(*earlier)
            fresh = fresh.join((before.where("ok") if retry else before).select("path"), "path", "left_anti")
        result = embed(fresh)
        have = {*result.columns}
        kinds = [c.split(" ", 1) for c in OUTCOME.split(", ")]
        default = {"ok": F.col("vec").isNotNull()}
        result.select(*((F.col(c) if c in have else default.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds)).write.mode("overwrite").parquet(target)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts of ``events`` (ts, event_type) by window and type, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
