"""Files as rows: listings, list caches, audio-like signals, logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.rules import extension

#: The extensions of the catalog's files.
EXTENSIONS = (".wav", ".mp3", ".aif", ".aiff", ".flac")


def gather(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime (epoch seconds), size of every file below ``root`` (or of the one file) with a known extension.

    Contents are pruned: only the listing is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    rows = found.select(plain.alias("path"), F.unix_micros("modificationTime").alias("us"), F.col("length").alias("size"))
    return rows.where(extension(F.col("path")).isin(*EXTENSIONS)).select("path", (F.col("us") / 1e6).alias("mtime"), "size")


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_bytes(path: str) -> bytes:
    """A file's content, of any file system that pyarrow knows, or of a mount that the executors share."""
    store, at = _opened(path)
    with store.open_input_stream(at) as f:
        return f.read()


def read_stat(path: str) -> tuple[float, int]:
    """A file's mtime (epoch seconds) and size."""
    store, at = _opened(path)
    found = store.get_file_info(at)
    if not found.is_file:
        raise FileNotFoundError(path)
    return found.mtime_ns / 1e9, found.size


def _tried(path: str, ways: list[Callable], attempts: int, pause: float) -> tuple[object, str | None]:
    error = "no way to read it"
    for way in ways:
        for turn in range(attempts):
            try:
                return way(path), None
            except Exception as failed:  # noqa: BLE001  a file that can't be read must not end the job
                error = f"{type(failed).__name__}: {failed}"
                if turn + 1 < attempts:
                    time.sleep(pause * 2**turn)
    return None, error


def fetch(paths: DataFrame, read: Callable[[str], bytes] = read_bytes, fallback: Callable[[str], bytes] | None = None, attempts: int = 2, pause: float = 0.1, batch_bytes: int = 64 << 20) -> DataFrame:
    """path, ok, error, content of every row of ``paths`` (path), read on the executors.

    ``read`` is tried ``attempts`` times, then ``fallback`` as often; what neither can read is a row with its error, and
    no other row is lost by it. Contents leave a task in batches of about ``batch_bytes``. A null path is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ok", "error", "content"]
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.binary()]
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                content, error = _tried(path, [w for w in (read, fallback) if w], attempts, pause)
                held.append((path, error is None, error, content))
                size += len(content or b"")
                if size >= batch_bytes or len(held) >= 10_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return paths.select("path").mapInArrow(run, "path string, ok boolean, error string, content binary")


def stat(paths: DataFrame, probe: Callable[[str], tuple[float, int]] = read_stat, attempts: int = 1) -> DataFrame:
    """path, mtime, size, ok, error of every row of ``paths`` (path): what can't be looked up is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *_tried(p, [probe], attempts, 0.1)) for p in batch.column(0).to_pylist()]
            mtimes, sizes = ([found and found[k] for _, found, _ in rows] for k in (0, 1))
            columns = ([p for p, _, _ in rows], mtimes, sizes, [e is None for _, _, e in rows], [e for _, _, e in rows])
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "mtime", "size", "ok", "error"])

    return paths.select("path").mapInArrow(run, "path string, mtime double, size long, ok boolean, error string")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A cached list of paths, one to a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def write_list(files: DataFrame, path: str, dry_run: bool = False) -> None:
    if not dry_run:
        files.select("path").write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (growing, with gaps) and line of a text file, in the order of the file's splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.rtrim("value").alias("line"))


def progress(lines: DataFrame) -> DataFrame:
    """One row done, total, rate, eta_min: the last line of a log that tells of progress. A line of a start resets it."""
    # The two lines of a log that tell of progress.
    start, step = r"(\d+) files to process on \d+ workers", r"(\d+)/(\d+)\s+([\d.]+)/s\s+eta\s+([\d.]+)m"
    group = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    state = F.when(F.col("line").rlike(step), F.struct(group(step, 1).cast("long").alias("done"), group(step, 2).cast("long").alias("total"), group(step, 3).cast("double").alias("rate"), group(step, 4).cast("double").alias("eta_min")))
    begun = F.struct(F.lit(0).cast("long").alias("done"), group(start, 1).cast("long").alias("total"), F.lit(0.0).alias("rate"), F.lit(None).cast("double").alias("eta_min"))
    marked = lines.withColumn("s", F.coalesce(state, F.when(F.col("line").rlike(start), begun))).where("s IS NOT NULL")
    last = marked.agg(F.max_by("s", "line_no").alias("s")).select("s.*")
    return last.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"), 1)))


def tail(lines: DataFrame, n: int = 12) -> DataFrame:
    """The last n lines that are not blank, oldest first."""
    return lines.where("trim(line) <> ''").orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
