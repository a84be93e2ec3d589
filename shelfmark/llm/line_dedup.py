"""Lines that several documents share, found by a range-partitioned sort of line hashes.

Each document sends one row for each distinct long line: a 128-bit hash, its id and the line's positions.
Rows are dealt by ranges of (hash, id), so a line found everywhere spreads over many partitions, and sorted
so that the first row of a line is its keeper. A partition streams its rows; only the lines that cross its
ends need the neighbours' counts, of which there are two for each partition.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.llm.worker import vacate
from shelfmark.sources.tables import checkpointed

_SPACE = b" \t\n\r\x0b\x0c"
_ROWS = "h1 long, h2 long, doc_id long, text_id long, n_lines int, at array<int>"
_DROPPED = "doc_id long, text_id long, n_lines int, at array<int>"


def _key(line: bytes, least: int) -> bytes | None:
    """A line as it is compared, or None if it has fewer than ``least`` code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, at = text.encode().split(b"\n"), defaultdict(list)
                for k, line in enumerate(lines):
                    if (key := _key(line, least)) is not None:
                        at[xxhash.xxh3_128_digest(key)].append(k)
                for digest, where in at.items():
                    for column, value in zip(out, (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), doc, text_id, len(lines), where), strict=True):
                        column.append(value)
            types = (pa.int64(),) * 4 + (pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["h1", "h2", "doc_id", "text_id", "n_lines", "at"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of its first and of its last line a partition has, and the largest id."""
    runs: list[list] = []  # h1, h2, documents, largest, last
    for h1, h2, doc in _rows(batches):
        if not runs or runs[-1][:2] != [h1, h2]:
            runs = [*runs[:1], [h1, h2, 0, doc, None]]
        if runs[-1][4] != doc:
            runs[-1][2] += 1
            runs[-1][4] = doc
    columns = list(zip(*runs, strict=True))[:4] or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "docs", "largest"])


def _dropping(shared: dict[tuple[int, int], tuple[int, int]], at_least: int):
    """Positions of lines to drop. Until a line's ``at_least``-th document comes, the rows before are held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, docs, held, out = None, None, 0, [], []

        def batch():
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text_id", "n_lines", "at"])

        for h1, h2, doc, *rest in _rows(batches):
            if key != (h1, h2):
                key, last, docs, held = (h1, h2), None, 0, []
            if last != doc:
                last, docs = doc, docs + 1
            row = (doc, *rest)
            if key in shared:
                total, largest = shared[key]
                if total >= at_least and doc != largest:
                    out.append(row)
            elif docs >= at_least:
                out += [*held, row]
                held = []
            elif docs > 1:
                held.append(row)
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    return run


@arrow_udf(T.BinaryType())
def _bitmap(n_lines: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for n, lists in zip(n_lines.to_pylist(), dropped.to_pylist(), strict=True):
        bits = np.ones(n, bool)
        for at in lists:
            bits[at] = False
        out.append(zlib.compress(np.packbits(bits).tobytes()))
    return pa.array(out, pa.binary())


@arrow_udf(T.StructType().add("kept", "string").add("n_lines", "long").add("n_dropped", "long"))
def _applied(texts: pa.Array, keep: pa.Array) -> pa.Array:
    vacate()
    kept, lines, dropped = [], [], []
    for text, packed in zip(texts.to_pylist(), keep.to_pylist(), strict=True):
        parts = (text or "").split("\n")
        lines.append(len(parts))
        if packed is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(parts)).astype(bool).tolist()
            parts = [x for x, stays in zip(parts, bits, strict=True) if stays]
        kept.append("\n".join(parts))
        dropped.append(lines[-1] - len(parts))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["kept", "n_lines", "n_dropped"])


def keep_bitmaps(docs: DataFrame, least: int = 20, at_least: int = 3) -> DataFrame:
    """doc_id, text_id, ``keep`` binary: one row for each document that loses lines.

    ``docs`` has doc_id and text. A line, stripped of ASCII white space and with A-Z in lower case, that has
    ``least`` code points or more and is found in ``at_least`` documents or more, is lost by all of them but the
    one with the largest doc_id. ``keep`` is a zlib-compressed bit for each line, the first in the highest bit.
    text_id is xxhash64 of the text: rows that repeat a doc_id with another text have their own bitmaps but count
    as one document. Rows with a null id or text lose nothing and don't count. Empty tables give an empty result.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    dealt = texts.mapInArrow(_hashed(least), _ROWS).repartitionByRange("h1", "h2", F.desc("doc_id"))
    rows = checkpointed(dealt.sortWithinPartitions("h1", "h2", F.desc("doc_id")))
    ends = rows.select("h1", "h2", "doc_id").mapInArrow(_ends, "h1 long, h2 long, docs long, largest long")
    crossing = ends.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    shared = {(r.h1, r.h2): (r.docs, r.largest) for r in crossing.collect()}  # one row at most for each pair of partitions
    dropped = rows.mapInArrow(_dropping(shared, at_least), _DROPPED)
    by_doc = dropped.groupBy("doc_id", "text_id").agg(F.first("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))
    return by_doc.select("doc_id", "text_id", _bitmap("n_lines", "at").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` struct<kept, n_lines, n_dropped>: each text without the lines its bitmap clears.

    A null text counts as one empty line. Repeated rows and extra columns stay as they are.
    """
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"), F.col("keep").alias("__keep"))
    joined = docs.join(marks, (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__text")), "left")
    return joined.withColumn("kept", _applied(docs["text"], F.col("__keep"))).drop("__doc", "__text", "__keep")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    docs = docs.select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.kept", 256).alias("kept_sha256"))
