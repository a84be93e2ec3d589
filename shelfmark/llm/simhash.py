"""Near-copies by SimHash fingerprints and multi-index hashing.

Fingerprints within 4 bits agree, in one of the segments they are cut into, up to that segment's radius, if
the radii plus one sum to more than 4. Every distinct fingerprint is put in a table by each segment's value;
probes enumerate the values within the segment's radius, and each match's whole distance is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.llm.components import components
from shelfmark.llm.worker import vacate
from shelfmark.sources.tables import checkpointed

#: (first bit, bits, radius) by the number of distinct fingerprints; each layout finds every pair within 4 bits.
LAYOUTS = {1 << 23: ((0, 21, 1), (21, 21, 1), (42, 22, 0)), 1 << 62: ((0, 33, 2), (33, 31, 1))}
_BLOCK = 1 << 15


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the hashes of all ``width``-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, hashed = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    lasts = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        block = np.array([hashed(line[a:b], seed) for a, b in zip(starts[k : min(n, k + _BLOCK)].tolist(), lasts[k : k + _BLOCK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    vacate()
    found = [fingerprint((t or "").encode()) for t in texts.to_pylist()]
    return pa.array(np.array(found, "<u8").view("<i8"))


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """a, b: the ids (``id`` long) of distinct fingerprints (``print`` long) at ``most`` (4) or fewer differing bits."""
    if most != 4:
        raise ValueError("the segments are laid out for 4 bits")
    n = prints.count()
    layout = next(x for size, x in LAYOUTS.items() if n < size)
    tables, probes = [], []
    for k, (first, bits, radius) in enumerate(layout):
        value = F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        masks = [0] + [1 << i for i in range(bits) if radius] + [1 << i | 1 << j for i in range(bits) for j in range(i) if radius > 1]
        tables.append(F.struct(F.lit(k).alias("segment"), value.alias("value")))
        probes += [F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(F.lit(m).cast("long")).alias("value")) for m in masks]
    held = prints.select("id", "print", F.explode(F.array(*tables)).alias("at")).select(F.col("id").alias("a"), F.col("print").alias("pa"), "at.segment", "at.value")
    asked = prints.select("id", "print", F.explode(F.array(*probes)).alias("at")).select(F.col("id").alias("b"), F.col("print").alias("pb"), "at.segment", "at.value")
    near = held.join(asked, ["segment", "value"]).where((F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= most) & (F.col("a") < F.col("b")))
    return near.select("a", "b").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, print long, component_id long: each document with the smallest doc_id that links of 4 bits reach.

    A null or empty text, or one of white space only, has fingerprint zero and is linked like any other. Equal
    fingerprints are one node, so exact copies add no links. Rows with a null doc_id get their node's class but
    never name one. Repeated rows are repeated in the result; an empty table gives an empty one.
    """
    prints = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("print")))
    nodes = checkpointed(prints.groupBy("print").agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes.where("id IS NOT NULL"))).select(F.col("node").alias("id"), "component")
    named = nodes.join(roots, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
