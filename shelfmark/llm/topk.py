"""Exact inner-product search in tiles.

Vectors are packed into blocks of rows, queries and candidates apart. Query blocks have a group, candidate blocks
a part; both sides are dealt by (group, part), so every block of queries meets every block of candidates once. A
tile's product is one matrix multiplication, from which each query keeps its best k. The lists of a query are
merged in a tree: first those of one task, then those of a part, then all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_ROWS, SHARD_ROWS, PARTS = 2048, 2048, 16
#: Blocks of candidates that a part beyond these has at least, on average.
PART_SHARDS = 4
#: Queries of a group; each block of candidates is dealt once to every group.
GROUP_ROWS = 1 << 17
_SELF = -(1 << 62)
_PACKED = "dim int, lot long, kind string, ids binary, cells binary"


def quantized(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty and has finite components only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, fine), F.lit(False))


def _packing(rows: int):
    """Blocks of at most ``rows`` rows of one dimension and lot, out of whatever a partition has; cells as narrow as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(key: tuple[int, int], ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            kind = next(t for t in ("<i2", "<i4", "<i8") if values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max)
            columns = zip((*key, kind, ids.astype("<i8").tobytes(), values.astype(kind).tobytes()), (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["dim", "lot", "kind", "ids", "cells"])

        for batch in batches:
            ids, cells, lots = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            flat, sizes = cells.flatten().to_numpy(), cells.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim, lot in sorted({*zip(sizes.tolist(), lots.tolist(), strict=True)}):
                some = np.flatnonzero((sizes == dim) & (lots == lot))
                held = waiting.setdefault((dim, lot), [])
                held.append((ids[some], flat[starts[some][:, None] + np.arange(dim)]))
                if sum(len(x) for x, _ in held) >= rows:
                    all_ids, all_cells = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    whole = len(all_ids) // rows * rows
                    for k in range(0, whole, rows):
                        yield block((dim, lot), all_ids[k : k + rows], all_cells[k : k + rows])
                    waiting[dim, lot] = [(all_ids[whole:], all_cells[whole:])] if whole < len(all_ids) else []
        for key, held in waiting.items():
            if held:
                yield block(key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``scores``, the columns of its k best, ties to the smaller id. ``ids`` ascend."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for row in range(len(scores)):
        at = np.flatnonzero(scores[row] >= least[row])  # the best and all ties with the last of them
        out[row] = at[np.argsort(-scores[row, at], kind="stable")[:k]]
    return out


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def found() -> pa.RecordBatch:
            rows = [(q, part, [x[1] for x in each], [-x[0] for x in each]) for (part, q), each in top.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "part", "vec_ids", "scores"])

        for batch in batches:
            for at in range(len(batch)):  # one tile of the batch at a time
                dim, part, q_kind, q_ids, q_cells, kind, ids, cells = (c[at].as_py() for c in batch.columns)
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                q, c = np.frombuffer(q_cells, q_kind).reshape(-1, dim), np.frombuffer(cells, kind).reshape(-1, dim)
                order = np.argsort(ids, kind="stable")
                ids, c = ids[order], c[order]
                most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * dim
                exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object  # of these sums
                products = q.astype(exact) @ c.astype(exact).T
                if exact is object and products.size and max(abs(products.min()), abs(products.max())) >= -_SELF:
                    raise OverflowError("an inner product is too large for a score")
                scores = products.astype(np.int64)
                for row, (a, b) in enumerate(zip(np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right"), strict=True)):
                    scores[row, a:b] = _SELF
                columns = best(scores, ids, k)
                for row, query in enumerate(q_ids.tolist()):
                    top_at = columns[row]
                    new = [(-s, i) for s, i in zip(scores[row, top_at].tolist(), ids[top_at].tolist(), strict=True) if s != _SELF]
                    top[part, query] = sorted([*top.get((part, query), []), *new])[:k]
                if len(top) > 100_000:
                    yield found()
                    top.clear()
        yield found()

    return run


def _merged(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of the lists that share ``by``; each list is short."""
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("vec_ids").alias("v"))
    best_first = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k)
    return lists.groupBy(*by).agg(best_first.alias("top")).select(*by, F.transform("top", lambda x: x["v"]).alias("vec_ids"), F.transform("top", lambda x: -x["s"]).alias("scores"))


def search(queries: DataFrame, shards: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k candidates of largest integer inner product.

    Both frames have ``id`` long and ``cells`` array<long>. Ties go to the smaller id; candidates with the query's
    own id are left out. Only vectors of the same number of components are compared. Null ids, and null or empty
    cells, take no part; a query without candidates has no rows. Queries that repeat an id ask once; candidates
    that repeat an id are candidates each. A product of 2^62 or more raises. No frame is collected or broadcast.
    """
    sane = lambda df: df.where("id IS NOT NULL AND size(cells) > 0")
    asked = sane(queries).select("id", "cells").dropDuplicates(["id"])
    groups = max(1, -(-asked.count() // GROUP_ROWS))
    most = -(-sane(shards).count() // (PART_SHARDS * SHARD_ROWS))  # queries are copied once a part
    parts = max(PARTS, min(most, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(groups))).repartition(groups, "lot").mapInArrow(_packing(QUERY_ROWS), _PACKED)
    held = sane(shards).select("id", "cells", F.lit(0).cast("long").alias("lot")).mapInArrow(_packing(SHARD_ROWS), _PACKED)
    asked = asked.select("dim", F.col("lot").alias("group"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    held = held.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).select("dim", "part", "kind", "ids", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    # Sizes are guessed from the rows before they are copied, so without the hint Spark may broadcast all copies of the queries.
    tiles = asked.hint("merge").join(held.hint("merge"), ["dim", "group", "part"]).select("dim", F.col("part").cast("long").alias("part"), "q_kind", "q_ids", "q_cells", "kind", "ids", "cells")
    lists = tiles.mapInArrow(_tiles(k), "query_id long, part long, vec_ids array<long>, scores array<long>")
    top = _merged(_merged(lists, k, "query_id", "part"), k, "query_id")
    each = top.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The search over ``embeddings`` (vec_id, embedding): rows whose vec_id is divisible by ``every`` ask all others."""
    cells = embeddings.where(usable("embedding")).select(F.col("vec_id").alias("id"), quantized("embedding", scale).alias("cells"))
    return search(cells.where(F.col("id") % every == 0), cells, k)
