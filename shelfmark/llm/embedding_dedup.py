"""Near-copies among embeddings: spherical k-means cells, blocked cosine products within cells, groups by their links.

Equal vectors are one node with a count, so copies cost nothing. A node lives in the cell of its nearest centre and
visits the next nearest ones; a cell compares those that live there with each other and with its visitors, so a link
is found if either end visits the other's home. Cells are cut into tiles of bounded size. A tile counts the links of
its nodes, and passes on only as many links as connect what it found connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.topk import usable
from shelfmark.sources.tables import checkpointed

#: Cells that a node is compared in; rows of a tile's side; sampled nodes a cell; rounds; bounds of the centres, which are broadcast.
PROBES, TILE_ROWS, SAMPLE_EACH, ROUNDS, MOST_CELLS, CENTRE_BYTES = 4, 2048, 48, 6, 1 << 14, 32 << 20
_BLOCK = 4096


def _rows(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, dim)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim and vector (little-endian doubles, -0.0 as 0.0)."""
    for batch in batches:
        ids, lists = batch.columns
        ends = np.cumsum(np.asarray(lists.value_lengths()))
        cells = np.asarray(lists.flatten().cast(pa.float64())) + 0.0
        data, bounds = cells.astype("<f8").tobytes(), [0, *(8 * ends).tolist()]
        vectors = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        dims = np.diff([0, *ends]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims), pa.array(vectors, pa.binary())], ["vec_id", "dim", "vector"])


def units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _sums(shared):
    """For each cell, the sum of the unit vectors of the nodes that are nearest to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        total, seen = np.zeros(centres.shape), np.zeros(len(centres), bool)
        for batch in batches:
            for k in range(0, len(batch), _BLOCK):
                rows = units(_rows(batch.column(0)[k : k + _BLOCK], centres.shape[1]))
                cell = (rows @ centres.T).argmax(axis=1)
                np.add.at(total, cell, rows)
                seen[cell] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[c].tobytes() for c in at], pa.binary())], ["cell", "total"])

    return run


def _adding(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(t, "<f8") for t in table.column("total").to_pylist())
    norm = np.linalg.norm(total)
    centres = [(total / norm).tobytes()] if norm > 0 else []
    return pa.table({"cell": pa.array([key[0].as_py()] * len(centres), pa.int64()), "centre": pa.array(centres, pa.binary())})


def fit(nodes: DataFrame, dim: int, cells: int) -> np.ndarray:
    """``cells`` centres (fewer, if there are fewer nodes) of ``nodes`` (vector) of one dimension.

    The bound of the sample: about SAMPLE_EACH nodes a cell, those of smallest hash; the first centres are those of the
    very smallest. A round sums the sample by nearest centre in tasks and brings the centres to the driver, bounded by
    CENTRE_BYTES; a cell that loses all its nodes keeps its centre.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    cut = -(1 << 63) + int((1 << 64) * min(1.0, SAMPLE_EACH * cells / max(1, n))) - 1
    sample = checkpointed(nodes.select("vector", F.xxhash64("vector").alias("h")).where(F.col("h") <= F.lit(cut).cast("long")))
    first = sample.orderBy("h", "vector").limit(cells).collect()
    if not first:
        first = nodes.select("vector").orderBy("vector").limit(1).collect()
    centres = units(np.array([np.frombuffer(r.vector, "<f8") for r in first]))
    for _ in range(ROUNDS):
        found = sample.select("vector").mapInArrow(_sums(spark.sparkContext.broadcast(centres)), "cell long, total binary")
        for r in found.groupBy("cell").applyInArrow(_adding, "cell long, centre binary").collect():
            centres[r.cell] = np.frombuffer(r.centre, "<f8")
    return centres.astype(np.float32).astype(np.float64)


def _placing(shared, probes: int):
    """Adds to each node its cells, the nearest first; of another dimension than the centres', one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, centres = shared.value
        near = min(probes, len(centres))
        for batch in batches:
            dims = np.asarray(batch.column(1)).astype(np.int64)
            for alike, rows in ((True, np.flatnonzero(dims == dim)), (False, np.flatnonzero(dims != dim))):
                for k in range(0, len(rows), _BLOCK):
                    part = batch.take(pa.array(rows[k : k + _BLOCK]))
                    if alike:
                        products = units(_rows(part.column(3), dim)) @ centres.T
                        cells = np.argpartition(-products, near - 1, axis=1)[:, :near]
                        cells = np.take_along_axis(cells, np.argsort(-np.take_along_axis(products, cells, 1), axis=1, kind="stable"), 1)
                    else:
                        cells = -dims[rows[k : k + _BLOCK], None]
                    offsets = pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1)))], [*part.schema.names, "cells"])

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root[a] == root[b]).all():
            break
    return root


def _comparing(least: float):
    """A tile's links: per node their number, and per group of linked nodes a star around its smallest id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        cell, low, high = (table.column(c)[0].as_py() for c in ("cell", "low", "high"))
        slot, ids, copies = (np.asarray(table.column(c).combine_chunks()) for c in ("slot", "id", "copies"))
        cells = np.asarray(table.column("cells").combine_chunks().flatten()).reshape(len(ids), -1)
        home = cells[:, 0]
        vectors = table.column("vector").combine_chunks()
        rows = units(_rows(vectors, len(vectors[0].as_py()) // 8))
        lives = home == cell
        linked, ends = np.zeros(len(ids)), []
        at = lambda which, here: np.flatnonzero((slot == which) & (lives == here))
        if low == high:
            sides = [(at(low, True), at(low, True), True), (at(low, True), at(low, False), False)]
        else:
            sides = [(at(low, True), np.flatnonzero(slot == high), False), (at(low, False), at(high, True), False)]
        for left, right, same in sides:
            for k in range(0, len(left), _BLOCK):
                for j in range(0, len(right), _BLOCK):
                    x, y = np.nonzero(rows[left[k : k + _BLOCK]] @ rows[right[j : j + _BLOCK]].T >= least)
                    a, b = left[k + x], right[j + y]
                    if same:
                        a, b = a[a < b], b[a < b]
                    ends.append((a, b))
                    # a link whose ends visit each other's homes is found in both; it is counted in the lesser one
                    host, guest = np.where(lives[a], a, b), np.where(lives[a], b, a)
                    own = lives[guest] | (cell < home[guest]) | ~(cells[host] == home[guest][:, None]).any(axis=1)
                    for p, q in ((a[own], b[own]), (b[own], a[own])):
                        linked += np.bincount(p, copies[q], len(ids))
        a, b = (np.concatenate([e[k] for e in ends]) if ends else np.empty(0, np.int64) for k in (0, 1))
        root = forest(len(ids), a, b)
        child, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(linked)
        none = np.full(len(some), None)
        return pa.table({"a": pa.array(np.concatenate([ids[child], ids[some]])), "b": pa.array([*ids[root[child]].tolist(), *none], pa.int64()), "n": pa.array(np.concatenate([np.zeros(len(child), np.int64), linked[some].astype(np.int64)]))})

    return run


def found_links(nodes: DataFrame, least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """a, b, n of ``nodes`` (id, dim, copies, vector): links that connect all that are linked, where b isn't null, and
    numbers of vectors linked to a, to be added up, where it is.

    The dimension that most nodes have gets centres, about as many as the root of their number; nodes of another
    dimension are compared in one cell each dimension, as only vectors of one dimension link. A cell of more than
    TILE_ROWS rows is dealt as tiles of two slots each.
    """
    spark = nodes.sparkSession
    usual = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (usual.dim, usual.n) if usual else (1, 0)
    cells = max(1, min(MOST_CELLS, round(n**0.5), CENTRE_BYTES // (8 * dim)))
    centres = fit(nodes.where(F.col("dim") == dim), dim, cells) if n else np.ones((1, 1))
    placed = checkpointed(nodes.select("id", "dim", "copies", "vector").mapInArrow(_placing(spark.sparkContext.broadcast((dim, centres)), probes), "id long, dim int, copies long, vector binary, cells array<long>"))
    each = placed.select("*", F.explode("cells").alias("cell"))
    slots = F.broadcast(placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("slots")))  # a row a cell
    dealt = each.join(slots, "cell").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    tiles = dealt.select("cell", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "cells", "id", "copies", "vector")
    return tiles.groupBy("cell", "low", "high").applyInArrow(_comparing(least), "a long, b long, n long")


def groups(embeddings: DataFrame, least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding), whatever else it has.

    Vectors link at a cosine of ``least`` or more, in doubles; n_links counts other rows, copies too. A null id or
    vector, an empty one, one of zeros, and one with a null or non-finite component links with nothing; the component
    of such a row is its own id, and it is kept. Rows that repeat an id are vectors of their own. Only vectors of as
    many components are compared. Copies are always found; of other links, those whose ends lie in cells far from each
    other may be missed (tests measure the share found; it is 0.99 and more). No links give no components, and an empty
    table an empty result.
    """
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.col("vec_id").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = checkpointed(whole.where(sound).mapInArrow(_packing, "vec_id long, dim int, vector binary"))
    nodes = checkpointed(rows.groupBy("vector", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    # rows that repeat an id with another vector are nodes that share it: their links are one node's, their counts their own
    node = nodes.withColumn("node", F.monotonically_increasing_id())
    node = checkpointed(node)
    found = checkpointed(found_links(node.select(F.col("node").alias("id"), "dim", "copies", "vector"), least, probes))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = components(found.where("b IS NOT NULL").select("a", "b")).select("node", F.col("component").alias("root"))
    named = node.select("node", "vector", "id", "copies").join(counts, "node", "left").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = checkpointed(named)
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "root").select("vector", F.col("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.join(checkpointed(named), "vector").select("vec_id", "n_links", "component_id")
    alone = whole.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
