"""Neighbour graphs: nearest rows in cells or by random projections, and labels that travel along them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import StorageLevel
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from shelfmark.functions.vectors import norm
from shelfmark.sources.tables import checkpointed

#: Rows of a block, of which products are made; numbers of a side's vectors that a cell has at most, cells of a small table.
BLOCK_ROWS, CELL_NUMBERS, PARTS = 2048, 1 << 23, 16
#: Lots of a small table that is searched for pairs of its own rows; cells have two of them, so there are 21.
LOTS = 6
#: Pairs that are scored at once.
_PAIRS = 1 << 16


# -- cells of rows asked for and rows held


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds; numbers too large to have such digits stay."""
    scale = 10.0**digits
    return np.where(np.abs(x) < 1e15 / scale, np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale, x)


def _first_copies(vectors: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k + 1 smallest keys of each distinct vector: no other copy is among the k best of any row."""
    _, of = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.strides[0]}").ravel(), return_inverse=True)
    order = np.lexsort((codes, of))
    begins = np.diff(of[order], prepend=-1) != 0
    rank = np.cumsum(begins | (np.diff(codes[order], prepend=-1) != 0))
    starts = np.maximum.accumulate(np.where(begins, rank, 0))
    return np.sort(order[rank - starts <= k])


class _Cell:
    """The pairs of a cell's two sides, each side with its vectors, its keys' places among all keys of the cell and its places in tables.
    Where both sides are the same rows (``own``), a pair counts once: first the row that stands first."""

    def __init__(self, sides, k: int | None, least: float | None, digits: int, own: bool = False):
        (self.q, self.q_codes, self.q_places), (self.c, self.c_codes, self.c_places) = sides
        self.k, self.least, self.digits, self.own = k, -np.inf if least is None else least, digits, own
        sizes = [np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float)) for x in (self.q, self.c)]
        narrow = max(sizes[0].max(), sizes[1].max()) < 1e18
        self.kind, unit, floor = (np.float32, 2.0**-24, 1e-36) if narrow else (np.float64, 2.0**-53, 0.0)
        #: By how much a product of this kind and the rounding may be below a score.
        self.slack = 0.51 * 10.0**-digits + floor + (self.q.shape[1] + 8) * unit * sizes[0] * sizes[1].max()
        self.q_flat, self.c_flat = self.q.astype(self.kind, copy=False), self.c.astype(self.kind, copy=False)
        if k is not None:
            self.scores, self.codes = np.full((len(self.q), k), -np.inf), np.full((len(self.q), k), -1)
        self.out: list[tuple[np.ndarray, ...]] = []

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """Products below it can't count any more."""
        least = np.full(len(rows), self.least) if self.k is None else np.maximum(self.scores[rows, -1], self.least)
        return np.nextafter((least - self.slack[rows]).astype(self.kind), self.kind(-np.inf))

    def offer(self, i: np.ndarray, j: np.ndarray, table: int | None) -> None:
        """Scores pairs and keeps those that count. Of pairs from a table those count that no table before brings together,
        of others those that any does."""
        for at in range(0, len(i), _PAIRS):
            a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
            fine = self.q_codes[a] != self.c_codes[b]
            if self.own:
                fine &= a < b
            if self.q_places is not None:
                met = (self.q_places[a, :table] == self.c_places[b, :table]).any(axis=1)
                fine &= met if table is None else ~met
            a, b = a[fine], b[fine]
            score = _rounded(np.einsum("ij,ij->i", self.q[a].astype(float), self.c[b].astype(float)), self.digits)
            fine = np.isfinite(score) & (score >= self.least)
            if self.k is None:
                self.out.append((self.q_codes[a[fine]], self.c_codes[b[fine]], score[fine]))
            elif fine.any():
                self._keep(a[fine], self.c_codes[b[fine]], score[fine])

    def _keep(self, a: np.ndarray, codes: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(a)
        each, scores, held = (np.concatenate(x) for x in ((np.repeat(rows, self.k), a), (self.scores[rows].ravel(), score), (self.codes[rows].ravel(), codes)))
        order = np.lexsort((held, -scores, each))
        best = order[np.searchsorted(each[order], rows)[:, None] + np.arange(self.k)]
        self.scores[rows], self.codes[rows] = scores[best], held[best]

    def multiply(self, rows: np.ndarray, columns: np.ndarray, table: int | None, block: int) -> Iterator[None]:
        """Offers what the products of ``rows`` and ``columns`` don't rule out; the first blocks are narrow, to raise the bound soon."""
        for at in range(0, len(rows), max(1, block // 2)):
            some, begin, step = rows[at : at + max(1, block // 2)], at if self.own else 0, block if self.k is None else min(block, 64)
            while begin < len(columns):
                held = columns[begin : begin + step]
                hit = np.flatnonzero((self.q_flat[some] @ self.c_flat[held].T) >= self.bound(some)[:, None])
                self.offer(some[hit // len(held)], held[hit % len(held)], table)
                yield
                begin, step = begin + step, min(block, 2 * step)

    def search(self, block: int) -> Iterator[None]:
        """All pairs; or those that share a place in a table: table by table, unless the tables together bring more pairs
        than there are, which are then multiplied once."""
        every = np.arange(len(self.q)), np.arange(len(self.c))
        if self.q_places is None:
            yield from self.multiply(*every, None, block)
            return
        met = [self._met(t) for t in range(self.q_places.shape[1])]
        if sum(int((n * m).sum()) for _, _, (_, n), (_, m) in met) >= len(self.q) * len(self.c):
            del met
            yield from self.multiply(*every, None, block)
            return
        for t, (left, right, (a, n), (b, m)) in enumerate(met):
            small = n * m <= 4096
            for k in np.flatnonzero(~small):
                yield from self.multiply(left[a[k] : a[k] + n[k]], right[b[k] : b[k] + m[k]], t, block)
            a, n, b, m = a[small], n[small], b[small], m[small]
            lot = np.cumsum(n * m) // _PAIRS
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(lot)) + 1):
                pairs = n[some] * m[some]
                of = np.repeat(some, pairs)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                self.offer(left[a[of] + nth // m[of]], right[b[of] + nth % m[of]], t)
                yield

    def _met(self, t: int):
        """Both sides in order of their places in table ``t``, and of each shared place the first row and the rows on each side."""
        left, right = (np.argsort(x[:, t], kind="stable") for x in (self.q_places, self.c_places))
        (u, a, n), (v, b, m) = (np.unique(x[o, t], return_index=True, return_counts=True) for x, o in ((self.q_places, left), (self.c_places, right)))
        _, x, y = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        return left, right, (a[x], n[x]), (b[y], m[y])

    def found(self) -> tuple[np.ndarray, ...]:
        if self.k is not None:
            row, at = np.nonzero(np.isfinite(self.scores))
            return self.q_codes[row], self.codes[row, at], self.scores[row, at]
        out, self.out = [np.concatenate(x) for x in zip(*self.out, strict=True)] if self.out else [np.empty(0, int)] * 3, []
        return tuple(out)


def _searching(k: int | None, least: float | None, digits: int, kind: pa.DataType, block: int, mirror: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        vectors, side = rows["vec"].combine_chunks(), rows["side"].to_numpy()
        if len(set(vectors.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors of one table have one number of components")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        codes = pa.compute.rank(rows["key"], tiebreaker="dense").to_numpy().astype(int)
        keys = rows["key"].take(pa.array(np.unique(codes, return_index=True)[1]))  # by code less one
        places = None
        if "places" in rows.column_names:
            places = rows["places"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        fine = np.isfinite(flat).all(axis=1)
        left, right = np.flatnonzero(fine & (side & 1 > 0)), np.flatnonzero(fine & (side & 2 > 0))
        right = right[np.argsort(codes[right], kind="stable")]
        if own := bool((side == 3).all()):
            left = right
        if k is not None and len(right):
            right = right[_first_copies(flat[right], codes[right], k)]
        if not len(left) or not len(right) or not flat.shape[1]:
            return
        sides = [(flat[x], codes[x], None if places is None else places[x]) for x in ((left,) if own else (left, right))]
        del rows, vectors, flat, places
        cell = _Cell(sides * 2 if own else sides, k, least, digits, own)
        del sides

        def batch() -> pa.RecordBatch:
            a, b, score = cell.found()
            if mirror:
                a, b, score = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(score, 2)
            named = [keys.take(pa.array(x - 1)).cast(kind) for x in (a, b)]
            named = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in named]
            return pa.RecordBatch.from_arrays([*named, pa.array(score, pa.float64())], ["query", "key", "score"])

        for _ in cell.search(block):
            if sum(len(x) for x, _, _ in cell.out) >= _PAIRS:
                yield batch()
        yield batch()

    return run


def _pairs(asked: DataFrame, held: DataFrame, key: str, k: int | None, least: float | None, digits: int) -> DataFrame:
    """query, key, score of the pairs of ``asked`` and ``held`` (key, vec, and places in tables if they have them) of ``least``
    or more; with ``k``, of at least the k best of each query.

    Both sides are dealt as a grid: a cell has a group of one and a part of the other, so the memory of a task doesn't grow
    with the tables, and a row is written once for each cell that it is in. Products in single precision rule out what is
    surely below the bound; what is left is scored in double precision. No pair is shuffled that isn't in the result.
    """
    sound = [df.where(F.col(key).isNotNull() & F.col("vec").isNotNull()) for df in (asked, held)]
    (n, width), (m, wide) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first() for df in sound)
    most = max(1, CELL_NUMBERS // max(1, width, wide))
    groups = max(1, -(-n // most))
    parts = max(-(-m // most), -(-PARTS // groups))
    lot = lambda of: F.pmod(F.xxhash64(key, "vec"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))).alias("copy")
    more = [c for c in ("places",) if c in asked.columns]
    left = sound[0].select(F.col(key).alias("key"), "vec", *more, F.lit(1).alias("side"), lot(groups).alias("lot"), every(parts))
    right = sound[1].select(F.col(key).alias("key"), "vec", *more, F.lit(2).alias("side"), lot(parts).alias("lot"), every(groups))
    cells = left.withColumn("cell", F.col("lot") * parts + F.col("copy")).unionByName(right.withColumn("cell", F.col("copy") * parts + F.col("lot"))).drop("lot", "copy")
    return _searched(cells, asked.schema[key].dataType, groups * parts, k, least, digits, False)


def _own_pairs(rows: DataFrame, key: str, least: float | None, digits: int) -> DataFrame:
    """The pairs of ``rows`` with each other, as ``_pairs`` of both would give them.

    Rows are dealt as lots; a cell has two lots, or one with itself. A pair is scored in one cell for both of its
    directions, so the products are half of the grid's, and a row is written once a lot.
    """
    sound = rows.where(F.col(key).isNotNull() & F.col("vec").isNotNull())
    n, width = sound.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    lots = max(LOTS, -(-n // max(1, CELL_NUMBERS // max(1, width))))
    more = [c for c in ("places",) if c in rows.columns]
    dealt = sound.select(F.col(key).alias("key"), "vec", *more, F.pmod(F.xxhash64(key, "vec"), F.lit(lots)).alias("lot"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("other"))
    side = F.when(F.col("lot") < F.col("other"), 1).when(F.col("lot") > F.col("other"), 2).otherwise(3)
    cells = dealt.select("key", "vec", *more, side.alias("side"), (F.least("lot", "other") * lots + F.greatest("lot", "other")).alias("cell"))
    return _searched(cells, rows.schema[key].dataType, lots * (lots + 1) // 2, None, least, digits, True)


def _searched(cells: DataFrame, kind: DataType, count: int, k: int | None, least: float | None, digits: int, mirror: bool) -> DataFrame:
    """query, key, score of the ``count`` cells of ``cells`` (key, vec, side, cell); a row's side is 1 (asked), 2 (held) or 3 (both)."""
    dealt = cells.repartition(4 * count, "cell")  # few cells share a task
    run = _searching(k, least, digits, to_arrow_type(kind), BLOCK_ROWS, mirror)
    return dealt.groupBy("cell").applyInArrow(run, f"query {kind.simpleString()}, key {kind.simpleString()}, score double")


# -- exact neighbours


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(asked: DataFrame, held: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """query, key, score, rank: for each row of ``asked`` (key, vec) the k rows of ``held`` of largest inner product.

    Exact: every row of ``asked`` meets every row of ``held`` once; ties go to the smaller key, the row itself is left out.
    The work grows with the product of both sides, one multiplication of matrices a cell (see ``_pairs``); of equal vectors
    that are held, k + 1 are compared. For close rows there is ``lsh_neighbors``. Null keys and vectors, and vectors with
    numbers that are null or not finite, take no part; vectors are of one length.
    """
    return _best(_pairs(asked.select(key, "vec"), held.select(key, "vec"), key, k, None, digits), k)


# -- neighbours by random projections


@dataclass(frozen=True)
class Tables:
    """``count`` hash tables; a row's place in each is its buckets on ``width`` random directions."""

    model: BucketedRandomProjectionLSHModel
    count: int
    width: int

    def _hashed(self, rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``rows`` (…, vec) hashed, and each table's buckets."""
        hashed = self.model.transform(rows.withColumn("__features", array_to_vector(F.col("vec").cast("array<double>"))))
        bucket = [vector_to_array(F.col("__hashes")[i])[0].cast("long") for i in range(self.count * self.width)]
        return hashed, [F.array(*bucket[t * self.width : (t + 1) * self.width]) for t in range(self.count)]

    def places(self, rows: DataFrame) -> DataFrame:
        """``rows`` (…, vec) with a row for each table, in the column ``place`` (table, buckets)."""
        hashed, buckets = self._hashed(rows)
        places = [F.struct(F.lit(t).alias("table"), b.alias("buckets")) for t, b in enumerate(buckets)]
        return hashed.select(*rows.columns, F.explode(F.array(*places)).alias("place"))

    def coded(self, rows: DataFrame) -> DataFrame:
        """``rows`` (…, vec) with ``places``, a 64-bit hash of the buckets of each table."""
        hashed, buckets = self._hashed(rows)
        return hashed.select(*rows.columns, F.array(*map(F.xxhash64, buckets)).alias("places"))


def lsh_tables(vectors: DataFrame, tables: int = 16, width: int = 2, bucket: float = 0.5, seed: int = 42) -> Tables:
    """Hash tables for ``vectors`` (vec): fitting only draws directions, so it reads one row.

    More ``tables`` find more, a greater ``width`` or a shorter ``bucket`` compares less. Rows at length one whose
    cosine is s are sqrt(2 - 2 s) apart; a bucket of about that length is a good start.
    """
    first = vectors.where("vec IS NOT NULL").limit(1).withColumn("__features", array_to_vector(F.col("vec").cast("array<double>")))
    lsh = BucketedRandomProjectionLSH(inputCol="__features", outputCol="__hashes", bucketLength=bucket, numHashTables=tables * width, seed=seed)
    return Tables(lsh.fit(first), tables, width)


def lsh_candidates(asked: DataFrame, held: DataFrame, key: str, tables: Tables) -> DataFrame:
    """query, key: the distinct pairs of rows of ``asked`` and ``held`` (key, vec) that share a place in any table.

    The two sides are joined by place; vectors stay behind, so a pair that meets in many tables costs that many pairs
    of keys. A place that very many rows share is a skewed join, which Spark splits.
    """
    sound = lambda df: df.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(key, "vec")
    left = tables.places(sound(asked)).select(F.col(key).alias("query"), "place")
    right = tables.places(sound(held)).select(key, "place")
    return left.join(right, "place").where(F.col("query") != F.col(key)).select("query", F.col(key).alias("key")).distinct()


def lsh_neighbors(asked: DataFrame, held: DataFrame, key: str, tables: Tables, k: int | None = None, least: float | None = None, digits: int = 6) -> DataFrame:
    """query, key, score (and rank, with ``k``): the candidates with their exact inner products, the k best of each query
    or those of ``least`` or more. What no table brings together is missing; ``recall`` tells how much that is.

    Candidates are made, scored and dropped within cells of both sides (see ``_pairs``), not joined as rows: tables that
    bring most rows together would shuffle nearly all pairs, once a table. If ``asked`` is ``held``, all pairs of a table
    are wanted, and each is scored once for both directions. Vectors with numbers that are null or not finite take no part."""
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    sound = lambda df: tables.coded(df.where(F.col(key).isNotNull() & F.col("vec").isNotNull() & finite).select(key, "vec"))
    if asked is held and k is None:
        return _own_pairs(sound(held), key, least, digits)
    scored = _pairs(sound(asked), sound(held), key, k, least, digits)
    return scored if k is None else _best(scored, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, found, recall: how many of the pairs (query, key) of ``exact`` are among those of ``found``."""
    hit = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")).distinct(), ["query", "key"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("found")).select("n", "found", F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(1.0).alias("recall"))


# -- labels along neighbours


def pseudo_labels(neighbors: DataFrame, labels: DataFrame, agree: float = 0.7, least: float = 0.0) -> DataFrame:
    """query, label, agreement, similarity, weight: what the labelled ``neighbors`` (query, key, score) of a row say.

    A row gets the label of most of its neighbours if the share ``agree`` or more has it and their mean score is
    ``least`` or more; weight is agreement times similarity. ``labels`` is (key, label), one row a key; neighbours
    without one are left out. Of equal counts the label that sorts first wins.
    """
    known = neighbors.join(labels.where("label IS NOT NULL").select("key", "label"), "key")
    votes = known.groupBy("query", "label").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    total = votes.groupBy("query").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("minus"), "label", "s")).alias("top"))
    out = total.select("query", "top.label", (-F.col("top.minus") / F.col("total")).alias("agreement"), (F.col("top.s") / -F.col("top.minus")).alias("similarity"))
    return out.where((F.col("agreement") >= agree) & (F.col("similarity") >= least)).withColumn("weight", F.col("agreement") * F.col("similarity"))


def undirected(neighbors: DataFrame) -> DataFrame:
    """src, dst, w: both directions of every pair of ``neighbors`` (query, key, score) of positive score, once each."""
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = neighbors.where("score > 0").select(F.explode(F.array(way("query", "key"), way("key", "query"))).alias("way"), F.col("score").alias("w")).select("way.*", "w")  # not a union, which works neighbours out twice
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def label_spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, most: int = 1000) -> DataFrame:
    """node, label, p: the labels of ``seeds`` (node, label) spread along ``edges`` (src, dst, w).

    In each round a node that isn't a seed takes the mean of its neighbours' shares, weighted by w; seeds keep their
    label, shared equally if they have several. The rounds are ``rounds``, or as many as it takes until no share changes
    by more than ``tolerance`` (at most ``most``; then it raises). Nodes that no seed reaches have no rows. Edges lie dealt
    by their source for all rounds, so that a round moves shares only; each round is written to the shared checkpoint
    folder, so a lost executor costs one round. A node of very many edges is a skewed join, which Spark splits.
    """
    named = seeds.where("node IS NOT NULL AND label IS NOT NULL").select("node", "label").distinct()
    fixed = checkpointed(named.join(named.groupBy("node").agg(F.count("*").alias("n")), "node").select("node", "label", (1 / F.col("n")).alias("p")))
    moving = checkpointed(edges.where("w > 0 AND src <> dst").join(fixed.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti"))  # it is read twice
    degree = moving.groupBy("dst").agg(F.sum("w").alias("total"))
    share = moving.join(degree, "dst").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))
    share = share.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    now, n = fixed, 0
    try:
        while rounds is None or n < rounds:
            moved = share.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "label").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
            new = checkpointed(fixed.unionByName(moved))
            n += 1
            if rounds is None:
                gap = new.join(now.withColumnRenamed("p", "q"), ["node", "label"], "full_outer").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))).first()[0]
                if not gap or gap <= tolerance:
                    return new
                if n == most:
                    raise ValueError(f"the shares still change by {gap} after {n} rounds")
            now = new
        return now
    finally:
        share.unpersist()


def spread_labels(shares: DataFrame) -> DataFrame:
    """node, label, p: each node's label of largest share; of equals the one that sorts first."""
    top = shares.groupBy("node").agg(F.min(F.struct((-F.col("p")).alias("minus"), "label")).alias("t"))
    return top.select("node", "t.label", (-F.col("t.minus")).alias("p"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """``vectors`` (…, vec) at length one; zero vectors are left out."""
    length = norm(F.col("vec"))
    return vectors.where(length > 0).withColumn("vec", F.transform(F.col("vec").cast("array<double>"), lambda x: x / length))
