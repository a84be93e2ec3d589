"""Ranked lexical search over a sharded inverted index, with block maxima deciding what is decompressed.

Documents are indexed where they lie: a task cuts its partition into shards of bounded size and writes, for each term
of a shard, its postings in compressed blocks of 128 and a head per block: first and last place, the largest impact
of any posting in it, and where its bytes end. A shard also has a directory, the ids of its documents in order.

A search moves over the heads alone. The borders of all blocks of a query's terms cut the shard into intervals; in each
the sum of the heads' maxima bounds every score. Intervals below the k-th best score so far are passed over, and only
blocks that meet another one are decompressed. Shards are independent; the best of each meet at the end.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.llm.contamination import _bounded, item_words
from shelfmark.sources.tables import checkpoint_dir

#: Postings of a block; what a shard holds at most, but for its last document; items that are searched for together.
BLOCK, SHARD_POSTINGS, SHARD_DOCS, LOT_ITEMS = 128, 1 << 20, 1 << 16, 512
#: ``term`` is empty in a shard's directory row, whose n, heads and data are its documents, their ids and lengths.
INDEX = "shard long, term string, n long, heads binary, data binary"
_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z to a-z, whatever lies between terms to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))
_IN_TERM = np.array([c != 32 for c in _FOLD])


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# -- blocks


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in groups of seven bits, the lowest first, the last marked; and where each ends."""
    size = 1 + sum((values >> s > 0).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> (7 * k) & 127) + 128 * (size[has] == k + 1)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data >= 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(data) else np.empty(0, np.int64)
    within = np.arange(len(data)) - np.repeat(starts, np.diff([*starts, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * within, starts) if len(data) else np.empty(0, np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by, in integers; 0 for documents that aren't ranked (m of -1)."""
    return np.where(m < 0, 0, 1_000_000_000 * tf // (1000 * tf + 8 * np.maximum(m, 1)))


def lengths(n: list[int], documents: int, total: int) -> np.ndarray:
    """The m of documents with n terms each, of the corpus's count and terms, in Python's integers."""
    return np.array([25 + 75 * x * documents // total for x in n], np.int64)


# -- building


class _Shard:
    """Documents until there are enough of them."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.kinds: list[int] = []  # of each document
        self.numbers: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        known = self.terms
        self.numbers.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.kinds.append(len(counts))
        self.postings += len(counts)

    def rows(self, shard: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
        """The directory, then the terms in order. Documents without an id are the last places."""
        m = lengths(self.sizes, documents, total)
        unknown = np.array([x is None for x in self.ids])
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        order = np.lexsort((ids, unknown))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m, ids = np.where(unknown, -1, m)[order], ids[order]
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.terms[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        key = rank[np.concatenate(self.numbers)] << 32 | np.repeat(place, self.kinds)
        by = np.argsort(key)
        key, tf = key[by], np.concatenate(self.tfs)[by].astype(np.int64)
        term, at = key >> 32, key & 0xFFFFFFFF
        firsts = np.searchsorted(term, np.arange(len(names)))
        inside = np.arange(len(term)) - firsts[term]
        heads = np.flatnonzero(inside % BLOCK == 0)  # where blocks begin
        gaps = np.diff(at, prepend=0)
        gaps[heads] = 0
        data, ends = packed(np.column_stack([gaps, tf - 1]).reshape(-1))
        stops = np.concatenate([heads[1:], [len(term)]])
        block_ends, starts = ends[2 * stops - 1], np.concatenate([[0], ends[2 * stops[:-1] - 1]])
        first_block = np.searchsorted(term[heads], np.arange(len(names)))
        offsets = np.concatenate([starts[first_block], [len(data)]])
        head = np.column_stack([at[heads], at[stops - 1], np.maximum.reduceat(impacts(tf, m[at]), heads), block_ends - offsets[term[heads]]]).astype("<i4")
        counts = np.diff([*firsts, len(term)])
        head_ends = 16 * np.concatenate([first_block, [len(heads)]])
        yield _batch(shard, [b""], [len(ids)], [0, 8 * len(ids)], ids.astype("<i8").tobytes(), [0, 8 * len(ids)], m.astype("<i8").tobytes())
        for k in range(0, len(names), 1 << 14):
            to = min(len(names), k + (1 << 14))
            h, d = head_ends[k : to + 1], offsets[k : to + 1]
            yield _batch(shard, names[k:to], counts[k:to], h - h[0], head[h[0] // 16 : h[-1] // 16].tobytes(), d - d[0], data[d[0] : d[-1]].tobytes())


def _binary(offsets, data: bytes) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.asarray(offsets, "<i4").tobytes()), pa.py_buffer(data)])


def _batch(shard, names, counts, head_offsets, heads, offsets, data) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(names), shard)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.asarray(counts, np.int64)), _binary(head_offsets, heads), _binary(offsets, data)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "heads", "data"])


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for batch in batches:
        for text in _bytes(batch.column(0)):
            inside = _IN_TERM[np.frombuffer(text, np.uint8)]
            n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])
            documents, total = documents + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64())], ["documents", "total"])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""
    found = docs.select(F.col("text")).mapInArrow(_counting, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def build(docs: DataFrame, postings: int = SHARD_POSTINGS, most: int = SHARD_DOCS) -> DataFrame:
    """The index of ``docs`` (doc_id long, text) as rows of ``INDEX``, to be written or searched. Nothing is shuffled.

    Every term of every whole text is indexed. Documents without a term (null and empty texts too) are left out;
    those with a null id count for their terms but are never found. Repeated rows are documents each. Extra columns
    are ignored. The corpus is read twice, first for its two counts; an empty one has an empty index.
    """
    documents, total = statistics(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, shard, n = TaskContext.get().partitionId() << 32, _Shard(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                if words := terms(text):
                    shard.add(doc_id, words)
                if shard.postings >= postings or len(shard.ids) >= most:
                    yield from shard.rows(base + n, documents, total)
                    shard, n = _Shard(), n + 1
        if shard.ids:
            yield from shard.rows(base + n, documents, total)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def saved(index: DataFrame) -> DataFrame:
    """``index`` written to the shared folder and read again; each shard's terms lie in order, so that scans skip."""
    spark = index.sparkSession
    index.write.parquet(path := f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}")
    return spark.read.schema(INDEX).parquet(path)


# -- searching


class Postings:
    """A term's postings in a shard; blocks are decompressed when they are first asked for."""

    def __init__(self, n: int, heads: bytes, data: bytes, m: np.ndarray):
        self.first, self.last, self.most, self.end = np.frombuffer(heads, "<i4").reshape(-1, 4).T.astype(np.int64)
        self.n, self.data, self.m = n, np.frombuffer(data, np.uint8), m
        self.open = np.zeros(len(self.first), bool)
        self.places, self.impacts = np.empty(n, np.int64), np.empty(n, np.int64)

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that holds each place, and its largest impact; 0 where the place is between two blocks."""
        block = np.minimum(np.searchsorted(self.last, at), len(self.last) - 1)
        return block, np.where((self.first[block] <= at) & (at <= self.last[block]), self.most[block], 0)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the blocks (ascending)."""
        new = blocks[~self.open[blocks]]
        if len(new):
            begin = np.concatenate([[0], self.end[:-1]])
            raw = self.data if len(new) == len(self.first) else np.concatenate([self.data[begin[b] : self.end[b]] for b in new])
            values = unpacked(raw)
            sizes = np.minimum(self.n - new * BLOCK, BLOCK)
            starts = np.cumsum(sizes) - sizes
            run = np.cumsum(values[0::2])
            place = run + np.repeat(self.first[new] - run[starts], sizes)
            at = _spans(new * BLOCK, sizes)
            self.places[at], self.impacts[at] = place, impacts(values[1::2] + 1, self.m[place])
            self.open[new] = True
        if len(blocks) == len(self.first):
            return self.places, self.impacts
        at = _spans(blocks * BLOCK, np.minimum(self.n - blocks * BLOCK, BLOCK))
        return self.places[at], self.impacts[at]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def best(query: list[tuple[Postings, int]], scores: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """(score, place) of the k best places, ties to the smaller place; and the blocks decompressed for it.

    ``scores`` has a zero for each place, and has again afterwards. The intervals of largest bounds are scored first,
    so that the threshold is high when the rest is passed over in order.
    """
    query = [(p, w) for p, w in query if w > 0]
    if not query:
        return [], 0
    edges = np.unique(np.concatenate([x for p, _ in query for x in (p.first, p.last + 1)]))
    bound, blocks = np.zeros(len(edges) - 1, np.int64), []
    for p, w in query:
        block, most = p.bounds(edges[:-1])
        blocks.append(np.where(most > 0, block, -1))
        bound += w * most
    waiting = np.flatnonzero(bound > 0)
    top: list[tuple[int, int]] = []  # (-score, place), ascending
    read, take = 0, 8
    turn = waiting[np.argsort(-bound[waiting], kind="stable")[:take]]
    while len(turn):
        turn = np.sort(turn)
        inside = np.zeros(len(scores) + 1, np.int8)
        np.add.at(inside, edges[turn], 1)
        np.add.at(inside, edges[turn + 1], -1)
        for (p, w), block in zip(query, blocks, strict=True):
            needed = np.unique(block[turn])
            if len(needed := needed[needed >= 0]):
                read += int(np.count_nonzero(~p.open[needed]))
                at, impact = p.read(needed)
                scores[at] += w * impact
        at = np.flatnonzero(np.cumsum(inside[:-1]) * scores > 0)
        found = scores[at]
        if len(at) > k:
            cut = -np.partition(-found, k - 1)[k - 1]
            at, found = at[found >= cut], found[found >= cut]
        top = sorted([*top, *zip((-found).tolist(), at.tolist(), strict=True)])[:k]
        scores[:] = 0
        waiting = waiting[~np.isin(waiting, turn, assume_unique=True)]
        if len(top) == k:  # what only reaches the k-th score still wins by a smaller place
            least, last = -top[-1][0], top[-1][1]
            waiting = waiting[(bound[waiting] > least) | (bound[waiting] == least) & (edges[waiting] < last)]
        take *= 4
        turn = waiting[:take]
    return [(-s, place) for s, place in top], read


def _searching(k: int, kind: pa.DataType):
    def run(lists: pa.Table, shards: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for ids, m, items in zip(*(shards.column(c).to_pylist() for c in ("ids", "m", "items")), strict=True):
            ids, m = np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8")
            held = {t: Postings(n, heads, data, m) for t, n, heads, data in zip(*(lists.column(c).to_pylist() for c in ("term", "n", "heads", "data")), strict=True)}
            scores = np.zeros(len(ids), np.int64)
            for item in items:
                top, _ = best([(held[x["term"]], x["weight"]) for x in item["terms"] if x["term"] in held], scores, k)
                for score, place in top:
                    for column, value in zip(out, (item["item_id"], int(ids[place]), score), strict=True):
                        column.append(value)
        return pa.table({"item_id": pa.array(out[0], kind), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each of ``items`` (item_id, text) its k documents of largest score above 0.

    Ties go to the smaller doc_id. Texts of rows that share an id are one query, equal ones counted once; null ids
    are left out; items without a term, or without a document, have no rows. Items are dealt in lots with the shards
    (both may be many); a shard's lists of a lot's terms are one task's work, at most a shard. Nothing is collected but
    the number of items and documents.
    """
    kind = to_arrow_type(items.schema["item_id"].dataType)
    asked = items.where("item_id IS NOT NULL").select("item_id", "text").distinct()
    words = asked.select("item_id", F.explode(item_words("text")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    lots = max(1, -(-asked.select("item_id").distinct().count() // LOT_ITEMS))
    words = words.withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(lots)).cast("int"))
    documents = index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sought = _bounded(words.select("lot", "term").distinct(), F.octet_length("term") + 8)
    counts = index.where("term <> ''").select("term", "n").join(sought, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = words.join(counts.select("term", weight.alias("weight")), "term").select("lot", "item_id", F.struct("term", (F.col("weight") * F.col("times")).alias("weight")).alias("x"))
    queries = weighed.groupBy("lot", "item_id").agg(F.collect_list("x").alias("terms")).groupBy("lot").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    shards = index.where("term = ''").select(F.col("shard").alias("of"), F.col("heads").alias("ids"), F.col("data").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")).join(queries, "lot")
    lists = index.where("term <> ''").join(sought, "term")
    found = lists.groupBy("shard", "lot").cogroup(shards.select("of", F.col("lot").alias("for"), "ids", "m", "items").groupBy("of", "for")).applyInArrow(_searching(k, kind), f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The search for all ``items`` in a new index of ``docs``, kept in the shared folder until that is cleared."""
    return search(saved(build(docs)), items, k)
