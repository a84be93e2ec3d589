"""Long byte strings that documents share, by a logarithmic family of sparse suffix arrays.

Every 50-byte string has an anchor, the least hashed of the 16-byte strings in it, which depends on its bytes alone.
Documents are packed into blocks. A block asks, by buckets of hashes, which of its anchors other blocks have too; only
around those does it send the bytes of the strings they anchor, dealt by the anchor's hash. A task takes its rows in
order of doc_id, in batches. A batch's 50-byte suffixes become a suffix array (a text and sorted places in it), whose
suffixes are looked up, in order, in each level of the index, arrays of suffixes of earlier documents; what is new
becomes a level, and levels of one size merge in one pass. As only matches of 50 bytes count, arrays are sorted by a
64-bit hash of these bytes, so neighbours in them share nothing and no longer match is carried from one to the next; the
bytes themselves are compared wherever hashes agree, so a chance agreement can't remove anything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.tables import checkpoint_dir

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES, SEGMENT, BATCH_ROWS, BUCKETS = 4 << 20, 1 << 20, 1 << 14, 256
#: Blocks whose share of the anchors one task may have.
BLOCKS_A_TASK = 64
_PLACE_BITS, _ASKED_BITS = 24, 48
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BLOCK = "block long, ids binary, known binary, sizes binary, body binary"
_CODEC, _TABLE = "zstd", "shelfmark_blocks"


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of columns of 8-byte words."""
    h = words[0] * _MIX[0]
    for w in words[1:]:
        h ^= h >> np.uint64(29)
        h = (h + w) * _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(29))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that starts at each place but the last seven."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view).view("<u8")[:, 0]


def anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, last start, the anchor's hash.

    ``data`` are the documents' bytes, ``ends`` where they end; strings don't cross ends. Long data is taken in
    segments that overlap by a string less a byte.
    """
    out: tuple[list, list, list] = [], [], []
    for base in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        part = data[base : base + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        words = _words_at(part)
        hashes = _mixed([words[: len(part) - GRAM + 1], words[GRAM - 8 :]])
        ranks = hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            ranks = np.minimum(ranks[:-width], ranks[width:])
            width *= 2
        if width < SPAN:
            ranks = np.minimum(ranks[: width - SPAN], ranks[SPAN - width :])
        place = (ranks & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(base, base + len(place))
        whole = ends[np.searchsorted(ends, starts, "right")] >= starts + LENGTH
        starts, place = starts[whole], place[whole]
        if len(starts):
            new = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(starts) != 1)))
            out[0].append(starts[new])
            out[1].append(starts[np.append(new[1:], len(starts)) - 1])
            out[2].append(hashes[place[new]])
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.uint64), strict=True))


class Block:
    """An unpacked block: its documents' ids, which of them are not null, bytes and ends; and its anchors."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, body: bytes):
        self.ids, self.known, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(known, bool), np.frombuffer(sizes, "<i8")
        self.data = np.frombuffer(pa.decompress(body, int(self.sizes.sum()), _CODEC), np.uint8) if self.sizes.sum() else np.empty(0, np.uint8)
        self.ends = np.cumsum(self.sizes)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """First start, last start and hash of each run, and the number of its document; without null ids."""
        first, last, hashes = anchored(self.data, self.ends)
        doc = np.searchsorted(self.ends, first, "right")
        fine = self.known[doc]
        return first[fine], last[fine], hashes[fine], doc[fine]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made, ids, known, bodies, held = TaskContext.get().partitionId(), 0, [], [], [], 0

    def block() -> pa.RecordBatch:
        body = b"".join(bodies)
        values = (part << 32 | made, np.array(ids, "<i8").tobytes(), np.array(known, bool).tobytes(), np.array([*map(len, bodies)], "<i8").tobytes(), pa.compress(body, _CODEC, asbytes=True))
        types = (pa.int64(), *(pa.binary(),) * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["block", "ids", "known", "sizes", "body"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            body = (text.as_py() or "").encode()
            if bodies and held + len(body) > BLOCK_BYTES:
                yield block()
                made, ids, known, bodies, held = made + 1, [], [], [], 0
            ids.append(doc.as_py() or 0)
            known.append(doc.is_valid)
            bodies.append(body)
            held += len(body)
    if bodies:
        yield block()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(c[row].as_py() for c in batch.columns)


def _differences(ascending: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte by byte; nothing for none."""
    if not len(ascending):
        return b""
    steps = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    return len(steps).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), _CODEC, asbytes=True)


def _from_differences(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, _CODEC), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def _asking(buckets: int):
    """The leading bits of a block's anchor hashes, sorted, each once, cut into equal ranges; a chance agreement only costs time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *packed in _rows(batches):
            hashes = Block(*packed).anchors()[2]
            hashes = np.unique(hashes >> np.uint64(64 - _ASKED_BITS))
            cuts = np.searchsorted(hashes, np.array([(k << _ASKED_BITS) // buckets for k in range(buckets)], np.uint64))
            parts = [_differences(hashes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(hashes)], strict=True)]
            asked = [k for k in range(buckets) if parts[k]]
            columns = [pa.array(asked, pa.int32()), pa.array([block] * len(asked), pa.int64()), pa.array([parts[k] for k in asked], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "hashes"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """For each block's hashes of a bucket, which of them another block has too, as bits."""
    lists = [_from_differences(x.as_py()) for x in table["hashes"]]
    every = np.sort(np.concatenate(lists))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    flags = []
    for hashes in lists:
        at = np.minimum(np.searchsorted(shared, hashes), max(0, len(shared) - 1))
        flags.append(np.packbits(shared[at] == hashes if len(shared) else np.zeros(len(hashes), bool)).tobytes())
    sizes = pa.array([len(x) for x in lists], pa.int32())
    return pa.table({"block": table["block"], "bucket": table["bucket"], "n": sizes, "flags": pa.array(flags, pa.binary())})


def _first_of(groups: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, groups, docs)
    return first


def _sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the index: each distinct run of a shared anchor's strings, once a block.

    ``doc_id`` is the smallest that has the run here. ``body`` is the number of its places in that document, the number
    of its places in larger ones, these places, and the bytes.
    """
    for block, *packed, answers in _rows(batches):
        one = Block(*packed)
        first, last, hashes, doc = one.anchors()
        ids = one.ids[doc]
        _, group = np.unique(hashes >> np.uint64(64 - _ASKED_BITS), return_inverse=True)
        n = int(group.max(initial=-1)) + 1
        flags = [np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=x["n"]).astype(bool) for x in sorted(answers or (), key=lambda x: x["bucket"])]
        elsewhere = np.concatenate([np.empty(0, bool), *flags])
        within = _first_of(group, ids, n) < -_first_of(group, -ids, n)
        keep = np.flatnonzero((elsewhere | within)[group]) if n else np.empty(0, int)
        first, last, hashes, ids = first[keep], last[keep] + LENGTH, hashes[keep].view(np.int64), ids[keep]
        body = one.data.tobytes()
        coded = pa.array([body[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()).dictionary_encode()
        codes, texts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        order = np.lexsort((first, ids, codes))
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        docs = ids[order[starts]]
        same = np.add.reduceat(ids[order] == np.repeat(docs, sizes), starts, dtype=np.int64) if len(starts) else sizes
        heads, places = np.stack([same, sizes - same], 1).astype("<u4").tobytes(), first[order].astype("<u4").tobytes()
        bodies = [heads[8 * k : 8 * k + 8] + places[4 * a : 4 * (a + m)] + text for k, (a, m, text) in enumerate(zip(starts.tolist(), sizes.tolist(), texts, strict=True))]
        columns = [pa.array(hashes[order[starts]]), pa.array(docs, pa.int64()), pa.array([block] * len(docs), pa.int64()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "block", "body"])


def _strings(text: np.ndarray) -> np.ndarray:
    """The 50-byte string that starts at each place; as all are of one length, zeros at their ends don't confuse them."""
    return np.ndarray(max(0, len(text) - LENGTH + 1), f"S{LENGTH}", text, strides=(1,))


def _hashed(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the 50 bytes from each of some places on."""
    if not len(at):
        return np.empty(0, np.uint64)
    words = _words_at(text)
    return _mixed([words[at + k] for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)])


class Suffixes:
    """A suffix array: places in a text in order of the hashes of their 50 bytes, and the smallest document of each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, docs: np.ndarray):
        self.text, self.at, self.hashes, self.docs = text, at, hashes, docs

    def __len__(self) -> int:
        return len(self.at)

    def only(self, chosen: np.ndarray) -> Suffixes:
        """Some of the suffixes, and of the text only what they cover."""
        at = self.at[chosen]
        depth = np.bincount(at, minlength=len(self.text) + 1) - np.bincount(at + LENGTH, minlength=len(self.text) + 1)
        covered = np.cumsum(depth[:-1]) > 0
        return Suffixes(self.text[covered], np.cumsum(covered)[at] - 1, self.hashes[chosen], self.docs[chosen])

    def merged(self, other: Suffixes) -> Suffixes:
        """Both arrays, which have no hash in common, in one pass over either."""
        theirs = np.searchsorted(self.hashes, other.hashes) + np.arange(len(other))
        ours = np.ones(len(self) + len(other), bool)
        ours[theirs] = False

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(ours), a.dtype)
            out[ours], out[theirs] = a, b
            return out

        return Suffixes(np.concatenate([self.text, other.text]), both(self.at, other.at + len(self.text)), both(self.hashes, other.hashes), both(self.docs, other.docs))


class Levels:
    """Suffix arrays whose sizes at least halve from one to the next.

    A hash stands in one level, for the string that came with it first. Other strings of the same hash, if there ever
    are any, are kept apart with their bytes.
    """

    def __init__(self):
        self._levels: list[Suffixes] = []
        self._others: dict[bytes, int] = {}

    def add(self, text: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each suffix of a batch was met in a smaller document, here or before; then the batch is added."""
        if not len(at):
            return np.empty(0, bool)
        hashes, strings = _hashed(text, at), _strings(text)
        order = np.argsort(hashes)
        ranked = hashes[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        distinct, chosen = ranked[starts], at[order[starts]]
        standing, new, owners = strings[chosen], np.ones(len(starts), bool), np.full(len(starts), np.iinfo(np.int64).max)
        for level in self._levels:
            found = np.minimum(np.searchsorted(level.hashes, distinct), len(level) - 1)
            same = np.flatnonzero(level.hashes[found] == distinct)
            found = found[same]
            standing[same], owners[same], new[same] = _strings(level.text)[level.at[found]], level.docs[found], False
        odd = strings[at] != standing[group]
        least = np.minimum(owners, np.minimum.reduceat(np.where(odd, np.iinfo(np.int64).max, docs)[order], starts))
        met = least[group] < docs
        if odd.any():
            apart = [*zip(strings[at[odd]].tolist(), docs[odd].tolist(), strict=True)]
            for string, doc in apart:
                self._others[string] = min(doc, self._others.get(string, doc))
            met[odd] = [self._others[string] < doc for string, doc in apart]
        if new.any():
            self._levels.append(Suffixes(text, chosen, distinct, least).only(new))
        while len(self._levels) > 1 and len(self._levels[-2]) < 2 * len(self._levels[-1]):
            last = self._levels.pop()
            self._levels.append(self._levels.pop().merged(last))
        return met


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these sizes, one after another: the row of each element and its place in the row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _judged(levels: Levels, part: pa.RecordBatch) -> pa.RecordBatch:
    """The intervals to remove, by block, that the index finds for a batch of rows."""
    docs, blocks, bodies = part["doc_id"].to_numpy(), part["block"].to_numpy(), part["body"].cast(pa.large_binary())
    bounds = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    head, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    numbers = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    same, more = numbers[head].astype(np.int64), numbers[head + 4].astype(np.int64)
    text = head + 8 + 4 * (same + more)
    row, offset = _ragged(end - text - LENGTH + 1)
    met = levels.add(data, text[row] + offset, docs[row])
    row, offset = row[met], offset[met]
    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(offset, prepend=-LENGTH) > LENGTH))
    lasts = np.append(starts[1:], len(row))[: len(starts)] - 1
    # the runs met, at each of their places in the row's document; whole rows, met there, at their places in larger ones
    run, k = _ragged(same[row[starts]])
    of, low, high = row[starts][run], offset[starts][run], offset[lasts][run] + LENGTH
    again, m = _ragged(more)
    place = numbers[np.concatenate([head[of] + 8 + 4 * k, head[again] + 8 + 4 * (same[again] + m)])].astype(np.int64)
    spans = np.stack([place + np.append(low, np.zeros(len(again), np.int64)), place + np.append(high, (end - text)[again])], 1).astype("<i8")
    block = blocks[np.append(of, again)]
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(order) else order
    gone = [spans[x].tobytes() for x in np.split(order, cuts[1:])] if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array(block[order[cuts]], pa.int64()), pa.array(gone, pa.binary())], ["block", "gone"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals to remove, by block. Rows come in order of doc_id."""
    levels = Levels()
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield _judged(levels, batch.slice(k, BATCH_ROWS))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, *packed, gone in _rows(batches):
        one = Block(*packed)
        depth = np.zeros(len(one.data) + 1, np.int32)
        for spans in gone or ():
            each = np.frombuffer(spans, "<i8").reshape(-1, 2)
            np.add.at(depth, each[:, 0], 1)
            np.add.at(depth, each[:, 1], -1)
        removed = np.cumsum(depth[:-1]) > 0
        kept, starts, ends = [], [], []
        for a, b in zip(one.ends - one.sizes, one.ends, strict=True):
            marks = np.diff(np.concatenate([[0], removed[a:b].view(np.int8), [0]]))
            kept.append(one.data[a:b][~removed[a:b]].tobytes())
            starts.append(np.flatnonzero(marks == 1))
            ends.append(np.flatnonzero(marks == -1))
        ids = pa.array(one.ids, pa.int64(), mask=~one.known)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(one.sizes), pa.array(kept, pa.binary()), pa.array(starts, lists), pa.array(ends, lists)], ["doc_id", "n_bytes", "kept", "starts", "ends"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept binary, starts and ends array<long>: what each document keeps, and its removed spans.

    ``docs`` has doc_id and text. A byte goes if a 50-byte string covers it that also starts in a document with a
    smaller doc_id; strings are judged on the input. Null and empty texts are empty. Rows with a null id keep
    everything and take nothing from others. Rows that repeat an id are one document for this, so take nothing from
    each other, but each has its row. Extra columns are not looked at; an empty table gives an empty result.

    The packed blocks are a bucketed table in the shared checkpoint folder; see ``drop_blocks``.
    """
    spark = docs.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{_prefix(spark)}_{uuid.uuid4().hex}"
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed, _BLOCK)
    packed.repartition(parts, "block").write.bucketBy(parts, "block").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    blocks = spark.table(name)  # bucketed, so that joins by block don't deal the text again
    n = blocks.count()
    buckets, tasks = max(BUCKETS, n // 64), max(parts, n // BLOCKS_A_TASK)  # so that a task's index stays as large, whatever the corpus
    asked = blocks.mapInArrow(_asking(buckets), "bucket int, block long, hashes binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "block long, bucket int, n int, flags binary")
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "flags")).alias("answers"))
    sent = blocks.join(by_block, "block", "left").mapInArrow(_sending, "anchor long, doc_id long, block long, body binary")
    dealt = sent.repartition(tasks, "anchor").select("doc_id", "block", "body")
    spans = dealt.sortWithinPartitions("doc_id").mapInArrow(_indexed, "block long, gone binary")
    gone = spans.groupBy("block").agg(F.collect_list("gone").alias("gone"))
    return blocks.join(gone, "block", "left").mapInArrow(_cleaned, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def _prefix(spark: SparkSession) -> str:
    return f"{_TABLE}_{re.sub('[^a-z0-9]', '_', spark.sparkContext.applicationId.lower())}"


def drop_blocks(spark: SparkSession) -> None:
    """Drops the tables of blocks that this application made, files too; a result that is still to be read needs its own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in spark.catalog.listTables():
        if t.name.startswith(_prefix(spark)):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{t.name}")
            path.getFileSystem(conf).delete(path, True)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return deduplicate(docs).select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
