"""Token counts by a transducer whose arcs emit counts instead of tokens.

The arcs of the byte machine carry counts: by how many tokens the encoding grows or shrinks with that byte;
their sum along a word is its number of tokens.

A long text is cut into chunks that are counted in different tasks. Where two neighbouring characters surely belong to
different words it can be cut anyway; a run of letters, digits, marks or white space that goes on for a whole chunk is
cut inside, and there the transducer is in a state of the byte machine. A chunk is then a map from the state it is
entered in to a count and the state it is left in. All maps are first worked out from the start state, in parallel. As
the machine forgets: from any two states its paths soon meet, and a map's final state hardly ever depends on the first.
So a scan over a text's chunks, each taking the state its neighbour was left in, is right after one round; further
rounds take up chunks whose neighbour was left in another state than supposed, until there is none.

Within a task a text is counted by maps of chunks of its characters, whose state is the text since the last place where
a word surely ends: a chunk without such a place appends itself to the state; any other maps a state s to its own tail
and emits count(s + head) + body. These maps compose associatively.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.llm.bpe import Memo, MergeAutomaton, in_worker, no_cycles, vocabulary
from shelfmark.sources.tables import checkpointed

CHUNK = 16_384
#: Texts of more characters than this are cut into chunk rows, of about CHUNK characters or more.
LONG = 2 * CHUNK
#: Characters whose classes are the same in every Unicode version; next to others no text is cut.
_SETTLED = "\\x00-\\u0241\\u0250-\\u036F\\u0400-\\u0524\\u2000-\\u2063\\u20A0-\\u20B5\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FA5\\uAC00-\\uD7A3"
_WORD_END = re.compile(r"(?<=\S)(?=\s)")


class StateMap(NamedTuple):
    """What a stretch of text does to the state: ``head`` completes it, ``body`` is emitted, ``tail`` is left."""

    head: str
    body: int
    tail: str | None  # None: no sure word end, the stretch is all head


class CountTransducer:
    """Token counts with the composition of chunk maps; one for each worker."""

    def __init__(self, source: bytes):
        self.automaton = MergeAutomaton(source, counting=True)
        self._emitted = Memo(self.automaton.count_piece)

    def count_piece(self, piece: str | int) -> int:
        return self._emitted[piece]

    def count(self, text: str) -> int:
        """The counts emitted along the path of a text that starts and ends at word ends."""
        return sum(map(self._emitted.__getitem__, self.automaton.pieces(text)))

    def chunk(self, text: str) -> StateMap:
        first = _WORD_END.search(text)
        if first is None:
            return StateMap(text, 0, None)
        cut = first.start()
        last = cut
        for at in range(len(text) - 1, cut, -1):
            if text[at].isspace() and not text[at - 1].isspace():
                last = at
                break
        return StateMap(text[:cut], self.count(text[cut:last]) if last > cut else 0, text[last:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.tail is None:
            return StateMap(a.head + b.head, b.body, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.body, a.tail + b.head)
        return StateMap(a.head, a.body + self.count(a.tail + b.head) + b.body, b.tail)

    def total(self, text: str | None) -> int:
        """The whole text's count: its chunks' maps composed pairwise, level by level."""
        maps = [self.chunk(text[k : k + CHUNK]) for k in range(0, len(text or ""), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return sum(self.count(m.head) + m.body + self.count(m.tail or "") for m in maps)


class Chunk(NamedTuple):
    """A stretch of a text; ``entered`` and ``left``: whether its first and its last run go on beyond it."""

    text: str
    entered: bool
    left: bool


@cache
def _patterns() -> tuple:
    """Places where a word surely ends (a class of characters does, and no contraction begins), by the classes' runs."""
    import regex

    letter, number, space = (rf"[{c}&&[{_SETTLED}]]" for c in (r"\p{L}", r"\p{N}", r"\s"))
    mark = rf"[[{_SETTLED}]--\p{{L}}--\p{{N}}--\s]"
    ends = rf"(?<={letter})(?={number}|{mark}|{space})|(?<={number})(?={letter}|{mark}|{space})|(?<={mark})(?={number}|{space})|(?<=[{mark}--'])(?={letter})"
    return regex.compile(ends, regex.V1), [regex.compile(rf"{c}+", regex.V1) for c in (letter, number, mark, space)]


def _run(text: str, at: int, end: int) -> int:
    """Where the run of settled characters of one class that ``at`` is in ends, at ``end`` at the latest; ``at`` if there is none."""
    return next((m.end() for p in _patterns()[1] if (m := p.match(text, at, end))), at)


def chunks(text: str, tokens: list[str], size: int = CHUNK) -> Iterator[Chunk]:
    """``text`` in order, in chunks of ``size`` characters or up to ``size`` more; longer only where no place is sure.

    A chunk ends where a word surely does, or inside a run that goes on for ``size`` characters and two more. Nowhere
    else, and never inside one of the added ``tokens``.
    """
    sure, begin, entered = _patterns()[0], 0, False
    spans = lambda p: any(0 <= text.find(t, max(0, p - len(t) + 1), p + len(t) - 1) < p for t in tokens)
    at = size
    while at + 2 < len(text):
        cut = next((m.start() for m in sure.finditer(text, at, at + size) if m.start() > begin and not spans(m.start())), None)
        inside = False
        if cut is None and _run(text, at - 1, at + size) >= min(len(text), at + 3) and at - 1 > begin and not spans(at):
            cut, inside = at, True
        if cut is None:
            at += size
            continue
        yield Chunk(text[begin:cut], entered, inside)
        begin, entered, at = cut, inside, cut + size
    yield Chunk(text[begin:], entered, False)


class Entry(NamedTuple):
    """A chunk's map at one state: counts of its first run and of the rest, and the state it is left in, if inside a run."""

    head: int
    rest: int
    state: bytes | None


def entry(transducer: CountTransducer, chunk: Chunk, state: bytes | None = None) -> Entry:
    """``chunk`` entered in ``state`` (None: the start of a word)."""
    machine, text, size = transducer.automaton, chunk.text, 0
    if chunk.entered:
        token = min((k for t in machine.added if (k := text.find(t)) >= 0), default=len(text))
        size = _run(text, 0, token)
        if size < len(text) and _patterns()[1][3].match(text) and size != token:
            size -= 1  # the last white space before a word is a word of its own, or begins it
    head, last = machine.run(text[:size].encode(), state) if size else (0, None)
    rest, after = text[size:], None
    if not chunk.left:
        return Entry(head, transducer.count(rest) if rest else 0, None)
    if not rest:
        return Entry(head, 0, last)
    pieces = machine.pieces(rest)
    words = machine.words(pieces[-1])
    tail, after = machine.run(words[-1].encode())
    return Entry(head, sum(transducer.count_piece(p) for p in [*pieces[:-1], *words[:-1]]) + tail, after)


_ROW, _ENTRY = "id long, n long, text string, entered boolean, left boolean", "id long, n long, entered boolean, used binary, head long, rest long, state binary"


def _cutting(tokens: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, c in enumerate(chunks(text.as_py(), tokens, size)):
                    columns = ((key, pa.int64()), (n, pa.int64()), (c.text, pa.string()), (c.entered, pa.bool_()), (c.left, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["id", "n", "text", "entered", "left"])

    return run


def _entering(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            with no_cycles():
                transducer = in_worker(CountTransducer, source.value)
                for key, n, text, entered, left, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    e = entry(transducer, Chunk(text, entered, left), used)
                    out.append((key, n, entered, used, e.head, e.rest, e.state))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "n", "entered", "used", "head", "rest", "state"])

    return run


def scanned(texts: DataFrame, tokenizer: str, size: int = CHUNK) -> DataFrame:
    """id, total of ``texts`` (id long, distinct; text): the counts of chunk rows, dealt over all tasks, and their scan.

    A chunk's row is entered in the state that the row before it was left in; rows whose supposed state wasn't that one
    are worked out again, until there is none. Each round is written to the shared checkpoint folder. What a round moves
    beside those chunks are states of some dozen bytes. Null texts have no row.
    """
    source = vocabulary(texts.sparkSession, tokenizer)
    tokens = sorted(MergeAutomaton(source.value).added)
    rows = texts.where("text IS NOT NULL").select("id", "text").mapInArrow(_cutting(tokens, size), _ROW)
    rows = checkpointed(rows.repartition("id", "n"))
    enter = lambda df: df.select("id", "n", "text", "entered", "left", "used").mapInArrow(_entering(source), _ENTRY)
    now = checkpointed(enter(rows.withColumn("used", F.lit(None).cast("binary"))))
    while True:
        before = F.lag("state").over(Window.partitionBy("id").orderBy("n"))
        wrong = checkpointed(now.withColumn("came", before).where(F.col("entered") & ~F.col("came").eqNullSafe(F.col("used"))).select("id", "n", F.col("came").alias("used")))
        if wrong.isEmpty():
            return now.groupBy("id").agg(F.sum(F.col("head") + F.col("rest")).alias("total"))
        again = enter(rows.join(wrong.select(F.col("id").alias("i"), F.col("n").alias("k"), "used"), (F.col("id") == F.col("i")) & (F.col("n") == F.col("k"))))
        kept = now.join(wrong.select(F.col("id").alias("i"), F.col("n").alias("k")), (F.col("id") == F.col("i")) & (F.col("n") == F.col("k")), "left_anti")
        now = checkpointed(kept.unionByName(again))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens", long: int = LONG, size: int = CHUNK) -> DataFrame:
    """``docs`` with ``into`` long, the number of tokens of each whole text.

    Null and empty texts have 0. All other columns stay; one that is named ``into`` is replaced. Rows are
    independent: repeated rows give repeated results, an empty table an empty one. Texts of over ``long`` characters
    are counted as rows of chunks (``scanned``), so that one text is the work of many tasks; the others in one call.
    """
    source = vocabulary(docs.sparkSession, tokenizer)

    @arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        with no_cycles():
            transducer = in_worker(CountTransducer, source.value)
            return pa.array([transducer.total(t.as_py()) for t in texts], pa.int64())

    is_long = F.coalesce(F.length(text) > long, F.lit(False))
    short = docs.where(~is_long).withColumn(into, counted(F.col(text)))
    key = f"__{uuid.uuid4().hex}"  # no column of ``docs`` has that name
    kept = checkpointed(docs.where(is_long).withColumn(key, F.monotonically_increasing_id()))
    if not kept.isEmpty():
        totals = scanned(kept.select(F.col(key).alias("id"), F.col(text).alias("text")), tokenizer, size)
        joined = kept.join(totals, kept[key] == totals["id"])
        short = short.unionByName(joined.select(*(kept[c] for c in docs.columns if c != into), totals["total"].alias(into)))
    return short


def budget(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed ``limit``."""
    return count_tokens(docs.select("doc_id", "text"), tokenizer).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
