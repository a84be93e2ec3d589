"""Byte-level BPE as a deterministic token automaton, compiled by one merge gadget per merge rule.

The automaton reads *tokens* and accepts exactly the token sequences that BPE can produce. It starts
as one state with a loop for each byte. A merge (u, v) -> w, in order of priority, adds a gadget: the
arcs labelled u are redirected to a copy of their target that has no arc v, and every state that has an
arc u gets an arc w to where v led. As all arcs of one label lead to one state, a state is known by the
label that enters it, and a state's lost arcs are those of its gadgets and of the states it was copied
from. Each byte string has exactly one accepted token sequence. A second machine reads bytes: its states
are the tokens that may have begun, its transitions are determined lazily and kept in a table, and each
carries the token that ends there and by how many tokens the encoding so far grows or shrinks.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.llm.worker import resident

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Scripts whose character classes are the same in every Unicode version; others are split by the library.
_SETTLED = re.compile("[^\x00-Ɂɐ-ͯЀ-Ԥ -⁣₠-₵]")
_LOOSE_SPACE = re.compile(r"\s ")
#: What a worker keeps at most: half the results by piece, states of the byte machine, cells of half a table of the automaton.
_MEMO_ENTRIES, _MACHINE_STATES, _CELLS = 100_000, 200_000, 200_000
_MEMO_WORD = 64
#: Texts whose tokens a worker holds at once.
_SLICE = 256
_NEVER = 1 << 60
#: Where so few nodes of the trie of labels or fewer go on, it is looked up whether any of them may follow; elsewhere a token is begun unchecked.
_FEW = 8
#: Counts are differences between tokenizations of a few dozen bytes, kept in 12 bits.
_BIAS = 1 << 11


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The compiled automaton of one tokenizer file (the JSON format, byte-level BPE without a normalizer)."""

    def __init__(self, source: bytes, counting: bool = False):
        """``counting``: the byte machine's arcs carry counts, for ``emitted``; else it has fewer states."""
        spec = json.loads(source)
        self._counting = counting
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files with the standard split are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        n = 1 + max([*model["vocab"].values(), *self.added.values()])
        self.labels: list[bytes] = [b""] * n
        for symbol, i in model["vocab"].items():
            self.labels[i] = bytes(byte_of[c] for c in symbol)
        for content, i in self.added.items():
            self.labels[i] = content.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._compile(model["vocab"], merges)
        self._sizes = [len(b) for b in self.labels]
        self._arcs, self._old_arcs, self._fits, self._old_fits = {}, {}, {}, {}
        self._next: dict[int, int] = {}
        self._numbers: dict[bytes, int] = {}
        self._pending: list[bytes] = []
        self._ended: list[int] = []  # the label that ends where a state begins
        self._counts: dict[int, int] = {}
        self._pattern = None
        self._library = None

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = len(self.labels)
        self._left, self._right, self._born = [-1] * n, [-1] * n, [-1] * n
        self._gadgets: dict[int, int] = {}
        live = {i: True for s, i in vocab.items() if len(s) == 1}
        for when, (x, y) in enumerate(merges):
            u, v, w = vocab[x], vocab[y], vocab[x + y]
            if w in live:
                raise ValueError("a token is made by two merges")
            if u in live and v in live and self._open(u, v):
                self._gadgets[u << 20 | v] = when
                self._left[w], self._right[w], self._born[w] = u, v, when
                live[w] = True
        self.n_states = 1 + len(self._gadgets)
        self._child: dict[int, int] = {}
        self._token_at = [-1]
        self._inner = [True]
        self._below: list[list[int]] = [[]]
        for i in live:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                if key not in self._child:
                    self._child[key] = len(self._token_at)
                    self._token_at.append(-1)
                    self._inner.append(False)
                    self._below[node].append(self._child[key])
                    self._below.append([])
                self._inner[node] = True
                node = self._child[key]
            self._token_at[node] = i
        sizes = [1] * len(self._below)
        for node in range(len(sizes) - 1, -1, -1):  # nodes below one come after it
            sizes[node] += sum(sizes[x] for x in self._below[node])
        self._few = bytes(n <= _FEW for n in sizes)

    def _open(self, entered: int, label: int) -> bool:
        """Whether the state that arcs ``entered`` lead to has an arc ``label``."""
        gadgets, left, right, born = self._gadgets, self._left, self._right, self._born
        owner, before = entered, _NEVER
        while True:
            part, until = label, _NEVER
            while True:
                when = gadgets.get(owner << 20 | part)
                if when is not None and born[part] < when <= until and when < before:
                    return False
                if left[part] < 0:
                    break
                until, part = born[part], left[part]
            if right[owner] < 0:
                return True
            before, owner = born[owner], right[owner]

    def arc(self, entered: int, label: int) -> bool:
        """The transition table, filled as its cells are first used; of its two halves the older one is given up when full."""
        key = entered << 20 | label
        found = self._arcs.get(key)
        if found is None:
            found = self._old_arcs.get(key)
            if found is None:
                found = self._open(entered, label)
            if len(self._arcs) >= _CELLS:
                self._arcs, self._old_arcs = {}, self._arcs
            self._arcs[key] = found
        return found

    def start(self) -> int:
        """The byte machine's start state. It is built anew when it has grown over a bound, between two words."""
        if not self._pending or len(self._pending) > _MACHINE_STATES:
            for table in (self._next, self._numbers, self._pending, self._ended, self._counts):
                table.clear()
            self._state([(0, -1, 0)])
        return 0

    def _state(self, begun: list[tuple[int, int, int]]) -> int:
        """The number of the state with these tokens begun: (node of the trie of labels, label before it, tokens up to there).

        The last one begins at the state, so the label before it is the one that ends there.
        """
        return self._adopted(array("q", [(node << 21 | before + 1) << 12 | tokens + _BIAS for node, before, tokens in begun]).tobytes())

    def _adopted(self, packed: bytes) -> int:
        found = self._numbers.get(packed)
        if found is None:
            found = self._numbers[packed] = len(self._pending)
            self._pending.append(packed)
            self._ended.append((int.from_bytes(packed[-8:], "little") >> 12 & 0x1FFFFF) - 1)
        return found

    def run(self, word: bytes, state: bytes | None = None) -> tuple[int, bytes]:
        """The sum of the counts on the arcs that spell ``word`` from ``state``, and the state they lead to.

        States are given as what is begun in them, which means the same in every worker; None is the start. So the
        counts of a word's parts, each from where the last one ended, add up to that of the word.
        """
        now, known, counts, total = self.start(), self._next.get, self._counts, 0
        if state is not None:
            now = self._adopted(state)
        for byte in word:
            arc = now << 8 | byte
            now = known(arc) or self._step(now, byte)
            total += counts[arc]
        return total, self._pending[now]

    def _viable(self, node: int, before: int) -> bool:
        """Whether some label whose first bytes led to ``node``, and which goes on, may follow ``before``."""
        key = node << 20 | before
        found = self._fits.get(key)
        if found is None:
            found = self._old_fits.get(key)
            if found is None:
                found, open_nodes = False, [*self._below[node]]
                while open_nodes and not found:
                    at = open_nodes.pop()
                    found = self._token_at[at] >= 0 and self._open(before, self._token_at[at])
                    open_nodes += self._below[at]
            if len(self._fits) >= _CELLS:
                self._fits, self._old_fits = {}, self._fits
            self._fits[key] = found
        return found

    def _step(self, state: int, byte: int) -> int:
        """The next state, found out when first asked for; and, kept aside, by how much the accepting path's length differs."""
        label, count, kept = -1, 0, []
        for packed in array("q", self._pending[state]):
            before, tokens = (packed >> 12 & 0x1FFFFF) - 1, (packed & 0xFFF) - _BIAS
            node = self._child.get(packed >> 33 << 8 | byte)
            if node is None:
                continue
            ends = self._token_at[node]
            if label < 0 <= ends and (before < 0 or self.arc(before, ends)):
                label, count = ends, tokens + 1
            # Begun tokens that can't end change no path: the label that ends is asked for its arc anyway.
            if self._inner[node] and (before < 0 or not self._few[node] or self._viable(node, before)):
                kept.append((node, before, tokens))
        if label < 0:
            raise ValueError("the merges accept no token sequence for this word")
        if self._counting:
            kept = [(node, before, tokens - count) for node, before, tokens in kept]
            self._counts[state << 8 | byte] = count
        out = self._next[state << 8 | byte] = self._state([*kept, (0, label, 0)])
        return out

    def path(self, word: bytes) -> list[int]:
        """The labels of the one accepting path that spells ``word``."""
        state, known, seen = self.start(), self._next.get, []
        for byte in word:
            state = known(state << 8 | byte) or self._step(state, byte)  # no arc leads to the start, which is 0
            seen.append(state)
        out, n, sizes, ended = [], len(word), self._sizes, self._ended
        while n:
            out.append(label := ended[seen[n - 1]])
            n -= sizes[label]
        out.reverse()
        return out

    def emitted(self, word: bytes) -> int:
        """The sum of the counts on the arcs that spell ``word``."""
        state, known, counts, total = self.start(), self._next.get, self._counts, 0
        for byte in word:
            arc = state << 8 | byte
            state = known(arc) or self._step(state, byte)
            total += counts[arc]
        return total

    def words(self, text: str) -> list[str]:
        """``text`` (without added tokens) cut by the pre-tokenizer's pattern."""
        if _SETTLED.search(text):
            if self._library is None:
                from tokenizers import pre_tokenizers

                self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if self._pattern is None:
            import regex

            self._pattern = regex.compile(SPLIT)
        return self._pattern.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Added tokens as their ids; the text between them cut where every reading of it has a word end."""
        out: list[str | int] = []
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                out.append(self.added[part])
            elif part and _LOOSE_SPACE.search(part):
                out += self.words(part)
            elif part:
                first, *rest = part.split(" ")  # no white space stands before a space: a word ends there
                if first:
                    out.append(first)
                out += [" " + x for x in rest]
        return out

    def encode_piece(self, piece: str | int) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        return list(chain.from_iterable(self.path(w.encode()) for w in self.words(piece)))

    def count_piece(self, piece: str | int) -> int:
        return 1 if isinstance(piece, int) else sum(self.emitted(w.encode()) for w in self.words(piece))

    def decode(self, ids) -> str:
        """The arc labels of ``ids``, one after the other, as text; bytes that are not UTF-8 become U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class Memo(dict):
    """Results by piece, in two halves: when the younger one is full, the older one is given up. Long pieces are never kept."""

    def __init__(self, work):
        super().__init__()
        self._work, self._older = work, {}

    def __missing__(self, piece):
        out = self._older.get(piece)
        if out is None:
            out = self._work(piece)
        if isinstance(piece, int) or len(piece) <= _MEMO_WORD:
            if len(self) >= _MEMO_ENTRIES:
                self._older = {**self}
                self.clear()
            self[piece] = out
        return out


class Codec:
    """A worker's automaton with the ids of the pieces it has met."""

    def __init__(self, source: bytes):
        self.automaton = MergeAutomaton(source)
        self._words = Memo(self._word)  # of pieces of several words
        self._ids = Memo(self._piece)

    def _word(self, word: str) -> bytes:
        return array("i", self.automaton.path(word.encode())).tobytes()

    def _piece(self, piece: str | int) -> bytes:
        if isinstance(piece, int):
            return array("i", [piece]).tobytes()
        words = self.automaton.words(piece)
        return self._word(piece) if len(words) == 1 else b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._ids.__getitem__, self.automaton.pieces(text or ""))), np.intc)


def in_worker(kind, source: bytes):
    """The worker's ``kind(source)``."""
    return resident((kind.__name__, hashlib.sha256(source).hexdigest()), lambda: kind(source))


@contextmanager
def no_cycles():
    """Holds the collector of cycles back: it would walk the tables, which have none, again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file at ``path`` (on the driver), broadcast; such files have a few MB, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(each: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *each])))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` array<int>, the tokens of each whole text.

    Null and empty texts get an empty array. Special strings inside a text become their one id. All other
    columns stay; one that is named ``ids`` is replaced. Rows are independent: repeated rows give repeated
    results, an empty table an empty one.
    """
    source = vocabulary(docs.sparkSession, tokenizer)

    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        with no_cycles():
            codec = in_worker(Codec, source.value)
            each = [codec.encode(t.as_py()) for t in texts]
        return _lists(each)

    return docs.withColumn(ids, encoded(F.col(text)))


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the string that ``ids`` spell, special tokens included; null ids spell the empty string."""
    source = vocabulary(docs.sparkSession, tokenizer)

    @arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        automaton = in_worker(Codec, source.value).automaton
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *(pa.compute.fill_null(pa.compute.list_value_length(rows), 0)).to_pylist()])
        return pa.array([automaton.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return docs.withColumn(text, decoded(F.col(ids)))


def transcode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the tokens of each whole text and what they spell, as ``encode`` and ``decode`` give them.

    One function makes both columns: of two, Spark would run the first twice, for its column and for the second.
    """
    source = vocabulary(docs.sparkSession, tokenizer)

    @arrow_udf("struct<ids:array<int>, decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for k in range(0, len(texts), _SLICE):  # what a batch of texts gives is never held whole
                with no_cycles():
                    codec = in_worker(Codec, source.value)
                    each = [codec.encode(t.as_py()) for t in texts[k : k + _SLICE]]
                    spelled = pa.array([codec.automaton.decode(x.tolist()) for x in each], pa.string())
                yield pa.StructArray.from_arrays([_lists(each), spelled], ["ids", "decoded"])

    coded = docs.withColumn("__coded", both(F.col(text)))
    return coded.withColumns({ids: F.col("__coded.ids"), decoded: F.col("__coded.decoded")}).drop("__coded")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = transcode(docs.select("doc_id", "text"), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
