"""Language identification by cross-parsing entropy, with suffix automata of running labelled text.

A language's automaton accepts every substring of its sample. A text is parsed greedily into the longest phrases that
the automaton knows, across words; a byte that it doesn't know is a phrase. A phrase is named by a place in the
sample, so it costs log2 of the sample's length; the language whose phrases cost least wins. The automata are
completed to one table: where an arc is missing, the arc from the start state is put, marked as the beginning of a
phrase. A parse is then one table look-up for each byte, and many stretches of text are parsed in lockstep.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.llm.worker import resident

#: Texts are parsed in stretches of so many bytes, at whose ends phrases end; and so many bytes at once.
STRETCH, TOGETHER = 1024, 4 << 20
UNKNOWN = "und"


class _Letters(dict):
    """For ``str.translate``: letters in lower case, a space for everything else, found out when first met."""

    def __missing__(self, code: int) -> str:
        if len(self) > 1 << 16:
            self.clear()
        out = self[code] = chr(code).lower() if chr(code).isalpha() else " "
        return out


_LETTERS = _Letters()


def running(text: str) -> bytes:
    """``text`` in lower case, with one space for whatever isn't a letter and at both ends; empty without letters."""
    words = text.translate(_LETTERS).split()
    return f" {' '.join(words)} ".encode("utf-8", "replace") if words else b""


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text (characters) or of bytes."""

    def __init__(self, text: str | bytes):
        self.arcs: list[dict[str | int, int]] = [{}]
        link, size, last = [-1], [0], 0
        arcs = self.arcs
        for c in text:
            new = len(arcs)
            arcs.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in arcs[p]:
                arcs[p][c] = new
                p = link[p]
            if p >= 0:
                q = arcs[p][c]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    copy = len(arcs)
                    arcs.append(dict(arcs[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and arcs[p].get(c) == q:
                        arcs[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str | bytes) -> int:
        """The number of phrases of the greedy parse, each the longest match from where the last one ended."""
        arcs, n, k = self.arcs, 0, 0
        while k < len(text):
            state, n = 0, n + 1
            start = k
            while k < len(text) and (found := arcs[state].get(text[k])) is not None:
                state, k = found, k + 1
            if k == start:
                k += 1
        return n


class Model:
    """The automata of all languages as one table, ready to parse; ``samples`` has texts (``running``) by language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        joined = [b"".join(samples[x]) for x in self.languages]
        self._bits = np.array([math.log2(2 + len(x)) for x in joined])
        seen = np.unique(np.frombuffer(b"".join(joined), np.uint8))
        self._width = len(seen) + 1  # the first column is for all other bytes
        self._column = np.zeros(256, np.int32)
        self._column[seen] = np.arange(1, self._width)
        tables, self._starts, base = [], [], 0
        for text in joined:
            tables.append(self._completed(SuffixAutomaton(text).arcs, base))
            self._starts.append(base * self._width)
            base += len(tables[-1])
        self._table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def _completed(self, arcs: list[dict[int, int]], base: int) -> np.ndarray:
        """Cells by state and column: twice the place of the next state's row, plus one if a phrase begins there."""
        fresh = np.full(self._width, base * self._width * 2 + 1, np.int32)
        for byte, to in arcs[0].items():
            fresh[self._column[byte]] = (base + to) * self._width * 2 + 1
        table = np.tile(fresh, (len(arcs), 1))
        states = np.fromiter((s for s, out in enumerate(arcs) if s for _ in out), np.int64)
        into = np.fromiter((to for out in arcs[1:] for to in out.values()), np.int64)
        if len(into):
            over = self._column[np.fromiter((byte for out in arcs[1:] for byte in out), np.int64)]
            table[states, over] = (base + into) * self._width * 2
        return table

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of phrases of each text (column) in each language (row)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(np.cumsum(sizes) - sizes, pieces) + within * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - within * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, first, length = owner[order], first[order], length[order]
        columns = self._column[np.frombuffer(b"".join(texts), np.uint8)]
        state = np.repeat(np.array(self._starts, np.int32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        for k in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length, -k, "left"))  # those longer than k
            cell = self._table.take(state[:, :active] + columns.take(first[:active] + k))
            count[:, :active] += cell & 1
            state[:, :active] = cell >> 1
        return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count]) if len(count) else np.empty((0, len(texts)))

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The language of each text, and the runner-up's share of the two least costs."""
        out: list[tuple[str, float]] = []
        waiting: list[bytes] = []
        held = 0
        for text in texts:
            waiting.append(running(text or ""))
            held += len(waiting[-1])
            if held >= TOGETHER:
                out += self._judged(waiting)
                waiting, held = [], 0
        return out + self._judged(waiting)

    def _judged(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        costs = self.phrases(texts) * self._bits[:, None]
        worst = np.fromiter(map(len, texts), float, len(texts)) * self._bits.max()  # every byte a phrase
        best = np.argmin(costs, axis=0)
        least = costs[best, np.arange(len(texts))]
        costs[best, np.arange(len(texts))] = worst
        second = costs.min(axis=0)
        return [(self.languages[b], float(y / (x + y))) if t else (UNKNOWN, 0.0) for t, b, x, y in zip(texts, best, least, second, strict=True)]


def _spread_over(text: Column, share: Column) -> Column:
    """Stretches of 1,024 characters or less, ``share`` characters in all, evenly spread over the whole text."""
    piece = F.least(F.lit(STRETCH), share)
    n = F.greatest(F.lit(1), F.floor(share / piece)).cast("int")
    step = F.greatest(F.lit(0), F.length(text) - piece) / F.greatest(F.lit(1), n - 1)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, (1 + F.floor(k * step)).cast("int"), piece.cast("int"))), " ")


def fit(labelled: DataFrame, docs_per_language: int = 150, sample_bytes: int = 240_000, most_languages: int = 1000) -> dict[str, list[bytes]]:
    """Each language's sample, from ``labelled`` (doc_id, text, lang).

    The bounds of the sample: the ``most_languages`` languages with most labelled documents; about ``docs_per_language``
    documents of each, those of smallest hashed id among those that fit; and ``sample_bytes`` in all, of which each
    language has an equal share and takes, in that order, documents whole as long as they fit. A language all of whose
    documents are longer than its share gets stretches of the shortest one, evenly spread over the whole of it. The
    bounds of all languages are one small table, joined with the documents.
    Rows with a null text or lang are left out. No rows give an empty model, which calls everything unknown.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("__at", F.xxhash64(F.col("doc_id"))).withColumn("__size", F.octet_length("text"))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang").collect()
    if not known:
        return {}
    share = max(1, sample_bytes // len(known))
    chosen = labelled.sparkSession.createDataFrame([(r.lang,) for r in known], "lang string")
    ours = labelled.join(F.broadcast(chosen), "lang")
    sizes = ours.groupBy("lang").agg(F.count_if(F.col("__size") <= share).alias("__some"))
    rank = F.col("__at").cast("double") / 2.0**64 + 0.5  # of the hash among all, from 0 to 1
    samples: dict[str, list[bytes]] = defaultdict(list)
    room = dict.fromkeys((r.lang for r in known), share)
    fitting = ours.where(F.col("__size") <= share).join(F.broadcast(sizes), "lang").where(rank * F.col("__some") <= docs_per_language)  # a row a language
    for r in fitting.select("lang", "text", "__at").orderBy("__at", "text").toLocalIterator():
        text = running(r.text)
        if text and len(text) <= room[r.lang]:
            samples[r.lang].append(text)
            room[r.lang] -= len(text)
    if lacking := sorted({*room} - {*samples}):
        rest = ours.join(F.broadcast(labelled.sparkSession.createDataFrame([(x,) for x in lacking], "lang string")), "lang")
        shortest = rest.groupBy("lang").agg(F.min(F.struct("__size", "__at", "text")).alias("s"))
        for r in shortest.select("lang", _spread_over(F.col("s.text"), F.lit(share)).alias("text")).collect():
            if text := running(r.text):
                samples[r.lang].append(text)
    return dict(samples)


def predicted(docs: DataFrame, samples: dict[str, list[bytes]], text: str = "text") -> Column:
    """A column struct<lang_pred, score> for each whole text; ``und`` and 0 where it is null or has no letter.

    The score is the runner-up's share of the two least costs: 0.5 for a tie, which the language that sorts first
    wins; with one language, the runner-up is a parse into single bytes. The samples are bounded and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = ("language", uuid.uuid4().hex)

    @arrow_udf("struct<lang_pred:string, score:double>")
    def of(texts: pa.Array) -> pa.Array:
        model = resident(key, lambda: Model(shared.value))
        found = model.predict(t.as_py() for t in texts)
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang_pred", "score"])

    return of(F.col(text))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "text", "lang")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; a null doc_id is neither learned from nor held out."""
    docs = docs.select("doc_id", "text", "lang")
    out = docs.select("doc_id", predicted(docs, fit(training_rows(docs))).alias("p"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "p.lang_pred", "p.score")
