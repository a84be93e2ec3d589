"""The tokenizer operators against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bpe, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "the", "'s", "'ll", " ", "  ", "\n", "\t", "é", "ß", "1", "12", "!", "$$", "<|endoftext|>", "中", "文", " ", " ", "😀", "\x1c", "\x85", "Ⅷ", "x" * 50, "-" * 70, " " * 30, "ab", "ba", "e" * 9, "ก็", "՘"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_and_counts_match_the_library(library, monkeypatch):
    source = open(PATH, "rb").read()
    codec, counter = bpe.Codec(source), token_count.CountTransducer(source)
    for k, t in enumerate([*texts(3000, 1), "", "word " * 9000, "x" * 40_000, "\n" * 20_000]):
        monkeypatch.setattr(token_count, "CHUNK", (1, 2, 7, 100, 16384)[k % 5] if len(t) < 1000 else 4096)
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == ids
        assert counter.total(t) == len(ids)
        assert codec.automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_composition_is_associative():
    counter = token_count.CountTransducer(open(PATH, "rb").read())
    for t in texts(200, 2):
        k = len(t) // 3
        a, b, c = (counter.chunk(x) for x in (t[:k], t[k : 2 * k], t[2 * k :]))
        left, right = counter.compose(counter.compose(a, b), c), counter.compose(a, counter.compose(b, c))
        assert left == right


def test_the_machine_starts_anew_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "_MACHINE_STATES", 20)
    codec = bpe.Codec(open(PATH, "rb").read())
    for t in texts(100, 3):
        assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_few_arcs_are_tried_for_a_step_of_the_machine(monkeypatch):
    machine, calls = bpe.MergeAutomaton(open(PATH, "rb").read()), []
    opened = machine._open
    monkeypatch.setattr(machine, "_open", lambda entered, label: calls.append(label) or opened(entered, label))
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 12))) for _ in range(2000)]
    assert all(b"".join(machine.labels[i] for i in machine.path(w.encode())) == w.encode() for w in words)
    assert len(calls) < 5 * len(machine._next)


def test_frames_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world<|endoftext|>!", "z"), (3, "Hello  world<|endoftext|>!", "z"), (None, "a" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert sorted(map(str, bpe.transcode(docs, PATH).collect())) == sorted(map(str, out.collect()))
    counted = token_count.budget(docs, PATH).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert bpe.digests(docs.limit(0), PATH).count() == 0 == token_count.budget(docs.limit(0), PATH).count()


def unbroken(rng, n):
    """A text almost without places where it can surely be cut."""
    kind = rng.choice(["letters", "digits", "marks", "spaces", "wide", "mixed", "unsettled"])
    if kind == "mixed":
        return "".join(rng.choice(PARTS) * rng.choice([1, 1, 40]) for _ in range(n // 20))
    alphabet = {"letters": "etaoinshrdlucmfwypvbgkjqxzé", "digits": "0123456789", "marks": "!-=.,'*#", "spaces": " \n\t", "wide": "中文字符測試語言", "unsettled": "กขคงจ՘"}[kind]
    return rng.choice(["", "a ", "'s", "<|endoftext|>"]) + "".join(rng.choices(alphabet, k=n)) + rng.choice(["", " z", "<|endoftext|>", "'ll", "  x"])


def test_maps_of_chunks_add_up_to_the_library_s_count(library):
    rng, counter = random.Random(5), token_count.CountTransducer(open(PATH, "rb").read())
    inside = 0
    for k in range(260):
        text, size = unbroken(rng, rng.choice([60, 300, 900])), rng.choice([3, 8, 40, 150])
        parts = [*token_count.chunks(text, [*counter.automaton.added], size)]
        assert "".join(c.text for c in parts) == text and not parts[0].entered and not parts[-1].left
        assert all(a.left == b.entered for a, b in zip(parts, parts[1:], strict=False))
        state, total = None, 0
        for c in parts:
            e = token_count.entry(counter, c, state)
            state, total = e.state, total + e.head + e.rest
            inside += c.entered
        assert total == len(library.encode(text, add_special_tokens=False).ids), (k, text[:80], size)
    assert inside > 500


def test_a_state_means_the_same_in_another_worker():
    source = open(PATH, "rb").read()
    one, other = (token_count.CountTransducer(source).automaton for _ in range(2))
    word = b"antidisestablishmentarianism" * 9
    for k in (1, 7, 30, 100):
        other.run(b"quite another word first")
        a, state = one.run(word[:k])
        b, _ = other.run(word[k:], state)
        assert a + b == one.run(word)[0] == one.emitted(word)


def test_long_texts_are_counted_over_tasks(spark, library):
    rng = random.Random(8)
    long = "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=400_000))
    texts = [long, long, "short one", None, "", "0123456789" * 9_000, " " * 70_000 + "x", "word " * 30_000, "中文字" * 20_000, "a<|endoftext|>" * 9_000]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    docs = docs.withColumns({"total": docs.doc_id * 2, "id": docs.n, "__of": docs.n})
    rows = token_count.count_tokens(docs, PATH).collect()
    assert token_count.count_tokens(docs, PATH).columns == [*docs.columns, "n_tokens"]
    want = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in rows} == want and all(r.total == 2 * r.doc_id and r.n == "n" for r in rows)
    pieces = [*token_count.chunks(long, [])]
    assert len(pieces) == 25 and all(len(c.text) < 2 * token_count.CHUNK for c in pieces)  # a row each, in whatever task
