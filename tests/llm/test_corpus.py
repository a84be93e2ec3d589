"""The corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import components, contamination, language, licences, line_dedup, quality, registry, simhash, suffix_dedup, topk
from shelfmark.sources.tables import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, ids string"


def frame(spark, texts, langs=None):
    rows = [(k, t, (langs or {}).get(k), "s", len(t or ""), "x", "y") for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


# Suffix dedup


def removed_by_force(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(d, first.get(b[p : p + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((d, len(b), sum(mark), sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [noise(rng, 40) for _ in range(6)]
    rows = [(k, noise(rng, rng.randint(0, 60)) + "".join(rng.choice(shared)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 3))) + noise(rng, 5)) for k in range(120)]
    rows += [(200, "a" * 300), (201, "b" + "a" * 120), (202, "é" * 60), (203, "é" * 60), (204, None), (205, ""), (206, rows[3][1]), (206, rows[3][1]), (207, shared[0][:49]), (208, shared[0][:50])]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in suffix_dedup.digests(frame(spark, rows).repartition(5)).collect())
    assert got == removed_by_force(rows)
    suffix_dedup.drop_blocks(spark)


def test_suffix_dedup_of_nothing_and_null_ids(spark):
    assert suffix_dedup.digests(frame(spark, [(1, "x")]).limit(0)).count() == 0
    rows = suffix_dedup.digests(frame(spark, [(None, "z" * 80), (1, "z" * 80), (2, "z" * 80)])).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {None: 0, 1: 0, 2: 80}
    suffix_dedup.drop_blocks(spark)


def test_levels_shrink_geometrically():
    levels, rng = suffix_dedup.Levels(), np.random.default_rng(1)
    for k in range(40):
        levels.add(rng.integers(0, 256, 1049).astype(np.uint8), np.arange(1000), np.full(1000, k))
    sizes = [len(x) for x in levels._levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == 40_000
    assert all((np.diff(x.hashes.astype(object)) > 0).all() for x in levels._levels)


@pytest.mark.parametrize("bits", [64, 8, 0])
def test_levels_are_exact_whatever_the_hash(monkeypatch, bits):
    mixed = suffix_dedup._mixed
    monkeypatch.setattr(suffix_dedup, "_mixed", lambda words: mixed(words) & np.uint64((1 << bits) - 1))
    rng, levels, seen = np.random.default_rng(bits), suffix_dedup.Levels(), {}
    passages = [rng.integers(0, 3, 90).astype(np.uint8) for _ in range(12)]
    for k in range(0, 60, 4):
        texts = [np.append(passages[rng.integers(12)][rng.integers(30) :], rng.integers(0, 3, 20).astype(np.uint8)) for _ in range(4)]
        text = np.concatenate(texts)
        ends = np.cumsum([len(x) for x in texts])
        at = np.concatenate([np.arange(e - len(x), e - 49) for e, x in zip(ends, texts)])
        docs = k + np.searchsorted(ends, at, "right")
        strings = [text[p : p + 50].tobytes() for p in at]
        for s, d in zip(strings, docs):
            seen[s] = min(d, seen.get(s, d))
        assert levels.add(text, at, docs).tolist() == [seen[s] < d for s, d in zip(strings, docs)]


def test_long_data_is_anchored_alike_in_segments(monkeypatch):
    data = np.frombuffer(noise(random.Random(2), 3000).encode(), np.uint8)
    ends = np.array([len(data) // 3, len(data)])
    spans = lambda: [(int(p), int(h)) for a, b, h in zip(*suffix_dedup.anchored(data, ends)) for p in range(a, b + 1)]
    whole = spans()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 777)
    assert spans() == whole and len(whole) == len(data) - 2 * 49


# Top-k


def test_topk_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.integers(-3, 4, (260, 6)) / 4]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, []), (550, [1.0, 2.0]), (600, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.nearest(df, 50, 5).collect())
    want = []
    usable = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in usable:
        if q % 50 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in usable if k != q and len(a) == len(b))[:5]
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(ranked)]
    assert got == sorted(want)
    assert topk.nearest(df.limit(0)).count() == 0


def test_topk_broadcasts_no_copies_of_the_queries(spark):
    rows = spark.createDataFrame([(k, [k % 7, k % 5]) for k in range(300)], "id long, cells array<long>")
    found = topk.search(rows.where("id % 3 = 0"), rows, 2)
    assert found.count() == 200
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_topk_is_exact_for_huge_values(spark):
    big = 1 << 30
    rows = spark.createDataFrame([(0, [big, 1]), (1, [big, 2]), (2, [big, 3]), (3, [-big, 5])], "id long, cells array<long>")
    got = [tuple(r)[2:] for r in topk.search(rows.where("id = 0"), rows, 2).orderBy("rank").collect()]
    assert got == [(2, big * big + 3), (1, big * big + 2)]


def test_topk_in_groups_and_past_64_bits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [int(x) for x in v]) for k, v in enumerate(rng.integers(-9, 9, (120, 4)))]
    df = spark.createDataFrame(rows, "id long, cells array<long>")
    whole = sorted(tuple(r) for r in topk.search(df, df, 3).collect())
    monkeypatch.setattr(topk, "GROUP_ROWS", 25)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    assert sorted(tuple(r) for r in topk.search(df, df, 3).collect()) == whole and len(whole) == 360
    big = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "id long, cells array<long>")
    with pytest.raises(Exception, match="too large for a score"):
        topk.search(big, big, 1).collect()


# SimHash


def classes_by_force(rows):
    prints = []
    for d, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, p in prints:
        for b, q in prints:
            if (p ^ q).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, f"{p:016x}", find(d)) for d, p in prints)


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [noise(rng, 80) for _ in range(12)]
    rows = [(k, rng.choice(base) + " " + noise(rng, rng.choice([0, 0, 1, 2]))) for k in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "ONE two"), (104, "one\ttwo"), (105, "É b c d e"), (106, base[0]), (106, base[0])]
    rng.shuffle(rows)
    assert sorted(tuple(r) for r in simhash.digests(frame(spark, rows)).collect()) == classes_by_force(rows)
    assert simhash.digests(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("layout", list(simhash.LAYOUTS.values()))
def test_both_layouts_find_every_link(spark, monkeypatch, layout):
    monkeypatch.setattr(simhash, "LAYOUTS", {1 << 62: layout})
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)})
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "id long, print long")
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert {tuple(r) for r in simhash.links(df).collect()} == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def lines_by_force(rows):
    where = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    for d, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(7)
    pool = [noise(rng, 8) for _ in range(25)] + ["é" * 19, "é" * 20, "x" * 20, " " * 30]
    rows = [(k, "\n".join(rng.choice([x, x.upper() if x.isascii() else x, f"  {x}\t", "common line of text, everywhere", "short"]) for x in rng.choices(pool, k=rng.randint(0, 9)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "common line of text, everywhere\ncommon line of text, everywhere")]
    rng.shuffle(rows)
    got = line_dedup.digests(frame(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == lines_by_force(rows)
    assert line_dedup.digests(frame(spark, rows).limit(0)).count() == 0


def test_repeated_ids_count_once_and_null_ids_not_at_all(spark):
    line = "a line that is long enough"
    rows = [(1, line), (1, line + "\nmore"), (2, line), (None, line)]
    assert {r.n_dropped for r in line_dedup.digests(frame(spark, rows)).collect()} == {0}
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.digests(frame(spark, [*rows, (3, line)])).collect()}
    assert got == {(1, 1), (2, 1), (3, 0), (None, 0)}


# Decontamination


def hits_by_force(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 12)) if w and i is not None else ():
            windows.setdefault(tuple(w[p : p + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, owners in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    ids |= owners
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(k, noise(rng, rng.choice([3, 12, 13, 14, 25, 40]))) for k in range(20)]
    items += [(30, None), (31, "!!! ..."), (32, "a a a a a a a a a a a a a a a"), (None, items[4][1]), (33, items[5][1]), (5, items[5][1]), (34, "É ÈÉ x1")]
    docs = []
    for k in range(80):
        i = rng.choice(items)[1] or ""
        w = i.split()
        cut = rng.randint(0, len(w))
        docs.append((k, " ".join([noise(rng, rng.randint(0, 60)), *w[cut : cut + rng.choice([12, 13, 14, 99])], noise(rng, 3)]).upper() if k % 3 else " ".join([noise(rng, 200), i])))
    docs += [(90, None), (91, ""), (92, "a " * 300), (93, "é ÈÉ É ÈÉ X1, x"), (94, items[5][1]), (94, items[5][1]), (94, "other")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.digests(frame(spark, docs), df)
    assert sorted(tuple(r) for r in got.collect()) == hits_by_force(docs, items)
    assert contamination.digests(frame(spark, docs), df.limit(0)).where("contaminated OR n_hit > 0").count() == 0
    assert contamination.digests(frame(spark, docs).limit(0), df).count() == 0


def test_decontamination_of_a_long_item_and_clashing_columns(spark):
    rng = random.Random(16)
    words = noise(rng, 20_000).split()
    items = [(1, " ".join(words)), (2, " ".join(words[500:520])), (3, "only three words")]
    docs = [(1, " ".join(words[100:160])), (2, noise(rng, 40) + " " + " ".join(words[495:530])), (3, "x only three words y " * 3), (None, "only three words")]
    whole = (4, " ".join(words))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.digests(frame(spark, docs), df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((d, *x[1:]) for d, x in zip([r[0] for r in docs], (hits_by_force([(0, t)], items)[0] for _, t in docs))), key=str)
    assert [tuple(r)[1:4] for r in contamination.digests(frame(spark, [whole]), df).collect()] == [(20_000, 20_000, 2)]
    clash = frame(spark, docs).withColumns({c: F.lit("mine") for c in ("n_words", "items", "words", "key", "hash")})
    out = contamination.contaminated(clash, df)
    assert out.columns.count("items") == 1 and {r.words for r in out.collect()} == {"mine"}


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    items = [(k, noise(rng, 30)) for k in range(5)]
    docs = [(k, noise(rng, 20) + " " + items[k % 5][1]) for k in range(20)]
    got = contamination.digests(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == hits_by_force(docs, items)


# Licences


def test_licences_by_force(spark):
    rng = random.Random(10)
    ready = [(name, t) for name, t in licences.TEMPLATES]
    texts = [(k, "\n".join([noise(rng, 5), rng.choice(ready)[1].upper() if k % 2 else rng.choice(ready)[1], "released UNDER the mit licence"])) for k in range(40)]
    texts += [(50, None), (51, ""), (52, "MIT"), (53, ready[-1][1]), (54, " ".join(ready[0][1].split()[:3]))]
    bigrams = lambda t: {*zip(w := [x.lower() for x in re.findall("[A-Za-z0-9]+", t)], w[1:])}
    want = []
    for d, t in texts:
        for unit, x in enumerate([t or "", *(t or "").split("\n")]):
            a = bigrams(x)
            best = min(((-2 * len(a & bigrams(y)) / (len(a) + len(bigrams(y))), name) for name, y in ready if a), default=(0, ""))
            if best[0] <= -0.8:
                want.append((d, unit, best[1], round(-best[0], 9)))
    got = sorted((r.doc_id, r.unit, r.license_id, round(r.score, 9)) for r in licences.scan(frame(spark, texts)).collect())
    assert got == sorted(want) and any(u == 0 for _, u, _, _ in got)
    assert licences.scan(frame(spark, texts).limit(0)).count() == 0
    empty = spark.createDataFrame([], "license_id string, text string")
    assert licences.scan(frame(spark, texts), empty).count() == 0


def test_licences_in_prose_and_over_lines(spark):
    rng = random.Random(11)
    filler = lambda n: textwrap.fill(noise(rng, n), 76)
    texts, want = [], []
    for k, (name, t) in enumerate(licences.TEMPLATES):
        for j, wrapped in enumerate((textwrap.fill(t, 72), textwrap.fill("// " + t, 78), f"{noise(rng, 30)}. {t} {noise(rng, 30)}")):
            texts.append((10 * k + j, f"{filler(200)}\n{wrapped}\n\n{filler(200)}"))
            want.append((10 * k + j, name))
    texts += [(900, filler(400)), (901, f"{filler(50)} Released under the MIT License. {filler(50)}\nLicensed under CC BY 4.0.\n{filler(9)} Licensed under CC BY 4.0. {filler(40)}")]
    got = {r.doc_id: r for r in licences.digests(frame(spark, texts)).collect()}
    assert [(d, got[d].licenses) for d, _ in want] == want
    assert {got[d].best_score for d, _ in want if d % 10 < 2} == {1.0}
    assert {got[d].n_units for d, _ in want} == {1, 2}  # 2: the first line matches a shorter template too
    assert tuple(got[900])[1:] == (0, "", 0.0)
    assert tuple(got[901])[1:] == (3, "CC-BY-4.0,MIT", 1.0)


def test_licences_of_repeated_and_null_ids(spark):
    rows = [(2, "Released under the MIT License."), (2, "nothing"), (3, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0."), (None, None)]
    got = sorted((str(r.doc_id), r.n_units, r.licenses) for r in licences.digests(frame(spark, rows)).collect())
    assert got == [("2", 0, ""), ("2", 2, "MIT"), ("3", 2, "CC-BY-4.0"), ("3", 2, "CC-BY-4.0"), ("None", 0, ""), ("None", 2, "CC-BY-4.0")]


def test_licence_runs_by_force(spark):
    rng = random.Random(12)
    kinds = [("A", "a b c d e"), ("B", "b c b d a c"), ("C", "e d c b a e b")]
    texts = [(k, "".join(rng.choice("abcdexyz") + rng.choice("  \n") for _ in range(60))) for k in range(60)]
    bigrams = lambda w: {*zip(w, w[1:])}
    score = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    sets = [(name, bigrams(t.split())) for name, t in kinds]
    templates = spark.createDataFrame(kinds, "license_id string, text string")
    rows = licences.scan(frame(spark, texts), templates, runs=True).collect()
    assert any(r.unit < 0 for r in rows)
    for d, t in texts:
        w, lines = t.split(), [x.split() for x in t.split("\n")]
        ours = [r for r in rows if r.doc_id == d]
        top = max((score(bigrams(w[i : i + n + 1]), b) for _, b in sets for n in range(1, int(1.5 * len(b)) + 1) for i in range(len(w) - n)), default=0)
        assert (max((r.score for r in ours), default=0) == pytest.approx(top)) if top >= 0.8 else not ours, t
        for r in ours:
            near = [b for name, b in sets if name == r.license_id]
            if r.unit < 0:
                assert any(score(bigrams(w[-r.unit - 1 : -r.unit + n]), b) == pytest.approx(r.score) for b in near for n in range(1, 20))
            else:
                assert any(score(bigrams(lines[r.unit - 1] if r.unit else w), b) == pytest.approx(r.score) for b in near)


# Language and quality


def language_rows(n, seed):
    rng = random.Random(seed)
    lexicon = {"en": "the and of to in that is was for with house water".split(), "de": "der die und das nicht mit ein haus wasser ich".split(), "fr": "le la les et une dans pour eau maison est".split()}
    return [(k, " ".join(rng.choices(lexicon[x := rng.choice([*lexicon])], k=30)), x) for k in range(n)]


def test_language_learns_from_whole_texts(spark):
    docs = frame(spark, [(1, "the same " * 3000 + "last"), (2, None)], {1: "en", 2: "en"})
    assert language.fit(docs.select("doc_id", "text", "lang")) == {"en": [b" " + b"the same " * 3000 + b"last "]}


def test_language_sample_is_bounded_and_takes_documents_whole(spark):
    docs = frame(spark, [(k, f"doc {'x' * k} end") for k in range(60)] + [(k, "y" * 500) for k in (100, 101)] + [(200, "12")], {**dict.fromkeys(range(60), "en"), 100: "de", 101: "de", 200: "fr"})
    got = language.fit(docs.select("doc_id", "text", "lang"), sample_bytes=900)
    assert sum(map(len, got["en"])) <= 300 and all(t.startswith(b" doc ") and t.endswith(b" end ") for t in got["en"])
    assert got["de"] == [b" " + b"y" * 300 + b" "] and "fr" not in got


def test_phrases_in_lockstep_match_the_automaton(monkeypatch):
    rng = random.Random(15)
    samples = {x: [("".join(rng.choice(letters) for _ in range(200))).encode()] for x, letters in (("a", "abc "), ("b", "bcdé "), ("c", "xyz"))}
    model, stretch = language.Model(samples), 16
    monkeypatch.setattr(language, "STRETCH", stretch)
    texts = ["".join(rng.choice("abcdexyzé ü") for _ in range(rng.randint(0, 90))).encode() for _ in range(200)]
    got = model.phrases(texts)
    for row, x in zip(got, model.languages):
        automaton = language.SuffixAutomaton(samples[x][0])
        assert row.tolist() == [sum(automaton.phrases(t[k : k + stretch]) for k in range(0, len(t), stretch)) for t in texts]
    assert model.phrases([]).shape == (3, 0) and language.Model({}).predict(["a", None]) == [("und", 0.0)] * 2


def test_only_letters_have_a_language(spark):
    docs = frame(spark, [(1, "the house"), (2, "½ ② ⅷ 12 ²"), (3, "\u0301 _ 中"), (4, "ª")], {1: "en"})
    assert {r.doc_id: r.lang_pred for r in language.identify(docs.withColumn("score", docs["text"])).collect()} == {1: "en", 2: "und", 3: "en", 4: "en"}


def test_language_ties_go_to_the_first_name():
    found = language.Model({"b": [b" one two "], "a": [b" one two "]}).predict(["one two", "\ud800x"])
    assert found[0] == ("a", 0.5) and found[1][0] == "a"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the synthetic tables")
def test_held_out_accuracy_on_the_synthetic_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    by_lang = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    assert by_lang.agg({"doc_id": "count"}).first()[0] > 100
    assert by_lang.selectExpr("avg(int(lang_pred = lang)) AS x").first().x >= 0.97
    by_quality = quality.classify(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    assert by_quality.selectExpr("avg(int(predicted = quality)) AS x").first().x >= 0.95


def test_language_on_held_out_rows(spark):
    rows = language_rows(300, 11)
    docs = frame(spark, [*((k, t) for k, t, _ in rows), (900, None), (901, "123 !? \n"), (902, ""), (903, "der " * 50_000), (None, "the water of the house")], {k: x for k, _, x in rows})
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [(k, x) for k, _, x in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {got[k].held_out for k, _ in held} == {True} and all(got[k].lang_pred == x for k, x in held)
    assert [got[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("lang IS NULL")).collect()} == {"und"}


def test_the_automaton_knows_every_substring():
    rng = random.Random(12)
    text = "".join(rng.choice("abc") for _ in range(60))
    automaton = language.SuffixAutomaton(text)
    for a in range(60):
        for b in range(a + 1, 61):
            assert automaton.phrases(text[a:b]) == 1
    for _ in range(300):
        probe, n, k = "".join(rng.choice("abcd") for _ in range(12)), 0, 0
        while k < len(probe):
            j = k
            while j < len(probe) and probe[k : j + 1] in text:
                j += 1
            n, k = n + 1, max(j, k + 1)
        assert automaton.phrases(probe) == n


def test_quality_on_held_out_rows(spark):
    rng = random.Random(13)
    texts = [(k, noise(rng, 40) if k % 2 else " ".join(x.upper() + "!!" for x in noise(rng, 40).split())) for k in range(400)] + [(900, None), (901, ""), (902, "ab"), (903, "word " * 30_000)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k].predicted == k % 2 for k in held) > 0.97 * len(held) and all(got[k].held_out for k in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and len(got) == len(texts)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


# The pipeline and the registry


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    passage = noise(rng, 30)
    texts = [(k, noise(rng, 60) + "\nthis very line is in all the documents") for k in range(30)]
    texts += [(50, texts[4][1]), (51, passage), (52, "12345"), (53, None)]
    frame(spark, texts, {k: "en" for k in range(30)}).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(30)) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
    assert all(("this very line" in r.text) == (k == 50) for k, r in out.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "bpe"]


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
