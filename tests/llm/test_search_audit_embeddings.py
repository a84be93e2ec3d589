"""The lexical search, the filter audit and the embedding groups against brute force; the samples that language learns from."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import embedding_dedup, filter_audit, language, lexical, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, **more):
    return spark.createDataFrame([(k, t, None, more.get("sources", {}).get(k, "s"), 0) for k, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))], DOCS)


# -- lexical search


def words(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """docs: (id, text); items: {id: text}."""
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items.items():
        scores = []
        for i, c in held:
            if i is None:
                continue
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def found(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def corpus(seed, n, longest=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["É", "naïve", "Über", "x_y", "Ab", "aB", "日本", "a b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize(("postings", "block"), [(1 << 20, 128), (150, 4), (1, 1)])
def test_search_is_exact_whatever_the_shards_and_blocks(spark, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    texts = corpus(3, 120) + [None, "", " ?! ", "w1 w1 w1", "w1 w1 w1"]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "w1 w2 w90", None, None, 0), (7, "w3 w3 É", None, None, 0)], DOCS))
    items = {1: "w0 w1 w1 É é", 2: "W40 naïve", 3: "nothing here", 4: "", 6: "日本 a b x_y ab AB", 7: " ".join(corpus(5, 30))}
    rows = spark.createDataFrame([*items.items(), (5, None), (None, "w1"), (1, "w0 w1 w1 É é")], "item_id long, text string")
    built = lexical.build(docs.withColumn("term", F.lit(1)).repartition(3), postings)
    want = ranked([(k, t) for k, t in enumerate(texts)] + [(None, "w1 w2 w90"), (7, "w3 w3 É")], items)
    assert found(lexical.search(lexical.saved(built), rows.withColumn("shard", F.lit("x")))) == want


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(documents(spark, [None, "", "--"]), items).count() == 0
    assert found(lexical.ranked(docs, items)) == ranked([(0, "a b")], {1: "a"})


def test_items_in_several_lots(spark, monkeypatch):
    monkeypatch.setattr(lexical, "LOT_ITEMS", 3)
    texts, items = corpus(8, 60), {str(k): t for k, t in enumerate(corpus(9, 20, 12))}
    rows = spark.createDataFrame([*items.items()], "item_id string, text string")
    assert found(lexical.ranked(documents(spark, texts), rows, 4)) == ranked([*enumerate(texts)], items, 4)


def test_a_very_long_text_and_a_very_frequent_word(spark):
    long = "common " * 150_000 + "rare"
    texts = [long] + [f"common {'filler ' * (k % 9)} x{k % 5}" for k in range(300)]
    items = {1: "common rare x3", 2: "common"}
    rows = spark.createDataFrame([*items.items()], "item_id long, text string")
    assert found(lexical.ranked(documents(spark, texts), rows)) == ranked([*enumerate(texts)], items)


def test_blocks_below_the_threshold_stay_packed():
    """The document that has all terms is in one block; where only the frequent term is, nothing is decompressed."""
    shard = lexical._Shard()
    for k in range(6000):
        shard.add(k, [b"often"] * (1 + k % 3) + [b"filler"] * 20 + ([b"rare", b"often"] if 3000 <= k < 3012 else []))
    rows = [r for batch in shard.rows(0, 6000, 6000 * 22) for r in batch.to_pylist()]
    lists = {r["term"]: lexical.Postings(r["n"], r["heads"], r["data"], np.frombuffer(rows[0]["data"], "<i8")) for r in rows if r["term"]}
    query = [(lists["rare"], 9000), (lists["often"], 3)]
    top, read = lexical.best(query, np.zeros(6000, np.int64), 10)
    assert {p for _, p in top} <= {*range(3000, 3012)} and len(top) == 10
    assert read <= 10 and not lists["often"].open.all() and len(lists["often"].first) == 47


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**33), max_size=300))
def test_numbers_survive_packing(values):
    data, ends = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(data).tolist() == values and (len(ends) == 0 or ends[-1] == len(data))


# -- filter audit


def failures(rows):
    """{row number: set of the filters failed}, by the contract's words."""
    out = {}
    for n, (doc_id, _, text) in enumerate(rows):
        text = text or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        out[n] = {
            f
            for f, bad in zip(
                "ABCDE",
                (
                    len(ws) < 50,
                    100 * len(set(ws)) < 65 * len(ws),
                    100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    bool(re.search(r"[#$%&*|]", text)),
                    doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, _, t in rows),
                ),
                strict=True,
            )
            if bad
        }
    return out


def audited(rows, labels):
    failed, out = failures(rows), {}
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    parts = defaultdict(list)
    for n, (_, source, _) in enumerate(rows):
        parts[source or ""].append(n)
    for part, members in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = set(members)
            for step, f in enumerate(order, 1):
                gone = {n for n in left if f in failed[n]}
                fails = {n for n in members if f in failed[n]}
                left -= gone
                total[f] += len(gone)
                ids = [rows[n][0] for n in gone]
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(failed[n] == {f} for n in fails), sum(i in good for i in ids), sum(i in toxic for i in ids)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_is_that_of_applying_every_order(spark):
    rng = random.Random(2)
    plain = lambda n, kinds: " ".join(f"word{rng.randrange(kinds)}" for _ in range(n))
    rows = [(k, rng.choice(["a", "b", None, ""]), rng.choice([plain(60, 500), plain(60, 20), plain(10, 50), "SHOUT " * 60, plain(70, 900) + " 50%", "", None, "ÀÉ Ü x", "copy of one"])) for k in range(120)]
    rows += [(200, "a", "copy of one"), (3, "b", rows[3][2]), (None, "a", "copy of one"), (None, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, s, t in rows], DOCS).withColumns({"part": F.lit(1), "mask": F.lit("x")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.interactions(docs, known).collect()}
    assert got == audited(rows, labels) and len(got) == 3 * 600


def test_audit_of_nothing_and_of_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(documents(spark, []), none).count() == 0
    long = "word " * 200_000 + "%"
    got = {(r.step, r.filter_order): r.removed for r in filter_audit.interactions(documents(spark, [long, long]), none).where("filter_order = 'ABCDE'").collect()}
    assert [got[k, "ABCDE"] for k in range(1, 6)] == [0, 2, 0, 0, 0]


def test_polynomials_of_other_numbers_of_filters(spark):
    """Three filters: corners and Shapley values against inclusion and exclusion by hand."""
    sets = spark.createDataFrame([("p", 0, 4, 0, 0), ("p", 1, 3, 0, 0), ("p", 3, 2, 1, 0), ("p", 7, 5, 0, 2)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(sets, "XYZ").collect()}
    assert len(rows) == 18 and [rows["XYZ", k].kept for k in (1, 2, 3)] == [4, 4, 4] and [rows["ZYX", k].removed for k in (1, 2, 3)] == [5, 2, 3]
    shares = {o[k - 1]: r.shapley for (o, k), r in rows.items()}
    assert shares == {"X": 6 * 3 + 3 * 2 + 2 * 5, "Y": 3 * 2 + 2 * 5, "Z": 2 * 5}


# -- embedding groups


def brute(rows, least=0.9):
    """rows: (id, vector or None). n_links, component, kept of each row number."""
    sound = [n for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a in sound:
        for b in sound:
            x, y = (np.array(rows[n][1], float) / np.abs(rows[n][1]).max() for n in (a, b))
            if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        component = min((rows[m][0] for m in seen), default=None) if i is not None else None
        out[n] = (len(links[n]), component, i == component)
    return out


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 40)
    rng = np.random.default_rng(0)
    rows = []
    for k in range(260):
        base = rng.standard_normal(8)
        rows.append((k, base.tolist()))
        if k % 9 == 0:
            rows += [(1000 + 10 * k + j, (base + 0.2 * rng.standard_normal(8)).tolist()) for j in range(4)]
    rows += [(5000 + j, rows[0][1]) for j in range(150)]  # copies, more than a tile
    rows += [(6000 + j, (np.eye(8)[0] + 0.1 * rng.standard_normal(8)).tolist()) for j in range(130)]  # near copies, more than a tile
    rows += [(7000, None), (7001, []), (7002, [0.0] * 8), (7003, [float("nan")] + [1.0] * 7), (7004, [float("inf")] + [1.0] * 7), (7005, [None] + [1.0] * 7), (None, rows[0][1]), (7006, [1e-200] * 8), (7007, [1e200] * 8), (7008, [1.0] * 8), (7009, [1.0, 2.0]), (7010, [2.0, 4.0]), (7011, [-0.0, 1.0]), (7012, [0.0, 1.0]), (5, [9.0] * 7 + [8.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "cell": F.lit("x"), "vector": F.lit(None)})
    want = brute(rows)
    got = embedding_dedup.groups(df.repartition(5), probes=64).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter((rows[n][0], *w) for n, w in want.items())


def test_most_links_are_found_in_few_cells(spark):
    """Pairs at the very threshold, the hardest to keep together: nine in ten are found at the usual number of cells."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.standard_normal((1500, 64))
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosines = rng.uniform(0.9001, 0.92, (1500, 1))
    rows = np.vstack([base, cosines * base + np.sqrt(1 - cosines**2) * aside])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.groups(df).collect()}
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum() - len(u)
    assert sum(r.n_links for r in got.values()) >= 0.9 * links
    assert all(got[k].n_links <= int((u[k] @ u.T >= 0.9).sum()) - 1 for k in range(0, 3000, 50))


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.groups(none).count() == 0
    lone = spark.createDataFrame([(4, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.groups(lone).collect()), key=str) == [(4, 0, 4, True), (None, 0, None, True)]


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        root = embedding_dedup.forest(n, a, b)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert (root == want).all()


# -- samples of language and quality


def test_a_thousand_languages(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(1000):
        own = ["".join(rng.choices(letters, k=7)) for _ in range(6)]
        rows += [(len(rows) + j, " ".join(rng.choices(own, k=9)), f"l{k:04}", "s", 0) for j in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    samples = language.fit(language.training_rows(docs))
    learned = {r[2] for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5}
    assert samples.keys() == learned and len(learned) > 980 and sum(map(len, map(b"".join, samples.values()))) <= 260_000
    few = docs.where("doc_id % 97 = 0")
    got = {r.doc_id: r.lang_pred for r in few.select("doc_id", language.predicted(few, samples).alias("p")).select("doc_id", "p.lang_pred").collect()}
    assert sum(got[r[0]] == r[2] for r in rows if r[0] in got) >= 0.9 * len(got)


def test_more_languages_than_are_learned(spark):
    docs = spark.createDataFrame([(k, f"text{k} of its own", f"l{k % 7}" if k < 70 else f"x{k}", "s", 0) for k in range(90)], DOCS)
    assert set(language.fit(docs, most_languages=7)) == {f"l{k}" for k in range(7)}


def test_long_documents_teach_from_their_whole_length(spark):
    rng = random.Random(6)
    rows = []
    for k, (lang, stems) in enumerate([("aa", "ka ro mi tu"), ("bb", "schn erg ung ein"), ("aa", "ka ro mi tu"), ("bb", "schn erg ung ein")]):
        first, last = f"{lang}begin ", f" {lang}end"
        text = first * 500 + " ".join("".join(rng.choices(stems.split(), k=3)) for _ in range(60_000)) + last * 500
        rows.append((k, text, lang, "s", 0))
    samples = language.fit(spark.createDataFrame(rows, DOCS).coalesce(1))
    for lang in ("aa", "bb"):
        text = b"".join(samples[lang])
        assert 100_000 < len(text) < 125_000 and f"{lang}begin".encode() in text and f"{lang}end".encode() in text


def test_language_and_quality_with_clashing_columns(spark):
    docs = documents(spark, {k: ("der hund und die katze " if k % 2 else "the dog and the cat ") * (k % 5 + 1) for k in range(40)})
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en")).withColumns({c: F.lit("clash") for c in ("lang_pred", "score", "held_out", "p", "__at", "__size", "predicted", "counts", "side")})
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert got == {k: "de" if k % 2 else "en" for k in range(40)}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    rows = quality.classify(docs.unionByName(docs.where("doc_id = 3")).withColumn("quality", F.lit(7)), labels).collect()
    assert len(rows) == 41 and sum(r.predicted == r.doc_id % 2 for r in rows) >= 39


def test_quality_is_the_vote_of_the_nearest_labelled_texts(spark):
    rng = random.Random(12)
    texts = {k: " ".join(rng.choices(["alpha", "beta", "gamma"] if k % 2 else ["BUY", "now", "!!!", "alpha"], k=30 + k % 20)) for k in range(240)}
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(240)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.training_labels(labels))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for k, text in texts.items():
        counts = quality.features(text)
        weighted = np.concatenate([counts[: quality.BUCKETS] * model.weights, counts[quality.BUCKETS :]])
        size = np.linalg.norm(weighted[: quality.BUCKETS])
        row = np.concatenate([weighted[: quality.BUCKETS] / size, quality.SHAPE_WEIGHT * weighted[quality.BUCKETS :]]) @ model.basis
        near = model.vectors @ (row / np.linalg.norm(row))
        top = np.sort(near)[::-1]
        if top[quality.NEIGHBOURS - 1] - top[quality.NEIGHBOURS] < 1e-5:
            continue  # a tie for the last place
        at = np.argsort(-near)[: quality.NEIGHBOURS]
        assert abs(got[k] - (np.maximum(near[at], 0) @ model.labels[at]) / np.maximum(near[at], 0).sum()) < 1e-3


def test_repeated_ids_do_not_crowd_out_labelled_texts(spark):
    texts = [(k, f"good calm words {k} " * 20, None, "s", 0) for k in range(30)] + [(100 + k, f"BAD !!! {k} " * 20, None, "s", 0) for k in range(30)]
    many = texts + [(k % 5, f"good calm words {k} again " * 9, None, "s", 0) for k in range(600)]
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(many, DOCS), labels, each=40)
    assert len(model.labels) == 60 and sorted(model.labels.tolist()) == [0.0] * 30 + [1.0] * 30
