"""Long texts, null ids and empty tables for the operators and the pipeline."""

import hashlib
import random
import time

import pyarrow as pa
import xxhash

import corpus_pipeline
from shelfmark.llm import licences, line_dedup, quality, simhash, topk, worker

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, root, docs, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def prose(rng, n, stems):
    return " ".join("".join(rng.choices(stems, k=3)) for _ in range(n))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, [], [(1, "a passage")]))
    assert out.count() == 0 and {"doc_id", "text", "ids", "n_tokens", "round_trip"} <= {*out.columns}


def test_pipeline_stage_by_stage_with_nulls_and_long_texts(spark, tmp_path):
    rng = random.Random(3)
    en, de = ["tha", "ing", "shu", "wer", "one"], ["sch", "ung", "ein", "lich", "ver"]
    passage = prose(rng, 30, en)
    line = "a line that stands in very many documents of this table"
    docs = [(k, prose(rng, 60, en if k % 2 else de), "en" if k % 2 else "de", "s", 0) for k in range(30)]
    docs += [(100 + k, f"{prose(rng, 50, en)}\n{line}\n{prose(rng, 50, en)}", "en", "s", 0) for k in range(4)]
    docs += [(200, docs[3][1], "en", "s", 0), (201, f"{prose(rng, 40, en)} {passage}", "en", "s", 0), (None, prose(rng, 70, en), "en", "s", 0), (None, None, None, None, None), (203, None, "en", "s", 0), (204, "", "en", "s", 0), (205, "12 34 !!", "en", "s", 0)]
    docs += [(300, prose(rng, 40_000, de), "de", "s", 0)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tables(spark, tmp_path, docs, [(1, passage), (None, line), (2, None)])).collect()}
    assert got.keys() == ({d[0] for d in docs} - {200, 201, 203, 204, 205})  # the copy, the contaminated one, those without a letter
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in got.values())
    assert [line in got[100 + k].text for k in range(4)] == [False, False, False, True]
    assert got[300].text == docs[-1][1] and got[None].text == docs[36][1]


def test_a_file_of_many_notices(spark):
    """Each notice is found, and the work grows with the text, not with its square."""
    rng = random.Random(1)
    mit = licences.TEMPLATES[-1][1]
    notices = lambda n: "\n".join(f"{mit}\n{prose(rng, 150, ['tha', 'ing', 'shu', 'wer'])}" for _ in range(n))
    took = {}
    for n in (8, 8, 40):  # the first compiles
        began = time.time()
        rows = licences.scan(spark.createDataFrame([(1, notices(n))], "doc_id long, text string"), runs=True).collect()
        took[n] = time.time() - began
        assert sum(r.license_id == "MIT" for r in rows) == n and len(rows) == n
    assert took[40] < 12 * took[8]


def test_long_texts_of_near_copies_and_lines(spark):
    rng = random.Random(9)
    long = prose(rng, 120_000, ["tha", "ing", "shu", "wer", "one"])
    near = long.replace("tha", "Tha", 5)
    docs = spark.createDataFrame([(1, long), (2, near), (3, "another text altogether"), (4, long + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.digests(docs).collect()}
    words = long.lower().split()
    ones = [0] * 64
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    assert int(got[1].fingerprint, 16) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 3)
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    lines = [prose(rng, 8, ["tha", "ing", "shu"]) for _ in range(9000)]
    docs = spark.createDataFrame([(k, "\n".join(lines + [f"the own line of document {k}"])) for k in range(3)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.digests(docs).collect()}
    assert [out[k].n_lines for k in range(3)] == [9001] * 3 and [out[k].n_dropped for k in range(3)] == [9000, 9000, 0]
    assert out[0].kept_sha256 == hashlib.sha256(b"the own line of document 0").hexdigest()


def test_null_ids_of_quality_and_search(spark):
    docs = spark.createDataFrame([(k, "good calm words " * 9 if k % 2 else "BAD !!! " * 9) for k in range(30)] + [(None, "good calm words " * 9), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 0)], "doc_id long, quality int")
    rows = [r for r in quality.classify(docs, labels).collect() if r.doc_id is None]
    assert sorted((r.held_out, 0 <= r.score <= 1) for r in rows) == [(False, True), (False, True)] and max(r.predicted for r in rows) == 1
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, None), (8, [None, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(vectors).collect()) == [(0, 1, 50, 32768), (50, 1, 0, 32768)]


def test_stages_without_a_model_give_up_the_worker_s():
    for stage in (lambda: simhash.fingerprints.func(pa.array(["a b", None])), lambda: list(line_dedup._hashed(20)(iter([])))):
        worker.resident("model", lambda: object())
        stage()
        assert not worker._HELD
