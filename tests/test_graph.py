"""Neighbour graphs against numpy: exact blocks, random projections with their recall, labels along the graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import graph, retrieve

SF = "/root/testdata/sf0.01"


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in r]) for k, r in enumerate(rows)], "id long, vec array<double>")


def units(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs(df):
    return {(r["query"], r["key"]) for r in df.collect()}


def test_nearest_is_exact_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 17)
    x = units(np.random.default_rng(1), 90, 6)
    x[40] = x[3]  # a tie goes to the smaller key
    got = {(r.query, r.rank): (r.key, r.score) for r in graph.nearest(frame(spark, x).where("id % 5 = 0"), frame(spark, x).repartition(3), "id", 4).collect()}
    scores = np.round(x @ x.T, 6)
    for q in range(0, 90, 5):
        want = sorted((-scores[q, j], j) for j in range(90) if j != q)[:4]
        assert [got[q, r] for r in range(1, 5)] == [(j, -s) for s, j in want]
    assert len(got) == 18 * 4


def test_nearest_of_few_none_and_null_rows(spark):
    some = frame(spark, [[1, 0], [0, 1]])
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (9, None)], "id long, vec array<double>")
    assert [(r.query, r.key) for r in graph.nearest(some, some.unionByName(nulls), "id", 5).orderBy("query").collect()] == [(0, 1), (1, 0)]
    assert graph.nearest(some.limit(0), some, "id", 5).count() == 0
    assert graph.nearest(some, some.limit(0), "id", 5).count() == 0
    with pytest.raises(Exception, match="number of components"):
        graph.nearest(some, frame(spark, [[1, 0, 0], [1, 0]]).coalesce(1), "id", 1).collect()


def test_projections_find_close_rows_and_compare_few(spark):
    rng = np.random.default_rng(7)
    centres = units(rng, 60, 16)
    x = np.repeat(centres, 10, axis=0) + 0.05 * rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, x)
    asked = rows.where("id % 10 = 0")
    tables = graph.lsh_tables(rows, 12, 6, 0.4)
    found = graph.lsh_neighbors(asked, rows, "id", tables, k=9)
    exact = graph.nearest(asked, rows, "id", 9)
    assert graph.recall(found, exact).first().recall >= 0.9
    assert graph.lsh_candidates(asked, rows, "id", tables).count() < 0.35 * 60 * 599
    wanted = {(r["query"], r["key"]): r.score for r in exact.collect()}
    assert all(wanted.get((r["query"], r["key"]), r.score) == r.score for r in found.collect())  # the scores are exact


def test_projections_recall_of_the_exact_search(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    asked = vectors.where("vec_id = 0")
    found = graph.lsh_neighbors(asked, vectors, "vec_id", graph.lsh_tables(vectors, 16, 2, 0.5), k=20)
    exact = retrieve.neighbors(vectors, "vec_id", 0, 20).select(F.lit(0).cast("long").alias("query"), F.col("vec_id").alias("key"))
    row = graph.recall(found, exact).first()
    assert row.n == 20 and row.recall >= 0.9


def brute(x, least, digits=6):
    scores = x @ x.T
    return {(a, b): round(float(scores[a, b]), digits) for a in range(len(x)) for b in range(len(x)) if a != b and round(float(scores[a, b]), digits) >= least}


@pytest.mark.parametrize(("count", "width", "bucket"), [(1, 1, 100.0), (2, 1, 0.5), (6, 3, 0.4)])
def test_projections_score_candidates_without_shuffling_pairs(spark, monkeypatch, count, width, bucket):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    monkeypatch.setattr(graph, "CELL_NUMBERS", 400)  # several groups and parts
    x = units(np.random.default_rng(4), 150, 6)
    x[70] = x[2]
    rows = frame(spark, x)
    tables = graph.lsh_tables(rows, count, width, bucket)
    found = graph.lsh_neighbors(rows, rows, "id", tables, least=0.3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [((r["query"], r["key"]), r.score) for r in found.collect()]
    assert len({p for p, _ in got}) == len(got)  # a pair comes once, however many tables bring it together
    asked = pairs(graph.lsh_candidates(rows, rows, "id", tables))
    assert dict(got) == {p: s for p, s in brute(x, 0.3).items() if p in asked}
    best = {(r["query"], r["rank"]): (r["key"], r.score) for r in graph.lsh_neighbors(rows, rows, "id", tables, k=2).collect()}
    every = brute(x, -9)
    for q in range(len(x)):
        want = sorted((-every[q, b], b) for a, b in asked if a == q)[:2]
        assert [best[q, k + 1] for k in range(len(want))] == [(b, -s) for s, b in want]


@pytest.mark.parametrize(("numbers", "table"), [(1 << 23, (1, 1, 100.0)), (400, (6, 3, 0.4)), (400, (1, 1, 100.0))])
def test_pairs_of_one_table_are_those_of_two(spark, monkeypatch, numbers, table):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 16)
    monkeypatch.setattr(graph, "CELL_NUMBERS", numbers)
    x = units(np.random.default_rng(8), 200, 4)
    x[50:120] = x[3]  # a group of copies
    odd = [(None, [1.0, 0.0, 0.0, 0.0]), (900, None), (901, [float("nan"), 1.0, 0.0, 0.0]), (902, [None, 1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.0])]  # 7 is there twice
    rows = frame(spark, x).unionByName(spark.createDataFrame(odd, "id long, vec array<double>"))
    tables = graph.lsh_tables(rows, *table)
    for asked, digits in ((rows, 6), (rows.limit(0), 6), (rows.where("id = 3"), 6), (rows, 1)):
        one, two = (sorted(map(tuple, graph.lsh_neighbors(asked, held, "id", tables, least=0.3, digits=digits).collect())) for held in (asked, asked.select("*")))
        assert one == two and (len(one) > 70 * 69 or asked is not rows)
        assert sorted((b, a, s) for a, b, s in one) == one


def test_nearest_of_many_copies_odd_numbers_and_halves(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_NUMBERS", 200)
    x = np.array([[1.0, 0.0]] * 80 + [[0.6, 0.8]] * 40 + [[1e200, 0.0], [1e-3, 0.0]])
    rows = frame(spark, x).unionByName(frame(spark, [[float("nan"), 1.0], [float("inf"), 0.0]], 900))
    got = {(r["query"], r["rank"]): (r["key"], r.score) for r in graph.nearest(rows, rows, "id", 4).collect()}
    assert [got[0, k][0] for k in range(1, 5)] == [120, 1, 2, 3] and [got[79, k][0] for k in range(1, 5)] == [120, 0, 1, 2]
    assert [got[100, k][0] for k in range(2, 5)] == [80, 81, 82] and len(got) == 122 * 4
    halves = frame(spark, [[0.0078125], [1.0], [-1.0]])
    assert {(r["query"], r["key"]): r.score for r in graph.nearest(halves.where("id = 0"), halves, "id", 2).collect()} == {(0, 1): 0.007813, (0, 2): -0.007813}


def test_neighbours_are_worked_out_once(spark):
    rows = frame(spark, units(np.random.default_rng(5), 60, 4))
    found = graph.nearest(rows, rows, "id", 3)
    assert graph.undirected(found)._jdf.queryExecution().optimizedPlan().toString().count("InArrow") == 1
    assert graph._pairs(rows, rows, "id", 3, None, 6).count() <= 60 * 3 * graph.PARTS  # a task's best, not a block's


def test_recall_of_nothing_wanted_is_whole(spark):
    none = spark.createDataFrame([], "query long, key long")
    assert graph.recall(none, none).first().recall == 1.0


def test_pseudo_labels_need_agreement_and_similarity(spark):
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (2, 10, 0.9), (2, 13, 0.9), (3, 12, 0.1), (4, 99, 0.9)], "query long, key long, score double")
    labels = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, "b"), (14, None)], "key long, label string")
    got = {r["query"]: (r.label, round(r.agreement, 6), round(r.similarity, 6), round(r.weight, 6)) for r in graph.pseudo_labels(near, labels, 0.6, 0.2).collect()}
    assert got == {1: ("a", 0.666667, 0.85, 0.566667)}
    tied = {r["query"]: r.label for r in graph.pseudo_labels(near, labels, 0.5, 0.2).collect()}
    assert tied == {1: "a", 2: "a"}


def harmonic(n, edges, seeds, labels):
    """The shares at rest: the solution of the linear system that the rounds converge to, on nodes that a seed reaches."""
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    free = [v for v in range(n) if v not in seeds]
    reached = {*seeds}
    while more := {v for v in free if v not in reached and any(w[v, u] for u in reached)}:
        reached |= more
    free = [v for v in free if v in reached]
    y = np.array([[float(seeds.get(v) == c) for c in labels] for v in range(n)])
    p = w / np.where(w.sum(1, keepdims=True) > 0, w.sum(1, keepdims=True), 1)
    y[free] = np.linalg.solve(np.eye(len(free)) - p[np.ix_(free, free)], p[np.ix_(free, [*seeds])] @ y[[*seeds]])
    return {(v, c): y[v, k] for v in reached for k, c in enumerate(labels) if y[v, k] > 1e-12}


def test_label_spread_converges_to_the_harmonic_shares(spark):
    rng = np.random.default_rng(3)
    edges = sorted({tuple(sorted(map(int, rng.choice(24, 2, replace=False)))) for _ in range(45)})
    weighted = [(a, b, round(float(rng.uniform(0.1, 1)), 3)) for a, b in edges] + [(24, 25, 0.5)]  # two that no seed reaches
    seeds = {0: "x", 5: "y", 9: "x", 17: "z"}
    rows = spark.createDataFrame(weighted + [(b, a, w) for a, b, w in weighted], "src long, dst long, w double")
    got = graph.label_spread(rows, spark.createDataFrame([*seeds.items()], "node long, label string"), tolerance=1e-10)
    want = harmonic(26, weighted, seeds, "xyz")
    shares = {(r.node, r.label): r.p for r in got.collect() if r.p > 1e-12}
    assert shares.keys() == want.keys()
    assert all(abs(shares[k] - want[k]) < 1e-7 for k in want)
    best = {r.node: r.label for r in graph.spread_labels(got).collect()}
    assert all(best[v] == s for v, s in seeds.items()) and 24 not in best


def test_label_spread_on_edges_cases(spark):
    empty = spark.createDataFrame([], "src long, dst long, w double")
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (None, "a")], "node long, label string")
    assert sorted((r.node, r.label, r.p) for r in graph.label_spread(empty, seeds).collect()) == [(1, "a", 0.5), (1, "b", 0.5)]
    assert graph.label_spread(empty, seeds.limit(0)).count() == 0
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 2, 9.0), (2, 3, 0.0)], "src long, dst long, w double")
    got = {(r.node, r.label): r.p for r in graph.label_spread(loop, seeds.where("node = 1"), rounds=3).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 0.5, (2, "b"): 0.5}
    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)] + [(k + 1, k, 1.0) for k in range(6)], "src long, dst long, w double")
    with pytest.raises(ValueError, match="still change"):
        graph.label_spread(chain, spark.createDataFrame([(0, "a"), (6, "b")], "node long, label string"), tolerance=0.0, most=2)


def test_unit_rows_drop_zero_vectors(spark):
    got = graph.unit_rows(frame(spark, [[3, 4], [0, 0]])).collect()
    assert [(r.id, r.vec) for r in got] == [(0, [0.6, 0.8])]
