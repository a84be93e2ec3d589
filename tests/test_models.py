"""Cross-validation, purity, sketches, held indexes, points by range, train and predict drivers: against loops and numpy."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import geometry, learn, retrieve, review, sonic, stages, stats
from shelfmark.plans import catalog_queries
from shelfmark.schema import conform, schema
from shelfmark.sources.store import Store

SF = "/root/testdata/sf0.001"


def samples(spark, rows):
    return conform(spark.createDataFrame(rows), "samples")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df) -> str:
    """The plan that ran, adaptive changes included."""
    df.collect()
    return plan(df)


def separable(spark, n=90, classes=3, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = np.eye(dim)[k % classes] + rng.normal(0, 0.08, dim)
        rows.append((f"p{k:03}", [float(x) for x in v], [f"c{k % classes}"]))
    return spark.createDataFrame(rows, "path string, vec array<double>, targets array<string>")


def test_rows_are_judged_by_heads_of_their_own_fold(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [0.0, 2.0]), ("d", 0, None)], "path string, fold int, vec array<double>")
    heads = {0: [learn.Head("x", (1.0, 0.0), 0.0), learn.Head("y", (0.0, 0.0), 2.0)], 1: [learn.Head("x", (-1.0, 0.0), 0.0), learn.Head("y", (0.0, 1.0), 0.0)]}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    got = {r.path: r.probs for r in learn.out_of_fold(rows, heads).collect()}
    assert got["d"] is None
    for path, want in (("a", (1, 2)), ("b", (-1, 0)), ("c", (0, 2))):
        assert np.allclose(got[path], [sigmoid(z) for z in want])


def test_cross_validation_never_sees_the_row(spark):
    rows = separable(spark).where("path <> 'p007'").unionByName(spark.createDataFrame([(p, [0.0] * 5 + [9.0], ["odd"]) for p in ("p007", "p107")], "path string, vec array<double>, targets array<string>"))
    classes = ["c0", "c1", "c2", "odd"]
    checked = learn.cross_validate(rows, classes, 6)
    assert checked.count() == 91 and checked.groupBy("fold").count().count() == 5
    heads = [learn.Head(c, (0.0,) * 6, 0.0, 0.5) for c in classes]
    found = {r["class"]: r for r in learn.cv_report(checked, heads).collect()}
    assert all(found[c].f1 > 0.95 for c in classes[:3])
    assert found["odd"].tp == 0  # of its two rows no fold's training has both, so it can't be fitted


def test_training_notes_tell_of_singles_and_folds(spark):
    base = separable(spark, 80, 2)
    rows = [dict(path=f"p{k:03}", status="ok", human_instrument=f"c{k % 2}", label_source="single" if k % 3 else "map", is_val=k % 8 == 0) for k in range(80)]
    none = spark.createDataFrame([], "path string, label string, rank int")
    _, metrics = learn.train(base, samples(spark, rows), none, ["c0", "c1"], {}, now=5.0, folds_of_singles=5)
    single = sum(1 for r in rows if r["label_source"] == "single" and not r["is_val"])
    assert metrics["notes"].startswith(f"train=70 single={single} multi_label=1 cv_macro_f1=") and float(metrics["notes"].rsplit("=", 1)[1]) > 0.9
    assert metrics["version"] == "ovr_v5" and metrics["val_n"] == 10
    assert json.loads(metrics["coverage"])["thresholds"].keys() == {"c0", "c1"}
    _, few = learn.train(base, samples(spark, rows[:30]), none, ["c0", "c1"], {}, now=5.0, folds_of_singles=5)
    assert "cv_macro_f1" not in few["notes"]


def test_best_class_before_the_explosion_is_the_window_s(spark):
    rng = np.random.default_rng(4)
    probs = rng.choice([0.0, 0.2, 0.5, 0.7], (60, 3))
    df = spark.createDataFrame([(str(k), [float(x) for x in p], [f"c{k % 3}"]) for k, p in enumerate(probs)], "path string, probs array<double>, targets array<string>")
    classes, limits = ["c0", "c1", "c2"], spark.createDataFrame([(f"c{k}", 0.6) for k in range(3)], "class string, threshold double")
    plain, fast = learn.report(learn.long_scores(df, classes), limits), learn.report(learn.long_scores(df, classes, best=True), limits)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fast.collect()))
    assert "Window" in plan(plain) and "Window" not in plan(fast)


def test_report_of_scored_rows_scores_once(spark):
    text = plan(catalog_queries.QUERIES["prf_report"](spark, SF))
    assert len(re.findall(r"ArrowEvalPython", text.split("== Initial Plan ==")[0])) == 1 and "Window" not in text


def test_a_saved_version_is_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = {f.name: None for f in schema("metrics")} | {"ts": 1.0, "val_n": 1}
    for version, n in (("ovr_v1", 1), ("ovr_v2", 2), ("ovr_v1", 3)):
        learn.save(store, [learn.Head("a", (1.0,), float(n), 0.5)], row | {"version": version, "val_n": n})
    assert sorted((r.version, r.val_n) for r in store.read("metrics").collect()) == [("ovr_v1", 3), ("ovr_v2", 2)]
    heads, version = learn.load(store)
    assert version == "ovr_v1" and heads[0].bias == 3.0


def test_five_candidates_are_compared(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        c = k % 2
        panns = np.eye(3)[c] + rng.normal(0, 0.6, 3)  # weak on its own
        clap = np.eye(4)[c] + rng.normal(0, 0.1, 4)
        rows.append((f"p{k}", [float(x) for x in panns], [float(x) for x in clap], [f"c{c}"], 1.0, k % 5 == 0))
    df = spark.createDataFrame(rows, "path string, panns array<double>, clap array<double>, targets array<string>, weight double, is_val boolean")
    anchors = {"c0": [1.0, 0, 0, 0], "c1": [0, 1.0, 0, 0]}
    found, apart = learn.five_candidates(df, ["c0", "c1"], anchors)
    assert all(x.count() == 24 for x in found.values()) and apart["zero_shot"].count() == 96
    table = {r.name: r.macro_f1 for r in learn.compare(found, ["c0", "c1"], apart=apart).collect()}
    assert table.keys() == {"panns_ovr", "zero_shot", "clap_ovr", "concat_ovr", "ensemble"}
    assert table["clap_ovr"] > 0.95 and table["concat_ovr"] > 0.95 and table["clap_ovr"] >= table["panns_ovr"]
    both = {r.path: r.probs for r in found["ensemble"].collect()}
    a, b = ({r.path: r.probs for r in found[n].collect()} for n in ("panns_ovr", "zero_shot"))
    assert all(np.allclose(both[p], (np.array(a[p]) + b[p]) / 2) for p in both)
    lone = learn.compare({"zero_shot": found["zero_shot"]}, ["c0", "c1"], apart={"zero_shot": apart["zero_shot"].limit(0)}).first()
    assert 0 <= lone.macro_f1 <= 1  # nothing to calibrate on: the fallback of 0.1


def test_purity_and_entropy_of_clusters(spark):
    members = [(1, "a")] * 3 + [(1, "b")] + [(2, "a")] * 5 + [(3, "b"), (3, "a")] + [(4, None), (4, "")] + [(None, "a")]
    rows = [dict(path=str(k), status="ok", cluster_id=c, human_instrument=h, label_source="map") for k, (c, h) in enumerate(members)] + [dict(path="gone", status="missing", cluster_id=2, human_instrument="z", label_source="map")]
    df = samples(spark, rows)
    got = {r.cluster_id: r for r in sonic.cluster_purity(df).collect()}
    assert got.keys() == {1, 2, 3} and [(got[c].n, got[c].labels, got[c].top, got[c].purity) for c in (1, 2, 3)] == [(4, 2, "a", 0.75), (5, 1, "a", 1.0), (2, 2, "a", 0.5)]
    assert abs(got[1].entropy - -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))) < 1e-12 and got[2].entropy == 0.0 and abs(got[3].entropy - math.log(2)) < 1e-12
    none = spark.createDataFrame([], "path string, label string, rank int")
    weights = {r.path: r.weight for r in learn.build_dataset(df, none, ["a", "b"], {}, bulk_weight=0.5, purity=sonic.cluster_purity(df)).collect()}
    assert weights["0"] == 0.5 * 0.75**2 and weights["4"] == 0.5 and weights["9"] == 0.5 * 0.25 and weights["13"] == 0.5
    assert set(r.weight for r in learn.build_dataset(df, none, ["a", "b"], {}, bulk_weight=0.5).collect()) == {0.5}
    assert sonic.cluster_purity(df.limit(0)).count() == 0


def test_sketches_of_parts_are_the_sketch_of_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 17_000).cast("string").alias("v"), (F.col("id") % 7).alias("batch"))
    parts = stats.sketches(rows, ["batch", "g"], "v")
    merged = {r.g: r.n for r in stats.estimated(stats.merged(parts, ["g"])).collect()}
    whole = {r.g: r.n for r in stats.estimated(stats.merged(stats.sketches(rows, ["g"], "v"), ["g"])).collect()}
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert merged == whole
    assert all(abs(merged[g] - n) <= 0.03 * n for g, n in exact.items())
    twice = parts.unionByName(parts)  # parts may overlap
    assert {r.g: r.n for r in stats.estimated(stats.merged(twice, ["g"])).collect()} == merged
    assert stats.sketches(rows.withColumn("v", F.lit(None).cast("string")), ["g"], "v").count() == 0


def test_a_held_index_reads_no_parquet_until_the_features_change(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(f"p{k}", "m", [float(k), 1.0]) for k in range(8)]
    write = lambda n: store.write("features", spark.createDataFrame(rows[:n], "path string, model string, vec array<float>"))
    write(5)
    index = retrieve.Index(store)
    assert [r.path for r in index.neighbors("p0", 2).collect()] == ["p1", "p2"] and index.n == 5
    held, path = index.vectors(), str(tmp_path / "store" / "features" / "v=1")
    for f in (tmp_path / "store" / "features" / "v=1").glob("*.parquet"):
        f.rename(f.with_suffix(".away"))  # what isn't there can't be read
    text = ran(index.neighbors("p1", 3))
    assert "InMemoryTableScan" in text and index.vectors() is held and path
    for f in (tmp_path / "store" / "features" / "v=1").glob("*.away"):
        f.rename(f.with_suffix(".parquet"))
    write(8)
    assert index.neighbors("p0", 20).count() == 7 and index.n == 8 and index.vectors() is not held
    assert not held.is_cached
    index.drop()
    assert index.n == 0
    aged = retrieve.Index(store, max_age=1e-9)
    assert aged.vectors() is not aged.vectors()
    aged.drop()


def test_a_point_is_found_in_one_file(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = spark.range(1000).select(F.col("id").cast("int").alias("map_i"), F.concat(F.lit("p"), F.col("id")).alias("path"))
    geometry.write_points(rows.repartition(7), path, 8)
    assert len(list((tmp_path / "map").glob("*.parquet"))) == 8
    one = geometry.point(spark, path, 437)
    assert [(r.map_i, r.path) for r in one.collect()] == [(437, "p437")]
    assert re.search(r"PushedFilters: \[.*EqualTo\(map_i,437\)", one._jdf.queryExecution().toString())
    import pyarrow.parquet as pq

    holding = []
    for f in (tmp_path / "map").glob("*.parquet"):
        s = [pq.ParquetFile(f).metadata.row_group(g).column(0).statistics for g in range(pq.ParquetFile(f).num_row_groups)]
        holding += [f for x in s if x.min <= 437 <= x.max]
    assert len(holding) == 1  # the others' statistics rule them out
    assert geometry.point(spark, path, 5000).count() == 0 and geometry.point(spark, path, -1).count() == 0


def test_an_unmatched_search_still_tells_the_number(spark):
    vectors = spark.createDataFrame([("a/x.wav", 1, [1.0, 0.0]), ("a/y.wav", 2, [0.5, 0.5]), ("b/z.wav", 3, [0.0, 1.0])], "path string, row_id long, vec array<double>")
    items = vectors.unionByName(spark.createDataFrame([("a/novec.wav", 4, None)], "path string, row_id long, vec array<double>"))
    df = samples(spark, [dict(path=p, status="ok", rating=r) for p, r in (("a/x.wav", 3), ("a/y.wav", None), ("b/z.wav", 1))])
    sets = spark.createDataFrame([("a/y.wav", "kick", 2), ("a/y.wav", "tom", 1)], "path string, label string, rank int")
    emitted = spark.createDataFrame([("b/z.wav", "pad", 0.5)], "path string, label string, conf double")
    indexed = spark.createDataFrame([("a/y.wav", 7)], "path string, map_i int")
    ask = lambda q, k=24: retrieve.similar_report(vectors, items, df, sets, emitted, indexed, q, k).orderBy("place").collect()
    got = ask("A/X")
    assert [(r.matched, r.n, r.place, r.name, r.score, r.map_i, r.rating, r.labels) for r in got] == [("a/x.wav", 3, 1, "y.wav", 0.5, 7, 0, ["tom", "kick"]), ("a/x.wav", 3, 2, "z.wav", 0.0, -1, 1, None)]
    assert got[1].model_labels[0].label == "pad"
    for nothing in ("nowhere", "novec"):
        assert [(r["query"], r.matched, r.n, r.path) for r in ask(nothing)] == [(nothing, None, 3, None)]


def test_the_queue_is_chosen_once(spark):
    words = review.vocabulary(spark.createDataFrame([], "old_label string, new_label string"), spark.createDataFrame([("a",)], "name string"))
    df = samples(spark, [dict(path=f"p{k}", status="ok", source="model", model_instrument="a", model_margin=k / 9, cluster_id=k % 2, cluster_l1=0) for k in range(6)])
    none = spark.createDataFrame([], "path string, label string, rank int")
    clusters = spark.createDataFrame([(0, 2, "grain"), (0, 1, "family")], "id int, level int, label string")
    vecs = spark.createDataFrame([("p0", [1.0, 0.0]), ("p1", [1.0, 0.0]), ("p2", [0.0, 1.0])], "path string, vec array<double>")
    rows, total = review.queue(df, spark.createDataFrame([], "path string, label string, conf double"), none, vecs, words, clusters=clusters)
    assert [(r.path, r.grain, r.family) for r in rows.collect()] == [("p0", "grain", "family"), ("p2", "grain", "family"), ("p3", None, "family"), ("p4", "grain", "family"), ("p5", None, "family")]
    assert "MapInPandas" not in plan(rows) and total.first().total == 6
    full = catalog_queries.QUERIES["review_queue_full"](spark, SF)
    text = plan(full).split("== Initial Plan ==")[-1]
    assert text.count("FileScan parquet") < 12 and "MapInPandas" not in text


def test_train_and_predict_drivers_with_their_guards(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no features"):
        stages.run_train(store)
    base = separable(spark, 60, 2)
    store.write("features", base.select("path", F.lit("panns").alias("model"), "vec").unionByName(spark.createDataFrame([("p000", "other", [1.0])], "path string, model string, vec array<double>")))
    with pytest.raises(ValueError, match="no classes"):
        stages.run_train(store)
    store.write("taxonomy", spark.createDataFrame([("c0", 0.0), ("c1", 0.0)], "name string, created_at double"))
    with pytest.raises(ValueError, match="no model"):
        stages.run_predict(store)
    store.write("samples", samples(spark, [dict(path=f"p{k:03}", status="ok", human_instrument=f"c{k % 2}" if k < 40 else None, label_source="map" if k < 40 else None, is_val=k % 10 < 2 and k < 40, cluster_id=k % 2) for k in range(60)]))
    metrics = stages.run_train(store, purity=True, now=7.0)
    assert metrics["version"] == "ovr_v7" and metrics["val_n"] == 8 and store.read("metrics").count() == 1
    assert stages.run_predict(store) == {"predicted": 60, "emitted": store.read("model_labels").count()}
    done = {r.path: r for r in store.read("samples").collect()}
    assert all(done[f"p{k:03}"].model_instrument == f"c{k % 2}" and done[f"p{k:03}"].model_version == "ovr_v7" for k in range(60))
    learn.save(store, learn.load(store)[0], metrics | {"version": "v3"})
    with pytest.raises(ValueError, match="one label an item"):
        stages.run_predict(store)
    learn.save(store, [learn.Head("c0", (1.0,), 0.0)], metrics | {"version": "ovr_v8"})
    with pytest.raises(ValueError, match="components"):
        stages.run_predict(store)


def test_export_and_projection_drivers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("features", separable(spark, 12).select("path", F.lit("panns").alias("model"), "vec"))
    store.write("samples", samples(spark, [dict(path="p000", status="ok", human_instrument="kick", is_val=True)]))
    path, made = stages.run_export(store)
    got = {r.path: (r.human, r.weak_path, r.is_val) for r in spark.read.parquet(path).collect()}
    assert made and len(got) == 12 and got["p000"] == ("kick", "", 1) and got["p001"] == ("", "", 0)
    assert stages.run_export(store) == (path, False) and stages.run_export(store, force=True) == (path, True)
    store.write("samples", samples(spark, [dict(path="p001", status="ok", human_instrument="tom")]))
    again, made = stages.run_export(store)
    assert made and again != path and {r.path for r in spark.read.parquet(again).where("human <> ''").collect()} == {"p001"}
    assert stages.run_project(store) == 12 and stages.run_project(store, sample=5) == 5  # replaced, not added to
    points = store.read("projection")
    assert points.count() == 5 and points.where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1").count() == 5


def test_lines_and_selection_of_a_search(spark):
    none = spark.createDataFrame([("nothing'", None, 7, None, None, None, None, None, None, None)], "query string, matched string, n long, place int, score double, instrument string, sample_type string, bpm int, key string, name string")
    assert [(r.place, r.line) for r in retrieve.report_lines(none).collect()] == [(0, "no sample matching 'nothing'' (index has 7 embeddings)")]
    hits = spark.createDataFrame([("a", 3), ("b", -1), ("a", 3)], "path string, map_i int")
    chosen = spark.createDataFrame([("a", 3), ("c", 5), ("c", 5)], "path string, map_i int")
    assert sorted(map(tuple, retrieve.with_selection(hits, chosen).collect())) == [("a", 3, True), ("c", 5, False)]


def test_vacuum_removes_what_a_dead_writer_left(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(3):
        store.write("taxonomy", spark.createDataFrame([("a", 0.0)], "name string, created_at double"))
    left = tmp_path / "store" / "taxonomy" / ".0123abcd"
    left.mkdir()
    assert store.vacuum("taxonomy") == [1] and left.exists()  # it may still be at work
    assert store.vacuum("taxonomy", abandoned=0) == [] and not left.exists()
    assert store.read("taxonomy").count() == 1 and store.vacuum("nothing") == []
