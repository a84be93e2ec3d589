"""The catalog operators on small fixtures with results worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import rules, scalars, vectors
from shelfmark.operators import catalog, geometry, gold, labels, learn, retrieve, review, sonic, stats
from shelfmark.schema import conform, schema
from shelfmark.sources import audio, config, features, files
from shelfmark.sources.store import Store
from shelfmark.streaming.discovery import discover_stream, windowed_counts


def samples(spark, rows):
    return conform(spark.createDataFrame([{"path": None, **r} for r in rows], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema("samples") if any(f.name in r for r in rows))), "samples")


def by_path(df, *columns):
    return {r.path: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


PATHS = [
    ("Drums/Kick_Hard_01.wav", "kick", None, None, None),
    ("Loops/808 Bass F#min 140bpm.wav", "808", "loop", 140, "F#m"),
    ("One Shots/my_kick.wav", None, "oneshot", None, None),
    ("Pads/Warm Pad Bbmaj 90 bpm.wav", "synth", None, 90, "A#"),
    ("fx/Riser 20bpm.wav", "fx", None, None, None),
    ("150bpm Folder/loop 999bpm.wav", None, "loop", None, None),
    ("120bpm/plain.wav", None, None, 120, None),
    ("Stabs/Loop Hit.wav", None, "oneshot", None, None),
    ("Vox/Chant Am.wav", "vocal", None, None, "Am"),
    ("Breakbeats/Amen 1234bpm.wav", "drums", "loop", None, None),
    ("Snares/snare rim.wav", "snare", None, None, None),
]


def test_path_rules(spark):
    df = spark.createDataFrame([(p,) for p, *_ in PATHS], "path string").select("path", *rules.path_hints(F.col("path")))
    assert by_path(df, "instrument", "sample_type", "bpm", "key") == {p: tuple(x) for p, *x in PATHS}


def test_upsert_and_missing(spark):
    before = samples(spark, [dict(path="a", mtime=10.0, size=1, status="ok", rating=3), dict(path="b", mtime=2.0, size=2, status="missing", path_instrument="tom"), dict(path="c", mtime=3.0, size=3, status="ok", path_instrument="perc")])
    scan = spark.createDataFrame([("a", 20.0, 1, "kick"), ("b", 2.0, 2, "snare"), ("d", 1.0, 1, "clap")], "path string, mtime double, size long, path_instrument string")
    after = catalog.upsert(catalog.mark_missing(before, scan), scan, F.lit(1.0))
    want = {"a": (20.0, "ok", "kick", 3), "b": (2.0, "new", "tom", 0), "c": (3.0, "missing", "perc", 0), "d": (1.0, "new", "clap", 0)}

    assert by_path(after, "mtime", "status", "path_instrument") == {k: v[:3] for k, v in want.items()}
    assert sorted(map(tuple, catalog.upsert(after, scan, F.lit(1.0)).collect())) == sorted(map(tuple, after.collect()))
    assert {r.path for r in catalog.changed_files(scan, before).collect()} == {"b", "d"}
    assert {r.path for r in catalog.changed_files(scan, before, trust_known=False).collect()} == {"a", "b", "d"}
    dry, counts = catalog.discover(before, scan.drop("path_instrument"), dry_run=True)
    assert dry is before and tuple(counts.first()) == (1, 2)


def test_label_todo_and_update(spark):
    rows = samples(spark, [dict(path="a", status="ok", path_instrument="kick", panns_instrument=None), dict(path="b", status="ok", path_instrument="x", panns_instrument="y"), dict(path="c", status="missing"), dict(path="d", status=None)])
    todo = lambda *a, **k: {r.path for r in catalog.label_todo(rows, *a, **k).collect()}
    assert todo(["path"]) == set() and todo(["panns"]) == {"a"} and todo(["panns"], redo=["panns"]) == {"a", "b"} and todo([]) == set()
    found = spark.createDataFrame([("a", True, None, "tom", "bass", 0.5), ("b", False, "broken", None, None, None)], "path string, ok boolean, error string, path_instrument string, panns_instrument string, panns_conf double")
    assert by_path(catalog.label_update(rows, found), "path_instrument", "panns_instrument", "status", "error")["a"] == ("kick", "bass", "ok", None)
    redone = by_path(catalog.label_update(rows, found, redo=["path"]), "path_instrument", "status", "error")
    assert redone["a"][0] == "tom" and redone["b"] == ("x", "error", "broken")


def test_resolution(spark):
    rows = [("kick", "tom", 0.9, "snare", "clap"), (None, "tom", 0.60, "snare", "clap"), (None, "tom", 0.59, "snare", "clap"), (None, "tom", 0.10, "snare", None), (None, None, None, "snare", "clap"), (None, None, None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, human string, model string, conf double, panns string, path_label string")
    human, model, conf, panns, path = (F.col(c) for c in ("human", "model", "conf", "panns", "path_label"))
    first = [tuple(r) for r in df.orderBy("k").select(*labels.resolve_predict(human, model, conf, F.lit(0.6), path)).collect()]
    assert first[:4] == [("kick", "human"), ("tom", "model"), ("clap", "path"), (None, "none")]
    second = [tuple(r) for r in df.orderBy("k").select(*labels.resolve_interactive(human, model, panns, path)).collect()]
    assert second == [("kick", "human"), ("tom", "model"), ("tom", "model"), ("tom", "model"), ("snare", "panns"), (None, "none")]


def test_label_sets(spark):
    rows = samples(spark, [dict(path=p, human_instrument=h, label_source="single") for p, h in (("x", "kick"), ("y", "kick"), ("z", "perc"), ("w", None))])
    sets = spark.createDataFrame([("x", "kick", 1, 0.0), ("x", "perc", 2, 0.0), ("y", "kick", 1, 0.0), ("z", "perc", 1, 0.0), ("z", "kick", 2, 0.0)], "path string, label string, rank int, ts double")
    taxonomy = spark.createDataFrame([("kick", 0.0), ("perc", 0.0)], "name string, created_at double")
    after, rest, names, touched = labels.delete_label(rows, sets, taxonomy, "kick")
    assert by_path(after, "human_instrument", "label_source") == {"x": ("perc", "single"), "y": (None, None), "z": ("perc", "single"), "w": (None, "single")}
    assert touched == 3 and rest.count() == 2 and names.count() == 1
    after, new = labels.label(rows, sets, "w", ["kick", "", "perc", "kick"], taxonomy)
    assert by_path(after, "human_instrument", "label_source", "source")["w"] == ("kick", "single", "human")
    assert [(r.label, r["rank"]) for r in new.where("path = 'w'").orderBy("rank").collect()] == [("kick", 1), ("perc", 2)]
    cleared, _ = labels.label(rows, sets, "x", [], taxonomy)
    assert by_path(cleared, "human_instrument", "label_source")["x"] == (None, None)
    for bad in (lambda: labels.label(rows, sets, "w", ["kick", "nope"], taxonomy), lambda: labels.label(rows, sets, "none", ["kick"], taxonomy), lambda: labels.rate(rows, "x", 6), lambda: labels.set_type(rows, "x", "song"), lambda: labels.add_label(taxonomy, " ")):
        with pytest.raises(ValueError):
            bad()
    indexed = spark.createDataFrame([(0, "x"), (1, "w")], "map_i int, path string")
    with pytest.raises(ValueError):
        labels.label_map(rows, sets, indexed, [1], ["kick"], taxonomy, "old", "new")
    marked, _, hit = labels.label_map(rows, sets, indexed, [0, 1, 99], ["perc"], taxonomy, "t", "t")
    assert [r.path for r in hit.collect()] == ["w"] and by_path(marked, "label_source")["w"] == "map"
    assert {r[0] for r in labels.add_label(taxonomy, "  Snare ").select("name").collect()} == {"kick", "perc", "snare"}
    assert by_path(labels.rate(rows, "x", 5), "rating")["x"] == 5


def test_weak_dataset(spark):
    rows = [("1", None, None, "kick", "single", False), ("2", None, None, "zzz", "single", False), ("3", None, None, "kick", "map", False), ("4", "kick", "snare", "drums", "single", True), ("5", "kick", None, None, None, True), ("6", "snare", "kick", None, None, False), ("7", "drums", None, None, None, False), ("8", None, "snare", None, None, False), ("9", None, "tonal", None, None, False)]
    df = samples(spark, [dict(zip(("path", "path_instrument", "panns_instrument", "human_instrument", "label_source", "is_val"), r)) for r in rows])
    sets = spark.createDataFrame([("1", "kick", 1), ("1", "zzz", 2), ("2", "zzz", 1), ("3", "kick", 1), ("3", "perc", 2), ("4", "drums", 1)], "path string, label string, rank int")
    got = by_path(learn.build_dataset(df, sets, ["kick", "snare_clap", "drums", "perc"], {"snare": "snare_clap", "drums": "perc"}, 0.007, 0.5), "targets", "weight", "is_val")
    assert got == {"1": (["kick"], 1.0, False), "3": (["kick", "perc"], 0.5, False), "4": (["drums"], 1.0, True), "6": (["kick"], 0.007, False), "7": (["perc"], 0.007, False), "8": (["snare_clap"], 0.007, False)}


def test_calibration(spark):
    a = [0.951, 0.901, 0.851, 0.801, 0.751, 0.701, 0.651, 0.601, 0.551, 0.501]
    rows = [("A", p, True) for p in a] + [("A", p, False) for p in (0.521, 0.621, 0.405, 0.101)] + [("B", p, True) for p in a[:4]] + [("C", p - 0.5, True) for p in a] + [("C", 0.99, False)] * 10
    got = {r["class"]: r.threshold for r in learn.calibrate(spark.createDataFrame(rows, "class string, p double, y boolean")).collect()}
    brute = next(t for t in (round(0.30 + 0.02 * i, 2) for i in range(35)) if (n := sum(p >= t for c, p, _ in rows if c == "A")) and sum(p >= t and y for c, p, y in rows if c == "A") / n >= 0.9)
    assert got == {"A": brute, "B": 0.6, "C": 0.6} and brute == 0.54


def test_predictions(spark):
    heads = [learn.Head(n, (0.0,), 0.0, 0.6) for n in "abc"]
    df = spark.createDataFrame([("1", [0.9, 0.7, 0.1]), ("2", [0.4, 0.3, 0.45]), ("3", [0.5, 0.5, 0.2])], "path string, probs array<double>")
    got = by_path(learn.predictions(df, heads), "top1", "margin_label", "emitted")
    assert {k: (a, b, [tuple(x) for x in c]) for k, (a, b, c) in got.items()} == {"1": ("a", "b", [("a", 0.9), ("b", 0.7)]), "2": ("c", "c", [("c", 0.45)]), "3": ("a", "a", [("a", 0.5)])}
    assert [round(r.margin, 6) for r in learn.predictions(df, heads).orderBy("path").collect()] == [0.4, 0.1, 0.0]


def test_heads_separate_separable_classes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(60):
        v = np.eye(8)[k % 3] + rng.normal(0, 0.05, 8) + (np.eye(8)[(k + 1) % 3] if k < 4 else 0)
        rows.append((f"p{k}", [float(x) for x in v / np.linalg.norm(v)], [f"c{k % 3}"] + ([f"c{(k + 1) % 3}"] if k < 4 else []) + (["rare"] if k == 9 else []), 1.0))
    df = spark.createDataFrame(rows, "path string, vec array<float>, targets array<string>, weight double")
    heads = learn.fit_ovr(df, ["c0", "c1", "c2", "rare"], 8)
    assert heads[3].bias == -100 and set(heads[3].weights) == {0.0}
    scores = learn.long_scores(learn.score(df, heads), [h.name for h in heads])
    limits = spark.createDataFrame([(h.name, 0.5) for h in heads], "class string, threshold double")
    recall = {r["class"]: r.recall for r in learn.report(scores, limits).collect()}
    assert recall["c0"] == recall["c1"] == recall["c2"] == 1.0 and recall["rare"] == 0.0
    table = learn.compare({"heads": learn.score(df, heads), "both": learn.ensemble(learn.score(df, heads), learn.score(df, heads))}, [h.name for h in heads])
    assert {r.name for r in table.collect()} == {"heads", "both"}


def test_pipeline_never_trains_on_validation(spark):
    rng = np.random.default_rng(1)
    rows = [dict(path=f"p{k}", status="ok", path_instrument=f"c{k % 2}", human_instrument=f"c{k % 2}" if k % 4 < 2 else None, label_source="single" if k % 4 < 2 else None, is_val=k % 8 < 2) for k in range(80)]
    df = samples(spark, rows)
    feats = spark.createDataFrame([(f"p{k}", [float(x) for x in np.eye(4)[k % 2] + rng.normal(0, 0.1, 4)]) for k in range(80)], "path string, vec array<float>")
    none = spark.createDataFrame([], "path string, label string, rank int")
    data = learn.build_dataset(df, none, ["c0", "c1"], {})
    assert not {r.path for r in data.where("is_val").collect()} & {r.path for r in data.where(~F.col("is_val")).collect()}
    after, emitted, metrics = learn.pipeline(feats, df, none, ["c0", "c1"], {})
    assert {r.path for r in emitted.collect()} == {f"p{k}" for k in range(80)} and metrics["val_n"] == 20 and json.loads(metrics["coverage"])["n"] == 80
    assert all(r.model_instrument == f"c{int(r.path[1:]) % 2}" for r in after.collect())


def queue_rows(spark):
    rows = [("q1", "ok", "model", None, "kick", 0.2, "kick", "kick"), ("q2", "ok", "model", None, "kick", 0.9, "tom", "tom"), ("q3", "ok", "path", None, None, None, "snare", "snare"), ("q4", "ok", None, None, None, None, "kick", None), ("q5", "ok", "human", "kick", "kick", 0.1, None, None), ("q6", "missing", "path", None, None, None, None, None), ("q7", "ok", "model", None, "tom", 0.3, None, "tonal")]
    return samples(spark, [dict(zip(("path", "status", "source", "human_instrument", "model_instrument", "model_margin", "path_instrument", "panns_instrument"), r)) for r in rows])


def test_queue(spark):
    weak = spark.createDataFrame([("snare", "snare_clap")], "old_label string, new_label string")
    taxonomy = spark.createDataFrame([("kick",), ("snare_clap",), ("tom",)], "name string")
    none = spark.createDataFrame([], "path string, label string, conf double")
    got = by_path(review.ranked(review.candidates(queue_rows(spark), none), review.vocabulary(weak, taxonomy)), "sort_score", "rn")
    assert {k: (round(s, 6), n) for k, (s, n) in got.items()} == {"q2": (-1.1, 1), "q3": (-1.0, 1), "q7": (0.3, 1), "q1": (0.2, 2)}
    vecs = spark.createDataFrame([("q2", [1.0, 0.0]), ("q1", [0.999, 0.01])], "path string, vec array<float>")
    rows, total = review.queue(queue_rows(spark), none, spark.createDataFrame([], "path string, label string, rank int"), vecs, review.vocabulary(weak, taxonomy))
    assert [r.path for r in rows.collect()] == ["q2", "q3", "q7"] and total.first().total == 4
    emits = spark.createDataFrame([("q1", "tom", 0.4)], "path string, label string, conf double")
    assert {r.path for r in review.candidates(queue_rows(spark), emits, "class_tom").collect()} == {"q1"}


def test_greedy(spark):
    rows = spark.createDataFrame([("v1", 1, [1.0, 0.0]), ("v2", 2, [0.96, 0.28]), ("v3", 3, [0.0, 1.0]), ("v4", 4, None), ("v5", 5, [0.28, 0.96])], "path string, rn int, vec array<double>")
    assert [r.path for r in review.greedy(rows).orderBy("rn").collect()] == ["v1", "v3", "v4"]
    assert [r.path for r in review.greedy(rows, limit=2).orderBy("rn").collect()] == ["v1", "v3"]
    assert review.greedy(rows.limit(0)).count() == 0


def test_similarity(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.8, 0.6], 1), ("c", [0.6, 0.8], 2), ("d", [0.0, 1.0], 3)], "path string, vec array<double>, row_id int")
    near = lambda k: [(r.path, r.score) for r in retrieve.neighbors(v, "path", "a", k).collect()]
    assert near(2) == [("b", 0.8), ("c", 0.6)] and [p for p, _ in near(10)] == ["b", "c", "d"]
    q = v.where("path = 'a'").select(F.col("vec").alias("qvec"))
    assert [r.path for r in retrieve.page(v, "path", q, 2, 2).collect()] == ["c", "d"] and retrieve.page(v, "path", q, 2, 9).count() == 0
    items = spark.createDataFrame([("x/AB", 0), ("ab", 1), ("ABC", 2)], "path string, row_id int")
    find = lambda t: [r.path for r in retrieve.resolve(items, "path", "row_id", t).collect()]
    assert find("ab") == ["ab"] and find("Ab") == ["x/AB"] and find("zzz") == []
    assert [r.path for r in retrieve.similar(v, v, "A", 1).collect()] == ["b"] and retrieve.similar(v, v, "nope").count() == 0
    assert retrieve.is_similarity_query("a/b") and not retrieve.is_similarity_query("warm pad")


def test_gold(spark):
    rows = samples(spark, [dict(path=f"p{k:02}", status="ok", gold_candidate=k < 2, is_val=False, human_instrument="a" if k == 1 else None, label_source="single" if k == 1 else None) for k in range(30)])
    model = spark.createDataFrame([(f"p{k:02}", "a" if k % 2 else "b", 0.5) for k in range(20)], "path string, label string, conf double")
    once = gold.sample(rows, model, 4, 3)
    picked = {r.path for r in once.where("gold_candidate").collect()}
    assert len(picked) == 4 + 4 + 3 and {"p00", "p01"} <= picked
    assert {r.path for r in gold.sample(once, model, 4, 3).where("gold_candidate").collect()} == picked
    frozen, counts = gold.freeze(once)
    assert [r.path for r in frozen.where("is_val").collect()] == ["p01"] and tuple(counts.first()) == (1, 0)
    assert gold.status(frozen).first().remaining == 10
    with pytest.raises(ValueError):
        gold.sample(rows, model, 0)
    assert gold.stratified(rows.withColumn("g", F.col("path").substr(1, 2)), "g", "path", 2).count() == 6


def test_geometry(spark):
    pts = spark.createDataFrame([("in", 1.0, 1.0), ("out", 3.0, 1.0)], "path string, x double, y double")
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert [r.path for r in pts.where(geometry.in_polygon(F.col("x"), F.col("y"), square)).collect()] == ["in"]
    ahead = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 1.9), ("me", 0.0, 0.0)], "path string, x double, y double")
    assert [r.path for r in geometry.directional(ahead, "path", 0, 0, 1, 0).collect()] == ["a"]
    assert [r.path for r in geometry.nearest(ahead, "path", 0.9, 0, 0.2).collect()] == ["a"] and geometry.nearest(ahead, "path", 9, 9, 1).count() == 0
    flat = geometry.normalize01(spark.createDataFrame([("a", 5.0), ("b", 5.0)], "path string, x double"), ["x"])
    assert {r.x for r in flat.collect()} == {0.0}
    assert spark.range(1).select(scalars.hue(F.lit("ab"))).first()[0] == 75
    numbered = geometry.numbered(spark.createDataFrame([(f"{k:03}",) for k in range(57)], "k string").repartition(5), "k", "i")
    assert sorted((r.i, r.k) for r in numbered.collect()) == [(k, f"{k:03}") for k in range(57)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.1]
    got = geometry.project(spark.createDataFrame([(f"p{k:02}", [float(v) for v in r]) for k, r in enumerate(x)], "path string, vec array<double>")).orderBy("path").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(u - u.mean(0), full_matrices=False)[2][:2]
    axes = axes * np.sign([a[np.abs(a).argmax()] for a in axes])[:, None]
    want = u @ axes.T
    want = (want - want.min(0)) / (want.max(0) - want.min(0))
    assert np.allclose([[r.x, r.y] for r in got], want, atol=1e-6)


def test_map_codes(spark):
    rows = samples(spark, [dict(path="a", human_instrument="kick", sample_type="loop", label_source="llm", duration_s=1.239, cluster_l1=1), dict(path="b", human_instrument="zzz", sample_type=None, label_source=None, duration_s=None, cluster_l1=7)])
    pts = spark.createDataFrame([("b", 0.5, 0.5), ("a", 0.12345, 1.0)], "path string, x double, y double")
    got = by_path(geometry.map_rows(pts, rows, spark.createDataFrame([("kick",), ("bass",)], "name string"), 2), "map_i", "human", "family", "t", "d", "ls", "x")
    assert got == {"a": (0, 1, 1, 1, 1.24, 4, 0.1235 if got["a"][6] == 0.1235 else 0.1234), "b": (1, 2, 2, 2, 0.0, 5, 0.5)}


def test_statistics_and_clusters(spark):
    rows = samples(spark, [dict(path=f"p{k}", status="ok" if k else "missing", bpm=95 + k, model_conf=1.0 if k == 1 else 0.25, cluster_id=1, cluster_d=float(5 - k)) for k in range(4)])
    assert [(r.label, r.n) for r in stats.bpm_histogram(rows).collect()] == [("90–99", 4)]
    assert [(r.label, r.n) for r in stats.confidence_histogram(rows).collect()] == [("0.2+", 3), ("1.0+", 1)]
    assert stats.coverage(rows).first().active == 3 and sonic.medoids(rows).first().medoid == "p3"
    assert [r.path for r in sonic.members(rows, 1, 2).collect()] == ["p3", "p2"]
    metrics = spark.createDataFrame([("v1", 1.0, 2, 0.5, '{"a": 1.0}', "{broken", None)], "version string, ts double, val_n long, macro_f1 double, per_class_f1 string, coverage string, notes string")
    assert stats.metrics_trend(metrics).first().per_class_f1 == {"a": 1.0}
    patched = stats.patch_coverage(metrics, "v1", rows.withColumn("source", F.lit("path"))).first().coverage
    assert json.loads(patched) == {"resolved_path": 4.0}
    assert set(stats.dashboard(rows, spark.createDataFrame([], "path string, label string"), spark.createDataFrame([], "level int, size int, id int, label string"))) >= {"totals", "coverage", "bpm", "sonic"}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalars.fnv1a(F.lit("a"))) == 0xE40C292C and value(scalars.fnv1a(F.lit(""))) == 2166136261
    assert value(scalars.csv_items(F.lit(" A, b,,a "))) == ["a", "b"] and value(scalars.rewrite_prefix(F.lit("/mnt/x"), "/mnt", "/home")) == "/home/x"
    assert value(scalars.preview_gain(F.lit(-50.0))) == 30.0 and value(scalars.path_encode(F.lit("a b"))) == "a%20b"
    assert value(vectors.tile(F.array(*map(F.lit, [1, 2])), 5)) == [1, 2, 1, 2, 1]
    names, scores = F.array(*map(F.lit, ["Silence", "Bass drum", "Siren"])), F.array(*map(F.lit, [0.9, 0.5, 0.6]))
    assert tuple(value(rules.score_category(scores, names))) == ("fx", 0.6)
    assert value(retrieve.suggestion(F.lit("zzz"), F.lit("snare"), F.lit("kick"), {"snare": "snare_clap"}, ["snare_clap", "kick"])) == "snare_clap"


def test_sources(spark, tmp_path):
    for name in ("a.wav", "sub/b.FLAC", "c.txt"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(b"xyz")
    found = files.gather(spark, str(tmp_path / "lib"))
    assert {(r.path.rsplit("/", 1)[1], r.size) for r in found.collect()} == {("a.wav", 3), ("b.FLAC", 3)}
    files.write_list(found, str(tmp_path / "list"))
    assert files.read_list(spark, str(tmp_path / "list")).count() == 2
    log = spark.createDataFrame([(1, "10 files to process on 4 workers"), (2, "  "), (3, "5/10  2.5/s  eta 1.5m"), (4, "done?")], "line_no long, line string")
    assert tuple(files.progress(log).first()) == (5, 10, 2.5, 1.5, 50.0) and files.tail(log, 2).count() == 2
    vecs = spark.createDataFrame([("p", "panns", [3.0, 4.0]), ("p", "clap", [0.0, 0.0]), ("q", "panns", [1.0])], "path string, model string, vec array<float>")
    assert [r.vec for r in features.load(vecs, "panns", 2).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]]
    assert features.load(vecs, "missing").count() == 0 and len(features.load_concat(vecs, "panns", "clap").first().vec) == 4
    blob = spark.createDataFrame([(np.array([1, 2], "<f4").tobytes(),)], "b binary")
    assert blob.select(features.from_blob("b").alias("v")).first().v == [1.0, 2.0]
    caches = spark.createDataFrame([("features_3.npz",), ("features_clap_9.npz",), ("features_12.npz",), ("other",)], "name string")
    assert features.latest(caches, "panns").first().version == 12 and features.latest(caches, "clap").first().version == 9
    embedded = audio.embed(spark.createDataFrame([("ok", b"12"), ("bad", b"")], "path string, content binary"), lambda c: np.array([c[0], c[1]], np.float32), lambda x: x * 2)
    assert [(r.path, r.vec) for r in embedded.collect()] == [("ok", [98.0, 100.0])]
    assert list(audio.fit_length(np.array([1, 2, 3]), 5, 7)) == [1, 2, 3, 1, 2, 0, 0] and not np.isnan(audio.clean(np.array([np.nan, 1]), 1, 5)).any()


def test_store_and_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    token = store.token("taxonomy")
    assert store.read("taxonomy").count() == 0
    store.write("taxonomy", config.seed_taxonomy(store.read("taxonomy"), ["kick", "bass"]), token)
    assert store.read("taxonomy").count() == 2
    with pytest.raises(ValueError):
        store.write("taxonomy", store.read("taxonomy"), token)
    params, weak = config.seed_params(store.read("ml_params"), {"bulk_weight": 0.7}), config.seed_weak_map(store.read("weak_map"))
    assert config.load_params(params, weak)["bulk_weight"] == 0.7 and config.seed_params(params).count() == params.count()
    path = str(tmp_path / "config.json")
    assert config.read_config(path).workers == 5
    config.write_config(path, {"workers": "7", "nonsense": 1})
    assert config.read_config(path).workers == 7


def test_store_takes_one_of_two_writers_and_vacuums(spark, tmp_path, monkeypatch):
    store, one = Store(spark, str(tmp_path / "store")), spark.createDataFrame([("kick", 1.0)], "name string, created_at double")
    for k in range(3):
        assert store.write("taxonomy", one, f"taxonomy@{k}") == f"taxonomy@{k + 1}"
    monkeypatch.setattr(store, "token", lambda name: f"{name}@2")  # a writer that looked before the third version came
    with pytest.raises(ValueError, match="changed"):
        store.write("taxonomy", one.limit(0), "taxonomy@2")
    monkeypatch.undo()
    assert store.read("taxonomy").count() == 1 and store.vacuum("taxonomy", 1) == [1, 2] and store.token("taxonomy") == "taxonomy@3"
    assert not [p for p in (tmp_path / "store" / "taxonomy").iterdir() if p.name.startswith(".") and p.is_dir()]


def test_models_are_saved_and_scores_take_nulls(spark, tmp_path):
    store, heads = Store(spark, str(tmp_path / "store")), [learn.Head("a", (1.0, 0.0), 0.5, 0.7), learn.Head("b", (0.0, -2.0), 0.0)]
    with pytest.raises(ValueError, match="no model"):
        learn.load(store)
    for k in range(2):
        learn.save(store, heads, {"version": f"v{k}", "ts": float(k), "val_n": 1, "macro_f1": None, "per_class_f1": None, "coverage": None, "notes": None})
    assert learn.load(store) == (heads, "v1") and store.read("metrics").count() == 2
    rows = spark.createDataFrame([("x", [1.0, 2.0]), ("none", None), ("y", [0.0, 0.0])], "path string, vec array<float>").repartition(1)
    got = by_path(learn.score(rows, heads), "probs")
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert got["none"] is None and np.allclose(got["x"], [sigmoid(1.5), sigmoid(-4)]) and np.allclose(got["y"], [sigmoid(0.5), 0.5])
    assert by_path(learn.zero_shot(rows, {"p": [1.0, 1.0], "q": None}), "probs") == {"x": [3.0, 0.0], "none": None, "y": [0.0, 0.0]}


def test_heads_match_a_newton_solver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0.3).astype(float)
    w = rng.choice([0.5, 1.0], 120)
    rows = [(v.tolist(), ["c"] if t else ["d"], float(k)) for v, t, k in zip(x, y, w)]
    head = learn.fit_ovr(spark.createDataFrame(rows, "vec array<double>, targets array<string>, weight double"), ["c"], 3)[0]
    balanced = w * np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    a, beta = np.c_[x, np.ones(120)], np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (balanced * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (balanced * (p - y)) + ridge @ beta)
    assert np.allclose([*head.weights, head.bias], beta, atol=1e-3)


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{g}-{k}", [float(v) for v in np.eye(3)[g] * 10 + rng.normal(size=3) * 0.1]) for g in range(3) for k in range(20)]
    found = by_path(sonic.fit_families(spark.createDataFrame(rows, "path string, vec array<float>"), 3), "cluster_l1", "cluster_d")
    groups = [{found[f"{g}-{k}"][0] for k in range(20)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    for g in range(3):
        own = np.array([np.float32(v) for p, v in rows if p.startswith(f"{g}-")], float)
        gaps = np.linalg.norm(own - own.mean(0), axis=1)
        assert np.allclose([found[f"{g}-{k}"][1] for k in range(20)], gaps, atol=1e-5)


def test_gold_sample_matches_a_loop(spark):
    rng = np.random.default_rng(9)
    state = {f"p{k:03}": (bool(rng.random() < 0.1), bool(rng.random() < 0.2)) for k in range(150)}
    emitted = [(p, c, 0.5) for p in state for c in "abc" if rng.random() < 0.25]
    rows = samples(spark, [dict(path=p, status="ok", gold_candidate=g, human_instrument="x" if h else None) for p, (g, h) in state.items()])
    order = by_path(spark.createDataFrame([(p,) for p in state], "path string").withColumn("h", F.xxhash64(F.lit(42), F.col("path"))), "h")
    taken, have = set(), lambda name: {p for p, c, _ in emitted if c == name} if name else set(state) - {p for p, _, _ in emitted}
    for name, most in (("a", 12), ("b", 12), ("c", 12), (None, 9)):
        need = most - sum(state[p][0] for p in have(name))
        free = sorted((p for p in have(name) if not any(state[p]) and p not in taken), key=lambda p: (order[p], p))
        taken |= set(free[: max(0, need)])
    got = gold.sample(rows, spark.createDataFrame(emitted, "path string, label string, conf double"), 12, 9)
    assert {r.path for r in got.where("gold_candidate").collect()} == taken | {p for p, (g, _) in state.items() if g}


def test_numbered_keeps_nulls_and_repeats_without_a_nested_loop(spark, capsys):
    rows = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), (None,)], "k string").repartition(3)
    done = geometry.numbered(rows, "k", "i")
    assert sorted((r.i, r.k) for r in done.collect()) == [(0, None), (1, None), (2, "a"), (3, "b"), (4, "b")]
    done.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_small_functions(spark):
    one = lambda *columns: tuple(spark.range(1).select(*columns).first())
    assert one(catalog.should_embed(F.lit(0.5)), catalog.should_embed(F.lit(1.0)), catalog.should_embed(F.lit(None).cast("double"))) == (False, True, True)
    assert one(labels.toggled_rating(F.lit(3), F.lit(3)), labels.toggled_rating(F.lit(2), F.lit(3))) == (0, 3)
    assert one(scalars.safe_name(F.lit("a b/c.wav"))) == ("a_b_c.wav",)
    means = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<float>").agg(*vectors.mean_vector("v", 2)).first()
    assert tuple(means) == (2.0, 3.0)
    names = spark.createDataFrame([("kick",), ("keys",), ("bass",)], "name string")
    assert retrieve.first_with_prefix(names, "k").first().name == "keys" and retrieve.first_with_prefix(names, "z").first().name is None
    assert by_path(geometry.colors(names, {"kick": "red"}).withColumnRenamed("name", "path"), "color")["kick"] == "red"
    points = spark.range(100).select(F.col("id").alias("map_i"))
    assert geometry.decimated(points, 100, 30).count() == 25 and geometry.decimated(points, 100).count() == 100
    dealt = learn.folds(spark.range(500).select(F.col("id").cast("string").alias("path"))).groupBy("fold").count().collect()
    assert len(dealt) == 5 and sum(r["count"] for r in dealt) == 500
    dimension = conform(spark.createDataFrame([(7, 2, 1, 3, "g"), (8, 2, 0, 9, "h"), (1, 1, None, 12, "f")], "id int, level int, parent int, size int, label string"), "sonic_clusters")
    placed = samples(spark, [dict(path="a", cluster_id=7, cluster_d=0.5), dict(path="b", cluster_id=7, cluster_d=0.2)])
    assert [(r.id, r.medoid) for r in sonic.grains(dimension, placed).collect()] == [(8, None), (7, "b")]
    assert [r.id for r in sonic.grains(dimension, placed, 1).collect()] == [7]


def test_streams(spark, tmp_path):
    source = spark.createDataFrame([("a/kick.wav", 1.0, 2), ("b.wav", 3.0, 4)], "path string, mtime double, size long")
    source.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        discover_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination(60)
    assert by_path(store.read("samples"), "status", "path_instrument") == {"a/kick.wav": ("new", "kick"), "b.wav": ("new", None)}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert windowed_counts(events).first().n == 2


def store_tables(spark, folder, **tables):
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def vector_tables(spark, folder, n=8):
    """n documents, each nearer to the third the nearer its number; labels for all of them."""
    angle = lambda k: [float(np.cos((k - 3) / 10)), float(np.sin((k - 3) / 10))]
    return store_tables(
        spark,
        folder,
        documents=([(k, "text", "en", "src", 100 + k) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long"),
        labels=([(k, 0, 0) for k in range(n)], "doc_id long, quality int, toxic int"),
        embeddings=([(k, angle(k), k) for k in range(n)], "vec_id long, embedding array<float>, label int"),
    )


def test_registered_page_ranks_all_rows(spark, tmp_path):
    from shelfmark.plans.catalog_queries import QUERIES

    got = QUERIES["paged_with_total"](spark, vector_tables(spark, tmp_path)).collect()
    assert sorted((-r.score, r.path, r.n) for r in got) == [(pytest.approx(-np.cos(gap / 10), abs=1e-6), f"lib/src/{k}.wav", 7) for gap, k in ((1, 2), (1, 4), (2, 1), (2, 5), (3, 0))]


def test_registered_metrics_are_the_last_of_all(spark, tmp_path):
    from shelfmark.plans.catalog_queries import QUERIES

    rows = [(k, f"2024-01-01 00:{k % 60:02}:00", 0.5 + k, f'{{"k": {k}}}') for k in range(40, 60)]
    events = spark.createDataFrame(rows, "event_id long, t string, value double, props string").select("event_id", F.to_timestamp("t").alias("ts"), "value", "props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in QUERIES["metrics_json"](spark, str(tmp_path)).collect()]
    assert got == [(str(k), 0.5 + k, float(k)) for k in range(50, 60)]


def test_registered_features_are_of_all_rows(spark, tmp_path):
    from shelfmark.plans.catalog_queries import QUERIES

    d = vector_tables(spark, tmp_path)
    assert sorted(r.path for r in QUERIES["concat_features"](spark, d).collect()) == [str(k) for k in range(8)]
    assert sorted((r.id, r.human_instrument) for r in QUERIES["features_with_labels"](spark, d).collect()) == [(str(k), "fr") for k in range(8)]


def test_registered_close_pairs_are_of_all_rows(spark, tmp_path):
    from shelfmark.plans.catalog_queries import QUERIES

    rows = spark.read.parquet(f"{vector_tables(spark, tmp_path)}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    want = {(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and round(float(x[a] @ x[b]), 6) >= 0.3}
    got = [(r["query"], r["key"]) for r in QUERIES["lsh_neighbors"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {q for q, _ in got} == set(range(len(x)))  # not only rows whose id is divisible by something


def test_registry_is_whole(spark):
    import __spark_entry__

    found, known = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(known) <= set(found) and len(found) > 60
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_anchors_and_label_choices(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [-1.0, 0.0])], "k string, vec array<double>")
    found = {r.k: r.vec for r in learn.anchors(rows, "k", 2).collect()}
    assert found["a"] == pytest.approx([0.5**0.5] * 2) and found["b"] == [0.0, 0.0]
    hits = spark.createDataFrame([("snare",), ("kick",), ("snare",), (None,)], "best string")
    assert [tuple(r) for r in retrieve.label_choices(hits, "best").collect()] == [(0, "all"), (1, "kick"), (2, "snare")]
    assert [tuple(r) for r in retrieve.label_choices(hits.limit(0), "best").collect()] == [(0, "all")]
