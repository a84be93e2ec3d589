"""Weak supervision, one-vs-rest heads, thresholds, predictions."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.functions.scalars import blank, mapped
from shelfmark.functions.vectors import argmax, mean_vector, unit
from shelfmark.operators.labels import label_sets, resolve_predict
from shelfmark.schema import schema
from shelfmark.sources.store import Store
from shelfmark.sources.tables import checkpointed

#: The parameters a fresh store starts with, and its weak-label map.
PARAMS = {"weak_weight": 0.007, "bulk_weight": 0.5, "conf_threshold": 0.6, "target_precision": 0.9, "feature_model": "panns"}
WEAK_MAP = {"snare": "snare_clap", "clap": "snare_clap", "hihat": "hats_cymbals", "cymbal": "hats_cymbals", "fx": "sfx", "drums": "perc", "808": "bass"}
NEVER = -100.0


@dataclass(frozen=True)
class Head:
    """One class: weights, bias, threshold. A class that can't be fitted has zero weights and never fires."""

    name: str
    weights: tuple[float, ...]
    bias: float
    threshold: float = 0.6


def weak_label(path: Column, panns: Column, classes: list[str], weak_map: dict[str, str], map_first: bool = False) -> Column:
    """The path's label if it is a class, else the mapped panns label; mapped (again), and null unless a class.

    ``map_first`` maps the path's label before it is judged, instead of giving it up.
    """
    own = mapped(path, weak_map) if map_first else path
    chosen = F.when(own.isin(classes), own).otherwise(mapped(panns, weak_map))
    final = chosen if map_first else mapped(chosen, weak_map)
    return F.when(final.isin(classes), final)


def build_dataset(samples: DataFrame, labels: DataFrame, classes: list[str], weak_map: dict[str, str], weak_weight: float = 0.2, bulk_weight: float = 0.5, purity: DataFrame | None = None) -> DataFrame:
    """path, targets array<string>, weight, is_val: one row for each item that trains or validates.

    Frozen items validate if they are labelled with a class, and never train. People's labels train with their whole
    set (weight 1 if given one by one); the rest trains with its weak label. A set without a known class is skipped.
    With ``purity`` (cluster_id, purity, as of ``sonic.cluster_purity``) a label given in bulk weighs less in a cluster
    whose people's labels disagree: by the square of its purity. An item in no cluster weighs as without.
    """
    if purity is not None:
        samples = samples.join(F.broadcast(purity.select("cluster_id", "purity")), "cluster_id", "left")  # a row a cluster
        bulk = bulk_weight * F.coalesce(F.col("purity") * F.col("purity"), F.lit(1.0))
    else:
        samples, bulk = samples.withColumn("purity", F.lit(None).cast("double")), F.lit(float(bulk_weight))
    known = F.array(*(F.lit(c) for c in classes))
    sets = samples.join(label_sets(labels, into="set"), "path", "left")
    human = F.when(F.size("set") > 0, F.col("set")).when(~blank(F.col("human_instrument")), F.array("human_instrument"))
    weak = weak_label(F.col("path_instrument"), F.col("panns_instrument"), classes, weak_map)
    rows = sets.select("path", F.col("is_val"), human.alias("human"), weak.alias("weak"), (F.col("label_source") == "single").alias("single"), bulk.alias("bulk"))
    targets = F.when(F.col("human").isNotNull(), F.array_intersect("human", known)).when(~F.col("is_val") & F.col("weak").isNotNull(), F.array("weak"))
    weight = F.when(F.col("is_val") | F.coalesce("single", F.lit(False)) & F.col("human").isNotNull(), 1.0).when(F.col("human").isNotNull(), F.col("bulk")).otherwise(weak_weight)
    return rows.select("path", targets.alias("targets"), weight.alias("weight"), "is_val").where(F.size("targets") > 0)


def fit_ovr(train: DataFrame, classes: list[str], dim: int, max_iter: int = 1000) -> list[Head]:
    """A weighted L2 logistic head (C = 1, classes balanced by count) for each class of ``train`` (vec, targets, weight)."""
    rows = train.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), "targets", "weight").cache()
    has = lambda c: F.array_contains("targets", c)
    sums = [x for k, c in enumerate(classes) for x in (F.count_if(has(c)).alias(f"p{k}"), F.sum(F.when(has(c), F.col("weight")).otherwise(0.0)).alias(f"w{k}"))]
    counts = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *sums).first()
    heads = []
    for k, c in enumerate(classes):
        pos, neg = counts[f"p{k}"], counts["n"] - counts[f"p{k}"]
        if pos < 2 or neg < 2:
            heads.append(Head(c, (0.0,) * dim, NEVER))
            continue
        for_pos, for_neg = counts["n"] / (2 * pos), counts["n"] / (2 * neg)
        one = rows.select("features", has(c).cast("double").alias("label"), (F.col("weight") * F.when(has(c), for_pos).otherwise(for_neg)).alias("w"))
        total = for_pos * counts[f"w{k}"] + for_neg * (counts["w"] - counts[f"w{k}"])
        model = LogisticRegression(weightCol="w", regParam=1 / total, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(one)
        heads.append(Head(c, tuple(map(float, model.coefficients.toArray())), float(model.intercept)))
    rows.unpersist()
    return heads


def _matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """The vectors that aren't null, as rows."""
    return vecs.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(rows: np.ndarray, like: pa.Array) -> pa.Array:
    """Rows as lists, null where ``like`` is."""
    known = like.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.where(known, rows.shape[1], 0))
    offsets = pa.array(np.append(0, ends), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()), mask=pa.array(~known))


def score(vectors: DataFrame, heads: list[Head], into: str = "probs") -> DataFrame:
    """``vectors`` (…, vec) with the probability of every head, in the heads' order; one matrix product per batch.

    A null vector has null for its probabilities.
    """
    weights, bias = np.array([h.weights for h in heads]), np.array([h.bias for h in heads])

    @arrow_udf("array<double>")
    def of(vecs: pa.Array) -> pa.Array:
        rows = _matrix(vecs, weights.shape[1])
        return _lists(1 / (1 + np.exp(-np.clip(rows @ weights.T + bias, -700, 700))), vecs)

    return vectors.withColumn(into, of(F.col("vec")))


def predictions(scored: DataFrame, heads: list[Head]) -> DataFrame:
    """``scored`` with top-1 label and confidence, margin, its head, and the emitted labels with confidences.

    The margin is twice the least distance of a probability from one half. Emitted is all at or over its threshold,
    and the top-1 always. Equal values: the first head wins.
    """
    names = F.array(*(F.lit(h.name) for h in heads))
    limits = F.array(*(F.lit(float(h.threshold)) for h in heads))
    probs, top = F.col("probs"), argmax(F.col("probs"))
    distance = F.transform(probs, lambda p: F.abs(p - 0.5))
    each = F.transform(probs, lambda p, k: F.struct(names[k].alias("label"), F.round(p, 4).alias("conf"), ((p >= limits[k]) | (k == top)).alias("on")))
    return scored.select(
        "*",
        names[top].alias("top1"),
        F.array_max(probs).alias("top1_conf"),
        limits[top].alias("top1_threshold"),
        (2 * F.array_min(distance)).alias("margin"),
        names[(F.array_position(distance, F.array_min(distance)) - 1).cast("int")].alias("margin_label"),
        F.transform(F.filter(each, lambda x: x["on"]), lambda x: F.struct(x["label"].alias("label"), x["conf"].alias("conf"))).alias("emitted"),
    )


def emitted_labels(predicted: DataFrame, key: str = "path") -> DataFrame:
    return predicted.select(key, F.explode("emitted").alias("e")).select(key, "e.label", "e.conf")


def write_back(samples: DataFrame, predicted: DataFrame, version: str) -> DataFrame:
    """``samples`` with the model's columns and the resolution of every predicted row; the others stay.

    The path's label counts as it stands.
    """
    fresh = predicted.select("path", F.lit(True).alias("__new"), "top1", "top1_conf", "top1_threshold", "margin", "margin_label")
    joined, new = samples.join(fresh, "path", "left"), F.coalesce("__new", F.lit(False))
    instrument, source = resolve_predict(F.col("human_instrument"), F.col("top1"), F.col("top1_conf"), F.col("top1_threshold"), F.col("path_instrument"))
    changed = {"model_instrument": F.col("top1"), "model_conf": F.col("top1_conf"), "model_version": F.lit(version), "model_margin": F.col("margin"), "model_margin_label": F.col("margin_label"), "instrument": instrument, "source": source}
    return joined.select(*(F.when(new, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in samples.columns))


def long_scores(scored: DataFrame, classes: list[str], key: str = "path", best: bool = False) -> DataFrame:
    """key, class, p and whether the class is among the row's targets; ``best``: and whether it is the row's best.

    Of equal probabilities the last class in ``classes`` is the best.
    """
    names = F.array(*(F.lit(c) for c in classes))
    top = F.size("probs") - F.array_position(F.reverse("probs"), F.array_max("probs"))
    # outer, as the filter on its array that an inner explosion brings would run the scoring function once more
    rows = scored.select(key, "targets", *([top.alias("__top")] if best else []), F.posexplode_outer("probs").alias("k", "p")).where("k IS NOT NULL")
    return rows.select(key, names[F.col("k")].alias("class"), "p", F.array_contains("targets", names[F.col("k")]).alias("y"), *([(F.col("k") == F.col("__top")).alias("best")] if best else []))


def calibrate(scores: DataFrame, target: float = 0.9, fallback: float = 0.6, low: float = 0.30, high: float = 0.98, step: float = 0.02, support: int = 10) -> DataFrame:
    """class, threshold: the lowest of a grid at which the precision of ``scores`` (class, p, y) reaches ``target``.

    A class with fewer than ``support`` positives, or that never gets there, has the fallback. Rows meet the grid as
    counts by the highest step they reach, so the shuffle carries grid rows, not scores.
    """
    n = round((high - low) / step) + 1
    grid = F.round(F.lit(low) + F.col("i") * step, 2)
    reached = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(-1), lambda best, i: F.when(F.col("p") >= F.round(F.lit(low) + i * step, 2), i).otherwise(best))
    counts = scores.select("class", reached.alias("r"), F.col("y").cast("int").alias("y")).groupBy("class", "r").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    steps = counts.select("class", F.explode(F.when(F.col("r") >= 0, F.sequence(F.lit(0), F.col("r")))).alias("i"), "tp", "n").groupBy("class", "i").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    good = steps.where(F.col("tp") / F.col("n") >= target).groupBy("class").agg(F.min("i").alias("i")).select("class", grid.alias("t"))
    totals = counts.groupBy("class").agg(F.sum("tp").alias("positives"))
    enough = F.col("positives") >= support
    return totals.join(good, "class", "left").select("class", F.when(enough & F.col("t").isNotNull(), F.col("t")).otherwise(F.lit(fallback)).alias("threshold"))


def report(scores: DataFrame, thresholds: DataFrame, key: str = "path") -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1; a row's best class counts as predicted whenever it has any probability.

    ``scores`` that tell each row's best class (``long_scores`` with ``best``) are added up where they lie; without it
    they are dealt by row to find it.
    """
    if "best" not in scores.columns:
        scores = scores.withColumn("best", F.col("class") == F.max_by("class", F.struct("p", "class")).over(Window.partitionBy(key)))
    judged = scores.join(F.broadcast(thresholds), "class")
    on = (F.col("p") >= F.col("threshold")) | (F.col("best") & (F.col("p") > 0))
    sums = judged.groupBy("class").agg(F.count_if(on & F.col("y")).alias("tp"), F.count_if(on & ~F.col("y")).alias("fp"), F.count_if(~on & F.col("y")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("f1").alias("macro_f1"))


def confident_share(scored: DataFrame, heads: list[Head]) -> DataFrame:
    """n, covered: rows with a probability at or over its class's threshold."""
    limits = F.array(*(F.lit(float(h.threshold)) for h in heads))
    return scored.agg(F.count("*").alias("n"), F.count_if(F.exists(F.zip_with("probs", limits, lambda p, t: p >= t), lambda x: x)).alias("covered"))


def anchors(prompts: DataFrame, key: str, dim: int) -> DataFrame:
    """``key``, vec: the mean of each key's vectors (vec) at length one; a zero mean stays as it is."""
    means = prompts.groupBy(key).agg(*mean_vector("vec", dim))
    return means.select(key, unit(F.array(*(f"v{k}" for k in range(dim)))).alias("vec"))


def zero_shot(vectors: DataFrame, anchors: dict[str, list[float] | None]) -> DataFrame:
    """``vectors`` with a probability-like score for each anchor: the inner product; an unknown anchor scores 0."""
    dim = len(next(v for v in anchors.values() if v))
    rows = np.array([v or [0.0] * dim for v in anchors.values()])

    @arrow_udf("array<double>")
    def of(vecs: pa.Array) -> pa.Array:
        return _lists(_matrix(vecs, dim) @ rows.T, vecs)

    return vectors.withColumn("probs", of(F.col("vec")))


def ensemble(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """key, targets, probs: the mean of two score columns."""
    other = b.select(key, F.col("probs").alias("__b"))
    return a.join(other, key).select(key, "targets", F.zip_with("probs", "__b", lambda x, y: (x + y) / 2).alias("probs"))


def with_thresholds(heads: list[Head], thresholds: DataFrame) -> list[Head]:
    found = {r["class"]: r["threshold"] for r in thresholds.collect()}  # one row for each class
    return [Head(h.name, h.weights, h.bias, found.get(h.name, h.threshold)) for h in heads]


def train(features: DataFrame, samples: DataFrame, labels: DataFrame, classes: list[str], weak_map: dict[str, str], params: dict | None = None, now: float | None = None, purity: DataFrame | None = None, folds_of_singles: int = 0) -> tuple[list[Head], dict]:
    """(heads with thresholds, the metrics row). Without validation rows: flat thresholds and no F1.

    ``folds_of_singles``: also cross-validates, in so many folds, the rows labelled one by one, if there are over 20; the
    outcome is in the row's notes.
    """
    params, now = PARAMS | (params or {}), time.time() if now is None else now
    rows = build_dataset(samples, labels, classes, weak_map, params["weak_weight"], params["bulk_weight"], purity).join(features.select("path", "vec"), "path")
    first = features.select(F.size("vec").alias("n")).first()
    if first is None or not classes:
        raise ValueError("no features or no classes")
    rows = checkpointed(rows)
    heads = [Head(h.name, h.weights, h.bias, params["conf_threshold"]) for h in fit_ovr(rows.where(~F.col("is_val")), classes, first.n)]
    held = checkpointed(score(rows.where("is_val"), heads))
    single = rows.where(~F.col("is_val") & (F.col("weight") == 1.0))
    sizes = rows.agg(F.count_if(~F.col("is_val")).alias("train"), F.count_if("is_val").alias("val"), F.count_if(~F.col("is_val") & (F.col("weight") == 1.0)).alias("single")).first()
    notes = f"train={sizes.train} single={sizes.single} multi_label=1"
    metrics = {"version": f"ovr_v{int(now)}", "ts": float(now), "val_n": sizes.val, "macro_f1": None, "per_class_f1": None, "coverage": None, "notes": notes}
    if sizes.val:
        scores = long_scores(held, classes, best=True)
        heads = with_thresholds(heads, calibrate(scores, params["target_precision"], params["conf_threshold"]))
        per_class = report(scores, limits(features.sparkSession, heads)).collect()
        metrics |= {"macro_f1": sum(r.f1 for r in per_class) / len(classes), "per_class_f1": json.dumps({r["class"]: round(r.f1, 4) for r in per_class})}
    if folds_of_singles and sizes.single > 20:
        checked = cross_validate(single.select("path", "vec", "targets"), classes, first.n, folds_of_singles)
        found = cv_report(checked, heads).collect()
        metrics["notes"] += f" cv_macro_f1={sum(r.f1 for r in found) / len(classes):.4f}"
    share = confident_share(score(features.select("vec"), heads), heads).first()
    metrics["coverage"] = json.dumps({"n": share.n, "covered": share.covered, "thresholds": {h.name: h.threshold for h in heads}})
    return heads, metrics


def limits(spark: SparkSession, heads: list[Head]) -> DataFrame:
    """class, threshold of the heads."""
    return spark.createDataFrame([(h.name, float(h.threshold)) for h in heads], "class string, threshold double")


def out_of_fold(rows: DataFrame, heads: dict[int, list[Head]], into: str = "probs") -> DataFrame:
    """``rows`` (…, fold, vec) with the probabilities of the heads of each row's own fold; one pass over all folds."""
    order = {f: k for k, f in enumerate(sorted(heads))}
    weights = np.array([[h.weights for h in heads[f]] for f in order])
    bias = np.array([[h.bias for h in heads[f]] for f in order])

    @arrow_udf("array<double>")
    def of(vecs: pa.Array, fold: pa.Array) -> pa.Array:
        data = _matrix(vecs, weights.shape[2])
        which = np.array([order[f] for f, known in zip(fold.to_pylist(), vecs.is_valid().to_pylist(), strict=True) if known], np.int64)
        out = np.empty((len(data), weights.shape[1]))
        for k in range(len(order)):
            at = which == k
            out[at] = 1 / (1 + np.exp(-np.clip(data[at] @ weights[k].T + bias[k], -700, 700)))
        return _lists(out, vecs)

    return rows.withColumn(into, of(F.col("vec"), F.col("fold")))


def fit_folds(rows: DataFrame, classes: list[str], dim: int, k: int = 5) -> dict[int, list[Head]]:
    """A set of heads for each fold of ``rows`` (fold, vec, targets), fitted to the rows of all others, which weigh alike."""
    return {f: fit_ovr(rows.where(F.col("fold") != f).withColumn("weight", F.lit(1.0)), classes, dim) for f in range(k)}


def cross_validate(rows: DataFrame, classes: list[str], dim: int, k: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` (path, vec, targets) with ``fold`` and the probabilities (probs) of the heads that didn't see the row."""
    dealt = checkpointed(folds(rows, k, seed))
    return out_of_fold(dealt, fit_folds(dealt, classes, dim, k))


def cv_report(checked: DataFrame, heads: list[Head], key: str = "path") -> DataFrame:
    """The report of out-of-fold probabilities at the heads' thresholds."""
    return report(long_scores(checked, [h.name for h in heads], key, best=True), limits(checked.sparkSession, heads), key)


def predict(features: DataFrame, samples: DataFrame, heads: list[Head], version: str) -> tuple[DataFrame, DataFrame]:
    """(samples, model_labels) after the heads have judged every feature row."""
    if not heads:
        raise ValueError("no model")
    done = predictions(score(features.select("path", "vec"), heads), heads)
    return write_back(samples, done, version), emitted_labels(done)


def pipeline(features: DataFrame, samples: DataFrame, labels: DataFrame, classes: list[str], weak_map: dict[str, str], params: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Train, predict, write back: (samples, model_labels, metrics)."""
    heads, metrics = train(features, samples, labels, classes, weak_map, params)
    return *predict(features, samples, heads, metrics["version"]), metrics


def save(store: Store, heads: list[Head], metrics: dict) -> None:
    """Writes the metrics row, in place of one of the same version, then the heads as the model that ``load`` finds.

    A reader between the two sees the old model, and a version whose row is there already.
    """
    rows = [(h.name, list(h.weights), h.bias, h.threshold, metrics["version"]) for h in heads]
    store.write("metrics", with_metrics(store.read("metrics"), metrics))
    store.write("head", store.spark.createDataFrame(rows, schema("head")))


def with_metrics(table: DataFrame, row: dict) -> DataFrame:
    """``table`` with ``row``, in place of one of the same version."""
    return table.where(F.col("version") != row["version"]).unionByName(table.sparkSession.createDataFrame([row], schema("metrics")))


def load(store: Store, default: float = PARAMS["conf_threshold"]) -> tuple[list[Head], str]:
    """(the saved heads by name, their version); a head saved without a threshold has ``default``."""
    rows = store.read("head").orderBy("class").collect()  # one row for each class
    if not rows:
        raise ValueError("no model")
    return [Head(r["class"], tuple(r.w), r.b, default if r.threshold is None else r.threshold) for r in rows], rows[0].version


def compare(candidates: dict[str, DataFrame], classes: list[str], target: float = 0.9, fallback: float = 0.6, apart: dict[str, DataFrame] | None = None) -> DataFrame:
    """name, macro_f1 of each scored frame (path, targets, probs).

    Thresholds are calibrated on the frame itself, so optimistic, or on the one that ``apart`` has of the same name.
    """
    out = None
    for name, scored in candidates.items():
        scores = long_scores(scored, classes, best=True)
        grid = {"low": 0.01, "step": 0.01, "support": 5, "fallback": 0.1} if name == "zero_shot" else {"fallback": fallback}
        basis = long_scores(apart[name], classes) if name in (apart or {}) else scores
        known = scores.sparkSession.createDataFrame([(c,) for c in classes], "class string")
        found = known.join(calibrate(basis, target, **grid), "class", "left").na.fill(grid["fallback"], ["threshold"])
        one = macro_f1(report(scores, found)).select(F.lit(name).alias("name"), "macro_f1")
        out = one if out is None else out.unionByName(one)
    return out


def five_candidates(rows: DataFrame, classes: list[str], anchors: dict[str, list[float] | None]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(the candidates' scores of the validation rows, what ``compare`` calibrates apart).

    ``rows`` is (path, panns, clap, targets, weight, is_val) with both vectors. The candidates: heads on panns vectors, the
    anchors' zero-shot scores, heads on clap vectors, heads on both vectors put together, and the mean of the first two.
    The zero-shot thresholds come from the training rows, which have taught it nothing.
    """
    rows = checkpointed(rows.withColumn("both", F.concat(F.col("panns").cast("array<double>"), F.col("clap").cast("array<double>"))))
    first = rows.select(F.size("panns").alias("panns"), F.size("clap").alias("clap"), F.size("both").alias("both")).first()
    train_rows, held = rows.where(~F.col("is_val")), rows.where("is_val")
    of = lambda df, column: df.select("path", "targets", "weight", F.col(column).alias("vec"))
    trained = lambda column: score(of(held, column), fit_ovr(of(train_rows, column), classes, first[column]))
    wanted = {c: anchors.get(c) for c in classes}
    zero = zero_shot(of(held, "clap"), wanted)
    found = {"panns_ovr": trained("panns"), "zero_shot": zero, "clap_ovr": trained("clap"), "concat_ovr": trained("both")}
    return found | {"ensemble": ensemble(found["panns_ovr"], zero)}, {"zero_shot": zero_shot(of(train_rows, "clap"), wanted)}


def folds(rows: DataFrame, k: int = 5, seed: int = 42, key: str = "path") -> DataFrame:
    """``rows`` with a fold from 0 to k - 1 by a seeded hash of the key."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))
