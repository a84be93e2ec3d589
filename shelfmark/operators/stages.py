"""The drivers of the catalog's stages: what is to be done, done on the executors, written back, and counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import learn
from shelfmark.operators.catalog import CLASSIFIERS, active, changed_files, embed_set, label_todo, label_update, mark_missing, resume, upsert, with_hints
from shelfmark.operators.geometry import project
from shelfmark.operators.learn import PARAMS
from shelfmark.operators.sonic import cluster_purity
from shelfmark.schema import conform
from shelfmark.sources import folders
from shelfmark.sources.config import load_params
from shelfmark.sources.features import with_labels
from shelfmark.sources.store import Store
from shelfmark.sources.tables import checkpointed


def _kept(results: DataFrame) -> DataFrame:
    """``results`` in the shared folder, its columns told apart from those of the table they came from."""
    return checkpointed(results).select(*(F.col(c).alias(c) for c in results.columns))


def run_discover(store: Store, files: DataFrame, trust_known: bool = True, limit: int | None = None, dry_run: bool = False) -> dict[str, int]:
    """Scans ``files`` (path, mtime, size; where there is an ``ok``, rows without it are errors) into the store's samples.

    Returns the counts: missing, selected, errors. A dry run counts and writes nothing. A file that couldn't be looked
    up is neither taken nor called missing.
    """
    before, token = store.read("samples"), store.token("samples")
    fine = F.coalesce("ok", F.lit(False)) if "ok" in files.columns else F.lit(True)
    todo = changed_files(files.where(fine).select("path", "mtime", "size"), before, trust_known, limit)
    gone = before.where(active()).join(files.select("path"), "path", "left_anti")
    counts = {"missing": gone.count(), "selected": todo.count(), "errors": files.where(~fine).count()}
    if not dry_run:
        store.write("samples", upsert(mark_missing(before, files), with_hints(todo).select("path", "mtime", "size", "path_instrument")), token)
    return counts


def run_label(store: Store, classify: Callable[[DataFrame], DataFrame], classifiers: list[str], redo: list[str] = (), limit: int | None = None, dry_run: bool = False) -> dict[str, int]:
    """Lets ``classify`` judge the files that lack one of ``classifiers``, and writes its results to the store's samples.

    ``classify`` maps samples to (path, ok, error and its columns), a row for each file whether it could be judged or
    not; ``redo`` may be ``all``. Returns the counts: selected, processed, errors. A dry run judges and counts, and writes
    nothing. Results are kept in the shared folder before they are counted and written, so files are judged once.
    """
    if unknown := {*classifiers} - {*CLASSIFIERS}:
        raise ValueError(f"no such classifiers: {', '.join(sorted(unknown))}")
    redo = list(classifiers) if "all" in redo else [c for c in redo if c in classifiers]
    before, token = store.read("samples"), store.token("samples")
    todo = label_todo(before, classifiers, redo, limit)
    results = _kept(classify(todo))
    counts = results.agg(F.count("*").alias("processed"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("errors")).first()
    if not dry_run and counts.processed:
        store.write("samples", label_update(before, results, redo), token)
    return {"selected": todo.count(), "processed": counts.processed, "errors": counts.errors}


def run_embed(store: Store, embed: Callable[[DataFrame], DataFrame], model: str, full: bool = False, limit: int | None = None, force: bool = False) -> dict[str, int]:
    """Embeds what the store's features lack of ``model``: all active files, or those frozen or labelled by people.

    ``embed`` maps paths to (path, vec, ok, error). What is there stays, unless ``force`` asks for all of it again; what
    fails has no row and is tried again next time. Returns the counts: known, selected, embedded, errors.
    """
    features, token = store.read("features"), store.token("features")
    same = features.where(F.col("model") == model)
    wanted = embed_set(store.read("samples"), full)
    todo = wanted if force else resume(wanted, same)
    todo = todo.orderBy("path").limit(limit) if limit else todo
    results = _kept(embed(todo))
    counts = results.agg(F.count("*").alias("n"), F.count_if(F.coalesce("ok", F.lit(False))).alias("embedded")).first()
    if counts.embedded:
        fresh = results.where("ok").select("path", F.lit(model).alias("model"), "vec")
        kept = features.join(fresh.select("path", "model"), ["path", "model"], "left_anti")
        store.write("features", conform(kept, "features").unionByName(conform(fresh, "features")), token)
    return {"known": same.count(), "selected": counts.n, "embedded": counts.embedded, "errors": counts.n - counts.embedded}


def _sources(store: Store) -> tuple[DataFrame, dict, list[str]]:
    params = load_params(store.read("ml_params"), store.read("weak_map"))
    model = params.get("feature_model", PARAMS["feature_model"])
    features = store.read("features").where(F.col("model") == model)
    if features.isEmpty():
        raise ValueError(f"no features of {model}: embed first")
    return features, params, sorted(r.name for r in store.read("taxonomy").select("name").distinct().collect())  # tens of names


def run_train(store: Store, purity: bool = False, folds: int = 5, now: float | None = None) -> dict:
    """Trains the heads on the store's tables and saves them with their metrics row, which it returns.

    ``purity`` lets bulk labels weigh by the agreement within their cluster. Raises without features or classes.
    """
    features, params, classes = _sources(store)
    if not classes:
        raise ValueError("no classes in the taxonomy")
    samples = store.read("samples")
    pure = cluster_purity(samples) if purity else None
    heads, metrics = learn.train(features, samples, store.read("sample_labels"), classes, params["weak_label_map"], {k: params[k] for k in PARAMS if k in params}, now, pure, folds)
    learn.save(store, heads, metrics)
    return metrics


def run_predict(store: Store) -> dict[str, int]:
    """Predicts with the saved heads, and writes the store's samples and model labels. Returns the counts: predicted, emitted.

    Raises without features, without a model, for a model of the older kind, which had one label an item, and for one
    that was fitted to vectors of another length.
    """
    features, _, _ = _sources(store)
    heads, version = learn.load(store)
    if not version.startswith("ovr_"):
        raise ValueError(f"{version} is a model of one label an item: train again")
    if features.where(F.size("vec") != len(heads[0].weights)).count():
        raise ValueError(f"{version} was fitted to vectors of {len(heads[0].weights)} components")
    token = store.token("samples")
    samples, emitted = learn.predict(features, store.read("samples"), heads, version)
    emitted = _kept(emitted)
    counts = {"predicted": features.count(), "emitted": emitted.count()}
    store.write("samples", samples, token)
    store.write("model_labels", emitted)
    return counts


def run_export(store: Store, force: bool = False) -> tuple[str, bool]:
    """(folder, whether it was written now): the features of the model in use with the labels that training reads.

    The folder is named by the model and the versions of both tables, so that what is there is taken as it is unless
    they have changed; ``force`` writes it anew. Features without a catalog row have empty labels.
    """
    features, params, _ = _sources(store)
    model = params.get("feature_model", PARAMS["feature_model"])
    path = f"{store.root}/exports/{model}-{store.token('features')}-{store.token('samples')}"
    if folders.exists(store.spark, f"{path}/_SUCCESS") and not force:
        return path, False
    named = {"human_instrument": "human", "path_instrument": "weak_path", "panns_instrument": "weak_panns"}
    with_labels(features.select("path", "vec"), store.read("samples")).withColumnsRenamed(named).write.mode("overwrite").parquet(path)
    return path, True


def run_project(store: Store, method: str | Callable = "pca", sample: int | None = None) -> int:
    """Projects the features of the model in use and replaces the store's projection by it; returns its rows."""
    features, _, _ = _sources(store)
    points = _kept(project(features.select("path", "vec"), "path", method, sample))
    store.write("projection", points)
    return points.count()
