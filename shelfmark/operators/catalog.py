"""The catalog of files: discovery, change detection, upserts and label updates as whole-table transforms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.rules import path_hints
from shelfmark.schema import conform

#: The columns that each classifier fills; a file lacks a classifier's pass if the first is null.
CLASSIFIERS = {"path": ("path_instrument",), "panns": ("panns_instrument", "panns_conf")}


def active() -> Column:
    """Rows that are not missing; a null status drops."""
    return F.col("status") != "missing"


def with_hints(files: DataFrame) -> DataFrame:
    """``files`` (path, mtime, size) with path_instrument, sample_type, bpm and key."""
    return files.select("*", *(c for c in path_hints(F.col("path")))).withColumnRenamed("instrument", "path_instrument")


def changed_files(files: DataFrame, catalog: DataFrame, trust_known: bool = True, limit: int | None = None) -> DataFrame:
    """The files to (re)discover: new ones, those whose rounded mtime or size differ, and missing ones that are back.

    With ``trust_known`` the comparison is skipped: only new and reappeared files are taken.
    """
    known = catalog.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), "status")
    joined = files.join(known, "path", "left")
    same = F.round("mtime", 3).eqNullSafe(F.round("old_mtime", 3)) & F.col("size").eqNullSafe(F.col("old_size"))
    new = F.col("status").isNull() | (F.col("status") == "missing")
    picked = joined.where(new if trust_known else new | ~same).select(*files.columns)
    return picked.orderBy("path").limit(limit) if limit else picked


def mark_missing(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """``catalog`` with status ``missing`` where the path isn't among ``files``."""
    seen = files.select("path", F.lit(True).alias("__seen")).distinct()
    return catalog.join(seen, "path", "left").withColumn("status", F.when(F.col("__seen").isNull(), "missing").otherwise(F.col("status"))).select(*catalog.columns)


def upsert(catalog: DataFrame, files: DataFrame, ts: Column | None = None) -> DataFrame:
    """``catalog`` after discovery of ``files`` (path, mtime, size, path_instrument), one row for each path.

    A new path has status ``new``; a known one gets mtime, size and ts, keeps its hint if it has one, and turns
    from ``missing`` to ``new``. No other column changes, so repeating an upsert changes nothing but ts.
    """
    catalog = conform(catalog, "samples")
    found = files.select("path", F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"), F.col("path_instrument").alias("f_hint"), F.lit(True).alias("f_here"), F.lit(True).alias("f_is"))
    both = catalog.withColumn("c_here", F.lit(True)).join(found, "path", "full_outer")
    here, known = F.col("f_here").isNotNull(), F.col("c_here").isNotNull()
    status = F.when(~known | (here & (F.col("status") == "missing")), "new").otherwise(F.col("status"))
    now = ts if ts is not None else F.unix_timestamp().cast("double")
    changed = {
        "mtime": F.when(here, F.col("f_mtime")).otherwise(F.col("mtime")),
        "size": F.when(here, F.col("f_size")).otherwise(F.col("size")),
        "path_instrument": F.coalesce("path_instrument", "f_hint"),
        "status": status,
        "ts": F.when(here, now).otherwise(F.col("ts")),
        **{flag: F.coalesce(flag, F.lit(False)) for flag in ("tagged", "is_val", "gold_candidate")},
        "rating": F.coalesce("rating", F.lit(0)),
    }
    return conform(both.select(*(changed.get(c, F.col(c)).alias(c) for c in catalog.columns)), "samples")


def label_todo(catalog: DataFrame, classifiers: list[str], redo: list[str] = (), limit: int | None = None) -> DataFrame:
    """Active files that lack one of ``classifiers``; all of them if every classifier is to be redone; none without any."""
    if not classifiers:
        return catalog.limit(0)
    wanted = [F.col(CLASSIFIERS[c][0]).isNull() for c in classifiers if c not in redo]
    rows = catalog.where(active() & (reduce(or_, wanted) if wanted and not redo else F.lit(True) if redo else reduce(or_, wanted)))
    return rows.orderBy("path").limit(limit) if limit else rows


def label_update(catalog: DataFrame, results: DataFrame, redo: list[str] = ()) -> DataFrame:
    """``catalog`` with the classifiers' ``results`` (path, ok, error and their columns).

    A column of a redone classifier is overwritten, any other keeps an old value. Status and error follow ``ok``.
    The resolved instrument and its source are never touched.
    """
    columns = [c for cs in CLASSIFIERS.values() for c in cs if c in results.columns]
    fresh = results.select("path", F.col("ok").alias("r_ok"), F.col("error").alias("r_error"), *(F.col(c).alias(f"r_{c}") for c in columns))
    joined = catalog.join(fresh, "path", "left")
    done, fine = F.col("r_ok").isNotNull(), F.coalesce("r_ok", F.lit(False))
    owner = {c: name for name, cs in CLASSIFIERS.items() for c in cs}
    changed = {c: F.when(fine, F.col(f"r_{c}") if owner[c] in redo else F.coalesce(c, f"r_{c}")).otherwise(F.col(c)) for c in columns}
    changed |= {"status": F.when(done, F.when(fine, "ok").otherwise("error")).otherwise(F.col("status")), "error": F.when(done, F.col("r_error")).otherwise(F.col("error"))}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in catalog.columns))


def discover(catalog: DataFrame, files: DataFrame, trust_known: bool = True, limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalog after a scan, and the scan's counts (missing, selected); a dry run leaves the catalog as it is."""
    todo = changed_files(files, catalog, trust_known, limit)
    gone = catalog.join(files.select("path"), "path", "left_anti").where(active())
    counts = gone.agg(F.count("*").alias("missing")).crossJoin(todo.agg(F.count("*").alias("selected")))
    if dry_run:
        return catalog, counts
    return upsert(mark_missing(catalog, files), with_hints(todo).select("path", "mtime", "size", "path_instrument")), counts


def should_embed(duration: Column, least: float = 1.0) -> Column:
    """Whether a file is long enough to embed."""
    return F.when(duration.isNotNull(), duration >= least).otherwise(F.lit(True))


def embed_set(catalog: DataFrame, full: bool) -> DataFrame:
    """The paths to embed: all active ones, or only those frozen for evaluation or labelled by people."""
    return catalog.where(active() if full else F.col("is_val") | (F.coalesce("human_instrument", F.lit("")) != "")).select("path")


def resume(todo: DataFrame, done: DataFrame) -> DataFrame:
    """What of ``todo`` isn't ``done`` yet, by path."""
    return todo.join(done.select("path"), "path", "left_anti")
