"""The dashboard's aggregates. One pass each; distributions break ties by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.catalog import active


def totals(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count_if(active()).alias("processed"), F.count_if(F.col("status") == "error").alias("errors"), F.count("model_conf").alias("modelled"))


def coverage(samples: DataFrame) -> DataFrame:
    """How many active items have a path, panns, human, and any automatic label."""
    either = F.col("path_instrument").isNotNull() | F.col("panns_instrument").isNotNull()
    return samples.where(active()).agg(F.count("*").alias("active"), F.count("path_instrument").alias("path"), F.count("panns_instrument").alias("panns"), F.count("human_instrument").alias("human"), F.count_if(either).alias("any_label"))


def distribution(samples: DataFrame, column: str, top: int = 14) -> DataFrame:
    rows = samples.where(active() & F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def set_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def shares(counts: DataFrame, digits: int = 1) -> DataFrame:
    """``counts`` (label, n) with each label's percentage of the whole."""
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("__all"), digits)).drop("__all")


def bpm_histogram(samples: DataFrame) -> DataFrame:
    low = (F.floor(F.col("bpm") / 10) * 10).cast("int")
    rows = samples.where("bpm IS NOT NULL").groupBy(low.alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")
    return rows.select(F.concat_ws("–", F.col("bucket").cast("string"), (F.col("bucket") + 9).cast("string")).alias("label"), "n")


def confidence_histogram(samples: DataFrame, column: str = "model_conf") -> DataFrame:
    rows = samples.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")
    return rows.select(F.format_string("%.1f+", F.col("bucket") / 10).alias("label"), "n")


def recent_errors(samples: DataFrame, limit: int = 15) -> DataFrame:
    return samples.where(F.col("status") == "error").orderBy(F.desc_nulls_last("ts"), "path").limit(limit).select("path", "error")


def metrics_trend(metrics: DataFrame, last: int = 10) -> DataFrame:
    """The last evaluations that have a macro F1, oldest first, their JSON parsed (null where it is broken)."""
    rows = metrics.where("macro_f1 IS NOT NULL").orderBy(F.desc("ts"), "version").limit(last)
    parsed = lambda c: F.from_json(c, "map<string,double>").alias(c)
    return rows.select("version", "ts", "val_n", "macro_f1", parsed("per_class_f1"), parsed("coverage"), "notes").orderBy("ts", "version")


def patch_coverage(metrics: DataFrame, version: str, samples: DataFrame) -> DataFrame:
    """``metrics`` with the counts of resolved sources added to the coverage JSON of ``version``."""
    counts = samples.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").cast("double").alias("n"))
    entries = F.broadcast(counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("resolved_"), F.col("source")), "n")))).alias("__new")))
    old = F.coalesce(F.from_json("coverage", "map<string,double>"), F.create_map().cast("map<string,double>"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(F.col("__new"), k)), F.col("__new")))
    return metrics.crossJoin(entries).withColumn("coverage", F.when(F.col("version") == version, merged).otherwise(F.col("coverage"))).drop("__new")


def dashboard(samples: DataFrame, labels: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """Every part of the dashboard by name; nothing is computed before it is asked for."""
    parts = {"totals": totals(samples), "coverage": coverage(samples), "human": set_distribution(labels), "bpm": bpm_histogram(samples), "confidence": confidence_histogram(samples), "errors": recent_errors(samples)}
    parts |= {c: distribution(samples, c) for c in ("path_instrument", "panns_instrument", "sample_type", "key", "model_instrument")}
    return parts | {"sonic": clusters.where("level = 1").orderBy(F.desc("size"), "id").select("label", "size")}


# -- sketches of distinct counts


def sketches(rows: DataFrame, by: list[str], value: str, precision: int = 14) -> DataFrame:
    """by, sketch: for each group a sketch of its distinct values, some KB whatever their number.

    Kept for each batch, sketches add up: the sketches of all batches together (``merged``) are the sketch of the whole.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, sketch: the sketches (by, sketch) of each group as one; parts may overlap."""
    return parts.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(parts: DataFrame, into: str = "n") -> DataFrame:
    """The sketches' estimates in place of them; at precision 14 within 3 % (about 0.8 % in the root mean square)."""
    return parts.withColumn(into, F.hll_sketch_estimate("sketch")).drop("sketch")
