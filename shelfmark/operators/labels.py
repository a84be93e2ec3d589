"""Ordered label sets, the taxonomy, and how an item's one label is resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import blank

SAMPLE_TYPES = ("oneshot", "loop")


def label_sets(labels: DataFrame, key: str = "path", into: str = "labels") -> DataFrame:
    """Each item's labels in the order of their ranks."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return labels.groupBy(key).agg(F.transform(ordered, lambda x: x["label"]).alias(into))


def resolve_interactive(human: Column, model: Column, panns: Column, path: Column) -> list[Column]:
    """instrument and source right after a person's label: the first that there is."""
    source = F.when(human.isNotNull(), "human").when(model.isNotNull(), "model").when(panns.isNotNull(), "panns").when(path.isNotNull(), "path").otherwise("none")
    return [F.coalesce(human, model, panns, path).alias("instrument"), source.alias("source")]


def resolve_predict(human: Column, model: Column, conf: Column, threshold: Column, path: Column) -> list[Column]:
    """instrument and source after a prediction: the model counts only at its class's threshold, panns not at all."""
    sure = F.coalesce(conf >= threshold, F.lit(False)) & model.isNotNull()
    source = F.when(~blank(human), "human").when(sure, "model").when(~blank(path), "path").otherwise("none")
    label = F.when(~blank(human), human).when(sure, model).when(~blank(path), path)
    return [label.alias("instrument"), source.alias("source")]


def _resolved(samples: DataFrame, touched: Column) -> DataFrame:
    instrument, source = resolve_interactive(*(F.col(c) for c in ("human_instrument", "model_instrument", "panns_instrument", "path_instrument")))
    return samples.withColumns({"instrument": F.when(touched, instrument).otherwise(F.col("instrument")), "source": F.when(touched, source).otherwise(F.col("source"))})


def _unknown(labels: list[str], taxonomy: DataFrame) -> list[str]:
    known = {r[0] for r in taxonomy.where(F.col("name").isin(labels)).select("name").collect()} if labels else set()
    return [x for x in labels if x not in known]


def bulk_label(samples: DataFrame, labels: DataFrame, paths: DataFrame, new: list[str], source: str, taxonomy: DataFrame, only_unlabeled: bool = False, ts: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, label sets, targets) after the set of every target is replaced by ``new``, in that order.

    Targets are the ``paths`` that exist (and, on request, have no label). Labels are cleaned; one that the taxonomy
    lacks rejects the whole update. An empty set clears the label and its source.
    """
    new = list(dict.fromkeys(x for x in new if x))
    if unknown := _unknown(new, taxonomy):
        raise ValueError(f"unknown labels: {unknown}")
    targets = samples.join(paths.select("path").distinct(), "path", "left_semi")
    if only_unlabeled:
        targets = targets.where(blank(F.col("human_instrument")))
    targets = targets.select("path", F.lit(True).alias("__hit"))
    kept = labels.join(targets, "path", "left_anti").select("path", "label", "rank", "ts")
    rows = targets.select("path", F.posexplode(F.array(*(F.lit(x) for x in new)).cast("array<string>")).alias("k", "label"))
    added = rows.select("path", "label", (F.col("k") + 1).cast("int").alias("rank"), (ts if ts is not None else F.unix_timestamp().cast("double")).alias("ts"))
    hit = F.col("__hit").isNotNull()
    marked = samples.join(targets, "path", "left").withColumns({
        "human_instrument": F.when(hit, F.lit(new[0] if new else None).cast("string")).otherwise(F.col("human_instrument")),
        "label_source": F.when(hit, F.lit(source if new else None).cast("string")).otherwise(F.col("label_source")),
    })
    return _resolved(marked, hit).select(*samples.columns), kept.unionByName(added), targets.select("path")


def label(samples: DataFrame, labels: DataFrame, path: str, new: list[str], taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One item's set replaced, source ``single``; an unknown path is an error."""
    one = samples.where(F.col("path") == path).select("path")
    if one.isEmpty():
        raise ValueError(f"no such path: {path}")
    return bulk_label(samples, labels, one, new, "single", taxonomy)[:2]


def propagate(samples: DataFrame, labels: DataFrame, paths: DataFrame, new: list[str], taxonomy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels given to similar items that have none yet."""
    if not [x for x in new if x]:
        raise ValueError("no labels")
    return bulk_label(samples, labels, paths, new, "propagate", taxonomy, only_unlabeled=True)


def label_map(samples: DataFrame, labels: DataFrame, indexed: DataFrame, picked: list[int], new: list[str], taxonomy: DataFrame, token: str, current: str, only_unlabeled: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels given to points of the map, by index. A stale ``token`` rejects all; unknown indices are ignored."""
    if token != current:
        raise ValueError("the map has changed")
    spark = samples.sparkSession
    paths = indexed.join(spark.createDataFrame([(i,) for i in picked], "map_i int"), "map_i", "left_semi")
    return bulk_label(samples, labels, paths, new, "map", taxonomy, only_unlabeled)


def rate(samples: DataFrame, path: str, rating: int) -> DataFrame:
    if isinstance(rating, bool) or not isinstance(rating, int) or not 0 <= rating <= 5:
        raise ValueError("a rating is an integer from 0 to 5")
    return samples.withColumn("rating", F.when(F.col("path") == path, F.lit(rating)).otherwise(F.col("rating")))


def toggled_rating(old: Column, new: Column) -> Column:
    """Giving the present rating again clears it."""
    return F.when(old == new, 0).otherwise(new)


def set_type(samples: DataFrame, path: str, kind: str | None) -> DataFrame:
    if kind and kind not in SAMPLE_TYPES:
        raise ValueError(f"unknown type {kind}")
    return samples.withColumn("human_sample_type", F.when(F.col("path") == path, F.lit(kind or None).cast("string")).otherwise(F.col("human_sample_type")))


def add_label(taxonomy: DataFrame, name: str) -> DataFrame:
    name = name.strip().lower()
    if not 1 <= len(name) <= 40:
        raise ValueError("a label has 1 to 40 characters")
    new = taxonomy.sparkSession.range(1).select(F.lit(name).alias("name"), F.unix_timestamp().cast("double").alias("created_at"))
    return taxonomy.unionByName(new.join(taxonomy.select("name"), "name", "left_anti"))


def delete_label(samples: DataFrame, labels: DataFrame, taxonomy: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(samples, label sets, taxonomy, items touched) without label ``name``.

    Where it was the first label, the next by rank takes its place, or none; the item is resolved again.
    """
    rest = labels.where(F.col("label") != name)
    next_label = rest.groupBy("path").agg(F.min_by("label", "rank").alias("__next"))
    hit = F.col("human_instrument").eqNullSafe(F.lit(name))
    touched = labels.where(F.col("label") == name).select("path").distinct().count()
    joined = samples.join(next_label, "path", "left").withColumn("__hit", hit)
    promoted = joined.withColumns({"human_instrument": F.when(F.col("__hit"), F.col("__next")).otherwise(F.col("human_instrument")), "label_source": F.when(F.col("__hit") & F.col("__next").isNull(), F.lit(None)).otherwise(F.col("label_source"))})
    return _resolved(promoted, F.col("__hit")).select(*samples.columns), rest, taxonomy.where(F.col("name") != name), touched
