"""The active-learning queue: what to label next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import blank
from shelfmark.operators.catalog import active
from shelfmark.operators.labels import label_sets
from shelfmark.operators.sonic import with_cluster_labels
from shelfmark.sources.tables import checkpointed

PER_CLASS, BONUS, TOO_CLOSE = 100, 2.0, 0.95


def candidates(samples: DataFrame, model_labels: DataFrame, mode: str = "disagree") -> DataFrame:
    """Unlabelled rows by mode: ``gold`` candidates, ``class_X`` (uncertain of, or emitting, X), else all predicted.

    A null source (never predicted) drops out of all modes but ``gold``.
    """
    unlabeled = blank(F.col("human_instrument"))
    if mode == "gold":
        return samples.where(F.col("gold_candidate") & unlabeled)
    rows = samples.where(active() & (F.col("source") != "human") & unlabeled)
    if not mode.startswith("class_"):
        return rows
    name = mode.removeprefix("class_")
    emitted = model_labels.where(F.col("label") == name).select("path", F.lit(True).alias("__emits")).distinct()
    return rows.join(emitted, "path", "left").where((F.col("model_margin_label") == name) | F.col("__emits")).select(*samples.columns)


def vocabulary(weak_map: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """old_label, new_label: the weak map, and every current label as itself unless the map has it."""
    same = taxonomy.select(F.col("name").alias("old_label"), F.col("name").alias("new_label"))
    return weak_map.select("old_label", "new_label").unionByName(same.join(weak_map.select("old_label"), "old_label", "left_anti"))


def ranked(rows: DataFrame, words: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``rows`` with disagree, sort_score and rn: the order within the predicted class, lowest score first.

    The score is the margin (else the confidence, else 1) less 2 for a disagreement: the path's label differs from
    the mapped panns label or from the model's. A label that can't be mapped disagrees with nothing. Ties by path.
    """
    joined = rows.join(F.broadcast(words.select(F.col("old_label").alias("panns_instrument"), F.col("new_label").alias("panns_mapped"))), "panns_instrument", "left")
    differs = F.coalesce(F.col("path_instrument") != F.col("panns_mapped"), F.lit(False)) | F.coalesce(F.col("model_instrument") != F.col("path_instrument"), F.lit(False))
    score = F.coalesce("model_margin", "model_conf", F.lit(1.0)) - F.when(differs, BONUS).otherwise(0.0)
    within = Window.partitionBy(F.coalesce("model_instrument", F.lit("unknown"))).orderBy("sort_score", "path")
    return joined.withColumn("disagree", differs).withColumn("sort_score", score).withColumn("rn", F.row_number().over(within)).where(F.col("rn") <= per_class)


def greedy(rows: DataFrame, limit: int = 80, too_close: float = TOO_CLOSE) -> DataFrame:
    """``rows`` (path, rn, vec) in order of rn and path, without those too similar to one kept before, up to ``limit``.

    Rows without a vector are kept and block nothing. The choice is sequential, so its input must be bounded: the
    queue's is, by ``per_class`` rows for each class of the taxonomy.
    """

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([p for p in parts if len(p)] or [pd.DataFrame({"path": [], "rn": [], "vec": []})]).sort_values(["rn", "path"])
        kept, vectors = [], []
        for path, rn, vec in frame[["path", "rn", "vec"]].itertuples(index=False):
            if len(kept) == limit:
                break
            if vec is not None:
                v = np.asarray(vec, np.float64)
                if vectors and (np.array([x for x in vectors if len(x) == len(v)]).reshape(-1, len(v)) @ v > too_close).any():
                    continue
                vectors.append(v)
            kept.append((path, rn))
        yield pd.DataFrame(kept, columns=["path", "rn"])

    # dealt to one task, not coalesced: that would run the plan of ``rows`` in this task too
    return rows.select("path", "rn", "vec").repartition(1).mapInPandas(pick, "path string, rn int")


def queue(samples: DataFrame, model_labels: DataFrame, labels: DataFrame, features: DataFrame, words: DataFrame, mode: str = "disagree", limit: int = 80, too_close: float = TOO_CLOSE, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the queue with label sets, its total before the limit as one row).

    An item without a set has its one label as the set. With ``clusters`` each item has the labels of its grain and
    family. The ranked rows are bounded (``PER_CLASS`` a class) and are written to the shared folder, as is the choice
    among them; so both are made once, whatever is then attached.
    """
    rows = candidates(samples, model_labels, mode)
    ordered = checkpointed(ranked(rows, words))
    few = F.broadcast(checkpointed(greedy(ordered.join(features.select("path", "vec"), "path", "left"), limit, too_close)))  # ``limit`` rows
    emitted = model_labels.join(few.select("path"), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list("label")).alias("model_set"))
    sets = label_sets(labels.join(few.select("path"), "path", "left_semi"))
    full = ordered.drop("rn").join(few, "path").join(sets, "path", "left").join(emitted, "path", "left")
    fallback = F.when(F.col("labels").isNull() & ~blank(F.col("human_instrument")), F.array("human_instrument")).otherwise(F.coalesce("labels", F.array().cast("array<string>")))
    full = full.withColumn("labels", fallback)
    full = full if clusters is None else with_cluster_labels(full, clusters)
    return full.orderBy("rn", "path"), rows.agg(F.count("*").alias("total"))
