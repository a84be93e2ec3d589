"""Feature vectors: one table (path, model, vec) for every model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from shelfmark.functions.vectors import unit


def load(features: DataFrame, model: str, dim: int | None = None) -> DataFrame:
    """path, vec of ``model``, at unit length; vectors of another length drop. A model that isn't there has no rows."""
    rows = features.where((F.col("model") == model) & F.col("vec").isNotNull())
    rows = rows.where(F.size("vec") == dim) if dim else rows
    return rows.select("path", unit(F.col("vec")).cast("array<float>").alias("vec"))


@arrow_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes as vectors."""
    return pa.array([None if b is None else np.frombuffer(b, "<f4") for b in blobs.to_pylist()], pa.list_(pa.float32()))


def load_concat(features: DataFrame, first: str, second: str) -> DataFrame:
    """path, vec: the vectors of two models end to end, for the paths that have both."""
    a, b = load(features, first), load(features, second).withColumnRenamed("vec", "__b")
    return a.join(b, "path").select("path", F.concat("vec", "__b").alias("vec"))


def latest(caches: DataFrame, model: str, default: str = "panns") -> DataFrame:
    """The cache of ``model`` with the largest number, among file names like ``features_clap_12``.

    Names without a model belong to ``default``.
    """
    name = F.regexp_extract("name", r"^features_(?:([a-z]+)_)?(\d+)", 1)
    number = F.nullif(F.regexp_extract("name", r"^features_(?:([a-z]+)_)?(\d+)", 2), F.lit("")).cast("long")
    rows = caches.select("name", F.coalesce(F.nullif(name, F.lit("")), F.lit(default)).alias("model"), number.alias("version"))
    return rows.where((F.col("model") == model) & F.col("version").isNotNull()).orderBy(F.desc("version"), "name").limit(1)


def with_labels(features: DataFrame, samples: DataFrame) -> DataFrame:
    """``features`` with the labels as they are now; what is unknown is empty or 0."""
    meta = samples.select("path", "human_instrument", "path_instrument", "panns_instrument", "label_source", F.col("is_val").cast("int").alias("is_val"))
    return features.join(meta, "path", "left").fillna("", ["human_instrument", "path_instrument", "panns_instrument", "label_source"]).fillna(0, ["is_val"])
