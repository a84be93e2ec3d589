"""Table schemas, and additive evolution towards them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The catalog's tables and their columns.
TABLES = {
    "samples": "path string, mtime double, size bigint, duration_s double, sample_type string, instrument string, tonal string, bpm int, key string, source string, status string, error string, tagged boolean, ts double, path_instrument string, panns_instrument string, panns_conf double, human_sample_type string, human_instrument string, model_instrument string, model_conf double, model_version string, model_margin double, model_margin_label string, is_val boolean, gold_candidate boolean, rating int, label_source string, cluster_id int, cluster_d double, cluster_l1 int",
    "features": "path string, model string, vec array<float>",
    "sample_labels": "path string, label string, rank int, ts double",
    "model_labels": "path string, label string, conf double",
    "metrics": "version string, ts double, val_n bigint, macro_f1 double, per_class_f1 string, coverage string, notes string",
    "taxonomy": "name string, created_at double",
    "weak_map": "old_label string, new_label string",
    "ml_params": "key string, value string",
    "projection": "path string, x double, y double",
    "sonic_clusters": "id int, level int, parent int, size int, label string, centroid double, flatness double, attack double, duration double",
    "head": "class string, w array<double>, b double, threshold double, version string",
}
_FALSE = {"tagged", "is_val", "gold_candidate"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of table ``name``: missing ones are added (null; flags false, rating 0)."""
    have = set(df.columns)
    default = lambda f: F.lit(False) if f.name in _FALSE else F.lit(0) if f.name == "rating" else F.lit(None)
    return df.select(*((F.col(f.name) if f.name in have else default(f)).cast(f.dataType).alias(f.name) for f in schema(name)))
