"""Settings: a typed JSON file, and the parameter and weak-map tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.learn import PARAMS, WEAK_MAP


@dataclass
class Config:
    """Settings with their defaults; the type of a default is the type of its setting."""

    # The names and defaults of the settings file.
    library_path: str = ""
    workers: int = 5
    trust_db: bool = True
    no_cache: bool = False
    label_path: bool = False
    label_panns: bool = True
    label_clap: bool = False
    redo: str = ""
    limit: int = 0
    analyze_seconds: float = 30.0
    panns_min_duration: float = 1.0
    proj_method: str = "auto"
    proj_n_neighbors: int = 25
    proj_min_dist: float = 0.12
    ml: dict = field(default_factory=dict)

    def merged(self, data: dict) -> Config:
        """With the known keys of ``data``, each converted to its type; unknown keys are ignored."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return Config(**asdict(self) | {k: kinds[k](v) for k, v in data.items() if k in kinds})


def read_config(path: str) -> Config:
    """The settings in the JSON file; defaults if it is missing or broken."""
    try:
        with open(path) as f:
            return Config().merged(json.load(f))
    except (OSError, ValueError, TypeError, AttributeError):
        return Config()


def write_config(path: str, changes: dict) -> Config:
    config = read_config(path).merged(changes)
    with open(path, "w") as f:
        json.dump(asdict(config), f, indent=2)
    return config


def seed_params(params: DataFrame, legacy: dict | None = None) -> DataFrame:
    """``params`` (key, value JSON) with what it lacks of the defaults, which older settings override."""
    wanted = PARAMS | {k: v for k, v in (legacy or {}).items() if k != "weak_label_map"}
    defaults = params.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in wanted.items()], "key string, value string")
    return params.unionByName(defaults.join(params.select("key"), "key", "left_anti"))


def seed_weak_map(weak_map: DataFrame, legacy: dict | None = None) -> DataFrame:
    """``weak_map``, or the older settings' map or the default one if it is empty."""
    if not weak_map.isEmpty():
        return weak_map
    chosen = (legacy or {}).get("weak_label_map") or WEAK_MAP
    return weak_map.sparkSession.createDataFrame(list(chosen.items()), "old_label string, new_label string")


def load_params(params: DataFrame, weak_map: DataFrame) -> dict:
    """All parameters; a value that isn't JSON stays a string. Both tables have tens of rows."""

    def value(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    return {r.key: value(r.value) for r in params.collect()} | {"weak_label_map": {r.old_label: r.new_label for r in weak_map.collect()}}


def seed_taxonomy(taxonomy: DataFrame, names: list[str]) -> DataFrame:
    """``taxonomy``, or ``names`` if it is empty."""
    if not taxonomy.isEmpty():
        return taxonomy
    spark: SparkSession = taxonomy.sparkSession
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("created_at", F.unix_timestamp().cast("double"))
