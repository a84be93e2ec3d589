"""The evaluation set: stratified sampling, status, freezing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import blank
from shelfmark.operators.catalog import active

#: Paths that a choice may bring to the driver.
MOST_CHOICES = 2_000_000


def sample(samples: DataFrame, model_labels: DataFrame, per_class: int = 25, include_none: int = 50, seed: int = 42) -> DataFrame:
    """``samples`` with more gold_candidate rows: ``per_class`` of each predicted label, ``include_none`` without one.

    Additive: what a label already has counts. Rows are taken in the order of a hash of seed and path, each for the
    first label (by name) that still needs it; rows people have labelled aren't taken. A label can lose to the ones
    before it as many rows as they need, so one ranked pass brings enough of each to choose from: with L labels at
    most L * (L + 1) / 2 * ``per_class`` paths, and ``include_none``; more than ``MOST_CHOICES`` in all raise.
    """
    if not (1 <= per_class <= 500 and 0 <= include_none <= 2000):
        raise ValueError("per_class is 1 to 500, include_none 0 to 2000")
    spark = samples.sparkSession
    state = samples.where(active()).select("path", "gold_candidate", blank(F.col("human_instrument")).alias("free"))
    pool = state.join(model_labels.where("label IS NOT NULL").select("path", "label").distinct(), "path", "left")
    have = {r.label: r.n for r in pool.groupBy("label").agg(F.count_if(F.col("gold_candidate")).alias("n")).collect()}  # labels are few
    needs = {name: max(0, per_class - have[name]) for name in sorted(n for n in have if n is not None)}
    reach, total = {}, 0
    for name, need in needs.items():
        reach[name] = total = total + need
    if None in have:
        needs[None] = reach[None] = max(0, include_none - have[None])
    if not any(needs.values()):
        return samples
    if sum(reach.values()) > MOST_CHOICES:
        raise ValueError(f"{len(needs)} labels need more than {MOST_CHOICES} rows to choose from: are they those of the taxonomy?")
    most = F.broadcast(spark.createDataFrame([*reach.items()], "name string, reach int"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), F.col("path")), "path")
    ranked = pool.where(~F.col("gold_candidate") & F.col("free")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max(reach.values()))
    choices: dict[str | None, list[str]] = {name: [] for name in needs}
    for r in ranked.join(most, F.col("label").eqNullSafe(F.col("name"))).where("rn <= reach").orderBy("label", "rn").collect():
        choices[r.label].append(r.path)
    taken: set[str] = set()
    for name, need in needs.items():
        taken.update([p for p in choices[name] if p not in taken][:need])
    chosen = F.broadcast(spark.createDataFrame([(p, True) for p in sorted(taken)], "path string, __taken boolean"))
    return samples.join(chosen, "path", "left").withColumn("gold_candidate", F.col("gold_candidate") | F.coalesce("__taken", F.lit(False))).select(*samples.columns)


def pool_sizes(samples: DataFrame, model_labels: DataFrame) -> DataFrame:
    """label, n: distinct active items that the model gives each label."""
    return model_labels.join(samples.where(active()).select("path"), "path", "left_semi").groupBy("label").agg(F.countDistinct("path").alias("n"))


def status(samples: DataFrame) -> DataFrame:
    """candidates, labeled, single, frozen, remaining, pct and whether freezing has something to do."""
    gold, labeled = F.col("gold_candidate"), ~blank(F.col("human_instrument"))
    counts = samples.agg(
        F.count_if(gold).alias("candidates"),
        F.count_if(gold & labeled).alias("labeled"),
        F.count_if(gold & labeled & (F.col("label_source") == "single")).alias("single"),
        F.count_if(F.col("is_val")).alias("frozen"),
    )
    remaining = F.col("candidates") - F.col("labeled")
    pct = F.when(F.col("candidates") > 0, F.round(100 * F.col("labeled") / F.col("candidates"), 1)).otherwise(0.0)
    return counts.select("*", remaining.alias("remaining"), pct.alias("pct"), ((remaining == 0) & (F.col("labeled") > F.col("frozen"))).alias("can_freeze"))


def support(samples: DataFrame, labels: DataFrame, flag: str = "gold_candidate") -> DataFrame:
    """label, n: flagged items whose set has each label."""
    return labels.join(samples.where(F.col(flag)).select("path"), "path", "left_semi").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def freeze(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with is_val set on gold rows labelled one by one, the counts frozen and skipped)."""
    done = F.col("gold_candidate") & ~blank(F.col("human_instrument"))
    single = F.coalesce(F.col("label_source") == "single", F.lit(False))
    counts = samples.agg(F.count_if(done & single).alias("frozen"), F.count_if(done & (F.col("label_source") != "single")).alias("skipped"))
    return samples.withColumn("is_val", F.col("is_val") | (done & single)), counts


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash of ``key``; one pass, for strata that don't overlap."""
    within = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("rn", F.row_number().over(within)).where(F.col("rn") <= n)
