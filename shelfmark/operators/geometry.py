"""The 2-D projection and the map: coordinates, codes, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import hue
from shelfmark.functions.vectors import unit
from shelfmark.operators.retrieve import fetch_meta
from shelfmark.operators.sonic import with_cluster_labels
from shelfmark.sources.store import Store
from shelfmark.sources.tables import checkpointed

TYPES = ("oneshot", "loop")
PROVENANCE = ("single", "cluster", "map", "propagate", "llm")
FIELDS = {"instrument": "instrument", "human": "human_instrument", "model": "model_instrument", "path_label": "path_instrument", "panns": "panns_instrument"}


def normalize01(points: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's range moved to 0..1; a constant column becomes 0."""
    bounds = points.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    joined = points.crossJoin(F.broadcast(bounds))
    scaled = {c: (F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in columns}
    return joined.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in points.columns))


def project(features: DataFrame, key: str = "path", method: str | Callable = "pca", sample: int | None = None, seed: int = 0) -> DataFrame:
    """key, x, y in 0..1: the two leading principal components of the unit vectors, signs pinned by the largest loading.

    ``method`` may be a function from (key, vec) rows to (key, x, y) for another projection. ``sample`` keeps that
    many rows, in the order of a seeded hash of the key.
    """
    rows = features.select(key, unit(F.col("vec")).alias("vec"))
    if sample:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample)
    if callable(method):
        return normalize01(method(rows), ["x", "y"])
    dense = rows.select(key, array_to_vector("vec").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(dense)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    points = model.transform(dense).select(key, vector_to_array("pc").alias("p"))
    return normalize01(points.select(key, *((F.col("p")[j] * signs[j]).alias(n) for j, n in enumerate("xy"))), ["x", "y"])


def _code(column: Column, names: list[str], missing: int) -> Column:
    return F.coalesce(*(F.when(column == n, F.lit(i)) for i, n in enumerate(names)), F.lit(missing)) if names else F.lit(missing)


def map_rows(projection: DataFrame, samples: DataFrame, taxonomy: DataFrame, n_families: int = 0) -> DataFrame:
    """The map's columns, dictionary-encoded: five category codes, family, type, provenance, rounded coordinates.

    Categories are numbered by name; what isn't one gets their number. map_i is the place in order of path.
    """
    names = [r.name for r in taxonomy.select("name").distinct().orderBy("name").collect()]  # the taxonomy has tens of names
    rows = projection.select("path", "x", "y").join(samples, "path")
    codes = [_code(F.col(source), names, len(names)).alias(field) for field, source in FIELDS.items()]
    family = F.when((F.col("cluster_l1") >= 0) & (F.col("cluster_l1") < n_families), F.col("cluster_l1")).otherwise(F.lit(n_families))
    coded = rows.select("path", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), *codes, family.alias("family"), _code(F.col("sample_type"), list(TYPES), 2).alias("t"), F.round(F.coalesce("duration_s", F.lit(0.0)), 2).alias("d"), _code(F.col("label_source"), list(PROVENANCE), 5).alias("ls"))
    return numbered(coded, "path", "map_i")


def map_of(points: Store, catalog: Store, n_families: int = 0) -> DataFrame:
    """The map's rows of a projection in one store and the catalog in another, as they are now."""
    return map_rows(points.read("projection"), catalog.read("samples"), catalog.read("taxonomy"), n_families)


def numbered(rows: DataFrame, by: str, into: str) -> DataFrame:
    """``rows`` numbered from 0 in order of ``by``, nulls first, without bringing them into one task.

    Sorted ranges are written once, as places in them must not change when they are counted; their offsets, one for
    each partition, are broadcast.
    """
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpointed(ranged).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "__part").withColumn(into, (F.col("__before") + within).cast("int")).select(*rows.columns, into)


def write_points(indexed: DataFrame, path: str, parts: int = 16) -> None:
    """Writes the map's rows (map_i, …) in ranges of map_i, so that a file's statistics tell which points it holds."""
    indexed.repartitionByRange(parts, "map_i").sortWithinPartitions("map_i").write.mode("overwrite").parquet(path)


def point(spark: SparkSession, path: str, i: int) -> DataFrame:
    """The row of the map at ``path`` whose map_i is ``i``, if there is one; files of other ranges are passed over."""
    return spark.read.parquet(path).where(F.col("map_i") == F.lit(i).cast("int"))


def point_details(spark: SparkSession, path: str, i: int, samples: DataFrame, labels: DataFrame, model_labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """What the map shows of one point: path, name, the catalog's columns, label sets, and the labels of its clusters."""
    full = fetch_meta(F.broadcast(point(spark, path, i).select("path")), samples, labels, model_labels)
    placed = full.join(samples.select("path", "cluster_id", "cluster_l1"), "path", "left")
    return with_cluster_labels(placed, clusters).withColumn("name", F.substring_index("path", "/", -1))


def shown(categories: list[int], types: list[int], provenance: list[int], low: float = 0, high: float = 0, field: str = "instrument") -> Column:
    """Whether a point passes the map's filters; the duration bounds bind only known durations, and only if set."""
    d = F.col("d")
    long_enough = (d <= 0) | (d >= low) if low > 0 else F.lit(True)
    short_enough = (d <= 0) | (d <= high) if high > 0 else F.lit(True)
    return F.col(field).isin(categories) & F.col("t").isin(types) & F.col("ls").isin(provenance) & long_enough & short_enough


def to_screen(points: DataFrame, scale: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """``points`` with sx, sy: x and y (0..1) magnified by ``scale`` and moved, in pixels; y grows downwards."""
    return points.select("*", (F.col("x") * scale * width + dx).alias("sx"), ((1 - F.col("y")) * scale * height + dy).alias("sy"))


def to_map(points: DataFrame, scale: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """The inverse of ``to_screen``: ``points`` with x, y of sx, sy."""
    return points.select("*", ((F.col("sx") - dx) / (scale * width)).alias("x"), (1 - (F.col("sy") - dy) / (scale * height)).alias("y"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule, behind a test of the bounding box."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        if ay != by:
            straddles = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + F.when(straddles & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return box & (crossings % 2 == 1)


def nearest(points: DataFrame, key: str, x: float, y: float, radius: float) -> DataFrame:
    """The closest point strictly within ``radius``; none if there is none."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d2", d2).where(F.col("d2") < radius * radius).orderBy("d2", key).limit(1).select(key, "d2")


def directional(points: DataFrame, key: str, x: float, y: float, dx: float, dy: float, cone: float = 0.3) -> DataFrame:
    """The next point in a direction: least distance over cosine, among cosines of ``cone`` or more."""
    vx, vy = F.col("x") - x, F.col("y") - y
    distance = F.sqrt(vx * vx + vy * vy)
    rows = points.withColumn("dist", distance).where("dist > 0").withColumn("cos", (vx * dx + vy * dy) / F.col("dist"))
    return rows.where(F.col("cos") >= cone).withColumn("score", F.col("dist") / F.col("cos")).orderBy("score", key).limit(1).select(key, "score")


def decimated(points: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """Every k-th point, so that about ``most`` of ``n`` remain to draw."""
    return points.where(F.col("map_i") % max(1, -(-n // most)) == 0)


def colors(taxonomy: DataFrame, fixed: dict[str, str]) -> DataFrame:
    """name, color: the fixed colour or one of a stable hue."""
    given = F.coalesce(*(F.when(F.col("name") == n, F.lit(c)) for n, c in fixed.items()), F.lit(None)) if fixed else F.lit(None).cast("string")
    made = F.concat(F.lit("hsl("), hue(F.col("name")).cast("string"), F.lit(", 60%, 55%)"))
    return taxonomy.select("name", F.coalesce(given, made).alias("color"))
