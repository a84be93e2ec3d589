"""Similarity search and what is attached to its hits."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import blank, mapped
from shelfmark.functions.vectors import dot
from shelfmark.operators.labels import label_sets
from shelfmark.sources.store import Store


def scored(vectors: DataFrame, query: DataFrame, digits: int = 6) -> DataFrame:
    """``vectors`` (key, vec) with ``score``: the inner product with the one row of ``query`` (qvec).

    A single query row is broadcast; the scan of the vectors is the whole cost and parallel.
    """
    one = F.broadcast(query.select("qvec").limit(1))
    return vectors.crossJoin(one).withColumn("score", F.round(dot(F.col("vec"), F.col("qvec")), digits)).drop("qvec")


def neighbors(vectors: DataFrame, key: str, query, k: int = 20) -> DataFrame:
    """The k most similar rows to the row whose ``key`` is ``query``, itself excluded; ties by key."""
    asked = vectors.where(F.col(key) == query).select(F.col("vec").alias("qvec"))
    hits = scored(vectors.where(F.col(key) != query), asked)
    return hits.orderBy(F.desc("score"), key).limit(k).select(key, "score")


def page(vectors: DataFrame, key: str, query: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """One page of the rows in order of similarity to ``query`` (qvec)."""
    return scored(vectors, query).orderBy(F.desc("score"), key).offset(offset).limit(k).select(key, "score")


def resolve(items: DataFrame, key: str, row_id: str, query: str) -> DataFrame:
    """The item whose key is ``query``, else the first by row id whose key contains it in any case."""
    exact = F.col(key) == query
    hits = items.where(exact | F.lower(key).contains(query.lower()))
    return hits.orderBy(F.desc(exact), row_id).limit(1)


def fetch_meta(hits: DataFrame, samples: DataFrame, labels: DataFrame, model_labels: DataFrame) -> DataFrame:
    """``hits`` (path, …) with the catalog's columns, confidences to 3 digits, the label set and the model's labels."""
    meta = samples.select("path", "instrument", "sample_type", "duration_s", "bpm", "key", "source", "path_instrument", "panns_instrument", F.round("panns_conf", 3).alias("panns_conf"), "human_instrument", "model_instrument", F.round("model_conf", 3).alias("model_conf"), F.coalesce("rating", F.lit(0)).alias("rating"))
    wanted = hits.select("path").distinct()
    sets = label_sets(labels.join(wanted, "path", "left_semi"))
    emitted = model_labels.join(wanted, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("minus"), "label"))).alias("ranked"))
    emitted = emitted.select("path", F.transform("ranked", lambda x: F.struct(x["label"].alias("label"), F.round(-x["minus"], 3).alias("conf"))).alias("model_labels"))
    return hits.join(meta, "path", "left").join(sets, "path", "left").join(emitted, "path", "left")


def with_map_index(hits: DataFrame, indexed: DataFrame) -> DataFrame:
    """``map_i`` of each hit, -1 where the map lacks it."""
    return hits.join(indexed.select("path", "map_i"), "path", "left").withColumn("map_i", F.coalesce("map_i", F.lit(-1)))


def similar(vectors: DataFrame, items: DataFrame, query: str, k: int = 24) -> DataFrame:
    """The neighbours of the item that ``query`` resolves to; none if it resolves to nothing. Keys are paths."""
    asked = resolve(items, "path", "row_id", query).select(F.col("path").alias("q")).join(vectors.select(F.col("path").alias("q"), F.col("vec").alias("qvec")), "q")
    others = vectors.crossJoin(F.broadcast(asked)).where("path <> q").withColumn("score", F.round(dot(F.col("vec"), F.col("qvec")), 6))
    return others.orderBy(F.desc("score"), "path").limit(k).select("path", "score")


def similar_report(vectors: DataFrame, items: DataFrame, samples: DataFrame, labels: DataFrame, model_labels: DataFrame, indexed: DataFrame, query: str, k: int = 24) -> DataFrame:
    """The whole answer to a similarity search: query, matched, n, place, name, score (3 digits), map_i and the hits' metadata.

    n is the number of vectors, there whether the query resolves or not; a query that resolves to nothing, or to an item
    without a vector, has one row with its n and a null ``matched``. Hits are numbered from 1 in order of score.
    """
    spark = vectors.sparkSession
    matched = resolve(items, "path", "row_id", query).join(vectors.select("path"), "path", "left_semi").select(F.col("path").alias("matched"))
    hits = similar(vectors, items, query, k)
    ranked = hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path")))  # k rows
    full = with_map_index(fetch_meta(ranked, samples, labels, model_labels), indexed).withColumn("score", F.round("score", 3))
    asked = spark.range(1).select(F.lit(query).alias("query")).join(F.broadcast(matched), F.lit(True), "left").join(F.broadcast(vectors.agg(F.count("*").alias("n"))), F.lit(True))
    named = F.substring_index("path", "/", -1)
    return asked.join(F.broadcast(full.select("*", named.alias("name"))), F.col("matched").isNotNull(), "left")


def report_lines(report: DataFrame) -> DataFrame:
    """place, line of a similarity search's whole answer, as a terminal shows it; a search without a match is one line."""
    cell = lambda c, width: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ")
    end = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 4, " ")
    hit = F.concat(F.lpad(F.format_string("%.3f", "score"), 5, " "), F.lit("  "), cell("instrument", 7), F.lit(" "), cell("sample_type", 7), F.lit(" "), end("bpm"), F.lit(" "), end("key"), F.lit("  "), "name")
    none = F.concat(F.lit("no sample matching '"), "query", F.lit("' (index has "), F.col("n").cast("string"), F.lit(" embeddings)"))
    return report.select(F.coalesce("place", F.lit(0)).alias("place"), F.when(F.col("matched").isNull(), none).otherwise(hit).alias("line"))


def with_selection(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """The hits (path, map_i, …) that are on the map, and the map's ``selected`` points (path, map_i), each once.

    A point that is both counts as a hit (``hit`` true).
    """
    on_map = hits.where("map_i >= 0").select("path", "map_i").distinct().withColumn("hit", F.lit(True))
    rest = selected.select("path", "map_i").distinct().join(on_map.select("path"), "path", "left_anti").withColumn("hit", F.lit(False))
    return on_map.unionByName(rest)


class Index:
    """The vectors of a store's features, held by the executors for searches until the features change.

    ``vectors`` asks for the table's token, a look at a folder; while it is the one that was loaded, searches read the
    held rows and no Parquet. A new token, or an age over ``max_age`` seconds, gives them up and loads what is there now.
    Rows that an executor loses are read again from the version they came from.
    """

    def __init__(self, store: Store, max_age: float = 0):
        self.store, self.max_age = store, max_age
        self._token, self._loaded, self._rows, self.n = None, 0.0, None, 0

    def vectors(self) -> DataFrame:
        token = self.store.token("features")
        if token != self._token or self.max_age and time.time() - self._loaded > self.max_age:
            self.drop()
            self._rows = self.store.read("features").select("path", "vec").persist(StorageLevel.MEMORY_AND_DISK)
            self._token, self._loaded, self.n = token, time.time(), self._rows.count()
        return self._rows

    def neighbors(self, path: str, k: int = 20) -> DataFrame:
        return neighbors(self.vectors(), "path", path, k)

    def drop(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()
        self._token, self._rows, self.n = None, None, 0


def propagate_candidates(vectors: DataFrame, samples: DataFrame, path: str, k: int = 24, preselect: float = 0.93) -> DataFrame:
    """The k neighbours less those that people labelled, so k or fewer; the closest come selected."""
    near = neighbors(vectors, "path", path, k)
    unlabeled = samples.where(blank(F.col("human_instrument"))).select("path")
    return near.join(unlabeled, "path").select("path", "score", (F.col("score") >= preselect).alias("selected")).orderBy(F.desc("score"), "path")


def suggestion(model: Column, panns: Column, path: Column, vocabulary: dict[str, str], valid: list[str]) -> Column:
    """The first of the three, mapped, that is a valid label."""
    choices = [mapped(c, vocabulary) for c in (model, panns, path)]
    return F.coalesce(*(F.when(c.isin(valid), c) for c in choices))


def disagree(model: Column, panns: Column, path: Column, vocabulary: dict[str, str]) -> Column:
    """Whether the three labels, mapped, name more than one thing; nulls name nothing."""
    return F.size(F.array_distinct(F.array_compact(F.array(*(mapped(c, vocabulary) for c in (model, panns, path)))))) > 1


def best_label(human_set: Column, instrument: Column, model: Column, panns: Column) -> Column:
    return F.coalesce(F.try_element_at(human_set, F.lit(1)), instrument, model, panns, F.lit("?"))


def label_choices(hits: DataFrame, best: str) -> DataFrame:
    """place, label: what a hit list can be filtered by, ``all`` first, then the hits' best labels in order."""
    known = hits.agg(F.array_sort(F.collect_set(best)).alias("known"))
    return known.select(F.posexplode(F.concat(F.array(F.lit("all")), "known")).alias("place", "label"))


def hit_filter(best: Column, kind: Column, duration: Column, label: str = "all", sample_type: str = "all", longest: float = 0) -> Column:
    """The filter of a hit list by label, type (``other``: neither one-shot nor loop) and longest duration."""
    out = F.lit(True) if label == "all" else best == label
    if sample_type == "other":
        out = out & ~F.coalesce(kind.isin("oneshot", "loop"), F.lit(False))
    elif sample_type != "all":
        out = out & F.coalesce(kind == sample_type, F.lit(False))
    return out & (F.coalesce(duration, F.lit(0.0)) <= longest) if longest > 0 else out


def is_similarity_query(text: str) -> bool:
    """A query with a path separator asks for similar items, any other is a text search."""
    return "/" in text or "\\" in text


def first_with_prefix(taxonomy: DataFrame, prefix: str) -> DataFrame:
    return taxonomy.where(F.col("name").startswith(prefix)).agg(F.min("name").alias("name"))


def review_steps(samples: DataFrame, gold: bool = False) -> DataFrame:
    """Which review steps each item has done, and whether all; a gold review has the labelling step only."""
    rated, typed, labeled = F.coalesce("rating", F.lit(0)) > 0, ~blank(F.col("human_sample_type")), ~blank(F.col("human_instrument"))
    complete = labeled if gold else rated & typed & labeled
    return samples.select("path", rated.alias("rated"), typed.alias("typed"), labeled.alias("labeled"), complete.alias("complete"))
