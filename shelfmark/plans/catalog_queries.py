"""Queries over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import rules, scalars
from shelfmark.functions.vectors import unit
from shelfmark.operators import catalog, geometry, gold, graph, labels, learn, retrieve, review, sonic, stages, stats
from shelfmark.plans.standins import CLASSES, WEAK_MAP, oracle, view
from shelfmark.schema import conform
from shelfmark.sources import features as feature_tables
from shelfmark.sources import files
from shelfmark.sources.buckets import Buckets
from shelfmark.sources.store import Store
from shelfmark.sources.tables import checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "review_queue_ranked"
VOCABULARY = dict(WEAK_MAP)
CLOSE = 0.3  # the driver's vectors have no pairs over 0.52


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


_DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_SIM = f"SELECT b.vec_id, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0"


# Similarity


@query(f"{_SIM} ORDER BY score DESC, vec_id LIMIT 20")
def sim_topk(spark, d):
    return retrieve.neighbors(view(spark, d, "vectors"), "vec_id", 0, 20)


@query(f"SELECT h.vec_id, h.score, t.lang, t.source, t.n_chars FROM ({_SIM} ORDER BY score DESC, vec_id LIMIT 20) h LEFT JOIN documents t ON h.vec_id = t.doc_id")
def sim_topk_meta(spark, d):
    hits = retrieve.neighbors(view(spark, d, "vectors"), "vec_id", 0, 20)
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars")
    return hits.join(meta, "vec_id", "left")


@query(f"SELECT b.vec_id, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM @vectors a, @vectors b WHERE a.vec_id = 7 ORDER BY score DESC, vec_id LIMIT 10 OFFSET 20")
def search_page(spark, d):
    vectors = view(spark, d, "vectors")
    return retrieve.page(vectors, "vec_id", vectors.where("vec_id = 7").select(F.col("vec").alias("qvec")), 10, 20)


@query("SELECT path, row_id FROM @samples WHERE path = 'SRC3/12' OR contains(lower(path), 'src3/12') ORDER BY path = 'SRC3/12' DESC, row_id LIMIT 1")
def resolve_query(spark, d):
    return retrieve.resolve(view(spark, d, "samples"), "path", "row_id", "SRC3/12").select("path", "row_id")


def _path_vectors(spark, d):
    return view(spark, d, "samples").select("row_id", "path").join(view(spark, d, "vectors").select(F.col("vec_id").alias("row_id"), "vec"), "row_id")


_PV = "(SELECT s.path, s.row_id, v.vec FROM @samples s JOIN @vectors v ON s.row_id = v.vec_id)"


@query(f"SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, (SELECT * FROM {_PV} WHERE contains(path, '/5.') ORDER BY row_id LIMIT 1) a WHERE a.path <> b.path ORDER BY score DESC, path LIMIT 24")
def similar_items(spark, d):
    rows = _path_vectors(spark, d)
    return retrieve.similar(rows, rows, "/5.", 24)


@query(f"SELECT h.path, h.score, h.score >= 0.3 AS selected FROM (SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, {_PV} a WHERE a.path = 'lib/src0/0.wav' AND a.path <> b.path ORDER BY score DESC, path LIMIT 24) h JOIN @samples s USING (path) WHERE s.human_instrument IS NULL OR s.human_instrument = ''")
def propagate_candidates(spark, d):
    return retrieve.propagate_candidates(_path_vectors(spark, d).select("path", "vec"), view(spark, d, "samples"), "lib/src0/0.wav", 24, CLOSE)


@query(f"SELECT path, (SELECT count(*) FROM @points) - 1 AS n, score FROM (SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, {_PV} a WHERE a.row_id = 3 AND b.row_id <> 3) ORDER BY score DESC, path LIMIT 5")
def paged_with_total(spark, d):
    rows = _path_vectors(spark, d)
    asked = rows.where("row_id = 3").select(F.col("vec").alias("qvec"))
    total = F.broadcast(view(spark, d, "points").agg((F.count("*") - 1).alias("n")))
    return retrieve.page(rows.where("row_id <> 3"), "path", asked, 5).crossJoin(total).select("path", "n", "score")


# Dashboard


@query("SELECT status <> 'missing' AND model_instrument IS NOT NULL AS x, model_instrument AS label, count(*) AS n FROM @samples WHERE status <> 'missing' AND model_instrument IS NOT NULL GROUP BY ALL ORDER BY n DESC, label LIMIT 14")
def label_dist_top14(spark, d):
    return stats.distribution(view(spark, d, "samples"), "model_instrument").select(F.lit(True).alias("x"), "label", "n")


@query("SELECT count(*) AS active, count(path_instrument) AS path, count(panns_instrument) AS panns, count(human_instrument) AS human, count(*) FILTER (WHERE path_instrument IS NOT NULL OR panns_instrument IS NOT NULL) AS any_label FROM @samples WHERE status <> 'missing'")
def coverage(spark, d):
    return stats.coverage(view(spark, d, "samples"))


@query("SELECT count(*) FILTER (WHERE status <> 'missing') AS processed, count(*) FILTER (WHERE status = 'error') AS errors, count(model_conf) AS modelled FROM @samples")
def status_totals(spark, d):
    return stats.totals(view(spark, d, "samples"))


@query("SELECT label, count(*) AS n FROM @sample_labels GROUP BY label")
def set_distribution(spark, d):
    return stats.set_distribution(view(spark, d, "sample_labels"))


@query("SELECT concat(b, '–', b + 9) AS label, n FROM (SELECT CAST(bpm // 10 * 10 AS INT) AS b, count(*) AS n FROM @samples WHERE bpm IS NOT NULL GROUP BY 1)")
def value_hist10(spark, d):
    return stats.bpm_histogram(view(spark, d, "samples"))


@query("SELECT printf('%.1f+', b / 10.0) AS label, n FROM (SELECT floor(model_conf * 10) AS b, count(*) AS n FROM @samples WHERE model_conf IS NOT NULL GROUP BY 1)")
def conf_hist(spark, d):
    return stats.confidence_histogram(view(spark, d, "samples"))


@query("SELECT m.label, count(DISTINCT m.path) AS n FROM @model_labels m JOIN @samples s ON m.path = s.path WHERE s.status <> 'missing' GROUP BY m.label")
def distinct_per_label(spark, d):
    return gold.pool_sizes(view(spark, d, "samples"), view(spark, d, "model_labels"))


@query("SELECT path, error FROM @samples WHERE status = 'error' ORDER BY ts DESC NULLS LAST, path LIMIT 15")
def recent_errors(spark, d):
    return stats.recent_errors(view(spark, d, "samples"))


@query("SELECT source AS label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM @samples WHERE source IS NOT NULL GROUP BY source")
def source_shares(spark, d):
    rows = view(spark, d, "samples").where("source IS NOT NULL")
    return stats.shares(rows.groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n")))


@query("SELECT l_returnflag AS label, l_linestatus AS kind, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def lineitem_distribution(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("kind"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT event_type, CAST(floor(value / 10) * 10 AS INT) AS bucket, count(*) AS n, CAST(max(CAST(json_extract_string(props, '$.k') AS INT)) AS INT) AS top FROM events GROUP BY ALL")
def event_histogram(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.floor(F.col("value") / 10) * 10).cast("int").alias("bucket"), F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.max("k").alias("top"))


@query("SELECT version, macro_f1, per_class_f1 FROM (SELECT CAST(event_id AS VARCHAR) AS version, value AS macro_f1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS per_class_f1, ts FROM events ORDER BY ts DESC, version LIMIT 10)")
def metrics_json(spark, d):
    rows = table(spark, d, "events")
    metrics = rows.select(F.col("event_id").cast("string").alias("version"), F.col("ts"), F.lit(1).alias("val_n"), F.col("value").alias("macro_f1"), F.col("props").alias("per_class_f1"), F.col("props").alias("coverage"), F.lit(None).cast("string").alias("notes"))
    return stats.metrics_trend(metrics).select("version", "macro_f1", F.col("per_class_f1")["k"].alias("per_class_f1"))


@query("SELECT 'v1' AS version, sum(CASE WHEN source = 'human' THEN 1 ELSE 0 END)::DOUBLE AS resolved_human, sum(CASE WHEN source = 'model' THEN 1 ELSE 0 END)::DOUBLE AS resolved_model, 5.0::DOUBLE AS n FROM @samples")
def metrics_patch(spark, d):
    metrics = spark.createDataFrame([("v1", '{"n": 5}')], "version string, coverage string")
    parsed = stats.patch_coverage(metrics, "v1", view(spark, d, "samples")).select("version", F.from_json("coverage", "map<string,double>").alias("c"))
    return parsed.select("version", *(F.col("c")[k].alias(k) for k in ("resolved_human", "resolved_model", "n")))


# Path rules

_FIRST = " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in rules.INSTRUMENTS)
_BASE = "list_extract(string_split(path, '/'), -1)"


@query(f"SELECT p_partkey, CASE {_FIRST} END AS instrument FROM @paths")
def path_rule_first_match(spark, d):
    return view(spark, d, "paths").select("p_partkey", rules.first_rule(F.lower("path")).alias("instrument"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(lower(path), '{rules.ONESHOT}') THEN 'oneshot' WHEN regexp_matches(lower(path), '{rules.LOOP}') THEN 'loop' END AS sample_type FROM @paths")
def sample_type_rule(spark, d):
    return view(spark, d, "paths").select("p_partkey", rules.sample_type(F.col("path")).alias("sample_type"))


@query(f"SELECT p_partkey, CASE WHEN b BETWEEN 40 AND 300 THEN b END AS bpm FROM (SELECT p_partkey, CAST(nullif(regexp_extract(lower({_BASE}), '(^|[^0-9])([0-9]{{2,3}})\\s?bpm\\b', 2), '') AS INT) AS b FROM @paths)")
def bpm_rule(spark, d):
    return view(spark, d, "paths").select("p_partkey", rules.bpm(F.col("path")).alias("bpm"))


_KEY = r"(^|[^A-Za-z])([A-G])[ _]?(#|b)?[ _]?((?i:maj(?:or)?|min(?:or)?|m))?\b"
_SHARP = " ".join(f"WHEN '{f[0]}' THEN '{s}'" for f, s in rules.SHARPS)


@query(f"""
WITH g AS (SELECT p_partkey, {_BASE} AS b FROM @paths),
x AS (SELECT p_partkey, b, regexp_extract(b, '{_KEY}', 2) AS n, regexp_extract(b, '{_KEY}', 3) AS a, lower(regexp_extract(b, '{_KEY}', 4)) AS q FROM g)
SELECT p_partkey, CASE WHEN n <> '' AND (regexp_matches(lower(b), '{rules.KEY_WORD}') OR regexp_matches(b, '{rules.KEY_NOTE}'))
  THEN concat(CASE WHEN a = 'b' THEN CASE n {_SHARP} END ELSE concat(n, a) END, CASE WHEN starts_with(q, 'm') AND NOT starts_with(q, 'maj') THEN 'm' ELSE '' END) END AS key FROM x""")
def key_rule(spark, d):
    return view(spark, d, "paths").select("p_partkey", rules.musical_key(F.col("path")).alias("key"))


# The catalog


def _scan(spark, d):
    """What a later scan finds: most of the catalog, some of it changed, and new files."""
    samples = view(spark, d, "samples").where("row_id % 19 <> 0")
    seen = samples.select("path", F.when(F.col("row_id") % 4 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.lit("kick").alias("path_instrument"))
    new = samples.where("row_id % 23 = 0").select(F.concat("path", F.lit(".flac")).alias("path"), "mtime", "size", F.lit("clap").alias("path_instrument"))
    return seen.unionByName(new)


_SCAN = """scan AS (SELECT path, CASE WHEN row_id % 4 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size, 'kick' AS hint FROM @samples WHERE row_id % 19 <> 0
UNION ALL SELECT concat(path, '.flac'), mtime, size, 'clap' FROM @samples WHERE row_id % 19 <> 0 AND row_id % 23 = 0)"""


@query(f"WITH {_SCAN} SELECT path, coalesce(f.mtime, s.mtime) AS mtime, coalesce(f.size, s.size) AS size, CASE WHEN s.path IS NULL OR (f.path IS NOT NULL AND s.status = 'missing') THEN 'new' ELSE s.status END AS status, coalesce(s.path_instrument, f.hint) AS path_instrument, s.human_instrument FROM @samples s FULL JOIN scan f USING (path)")
def catalog_upsert(spark, d):
    done = catalog.upsert(view(spark, d, "samples"), _scan(spark, d), F.lit(0.0))
    return done.select("path", "mtime", "size", "status", "path_instrument", "human_instrument")


@query("SELECT path, CASE WHEN row_id % 19 = 0 THEN 'missing' ELSE status END AS status FROM @samples")
def mark_missing(spark, d):
    return catalog.mark_missing(view(spark, d, "samples").select("path", "status"), _scan(spark, d))


@query(f"WITH {_SCAN} SELECT f.path, f.mtime, f.size FROM scan f LEFT JOIN @samples s ON f.path = s.path WHERE s.path IS NULL OR s.status = 'missing' OR round(f.mtime, 3) <> round(s.mtime, 3) OR f.size <> s.size")
def changed_files(spark, d):
    return catalog.changed_files(_scan(spark, d).drop("path_instrument"), view(spark, d, "samples"), trust_known=False)


@query(f"WITH {_SCAN} SELECT f.path FROM scan f LEFT JOIN @samples s ON f.path = s.path WHERE s.path IS NULL OR s.status = 'missing'")
def new_files(spark, d):
    return catalog.changed_files(_scan(spark, d).select("path", "mtime", "size"), view(spark, d, "samples")).select("path")


@query("SELECT path FROM @samples WHERE status <> 'missing' AND (path_instrument IS NULL OR panns_instrument IS NULL)")
def label_todo(spark, d):
    return catalog.label_todo(view(spark, d, "samples"), ["path", "panns"]).select("path")


@query("SELECT path, CASE WHEN row_id % 6 = 0 THEN coalesce(path_instrument, 'tom') ELSE path_instrument END AS path_instrument, CASE WHEN row_id % 6 = 0 THEN 'bass' ELSE panns_instrument END AS panns_instrument, CASE WHEN row_id % 6 = 0 THEN 'ok' WHEN row_id % 6 = 1 THEN 'error' ELSE status END AS status FROM @samples")
def label_update(spark, d):
    samples = view(spark, d, "samples")
    results = samples.where("row_id % 6 < 2").select("path", (F.col("row_id") % 6 == 0).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit("tom").alias("path_instrument"), F.lit("bass").alias("panns_instrument"))
    return catalog.label_update(samples, results, redo=["panns"]).select("path", "path_instrument", "panns_instrument", "status")


@query("SELECT path FROM @samples WHERE (is_val OR coalesce(human_instrument, '') <> '') AND row_id % 2 = 1")
def embed_resume(spark, d):
    samples = view(spark, d, "samples")
    return catalog.resume(catalog.embed_set(samples, full=False), samples.where("row_id % 2 = 0"))


# Label sets


@query("SELECT path, coalesce(duration_s >= 1.0, true) AS embeds FROM @samples")
def embed_gate(spark, d):
    return view(spark, d, "samples").select("path", catalog.should_embed(F.col("duration_s")).alias("embeds"))


@query("SELECT path, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM @paths")
def safe_names(spark, d):
    return view(spark, d, "paths").select("path", scalars.safe_name(F.col("path")).alias("name"))


@query("SELECT path, list(label ORDER BY rank, label) AS labels FROM @sample_labels GROUP BY path")
def label_set_ordered(spark, d):
    return labels.label_sets(view(spark, d, "sample_labels"))


@query("SELECT path, arg_min(label, rank) AS human_instrument FROM @sample_labels WHERE label <> 'user' GROUP BY path")
def label_promote(spark, d):
    return view(spark, d, "sample_labels").where("label <> 'user'").groupBy("path").agg(F.min_by("label", "rank").alias("human_instrument"))


@query("SELECT path, CASE WHEN human_instrument = 'en' THEN NULL ELSE human_instrument END AS human_instrument, CASE WHEN human_instrument = 'en' THEN NULL ELSE label_source END AS label_source, CASE WHEN human_instrument = 'en' THEN CASE WHEN model_instrument IS NOT NULL THEN 'model' WHEN panns_instrument IS NOT NULL THEN 'panns' WHEN path_instrument IS NOT NULL THEN 'path' ELSE 'none' END ELSE source END AS source FROM @samples")
def label_delete(spark, d):
    samples = view(spark, d, "samples").withColumn("instrument", F.lit(None).cast("string"))
    sets = samples.where("human_instrument IS NOT NULL").select("path", F.col("human_instrument").alias("label"), F.lit(1).alias("rank"), F.lit(0.0).alias("ts"))
    after, _, _, _ = labels.delete_label(samples, sets, view(spark, d, "taxonomy"), "en")
    return after.select("path", "human_instrument", "label_source", "source")


@query("SELECT path, CASE WHEN hit THEN 'es' ELSE human_instrument END AS human_instrument, CASE WHEN hit THEN 'propagate' ELSE label_source END AS label_source, CASE WHEN hit THEN 'human' ELSE source END AS source FROM (SELECT *, row_id % 3 = 0 AND human_instrument IS NULL AS hit FROM @samples)")
def label_bulk(spark, d):
    samples = view(spark, d, "samples").withColumn("instrument", F.lit(None).cast("string"))
    none = samples.limit(0).select("path", F.lit("").alias("label"), F.lit(1).alias("rank"), F.lit(0.0).alias("ts"))
    after, _, _ = labels.propagate(samples, none, samples.where("row_id % 3 = 0"), ["es", "", "de", "es"], view(spark, d, "taxonomy"))
    return after.select("path", "human_instrument", "label_source", "source")


@query("SELECT path, CASE WHEN human_instrument IS NOT NULL THEN human_instrument WHEN model_instrument IS NOT NULL AND model_conf >= 0.6 THEN model_instrument ELSE path_instrument END AS instrument, CASE WHEN human_instrument IS NOT NULL THEN 'human' WHEN model_instrument IS NOT NULL AND model_conf >= 0.6 THEN 'model' WHEN path_instrument IS NOT NULL THEN 'path' ELSE 'none' END AS source FROM @samples")
def resolve_predict(spark, d):
    return view(spark, d, "samples").select("path", *labels.resolve_predict(F.col("human_instrument"), F.col("model_instrument"), F.col("model_conf"), F.lit(0.6), F.col("path_instrument")))


@query("SELECT path, coalesce(human_instrument, model_instrument, panns_instrument, path_instrument) AS instrument, CASE WHEN human_instrument IS NOT NULL THEN 'human' WHEN model_instrument IS NOT NULL THEN 'model' WHEN panns_instrument IS NOT NULL THEN 'panns' WHEN path_instrument IS NOT NULL THEN 'path' ELSE 'none' END AS source FROM @samples")
def resolve_interactive(spark, d):
    return view(spark, d, "samples").select("path", *labels.resolve_interactive(*(F.col(c) for c in ("human_instrument", "model_instrument", "panns_instrument", "path_instrument"))))


@query("SELECT path, list(label ORDER BY label) AS labels FROM (SELECT DISTINCT path, label FROM @model_labels) GROUP BY path")
def model_label_sets(spark, d):
    return view(spark, d, "model_labels").groupBy("path").agg(F.sort_array(F.collect_set("label")).alias("labels"))


# Learning

_M = "CASE {0} WHEN 'old_en' THEN 'en' WHEN 'old_de' THEN 'de' WHEN 'assistant' THEN 'en' ELSE {0} END"
_IN = "IN ('de', 'en', 'es', 'fr')"


@query(f"""
WITH w AS (SELECT *, CASE WHEN path_instrument {_IN} THEN path_instrument ELSE {_M.format("panns_instrument")} END AS c FROM @samples)
SELECT path, CASE WHEN human_instrument IS NOT NULL THEN [human_instrument] ELSE [c] END AS targets,
  CASE WHEN is_val OR label_source = 'single' THEN 1.0 WHEN human_instrument IS NOT NULL THEN 0.5 ELSE 0.2 END::DOUBLE AS weight, is_val
FROM w WHERE human_instrument IS NOT NULL OR (NOT is_val AND c {_IN})""")
def weak_dataset_weights(spark, d):
    samples = view(spark, d, "samples")
    none = samples.limit(0).select("path", F.lit("").alias("label"), F.lit(1).alias("rank"))
    return learn.build_dataset(samples, none, list(CLASSES), VOCABULARY)


def _heads(spark, d):
    """Class centroids as deterministic heads: one row for each label of the vectors."""
    rows = view(spark, d, "vectors")
    means = rows.groupBy("label").agg(*(F.avg(F.col("vec")[k].cast("double")).alias(f"v{k}") for k in range(64))).orderBy("label").collect()
    return [learn.Head(str(r.label), tuple(8 * r[f"v{k}"] for k in range(64)), 0.1 * (r.label % 3)) for r in means]


_SCORES = f"""
c AS (SELECT label, list(8 * m ORDER BY k) AS w FROM (SELECT label, k, avg(CAST(vec[k] AS DOUBLE)) AS m FROM (SELECT label, vec, unnest(range(1, 65)) AS k FROM @vectors) GROUP BY label, k) GROUP BY label),
p AS (SELECT v.vec_id, v.label AS truth, c.label AS cls, 1 / (1 + exp(-({_DOT.format("v.vec", "c.w")} + 0.1 * (c.label % 3)))) AS p FROM @vectors v, c)"""


def _scored(spark, d):
    heads = _heads(spark, d)
    rows = view(spark, d, "vectors").select(F.col("vec_id").alias("path"), "vec", F.array(F.col("label").cast("string")).alias("targets"))
    return learn.score(rows, heads), heads


@query(f"WITH {_SCORES} SELECT vec_id, CAST(cls AS VARCHAR) AS class, round(p, 6) AS p FROM p")
def model_roundtrip(spark, d):
    """Scores by heads that were saved to a store and loaded again."""
    scored, heads = _scored(spark, d)
    store = Store(spark, f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}")
    learn.save(store, heads, {"version": "ovr_v0", "ts": 0.0})
    again, _ = learn.load(store)
    rows = learn.long_scores(learn.score(scored, again), [h.name for h in again])
    return rows.select(F.col("path").alias("vec_id"), "class", F.round("p", 6).alias("p"))


_HITS = f"h AS (SELECT s.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id JOIN @samples s ON s.row_id = b.vec_id WHERE a.vec_id = 0 ORDER BY score DESC, path LIMIT 20)"
_INDEX = "i AS (SELECT path, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS map_i FROM @points)"


@query(f"WITH {_HITS}, {_INDEX}, e AS (SELECT path, string_agg(label, ',' ORDER BY conf DESC, label) AS emitted FROM @model_labels GROUP BY path) SELECT h.path, h.score, s.instrument_source AS source, s.rating, i.map_i, e.emitted FROM h JOIN (SELECT path, source AS instrument_source, rating FROM @samples) s ON s.path = h.path JOIN i ON i.path = h.path LEFT JOIN e ON e.path = h.path")
def hits_with_meta(spark, d):
    """The 20 nearest items with the catalog's columns, the model's labels and their places on the map."""
    samples = view(spark, d, "samples")
    found = view(spark, d, "vectors").join(samples.select(F.col("row_id").alias("vec_id"), "path"), "vec_id")
    asked = view(spark, d, "vectors").where("vec_id = 0").select(F.col("vec").alias("qvec"))
    hits = retrieve.page(found.where("vec_id <> 0").select("path", "vec"), "path", asked, 20)
    none = samples.select("path", F.lit("x").alias("label"), F.lit(0).alias("rank")).limit(0)
    full = retrieve.fetch_meta(hits, samples.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("instrument", "string"), ("panns_conf", "double")))), none, view(spark, d, "model_labels"))
    indexed = geometry.numbered(view(spark, d, "points").select("path"), "path", "map_i")
    names = F.concat_ws(",", F.transform("model_labels", lambda x: x["label"]))
    return retrieve.with_map_index(full, indexed).select("path", "score", "source", "rating", "map_i", F.when(F.col("model_labels").isNotNull(), names).alias("emitted"))


@query(f"WITH {_SCORES} SELECT vec_id, CAST(cls AS VARCHAR) AS class, round(p, 6) AS p FROM p")
def scores_long(spark, d):
    scored, heads = _scored(spark, d)
    rows = learn.long_scores(scored, [h.name for h in heads])
    return rows.select(F.col("path").alias("vec_id"), "class", F.round("p", 6).alias("p"))


@query(f"WITH {_SCORES} SELECT vec_id, CAST(arg_max(cls, p) AS VARCHAR) AS top1, round(max(p), 6) AS conf, round(2 * min(abs(p - 0.5)), 6) AS margin, CAST(arg_min(cls, abs(p - 0.5)) AS VARCHAR) AS margin_label FROM p GROUP BY vec_id")
def top1_margin(spark, d):
    done = learn.predictions(*_scored(spark, d))
    return done.select(F.col("path").alias("vec_id"), "top1", F.round("top1_conf", 6).alias("conf"), F.round("margin", 6).alias("margin"), "margin_label")


@query(f"WITH {_SCORES}, m AS (SELECT vec_id, max(p) AS m FROM p GROUP BY vec_id) SELECT p.vec_id, CAST(cls AS VARCHAR) AS label, round(round(p, 4), 3) AS conf FROM p JOIN m USING (vec_id) WHERE p >= 0.6 OR p = m.m")
def model_labels_emit(spark, d):
    rows = learn.emitted_labels(learn.predictions(*_scored(spark, d)))
    return rows.select(F.col("path").alias("vec_id"), "label", F.round("conf", 3).alias("conf"))


@query(f"""
WITH {_SCORES}, g AS (SELECT i, round(0.30 + 0.02 * i, 2) AS t FROM range(0, 35) r(i)),
s AS (SELECT cls, g.t, sum(CASE WHEN cls = truth THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM p, g WHERE p >= g.t GROUP BY cls, g.t),
b AS (SELECT cls, min(t) AS t FROM s WHERE tp / n >= 0.15 GROUP BY cls)
SELECT CAST(cls AS VARCHAR) AS class, CASE WHEN pos >= 10 AND t IS NOT NULL THEN t ELSE 0.6 END::DOUBLE AS threshold
FROM (SELECT cls, sum(CASE WHEN cls = truth THEN 1 ELSE 0 END) AS pos FROM p GROUP BY cls) LEFT JOIN b USING (cls)""")
def threshold_calibration(spark, d):
    scored, heads = _scored(spark, d)
    return learn.calibrate(learn.long_scores(scored, [h.name for h in heads]), target=0.15)


@query(f"""
WITH {_SCORES}, m AS (SELECT vec_id, arg_max(cls, p) AS best FROM p GROUP BY vec_id),
j AS (SELECT cls, cls = truth AS y, p >= 0.6 OR cls = best AS o FROM p JOIN m USING (vec_id)),
s AS (SELECT cls, count(*) FILTER (WHERE o AND y) AS tp, count(*) FILTER (WHERE o AND NOT y) AS fp, count(*) FILTER (WHERE NOT o AND y) AS fn FROM j GROUP BY cls)
SELECT CAST(cls AS VARCHAR) AS class, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM s""")
def prf_report(spark, d):
    scored, heads = _scored(spark, d)
    flat = spark.createDataFrame([(h.name, 0.6) for h in heads], "class string, threshold double")
    rows = learn.report(learn.long_scores(scored, [h.name for h in heads], best=True), flat)
    return rows.select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_SCORES} SELECT count(*) AS n, count(*) FILTER (WHERE m >= 0.6) AS covered FROM (SELECT vec_id, max(p) AS m FROM p GROUP BY vec_id)")
def coverage_any(spark, d):
    return learn.confident_share(*_scored(spark, d))


@query(f"SELECT v.vec_id, CAST(a.label AS VARCHAR) AS class, round({_DOT.format('v.vec', 'a.vec')}, 6) AS p FROM @vectors v, (SELECT * FROM @vectors WHERE vec_id < 3) a WHERE a.vec_id < 3")
def zero_shot_scores(spark, d):
    rows = view(spark, d, "vectors")
    picked = rows.where("vec_id < 3").orderBy("vec_id").collect()  # three prompts
    scored = learn.zero_shot(rows.select(F.col("vec_id").alias("path"), "vec", F.array().cast("array<string>").alias("targets")), {f"{r.vec_id}": [float(x) for x in r.vec] for r in picked})
    names = F.array(*(F.lit(str(r.label)) for r in picked))
    return scored.select("path", F.posexplode("probs").alias("k", "p")).select(F.col("path").alias("vec_id"), names[F.col("k")].alias("class"), F.round("p", 6).alias("p"))


@query("WITH c AS (SELECT label, generate_subscripts(vec, 1) AS k, unnest(CAST(vec AS DOUBLE[])) AS x FROM @vectors), m AS (SELECT label, k, avg(x) AS x FROM c GROUP BY label, k) SELECT CAST(label AS INT) AS label, CAST(k - 1 AS INT) AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m")
def mean_anchors(spark, d):
    rows = learn.anchors(view(spark, d, "vectors").select(F.col("label").cast("int").alias("label"), "vec"), "label", 64)
    return rows.select("label", F.posexplode("vec").alias("k", "x")).select("label", "k", F.round("x", 5).alias("x"))


@query()
def ovr_train_predict(spark, d):
    samples = view(spark, d, "samples").withColumns({"instrument": F.lit(None).cast("string"), "model_version": F.lit(None).cast("string")})
    rows = _path_vectors(spark, d).select("path", "vec")
    none = samples.limit(0).select("path", F.lit("").alias("label"), F.lit(1).alias("rank"))
    heads, _ = learn.train(rows, samples, none, list(CLASSES), VOCABULARY, now=0.0)
    after, _ = learn.predict(rows, samples, heads, "ovr_v0")
    return after.select("path", "model_instrument", "model_conf", "model_margin", "instrument", "source")


# The review queue

_QUEUE = """
q AS (SELECT s.*, m.new_label AS pm FROM @samples s LEFT JOIN (SELECT old_label, new_label FROM @weak_map UNION ALL SELECT name, name FROM @taxonomy WHERE name NOT IN (SELECT old_label FROM @weak_map)) m ON s.panns_instrument = m.old_label
      WHERE status <> 'missing' AND source <> 'human' AND (human_instrument IS NULL OR human_instrument = '')),
r AS (SELECT *, coalesce(path_instrument <> pm, false) OR coalesce(model_instrument <> path_instrument, false) AS disagree FROM q),
t AS (SELECT *, coalesce(model_margin, model_conf, 1.0) - CASE WHEN disagree THEN 2.0 ELSE 0.0 END AS sort_score FROM r),
u AS (SELECT *, row_number() OVER (PARTITION BY coalesce(model_instrument, 'unknown') ORDER BY sort_score, path) AS rn FROM t)"""


def _ranked(spark, d, mode="disagree"):
    rows = review.candidates(view(spark, d, "samples"), view(spark, d, "model_labels"), mode)
    return review.ranked(rows, review.vocabulary(view(spark, d, "weak_map"), view(spark, d, "taxonomy")))


@query(f"WITH {_QUEUE} SELECT path, model_instrument, round(sort_score, 9) AS sort_score, disagree, CAST(rn AS INT) AS rn FROM u WHERE rn <= 100")
def review_queue_ranked(spark, d):
    return _ranked(spark, d).select("path", "model_instrument", F.round("sort_score", 9).alias("sort_score"), "disagree", "rn")


@query(f"WITH {_QUEUE} SELECT path FROM q WHERE model_margin_label = 'es' OR EXISTS (SELECT 1 FROM @model_labels m WHERE m.path = q.path AND m.label = 'es')")
def review_queue_class(spark, d):
    return review.candidates(view(spark, d, "samples"), view(spark, d, "model_labels"), "class_es").select("path")


@query("SELECT path FROM @samples WHERE gold_candidate AND (human_instrument IS NULL OR human_instrument = '')")
def review_queue_gold(spark, d):
    return review.candidates(view(spark, d, "samples"), view(spark, d, "model_labels"), "gold").select("path")


@query()
def review_queue_full(spark, d):
    words = review.vocabulary(view(spark, d, "weak_map"), view(spark, d, "taxonomy"))
    rows, _ = review.queue(view(spark, d, "samples"), view(spark, d, "model_labels"), view(spark, d, "item_labels"), _path_vectors(spark, d), words, too_close=CLOSE)
    return rows.select("path", "rn", "sort_score", "labels", "model_set")


@query(f"WITH {_QUEUE} SELECT count(*) AS total FROM q")
def review_queue_total(spark, d):
    return review.candidates(view(spark, d, "samples"), view(spark, d, "model_labels")).agg(F.count("*").alias("total"))


_THREE = ", ".join(_M.format(c) for c in ("model_instrument", "panns_instrument", "path_instrument"))


@query(f"SELECT path, len(list_distinct([x for x in [{_THREE}] if x IS NOT NULL])) > 1 AS disagree FROM @samples")
def disagreement_flag(spark, d):
    return view(spark, d, "samples").select("path", retrieve.disagree(F.col("model_instrument"), F.col("panns_instrument"), F.col("path_instrument"), VOCABULARY).alias("disagree"))


@query(f"SELECT path, [x for x in [{_THREE}] if x {_IN}][1] AS suggestion FROM @samples")
def suggestion(spark, d):
    return view(spark, d, "samples").select("path", retrieve.suggestion(F.col("model_instrument"), F.col("panns_instrument"), F.col("path_instrument"), VOCABULARY, list(CLASSES)).alias("suggestion"))


@query("SELECT path, best FROM (SELECT path, duration_s, sample_type, coalesce(human_instrument, model_instrument, panns_instrument, '?') AS best FROM @samples) WHERE best = 'en' AND (sample_type IS NULL OR sample_type NOT IN ('oneshot', 'loop')) AND coalesce(duration_s, 0) <= 3")
def hit_filter(spark, d):
    best = retrieve.best_label(F.array_compact(F.array("human_instrument")), F.lit(None), F.col("model_instrument"), F.col("panns_instrument"))
    rows = view(spark, d, "samples").withColumn("best", best)
    return rows.where(retrieve.hit_filter(F.col("best"), F.col("sample_type"), F.col("duration_s"), "en", "other", 3)).select("path", "best")


@query("WITH b AS (SELECT DISTINCT coalesce(human_instrument, model_instrument, panns_instrument, '?') AS label FROM @samples) SELECT 0 AS place, 'all' AS label UNION ALL SELECT CAST(row_number() OVER (ORDER BY label) AS INT), label FROM b")
def label_choices(spark, d):
    best = retrieve.best_label(F.array_compact(F.array("human_instrument")), F.lit(None), F.col("model_instrument"), F.col("panns_instrument"))
    return retrieve.label_choices(view(spark, d, "samples").select(best.alias("best")), "best")


@query("SELECT min(name) AS name FROM @taxonomy WHERE starts_with(name, 'e')")
def label_by_prefix(spark, d):
    return retrieve.first_with_prefix(view(spark, d, "taxonomy"), "e")


@query("SELECT path, CASE WHEN rating = 3 THEN 0 ELSE 3 END AS rating FROM @samples")
def rating_toggled(spark, d):
    return view(spark, d, "samples").select("path", labels.toggled_rating(F.col("rating"), F.lit(3)).alias("rating"))


@query("SELECT path, rating > 0 AS rated, false AS typed, human_instrument IS NOT NULL AS labeled, false AS complete FROM @samples")
def review_steps(spark, d):
    return retrieve.review_steps(view(spark, d, "samples").withColumn("human_sample_type", F.lit(None).cast("string")))


# The evaluation set


@query("SELECT m.label, count(*) AS n, count(*) FILTER (WHERE s.gold_candidate) AS have FROM (SELECT DISTINCT path, label FROM @model_labels) m JOIN @samples s ON m.path = s.path WHERE s.status <> 'missing' GROUP BY m.label")
def gold_pool(spark, d):
    rows = view(spark, d, "model_labels").select("path", "label").distinct().join(view(spark, d, "samples").where(catalog.active()).select("path", "gold_candidate"), "path")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("gold_candidate").alias("have"))


@query("SELECT c AS candidates, l AS labeled, s AS single, f AS frozen, c - l AS remaining, round(100 * l / c, 1) AS pct, c = l AND l > f AS can_freeze FROM (SELECT count(*) FILTER (WHERE gold_candidate) AS c, count(*) FILTER (WHERE gold_candidate AND human_instrument IS NOT NULL) AS l, count(*) FILTER (WHERE gold_candidate AND human_instrument IS NOT NULL AND label_source = 'single') AS s, count(*) FILTER (WHERE is_val) AS f FROM @samples)")
def gold_status(spark, d):
    return gold.status(view(spark, d, "samples"))


@query()
def gold_sample(spark, d):
    return gold.sample(view(spark, d, "samples"), view(spark, d, "model_labels"), 5, 10).where("gold_candidate").select("path", "row_id")


@query("SELECT path, is_val OR (gold_candidate AND human_instrument IS NOT NULL AND label_source = 'single') AS is_val FROM @samples")
def freeze_split(spark, d):
    return gold.freeze(view(spark, d, "samples"))[0].select("path", "is_val")


@query("SELECT m.label, count(*) AS n FROM @model_labels m JOIN @samples s ON m.path = s.path WHERE s.gold_candidate GROUP BY m.label")
def gold_support(spark, d):
    return gold.support(view(spark, d, "samples"), view(spark, d, "model_labels"))


# The map

_CODE = "CASE {0} WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END"
_MAP = f"""
m AS (SELECT p.path, round(p.x, 4) AS x, round(p.y, 4) AS y, {_CODE.format("s.human_instrument")} AS human, {_CODE.format("s.model_instrument")} AS model, {_CODE.format("s.path_instrument")} AS path_label, {_CODE.format("s.panns_instrument")} AS panns,
  CASE WHEN cluster_l1 >= 0 AND cluster_l1 < 2 THEN cluster_l1 ELSE 2 END AS family, CASE sample_type WHEN 'oneshot' THEN 0 WHEN 'loop' THEN 1 ELSE 2 END AS t, round(coalesce(duration_s, 0), 2) AS d,
  CASE label_source WHEN 'single' THEN 0 WHEN 'cluster' THEN 1 WHEN 'map' THEN 2 WHEN 'propagate' THEN 3 WHEN 'llm' THEN 4 ELSE 5 END AS ls, CAST(row_number() OVER (ORDER BY p.path) - 1 AS INT) AS map_i
  FROM @points p JOIN @samples s ON p.path = s.path)"""


def _map(spark, d):
    samples = view(spark, d, "samples").withColumn("instrument", F.col("model_instrument"))
    return geometry.map_rows(view(spark, d, "points"), samples, view(spark, d, "taxonomy"), 2)


@query(f"WITH {_MAP} SELECT map_i, path, x, y, human, model, path_label, panns, family, t, ls FROM m")
def map_codes(spark, d):
    return _map(spark, d).select("map_i", "path", "x", "y", "human", "model", "path_label", "panns", "family", "t", "ls")


@query(f"WITH {_MAP} SELECT path FROM m WHERE model IN (0, 1) AND t IN (0, 2) AND ls IN (0, 5) AND (d <= 0 OR d >= 0.5) AND (d <= 0 OR d <= 4)")
def map_filter(spark, d):
    return _map(spark, d).where(geometry.shown([0, 1], [0, 2], [0, 5], 0.5, 4, "model")).select("path")


@query("SELECT path FROM @points WHERE x + y <= 0.9005 AND x >= 0.0995 AND y >= 0.0995")
def polygon_select(spark, d):
    triangle = [(0.0995, 0.0995), (0.801, 0.0995), (0.0995, 0.801)]
    return view(spark, d, "points").where(geometry.in_polygon(F.col("x"), F.col("y"), triangle)).select("path")


@query("SELECT path, round((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5), 9) AS d2 FROM @points WHERE (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) < 0.04 ORDER BY (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5), path LIMIT 1")
def nearest_point(spark, d):
    return geometry.nearest(view(spark, d, "points"), "path", 0.5, 0.5, 0.2).select("path", F.round("d2", 9).alias("d2"))


@query("SELECT path, round(dist / c, 9) AS score FROM (SELECT path, dist, (x - 0.2) / dist AS c FROM (SELECT *, sqrt((x - 0.2) * (x - 0.2) + (y - 0.2) * (y - 0.2)) AS dist FROM @points) WHERE dist > 0) WHERE c >= 0.3 ORDER BY dist / c, path LIMIT 1")
def directional_nearest(spark, d):
    return geometry.directional(view(spark, d, "points"), "path", 0.2, 0.2, 1.0, 0.0).select("path", F.round("score", 9).alias("score"))


@query("SELECT path, round((x - a) / (b - a), 9) AS x, round((y - e) / (f - e), 9) AS y FROM @points, (SELECT min(x) AS a, max(x) AS b, min(y) AS e, max(y) AS f FROM @points)")
def normalize01(spark, d):
    done = geometry.normalize01(view(spark, d, "points"), ["x", "y"])
    return done.select("path", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query()
def pca_projection(spark, d):
    return geometry.project(_path_vectors(spark, d).select("path", "vec"))


@query("SELECT label, CAST(sum(ord(c)) * 137 % 360 AS INT) AS hue FROM (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT p_type AS label FROM part)) GROUP BY label")
def label_color_hue(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("label")).distinct().select("label", scalars.hue(F.col("label")).alias("hue"))


@query("SELECT name, CASE WHEN name = 'en' THEN 'red' ELSE concat('hsl(', CAST(list_sum([ord(c) for c in string_split(name, '')]) * 137 % 360 AS INT), ', 60%, 55%)') END AS color FROM @taxonomy")
def taxonomy_colors(spark, d):
    return geometry.colors(view(spark, d, "taxonomy"), {"en": "red"})


@query(f"WITH {_MAP} SELECT map_i, path FROM m WHERE map_i % (SELECT greatest(1, CAST(ceil(count(*) / 500.0) AS INT)) FROM m) = 0")
def map_decimated(spark, d):
    """What a viewport of 500 points draws: the stride is the feature."""
    points = _map(spark, d)
    return geometry.decimated(points, points.count(), 500).select("map_i", "path")


# Clusters


@query("SELECT c.id, c.parent, c.size, c.label, arg_min(s.path, {'k': s.cluster_d IS NOT NULL, 'd': s.cluster_d, 'p': s.path}) FILTER (WHERE s.path IS NOT NULL) AS medoid FROM @clusters c LEFT JOIN @samples s ON s.cluster_id = c.id WHERE c.level = 2 GROUP BY ALL")
def cluster_grains(spark, d):
    rows = view(spark, d, "clusters").withColumns({c: F.lit(None).cast("double") for c in ("centroid", "flatness", "attack", "duration")})
    return sonic.grains(rows, view(spark, d, "samples")).select("id", "parent", "size", "label", "medoid")


@query("SELECT cluster_id, arg_min(path, {'k': cluster_d IS NOT NULL, 'd': cluster_d, 'p': path}) AS medoid FROM @samples WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def medoid_per_cluster(spark, d):
    return sonic.medoids(view(spark, d, "samples"))


@query("SELECT CAST(i AS INT) AS id, coalesce(label, concat('family ', i)) AS label FROM range(0, (SELECT max(id) + 1 FROM @clusters WHERE level = 1)) r(i) LEFT JOIN (SELECT id, label FROM @clusters WHERE level = 1) c ON r.i = c.id")
def family_labels_dense(spark, d):
    return sonic.family_labels(view(spark, d, "clusters"))


@query("SELECT path, cluster_d FROM @samples WHERE cluster_id = 3 ORDER BY cluster_d NULLS FIRST, path LIMIT 60")
def cluster_members(spark, d):
    return sonic.members(view(spark, d, "samples"), 3)


@query("SELECT s.path, g.label AS grain, f.label AS family FROM @samples s LEFT JOIN (SELECT * FROM @clusters WHERE level = 2) g ON s.cluster_id = g.id LEFT JOIN (SELECT * FROM @clusters WHERE level = 1) f ON s.cluster_l1 = f.id")
def cluster_lookup(spark, d):
    return sonic.with_cluster_labels(view(spark, d, "samples").select("path", "cluster_id", "cluster_l1"), view(spark, d, "clusters")).select("path", "grain", "family")


@query("SELECT id, size, label FROM @clusters WHERE level = 1")
def cluster_families(spark, d):
    rows = view(spark, d, "clusters").withColumns({c: F.lit(None).cast("double") for c in ("centroid", "flatness", "attack", "duration")})
    return sonic.families(rows).select("id", "size", "label")


@query()
def kmeans_families(spark, d):
    return sonic.fit_families(_path_vectors(spark, d).select("path", "vec"), 4)


# Features


@query(f"SELECT vec_id, round({_DOT.format('vec', 'vec')}, 5) AS norm2 FROM @vectors")
def unit_vectors(spark, d):
    rows = view(spark, d, "vectors").select("vec_id", unit(F.transform("vec", lambda x: x * 3)).alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 5).alias("norm2"))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS path, 128::INT AS dim, round(sqrt({_DOT.format('vec', 'vec')}), 3) AS length FROM @vectors")
def concat_features(spark, d):
    rows = view(spark, d, "vectors").select(F.col("vec_id").cast("string").alias("path"), "vec", "vec_id")
    both = rows.withColumn("model", F.lit("panns")).unionByName(rows.withColumn("model", F.lit("clap"))).select("path", "model", "vec")
    done = feature_tables.load_concat(both, "panns", "clap")
    return done.select("path", F.size("vec").alias("dim"), F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / 2), 3).alias("length"))


@query("SELECT CAST(v.vec_id AS VARCHAR) AS id, coalesce(s.human_instrument, '') AS human_instrument, coalesce(s.label_source, '') AS label_source, coalesce(CAST(s.is_val AS INT), 0) AS is_val FROM @vectors v LEFT JOIN @samples s ON s.row_id = v.vec_id")
def features_with_labels(spark, d):
    samples = view(spark, d, "samples").withColumn("path", F.col("row_id").cast("string"))
    rows = view(spark, d, "vectors").select(F.col("vec_id").cast("string").alias("path"))
    return feature_tables.with_labels(rows, samples).select(F.col("path").alias("id"), "human_instrument", "label_source", "is_val")


# Extensions beyond the surveyed operators


@query("SELECT source, label_source, count(*) AS n FROM @samples GROUP BY ROLLUP (source, label_source)")
def coverage_rollup(spark, d):
    return view(spark, d, "samples").rollup("source", "label_source").agg(F.count("*").alias("n"))


# Neighbour graphs


_PAIRS = f"(SELECT a.vec_id AS query, b.vec_id AS key, b.label, round({_DOT.format('a.vec', 'b.vec')}, 6) AS score FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id)"


@query(f"SELECT query, key, score FROM {_PAIRS} WHERE score >= 0.3")
def lsh_neighbors(spark, d):
    """Close pairs of all rows, by random projections; tables are as many as the driver's spread vectors need."""
    vectors = view(spark, d, "vectors")
    return graph.lsh_neighbors(vectors, vectors, "vec_id", graph.lsh_tables(vectors, 32, 2, 0.5), least=CLOSE)


@query(f"SELECT query, key, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM {_PAIRS} WHERE query % 20 = 0) WHERE rank <= 10")
def nearest_in_blocks(spark, d):
    vectors = view(spark, d, "vectors")
    return graph.nearest(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", 10)


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM {_PAIRS} WHERE query % 3 <> 0 AND key % 3 = 0),
v AS (SELECT query, label, count(*) AS n, sum(score) AS s FROM r WHERE rank <= 15 GROUP BY query, label),
t AS (SELECT *, sum(n) OVER (PARTITION BY query) AS total, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS place FROM v)
SELECT query, label, round(n / total, 6) AS agreement, round(s / n, 6) AS similarity, round(n / total * (s / n), 6) AS weight FROM t WHERE place = 1 AND n / total >= 0.4 AND s / n >= 0.1""")
def knn_pseudo_labels(spark, d):
    vectors = view(spark, d, "vectors")
    known = vectors.where("vec_id % 3 = 0")
    found = graph.pseudo_labels(graph.nearest(vectors.where("vec_id % 3 <> 0"), known, "vec_id", 15), known.select(F.col("vec_id").alias("key"), "label"), 0.4, 0.1)
    return found.select("query", "label", *(F.round(c, 6).alias(c) for c in ("agreement", "similarity", "weight")))


@query(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM {_PAIRS}),
e AS (SELECT src, dst, max(w) AS w FROM (SELECT query AS src, key AS dst, score AS w FROM r WHERE rank <= 6 AND score > 0 UNION ALL SELECT key, query, score FROM r WHERE rank <= 6 AND score > 0) GROUP BY src, dst),
m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM e WHERE dst % 4 <> 0),
s AS (SELECT vec_id AS node, label, CAST(1 AS DOUBLE) AS p FROM @vectors WHERE vec_id % 4 = 0),
f AS (SELECT 0 AS n, node, label, p FROM s UNION ALL
      (WITH prior AS (SELECT * FROM f) SELECT max(n) + 1, node, label, sum(p) FROM
       (SELECT n, m.dst AS node, label, w * p AS p FROM prior JOIN m ON m.src = prior.node UNION ALL SELECT n, node, label, p FROM prior WHERE node % 4 = 0) x WHERE n < 4 GROUP BY node, label))
SELECT node, label, round(p, 6) AS p FROM f WHERE n = 4""")
def label_spread(spark, d):
    """Four rounds along the graph of six nearest neighbours; every fourth row is labelled."""
    vectors = view(spark, d, "vectors")
    edges = graph.undirected(graph.nearest(vectors, vectors, "vec_id", 6))
    shares = graph.label_spread(edges, vectors.where("vec_id % 4 = 0").select(F.col("vec_id").alias("node"), "label"), rounds=4)
    return shares.select("node", "label", F.round("p", 6).alias("p"))


# Cross-validation, purity, sketches


_FOLD_SCORES = f"""
f AS (SELECT unnest(range(0, 5)) AS fold),
c AS (SELECT fold, label, list(8 * m ORDER BY k) AS w FROM (SELECT fold, label, k, avg(CAST(vec[k] AS DOUBLE)) AS m FROM (SELECT f.fold, label, vec, unnest(range(1, 65)) AS k FROM @vectors v, f WHERE v.vec_id % 5 <> f.fold) GROUP BY fold, label, k) GROUP BY fold, label),
p AS (SELECT v.vec_id, v.label AS truth, c.label AS cls, 1 / (1 + exp(-({_DOT.format("v.vec", "c.w")} + 0.1 * (c.label % 3)))) AS p FROM @vectors v JOIN c ON c.fold = v.vec_id % 5)"""


@query(f"""
WITH {_FOLD_SCORES}, m AS (SELECT vec_id, arg_max(cls, p) AS best FROM p GROUP BY vec_id),
j AS (SELECT cls, cls = truth AS y, p >= 0.6 OR cls = best AS o FROM p JOIN m USING (vec_id)),
s AS (SELECT cls, count(*) FILTER (WHERE o AND y) AS tp, count(*) FILTER (WHERE o AND NOT y) AS fp, count(*) FILTER (WHERE NOT o AND y) AS fn FROM j GROUP BY cls)
SELECT CAST(cls AS VARCHAR) AS class, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM s""")
def cv_report(spark, d):
    """Every row judged by the centroids of the four folds that it isn't in."""
    rows = view(spark, d, "vectors")
    parts = F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("vec_id") % 5)).alias("fold")
    means = rows.select(parts, "label", "vec").groupBy("fold", "label").agg(*(F.avg(F.col("vec")[k].cast("double")).alias(f"v{k}") for k in range(64))).orderBy("fold", "label").collect()
    heads: dict[int, list[learn.Head]] = {}
    for r in means:
        heads.setdefault(r.fold, []).append(learn.Head(str(r.label), tuple(8 * r[f"v{k}"] for k in range(64)), 0.1 * (r.label % 3)))
    dealt = rows.select(F.col("vec_id").alias("path"), "vec", F.array(F.col("label").cast("string")).alias("targets"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    report = learn.cv_report(learn.out_of_fold(dealt, heads), heads[0])
    return report.select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_PURITY = """
k AS (SELECT cluster_id, human_instrument AS label, count(*) AS m FROM @samples WHERE cluster_id IS NOT NULL AND human_instrument <> '' AND status <> 'missing' GROUP BY 1, 2),
z AS (SELECT cluster_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS labels, max(m) AS most, first(label ORDER BY m DESC, label) AS top, sum(m * ln(m)) AS s FROM k GROUP BY cluster_id)"""


@query(f"WITH {_PURITY} SELECT cluster_id, n, labels, top, round(most / n, 9) AS purity, round(greatest(0, ln(n) - s / n), 9) AS entropy FROM z")
def cluster_purity(spark, d):
    found = sonic.cluster_purity(view(spark, d, "samples"))
    return found.select("cluster_id", "n", "labels", "top", F.round("purity", 9).alias("purity"), F.round("entropy", 9).alias("entropy"))


@query(f"""
WITH {_PURITY}, l AS (SELECT path, list(label ORDER BY rank, label) AS ls FROM @item_labels GROUP BY path),
w AS (SELECT s.*, l.ls, (z.most / z.n) * (z.most / z.n) AS trust, CASE WHEN path_instrument {_IN} THEN path_instrument ELSE {_M.format("panns_instrument")} END AS c FROM @samples s LEFT JOIN l USING (path) LEFT JOIN z USING (cluster_id)),
h AS (SELECT *, CASE WHEN len(ls) > 0 THEN ls WHEN human_instrument <> '' THEN [human_instrument] END AS human FROM w),
t AS (SELECT *, CASE WHEN human IS NOT NULL THEN [x FOR x IN list_distinct(human) IF x {_IN}] WHEN NOT is_val AND c {_IN} THEN [c] END AS wanted FROM h)
SELECT path, list_sort(wanted) AS targets, round(CASE WHEN is_val OR label_source = 'single' AND human IS NOT NULL THEN 1.0 WHEN human IS NOT NULL THEN 0.5 * coalesce(trust, 1) ELSE 0.2 END::DOUBLE, 9) AS weight, is_val FROM t WHERE len(wanted) > 0""")
def weak_dataset_purity(spark, d):
    """Label sets and weak labels; bulk labels weigh by the agreement within their cluster."""
    samples = view(spark, d, "samples")
    rows = learn.build_dataset(samples, view(spark, d, "item_labels"), list(CLASSES), VOCABULARY, purity=sonic.cluster_purity(samples))
    return rows.select("path", F.array_sort("targets").alias("targets"), F.round("weight", 9).alias("weight"), "is_val")


@query("SELECT m.label, count(DISTINCT m.path) AS n, true AS close FROM @model_labels m GROUP BY m.label")
def label_sketches(spark, d):
    """The exact distinct counts, and whether sketches kept for each source and then merged come within 3 % of them."""
    rows = view(spark, d, "model_labels").withColumn("batch", F.split("path", "/")[1])
    exact = rows.groupBy("label").agg(F.count_distinct("path").alias("n"))
    guess = stats.estimated(stats.merged(stats.sketches(rows, ["batch", "label"], "path"), ["label"]), "guess")
    return exact.join(guess, "label").select("label", "n", (F.abs(F.col("guess") - F.col("n")) <= 0.03 * F.col("n")).alias("close"))


@query("SELECT source AS version, count(*) AS val_n, CAST(NULL AS VARCHAR) AS notes FROM documents WHERE source <> 'src0' GROUP BY source UNION ALL SELECT 'src0', count(*), 'again' FROM documents")
def metrics_append(spark, d):
    """A metrics row for every source; that of ``src0`` is replaced by one of the whole."""
    docs = table(spark, d, "documents")
    rows = conform(docs.where("source IS NOT NULL").groupBy(F.col("source").alias("version")).agg(F.count("*").alias("val_n")), "metrics")
    fresh = {f.name: None for f in rows.schema} | {"version": "src0", "val_n": docs.count(), "notes": "again"}
    return learn.with_metrics(rows, fresh).select("version", "val_n", "notes")


# Buckets, held and clustered rows


@query(ORACLE["catalog_upsert"])
def bucket_upsert(spark, d):
    """The catalog in hash buckets after a scan is merged into it, twice under the same number."""
    kept = Buckets(spark, f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}", count=16)
    kept.merge(view(spark, d, "samples"), lambda old, new: new)
    for _ in range(2):
        kept.merge(_scan(spark, d), lambda old, new: catalog.upsert(old, new, F.lit(0.0)), "scan", 0)
    return kept.read().select("path", "mtime", "size", "status", "path_instrument", "human_instrument")


@query(f"SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, {_PV} a WHERE a.path = 'lib/src0/0.wav' AND a.path <> b.path ORDER BY score DESC, path LIMIT 20")
def index_neighbors(spark, d):
    """The nearest items by an index that is held for the version of the features that a store has."""
    kept = Store(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    kept.write("features", _path_vectors(spark, d).select("path", "vec"))
    return retrieve.Index(kept).neighbors("lib/src0/0.wav", 20)


_POINTS = "i AS (SELECT *, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS map_i FROM @points)"
_META = [("instrument", "string"), ("panns_conf", "double")]


def _samples_meta(spark, d):
    return view(spark, d, "samples").select("*", *(F.lit(None).cast(t).alias(c) for c, t in _META))


@query(f"""
WITH {_POINTS}, l AS (SELECT path, list(label ORDER BY rank, label) AS labels FROM @item_labels GROUP BY path)
SELECT i.map_i, i.path, s.source, s.rating, g.label AS grain, f.label AS family, array_to_string(l.labels, ',') AS labels FROM i JOIN @samples s USING (path) LEFT JOIN l USING (path)
LEFT JOIN (SELECT * FROM @clusters WHERE level = 2) g ON g.id = s.cluster_id LEFT JOIN (SELECT * FROM @clusters WHERE level = 1) f ON f.id = s.cluster_l1 WHERE i.map_i = 77""")
def point_lookup(spark, d):
    """One point of a map that was written in ranges of its numbers, with what the map shows of it."""
    path = f"{checkpoint_dir(spark)}/map-{uuid.uuid4().hex}"
    geometry.write_points(geometry.numbered(view(spark, d, "points"), "path", "map_i"), path, 8)
    found = geometry.point_details(spark, path, 77, _samples_meta(spark, d), view(spark, d, "item_labels"), view(spark, d, "model_labels"), view(spark, d, "clusters"))
    return found.select(F.lit(77).alias("map_i"), "path", "source", "rating", "grain", "family", F.when(F.col("labels").isNotNull(), F.concat_ws(",", "labels")).alias("labels"))


@query(f"""
WITH {_POINTS}, l AS (SELECT path, list(label ORDER BY rank, label) AS labels FROM @item_labels GROUP BY path),
a AS (SELECT * FROM {_PV} WHERE contains(path, '/5.') ORDER BY row_id LIMIT 1),
h AS (SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, a WHERE b.path <> a.path ORDER BY score DESC, path LIMIT 24)
SELECT a.path AS matched, (SELECT count(*) FROM {_PV}) AS n, CAST(row_number() OVER (ORDER BY h.score DESC, h.path) AS INT) AS place, h.path, list_extract(string_split(h.path, '/'), -1) AS name, round(h.score, 3) AS score,
  coalesce(i.map_i, -1) AS map_i, s.source, array_to_string(l.labels, ',') AS labels FROM h CROSS JOIN a JOIN @samples s ON s.path = h.path LEFT JOIN i ON i.path = h.path LEFT JOIN l ON l.path = h.path""")
def similar_report(spark, d):
    rows = _path_vectors(spark, d)
    indexed = geometry.numbered(view(spark, d, "points").select("path"), "path", "map_i")
    full = retrieve.similar_report(rows, rows, _samples_meta(spark, d), view(spark, d, "item_labels"), view(spark, d, "model_labels"), indexed, "/5.", 24)
    return full.select("matched", "n", "place", "path", "name", "score", "map_i", "source", F.when(F.col("labels").isNotNull(), F.concat_ws(",", "labels")).alias("labels"))


@query(f"""
WITH {_QUEUE}, l AS (SELECT path, list(label ORDER BY rank, label) AS labels FROM @item_labels GROUP BY path), e AS (SELECT path, list(label ORDER BY label) AS ms FROM @model_labels GROUP BY path)
SELECT u.path, CAST(rn AS INT) AS rn, array_to_string(coalesce(l.labels, []), ',') AS labels, array_to_string(e.ms, ',') AS model_set, g.label AS grain, f.label AS family FROM (SELECT * FROM u WHERE rn <= 100 ORDER BY rn, path LIMIT 80) u
LEFT JOIN l USING (path) LEFT JOIN e USING (path) LEFT JOIN (SELECT * FROM @clusters WHERE level = 2) g ON g.id = u.cluster_id LEFT JOIN (SELECT * FROM @clusters WHERE level = 1) f ON f.id = u.cluster_l1""")
def review_queue_sets(spark, d):
    """The queue with label sets, the model's sets and sonic labels; no pair is too close here, so that SQL can choose."""
    words = review.vocabulary(view(spark, d, "weak_map"), view(spark, d, "taxonomy"))
    rows, _ = review.queue(view(spark, d, "samples"), view(spark, d, "model_labels"), view(spark, d, "item_labels"), _path_vectors(spark, d), words, too_close=2.0, clusters=view(spark, d, "clusters"))
    return rows.select("path", "rn", F.concat_ws(",", "labels").alias("labels"), F.when(F.col("model_set").isNotNull(), F.concat_ws(",", "model_set")).alias("model_set"), "grain", "family")


@query(f"""
WITH a AS (SELECT * FROM {_PV} WHERE contains(path, '/5.') ORDER BY row_id LIMIT 1),
h AS (SELECT b.path, round({_DOT.format('b.vec', 'a.vec')}, 6) AS score FROM {_PV} b, a WHERE b.path <> a.path ORDER BY score DESC, path LIMIT 24)
SELECT CAST(row_number() OVER (ORDER BY h.score DESC, h.path) AS INT) AS place, printf('%.3f', h.score) || '  ' || repeat(' ', 7) || ' ' || rpad(coalesce(s.sample_type, ''), 7, ' ') || ' ' || lpad(coalesce(CAST(s.bpm AS VARCHAR), ''), 4, ' ') || ' '
  || lpad(coalesce(s.key, ''), 4, ' ') || '  ' || list_extract(string_split(h.path, '/'), -1) AS line FROM h JOIN @samples s ON s.path = h.path""")
def sim_lines(spark, d):
    rows = _path_vectors(spark, d)
    indexed = geometry.numbered(view(spark, d, "points").select("path"), "path", "map_i")
    return retrieve.report_lines(retrieve.similar_report(rows, rows, _samples_meta(spark, d), view(spark, d, "item_labels"), view(spark, d, "model_labels"), indexed, "/5.", 24))


@query(f"""
WITH {_POINTS}, {_HITS} SELECT i.path, i.map_i, h.path IS NOT NULL AS hit FROM i LEFT JOIN h USING (path) WHERE h.path IS NOT NULL OR i.x < 0.05 AND i.y > 0.9""")
def hits_and_selection(spark, d):
    """The 20 nearest items that are on the map, and the points of a corner."""
    points = geometry.numbered(view(spark, d, "points"), "path", "map_i")
    rows = view(spark, d, "samples").select("path", "row_id").join(view(spark, d, "vectors").select(F.col("vec_id").alias("row_id"), "vec"), "row_id")
    asked = view(spark, d, "vectors").where("vec_id = 0").select(F.col("vec").alias("qvec"))
    hits = retrieve.with_map_index(retrieve.page(rows.where("row_id <> 0").select("path", "vec"), "path", asked, 20), points)
    return retrieve.with_selection(hits, points.where("x < 0.05 AND y > 0.9"))


@query("SELECT path, round(x * 2.5 * 800 - 40, 6) AS sx, round((1 - y) * 2.5 * 600 + 25, 6) AS sy, true AS back FROM @points")
def screen_points(spark, d):
    """The map's points on a screen, and whether they come back from it."""
    there = geometry.to_screen(view(spark, d, "points"), 2.5, -40, 25, 800, 600)
    again = geometry.to_map(there.select("path", F.col("x").alias("x0"), F.col("y").alias("y0"), "sx", "sy"), 2.5, -40, 25, 800, 600)
    near = (F.abs(F.col("x") - F.col("x0")) < 1e-9) & (F.abs(F.col("y") - F.col("y0")) < 1e-9)
    return again.select("path", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), near.alias("back"))


@query(f"SELECT p.path, coalesce(s.human_instrument, '') AS human, coalesce(s.path_instrument, '') AS weak_path, coalesce(s.panns_instrument, '') AS weak_panns, coalesce(s.label_source, '') AS label_source, CAST(coalesce(s.is_val, false) AS INT) AS is_val FROM {_PV} p LEFT JOIN @samples s USING (path)")
def exported_features(spark, d):
    """What the export of a store's features holds beside the vectors."""
    kept = Store(spark, f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}")
    kept.write("features", _path_vectors(spark, d).select("path", F.lit("panns").alias("model"), "vec"))
    kept.write("samples", view(spark, d, "samples"))
    path, _ = stages.run_export(kept)
    return spark.read.parquet(path).select("path", "human", "weak_path", "weak_panns", "label_source", "is_val")


# Scores by category, logs, two stores


_HEARD = ("Cowbell", "Silence", "Singing", "Piano", "Music", "Engine")
_CATEGORY = "CASE name WHEN 'Cowbell' THEN 'perc' WHEN 'Singing' THEN 'vocal' WHEN 'Piano' THEN 'tonal' WHEN 'Engine' THEN 'fx' END"


@query(f"""
WITH s AS (SELECT vec_id, unnest([{", ".join(f"'{n}'" for n in _HEARD)}]) AS name, unnest(vec[1:6]) AS score FROM @vectors),
r AS (SELECT *, {_CATEGORY} AS category, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name DESC) AS place FROM s),
b AS (SELECT vec_id, first(category ORDER BY place) AS category, first(score ORDER BY place) AS score FROM r WHERE place <= 3 AND category IS NOT NULL GROUP BY vec_id)
SELECT v.vec_id, b.category, round(CAST(b.score AS DOUBLE), 6) AS score FROM @vectors v LEFT JOIN b USING (vec_id)""")
def category_of_scores(spark, d):
    """The category of the best of three scores that has one; the scores are vectors' first components."""
    rows = view(spark, d, "vectors")
    best = rules.score_category(F.slice("vec", 1, len(_HEARD)), F.array(*map(F.lit, _HEARD)), 3)
    return rows.select("vec_id", best.alias("b")).select("vec_id", "b.category", F.round(F.col("b.score").cast("double"), 6).alias("score"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS done, CAST(o_orderkey * 2 AS BIGINT) AS total, CAST(o_custkey AS DOUBLE) AS rate, 1.5::DOUBLE AS eta_min, 50.0::DOUBLE AS pct FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def log_progress(spark, d):
    """Where a job is by its log: here a line for each order, among others."""
    orders = table(spark, d, "orders")
    told = F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), (F.col("o_orderkey") * 2).cast("string"), F.lit("  "), F.col("o_custkey").cast("string"), F.lit("/s  eta  1.5m  err=0"))
    lines = orders.select((F.col("o_orderkey") * 2).alias("line_no"), told.alias("line")).unionByName(orders.select((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.lit("something else").alias("line")))
    return files.progress(lines)


@query("SELECT label, CAST(size AS INT) AS size FROM @clusters WHERE level = 1")
def dashboard_sonic(spark, d):
    parts = stats.dashboard(view(spark, d, "samples"), view(spark, d, "sample_labels"), view(spark, d, "clusters"))
    return parts["sonic"]


@query(f"SELECT i.path, i.map_i, round(i.x, 4) AS x, round(i.y, 4) AS y, CASE s.human_instrument WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS human, CASE s.sample_type WHEN 'oneshot' THEN 0 WHEN 'loop' THEN 1 ELSE 2 END AS t FROM (SELECT *, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS map_i FROM @points) i JOIN @samples s USING (path)")
def map_of_two_stores(spark, d):
    """The map of a projection in one store and the catalog in another."""
    root = f"{checkpoint_dir(spark)}/stores-{uuid.uuid4().hex}"
    points, kept = Store(spark, f"{root}/points"), Store(spark, f"{root}/catalog")
    points.write("projection", view(spark, d, "points"))
    kept.write("samples", view(spark, d, "samples"))
    kept.write("taxonomy", view(spark, d, "taxonomy"))
    return geometry.map_of(points, kept).select("path", "map_i", "x", "y", "human", "t")
