"""The catalog's tables, made out of the driver's. The same SQL runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.tables import table

CLASSES = ("de", "en", "es", "fr")
WEAK_MAP = (("old_en", "en"), ("old_de", "de"), ("assistant", "en"))

VIEWS = {
    "samples": """
SELECT concat('lib/', d.source, '/', CAST(d.doc_id AS STRING), '.wav') AS path, d.doc_id AS row_id,
  CAST(d.doc_id % 97 AS DOUBLE) + 0.5 AS mtime, d.n_chars AS size, CAST(d.n_chars AS DOUBLE) / 1000 AS duration_s,
  CASE WHEN d.doc_id % 3 = 0 THEN 'loop' WHEN d.doc_id % 3 = 1 THEN 'oneshot' END AS sample_type,
  CAST(40 + d.n_chars % 260 AS INT) AS bpm, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE concat('key', CAST(d.n_chars % 12 AS STRING)) END AS key,
  CASE WHEN d.doc_id % 17 = 0 THEN 'missing' WHEN d.doc_id % 13 = 0 THEN 'error' WHEN d.doc_id % 29 = 0 THEN 'new' ELSE 'ok' END AS status,
  CASE WHEN d.doc_id % 13 = 0 THEN 'decode' END AS error, CAST(d.n_chars * 3 % 1009 AS DOUBLE) AS ts,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN concat('old_', d.lang) ELSE d.lang END AS path_instrument,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 9 = 0 THEN concat('old_', d.lang) WHEN d.doc_id % 11 = 0 THEN 'en' ELSE d.lang END AS panns_instrument,
  CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'en' WHEN l.quality = 0 THEN 'fr' END AS human_instrument,
  CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'single' WHEN l.quality = 0 THEN 'map' END AS label_source,
  CASE WHEN e.label IS NULL THEN NULL WHEN e.label % 4 = 0 THEN 'de' WHEN e.label % 4 = 1 THEN 'en' WHEN e.label % 4 = 2 THEN 'es' ELSE 'fr' END AS model_instrument,
  CASE WHEN e.label IS NOT NULL THEN CAST(d.n_chars % 101 AS DOUBLE) / 100 END AS model_conf,
  CASE WHEN e.label IS NOT NULL AND d.doc_id % 10 <> 0 THEN CAST(d.n_chars % 89 AS DOUBLE) / 89 END AS model_margin,
  CASE WHEN e.label IS NULL THEN NULL WHEN e.label % 2 = 0 THEN 'en' ELSE 'es' END AS model_margin_label,
  CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 OR l.quality = 0 THEN 'human' WHEN e.label IS NOT NULL THEN 'model' WHEN d.doc_id % 5 <> 0 THEN 'path' END AS source,
  CAST(d.doc_id % 6 AS INT) AS rating, d.doc_id % 31 = 0 AS is_val, d.doc_id % 8 = 0 AS gold_candidate,
  CAST(e.label AS INT) AS cluster_id, CASE WHEN e.label IS NOT NULL THEN CAST(d.n_chars % 37 AS DOUBLE) END AS cluster_d, CAST(e.label % 3 AS INT) AS cluster_l1
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id""",
    "sample_labels": """
SELECT path, label, CAST(rank AS INT) AS rank FROM (
  SELECT concat('lib/', CAST(conv_id AS STRING)) AS path, role AS label, min(turn) + 1 AS rank FROM {conversations} GROUP BY conv_id, role) x""",
    "item_labels": """
SELECT concat('lib/', d.source, '/', CAST(d.doc_id AS STRING), '.wav') AS path, c.label AS label, CAST((d.n_chars + c.k) % 5 AS INT) AS rank
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id JOIN (VALUES ('de', 1), ('en', 2), ('es', 3), ('fr', 4), ('odd', 5)) AS c(label, k) ON (d.doc_id + c.k) % 3 = 0 OR c.label = d.lang
WHERE l.quality = 1 OR l.quality = 0 AND d.doc_id % 3 <> 0""",
    "model_labels": """
SELECT concat('lib/', d.source, '/', CAST(d.doc_id AS STRING), '.wav') AS path, c.label AS label, CAST((d.n_chars * c.k) % 101 AS DOUBLE) / 100 AS conf
FROM {documents} d JOIN {embeddings} e ON d.doc_id = e.vec_id JOIN (VALUES ('de', 1), ('en', 3), ('es', 7), ('fr', 11)) AS c(label, k) ON (d.n_chars * c.k) % 3 = 0""",
    "points": """
SELECT concat('lib/', source, '/', CAST(doc_id AS STRING), '.wav') AS path, CAST(doc_id % 101 AS DOUBLE) / 100 AS x, CAST(doc_id * 7 % 103 AS DOUBLE) / 102 AS y FROM {documents}""",
    "vectors": "SELECT vec_id, embedding AS vec, label FROM {embeddings}",
    "taxonomy": "SELECT c.name AS name FROM (VALUES ('de'), ('en'), ('es'), ('fr')) AS c(name)",
    "weak_map": "SELECT c.old_label AS old_label, c.new_label AS new_label FROM (VALUES ('old_en', 'en'), ('old_de', 'de'), ('assistant', 'en')) AS c(old_label, new_label)",
    "clusters": """
SELECT CAST(label AS INT) AS id, 2 AS level, CAST(label % 3 AS INT) AS parent, CAST(count(*) AS INT) AS size, concat('grain ', CAST(label AS STRING)) AS label FROM {embeddings} GROUP BY label
UNION ALL SELECT CAST(label % 3 AS INT) * 2 AS id, 1 AS level, CAST(NULL AS INT) AS parent, CAST(count(*) AS INT) AS size, concat('family ', CAST(label % 3 AS STRING), '!') AS label FROM {embeddings} GROUP BY label % 3""",
    "paths": """
SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN 'Loops/' WHEN p_partkey % 7 = 0 THEN 'One Shots/' ELSE 'lib/' END, p_type, '/',
  CASE p_partkey % 13 WHEN 0 THEN '808 sub' WHEN 1 THEN 'Kick_Hard' WHEN 2 THEN 'snare rim' WHEN 3 THEN 'Clap' WHEN 4 THEN 'closed hat' WHEN 5 THEN 'Crash' WHEN 6 THEN 'tom' WHEN 7 THEN 'Shaker Am'
    WHEN 8 THEN 'Vox Bbmaj' WHEN 9 THEN 'Bass F#min' WHEN 10 THEN 'Riser' WHEN 11 THEN 'Warm Pad Ebm' ELSE 'misc' END,
  ' ', CAST(p_size * 7 AS STRING), 'bpm.wav') AS path FROM {part}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **sources)


def oracle(sql: str) -> str:
    """``sql`` with a definition before it of every view it names as ``@view``."""
    used = [n for n in VIEWS if f"@{n}" in sql]
    defined = ", ".join(f"v_{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in used)
    body = re.sub(r"@(\w+)", r"v_\1", sql).strip()
    first, _, rest = body.partition(" ")
    again = rest.startswith("RECURSIVE ")
    return f"WITH {'RECURSIVE ' * again}{defined}" + (f", {rest.removeprefix('RECURSIVE ')}" if first.upper() == "WITH" else f" {body}") if used else body
