"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, contamination, embedding_dedup, filter_audit, language, lexical, licences, line_dedup, quality, simhash, suffix_dedup, token_count, topk
from shelfmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.budget(table(spark, sf_dir, "documents"), tokenizer())


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


ORACLE["op3_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(d.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op9_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT id, m, array_to_string(w[p:p + m - 1], ' ') AS win FROM
       (SELECT id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win FROM
       (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, iw.id, dw.p, dw.m FROM dw JOIN iw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digests(table(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in licences.TEMPLATES)
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
_ASCII_WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
ORACLE["op2_license_scan"] = f"""
WITH t AS (SELECT id, {_BIGRAMS} AS b FROM (SELECT id, {_ASCII_WORDS.format("text")} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(id, text))),
d AS (SELECT doc_id, list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10))) AS us FROM documents),
u AS (SELECT doc_id, unit, {_ASCII_WORDS.format("x")} AS w FROM (SELECT doc_id, unnest(us) AS x, generate_subscripts(us, 1) AS unit FROM d)),
b AS (SELECT doc_id, unit, {_BIGRAMS} AS b FROM u WHERE len(w) > 1 AND list_has_any(w, (SELECT list_distinct(flatten(list(string_split_regex(array_to_string(b, ' '), ' ')))) FROM t))),
s AS (SELECT doc_id, unit, id, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS score FROM b, t
      WHERE 5 * 2 * least(len(b.b), len(t.b)) >= 4 * (len(b.b) + len(t.b))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.8),
g AS (SELECT doc_id, count(*) AS n_units, array_to_string(list_sort(list(DISTINCT id)), ',') AS licenses, max(score) AS best_score FROM r WHERE k = 1 GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, coalesce(licenses, '') AS licenses, coalesce(best_score, 0.0) AS best_score
FROM documents LEFT JOIN g USING (doc_id)
"""


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_FIRST_BIT = "CAST(1 << (instr('ABCDE', substr(filter_order, {}, 1)) - 1) AS INTEGER)"
ORACLE["op12_filter_audit"] = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM t),
g AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN g USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(string_split('A B C D E', ' ')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, {_FIRST_BIT.format("step")} AS bit,
      list_sum(list_transform(range(1, step), lambda j: {_FIRST_BIT.format("j")})) AS past FROM o, (SELECT unnest(range(1, 6)) AS step)),
b AS (SELECT filter_order, step, bit, CAST(coalesce(past, 0) AS INTEGER) AS past FROM s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
      sum(CASE WHEN mask & (past | bit) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & past > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_sql_words("text")}) AS term FROM
      (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), n),
m AS (SELECT r, doc_id, 25 + (75 * len(d.w) * n.n) // n.l AS m FROM d, n WHERE len(d.w) > 0 AND doc_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


ORACLE["op13_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
      AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9 ELSE false END),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), c AS (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
