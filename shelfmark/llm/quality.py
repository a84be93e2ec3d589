"""Quality scores by nearest-neighbour votes among labelled latent-semantic vectors.

A text's features are its counts of hashed byte trigrams, damped and weighted by how few labelled texts have them,
beside a few measures of repetition and shape; they are projected on the leading singular directions of the labelled
texts. The labelled vectors are broadcast; every
document's cosine with each of them is computed in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

BUCKETS, SHAPE_WEIGHT, DIMENSIONS, NEIGHBOURS, BLOCK = 2048, 1.5, 48, 15, 512


class Model(NamedTuple):
    weights: np.ndarray  # of each bucket
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # of the labelled texts, unit length
    labels: np.ndarray  # 0 to 1
    prior: float


def features(text: str | None) -> np.ndarray:
    """log(1 + count) of each bucket of the text's byte trigrams, then five shares from 0 to 1.

    The shares: words that repeat the word before, repeated word pairs, repeated lines, capitals among ASCII letters,
    marks among the bytes. Empty texts have zeros.
    """
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    wide = data.astype(np.uint32)
    codes = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    words, lines = raw.split(), raw.split(b"\n")
    pairs = [*zip(words, words[1:])]
    upper, lower = ((data >= 65) & (data <= 90)).sum(), ((data >= 97) & (data <= 122)).sum()
    marks = ((data > 32) & (data < 128)).sum() - upper - lower - ((data >= 48) & (data <= 57)).sum()
    shares = (sum(a == b for a, b in pairs) / max(1, len(pairs)), 1 - len({*pairs}) / max(1, len(pairs)) if pairs else 0, 1 - len({*lines}) / len(lines), upper / max(1, upper + lower), marks / max(1, len(data)))
    return np.concatenate([np.log1p(np.bincount(buckets, minlength=BUCKETS)), shares]).astype(np.float32)


@arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Trigrams at unit length; the shares beside them, so that they weigh as much in long texts as in short ones."""
    return np.hstack([_unit(counts[:, :BUCKETS] * weights), SHAPE_WEIGHT * counts[:, BUCKETS:]])


def latent(counts: np.ndarray, labels: np.ndarray, seed: int = 0) -> Model:
    """The model of labelled feature rows; the leading directions by subspace iteration."""
    weights = np.log((1 + len(counts)) / (1 + (counts[:, :BUCKETS] > 0).sum(axis=0))).astype(np.float32) + 1
    rows = _weighted(counts, weights)
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], min(DIMENSIONS, *rows.shape))).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    return Model(weights, basis.astype(np.float32), _unit(rows @ basis), labels, float(labels.mean()))


def votes(model: Model, counts: np.ndarray) -> np.ndarray:
    """The similarity-weighted mean label of each row's nearest neighbours; the prior where nothing is similar."""
    k, out = min(NEIGHBOURS, len(model.labels)), []
    near = _unit(_weighted(counts, model.weights) @ model.basis) @ model.vectors.T
    for row in near:
        at = np.argpartition(-row, k - 1)[:k]
        weight = np.maximum(row[at], 0)
        out.append(float(weight @ model.labels[at] / weight.sum()) if weight.sum() > 1e-6 else model.prior)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, each: int = 1500) -> Model | None:
    """The model of ``labels`` (doc_id, quality 0 or 1) on ``docs`` (doc_id, text).

    The bound of the sample: about ``each`` labelled documents of each label, those of smallest hashed id. Null ids,
    labels and texts are left out; a document with several labels gets their mean, and of texts that share an id the one
    that sorts first teaches. No rows give no model.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality")).withColumn("side", F.col("quality") >= 0.5)
    sizes = {r.side: r.n for r in marked.groupBy("side").agg(F.count("*").alias("n")).collect()}
    taken = F.lit(False)
    for side, n in sizes.items():
        cut = -(1 << 63) + int((1 << 64) * min(1.0, each / n)) - 1
        taken = taken | ((F.col("side") == side) & (F.xxhash64("doc_id") <= F.lit(cut).cast("long")))
    sample = F.broadcast(marked.where(taken).select("doc_id", "quality"))  # about twice ``each`` rows
    texts = docs.where("text IS NOT NULL").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "quality", _features("text").alias("counts")).orderBy("doc_id").collect()
    if not rows:
        return None
    return latent(np.array([np.frombuffer(r.counts, np.float32) for r in rows]), np.array([r.quality for r in rows]))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A column of doubles from 0 to 1, higher where label 1 is likelier; 0.5 without a model. Any text has one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand short vectors

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for k in range(0, len(texts), BLOCK):
            block = texts[k : k + BLOCK].to_pylist()
            out += [0.5] * len(block) if model is None else votes(model, np.array([features(t) for t in block])).tolist()
        return pa.array(out, pa.float64())

    return of(F.col(text))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "quality")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, repeated rows included; a null id isn't held out."""
    docs = docs.select("doc_id", "text")
    scored = docs.select("doc_id", score(docs, fit(docs, training_labels(labels))).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
