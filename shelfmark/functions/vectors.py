"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` at length one; a zero vector stays as it is."""
    length = F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.transform(_doubles(v), lambda x: x / length)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_vector(vectors: str | Column, dim: int) -> list[Column]:
    """Aggregates, one for each component: the element-wise mean."""
    v = F.col(vectors) if isinstance(vectors, str) else vectors
    return [F.avg(v[k].cast("double")).alias(f"v{k}") for k in range(dim)]


def argmax(probs: Column) -> Column:
    """The place (from 0) of the largest element; the first of equals."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def tile(values: Column, length: int) -> Column:
    """A short signal repeated up to ``length`` elements; a longer one is cut."""
    times = F.ceil(F.lit(length) / F.size(values)).cast("int")
    return F.when(F.size(values) > 0, F.slice(F.flatten(F.array_repeat(values, times)), 1, length)).otherwise(values)
