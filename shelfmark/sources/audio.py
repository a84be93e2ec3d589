"""Signals behind the embedding step. Decoders and models are callables, so that none is required to be installed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def clean(signal: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    """Mono float32, at most ``seconds`` long, without NaN and infinities."""
    mono = signal.mean(axis=1) if signal.ndim > 1 else signal
    return np.nan_to_num(mono[: int(rate * seconds)].astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)


def fit_length(signal: np.ndarray, least: int, length: int) -> np.ndarray:
    """Tiled if shorter than ``least``, then padded with zeros (or cut) to ``length``."""
    if 0 < len(signal) < least:
        signal = np.tile(signal, -(-least // len(signal)))[:least]
    return np.pad(signal[:length], (0, max(0, length - len(signal))))


_OUTCOME = "struct<vec:array<float>, error:string>"


def embed_outcomes(files: DataFrame, decode: Callable[[bytes], np.ndarray], model: Callable[[np.ndarray], np.ndarray], batch: int = 16, length: int = 1) -> DataFrame:
    """path, vec, ok, error of ``files`` (path, content): decoded on the executors, judged in batches at length one.

    A file whose content is null, doesn't decode, or decodes to nothing has no vector and its error; a batch that the
    model can't judge is judged file by file, so that one file costs no other. ``length`` 0 leaves vectors as they are.
    """

    def judged(signals: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.asarray(model(np.stack(signals)), np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return [*(rows / np.where(norms > 0, norms, 1) if length else rows)]

    @arrow_udf(_OUTCOME)
    def of(contents: pa.Array) -> pa.Array:
        vecs: list = [None] * len(contents)
        errors: list = [None] * len(contents)
        for k in range(0, len(contents), batch):
            ready = []
            for j, c in enumerate(contents[k : k + batch].to_pylist(), k):
                try:
                    if c is None or not len(signal := decode(c)):
                        raise ValueError("no content")
                    ready.append((j, signal))
                except Exception as failed:  # noqa: BLE001  a broken file must not end the job
                    errors[j] = f"{type(failed).__name__}: {failed}"
            try:
                found = judged([s for _, s in ready]) if ready else []
            except Exception:  # noqa: BLE001
                found = []
                for j, signal in ready:
                    try:
                        found += judged([signal])
                    except Exception as failed:  # noqa: BLE001
                        found.append(None)
                        errors[j] = f"{type(failed).__name__}: {failed}"
            for (j, _), v in zip(ready, found, strict=True):
                vecs[j] = None if v is None else v.astype(np.float32)
        return pa.StructArray.from_arrays([pa.array(vecs, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["vec", "error"])

    done = files.select("path", of(F.col("content")).alias("o"))
    return done.select("path", "o.vec", F.col("o.error").isNull().alias("ok"), "o.error")


def embed(files: DataFrame, decode: Callable[[bytes], np.ndarray], model: Callable[[np.ndarray], np.ndarray], batch: int = 16) -> DataFrame:
    """path, vec of ``files`` (path, content): decoded on the executors, judged in batches; what fails has no vector."""

    @arrow_udf("array<float>")
    def of(contents: pa.Array) -> pa.Array:
        out: list = [None] * len(contents)
        for k in range(0, len(contents), batch):
            ready = []
            for j, c in enumerate(contents[k : k + batch].to_pylist()):
                try:
                    ready.append((k + j, decode(c)))
                except Exception:  # noqa: BLE001  a broken file must not end the job
                    continue
            if ready:
                for (j, _), v in zip(ready, model(np.stack([s for _, s in ready])), strict=True):
                    out[j] = np.asarray(v, np.float32)
        return pa.array(out, pa.list_(pa.float32()))

    return files.select("path", of(F.col("content")).alias("vec")).where("vec IS NOT NULL")
