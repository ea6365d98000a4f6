"""Embedding backends: functions from a text column to an array column, by name. A model is plugged in as a pandas UDF."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import md5_embedding, normalised, stub_embedding

BACKENDS: dict[str, Callable[[Column, int], Column]] = {
    "stub": lambda text, dim: stub_embedding(text, dim),
    "md5": lambda text, dim: md5_embedding(text, dim),
    "zero": lambda text, dim: F.array_repeat(F.lit(0.0), dim),
}


def register(name: str, backend: Callable[[Column, int], Column]) -> None:
    BACKENDS[name] = backend


def model_backend(load: Callable[[], Callable[[list[str]], object]], batch: int = 32, retries: int = 3, wait: float = 1.0, fallback: bool = True) -> Callable[[Column, int], Column]:
    """A backend of a model: load() gives, once a worker, a function from texts to their vectors, which is called with
    `batch` texts at a time. A call that fails is made again up to `retries` times, after a wait that doubles; one that
    fails for good gives zero vectors, or stops the job without `fallback`."""

    def backend(text: Column, dim: int) -> Column:
        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()

            def called(texts: list[str]) -> np.ndarray:
                for k in range(retries + 1):
                    try:
                        return np.asarray(model(texts), float).reshape(len(texts), -1)
                    except Exception:
                        if k == retries and not fallback:
                            raise
                        if k < retries:
                            time.sleep(wait * 2**k)
                return np.zeros((len(texts), dim))

            for part in parts:
                texts = part.fillna("").tolist()
                yield pd.Series([v.tolist() for i in range(0, len(texts), batch) for v in called(texts[i : i + batch])], index=part.index, dtype=object)

        return run(text)

    return backend


def chosen_backend(environ: Mapping[str, str], real: str = "model", choice: str = "RAG_REAL_EMBED", key: str = "MODEL_API_KEY") -> str:
    """The name of the backend that the environment asks for: the real one if its variable `choice` is 1, it has the variable `key` and is registered, else stub."""
    return real if environ.get(choice) == "1" and environ.get(key) and real in BACKENDS else "stub"


#: How a component is kept: as it is, or with the precision of a narrower type.
PRECISIONS: dict[str, Callable[[Column], Column]] = {"fp64": lambda x: x, "fp32": lambda x: x.cast("float").cast("double"), "bf16": lambda x: x.cast("float").cast("double"), "fp16": lambda x: half(x)}


def half(x: Column) -> Column:
    """x rounded to 11 significant bits, as a 16-bit float keeps it, to the even one in the middle; magnitudes below 2^-14 to multiples of 2^-24."""
    exponent = F.floor(F.log2(F.greatest(F.abs(x), F.lit(2.0**-14))))
    step = F.pow(F.lit(2.0), exponent - 10)
    return F.rint(x / step) * step


def embed(df: DataFrame, backend: str, dim: int, text: str = "text", out: str = "v", unit: bool = True, precision: str = "fp64") -> DataFrame:
    """df with the vectors; null texts get zeros, and vectors of another length than dim stop the job."""
    raw = F.when(F.col(text).isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(BACKENDS[backend](F.col(text), dim))
    checked = F.when(F.size(raw) == dim, raw).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} dimensions")))
    return df.withColumn(out, F.transform(normalised(checked) if unit else checked, PRECISIONS[precision]))
