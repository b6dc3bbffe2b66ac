"""Models behind one interface: each provider is a function of a Column, or one that scores batches in a pandas UDF.

The rules, the hashed embedding and the overlap reranker are Column expressions and need no model. Any other model comes as
a function that makes it (once a Python worker) and is called on batches, again once if a batch fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import similarity as S
from quern.functions import text as T
from quern.operators import fusion

BATCH = 32


def again(call: Callable, *args, times: int = 2):
    """call(*args), once more if it raises."""
    for left in range(times - 1, -1, -1):
        try:
            return call(*args)
        except Exception:
            if not left:
                raise


def encoder(make: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int):
    """A pandas UDF from text to a unit vector: the model is made once a worker, called on BATCH texts, and must give vectors of the dimension. Null texts give null."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            known = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(known), BATCH):
                some = known[k : k + BATCH]
                v = np.asarray(again(model, [texts.iloc[i] for i in some]), np.float32)
                if v.shape != (len(some), dimension):
                    raise ValueError(f"{v.shape}: {dimension} dimensions are asked for")
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, row in zip(some, v, strict=True):
                    out.iloc[i] = row.tolist()
            yield out

    return encode


def scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A pandas UDF that scores (query, passage) pairs with a model made once a worker."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for queries, passages in parts:
            pairs = list(zip(queries.fillna(""), passages.fillna(""), strict=True))
            yield pd.Series([x for k in range(0, len(pairs), BATCH) for x in again(model, pairs[k : k + BATCH])], dtype="float64")

    return score


def overlap_score(query: Column, passage: Column) -> Column:
    return fusion.overlap(F.array_distinct(T.simple_tokens(query)), T.simple_tokens(passage))


#: By name; "model" ones are made by encoder() and scorer().
EMBEDDINGS: dict[str, Callable[[Column], Column]] = {"hashed": S.hashed_slots}
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}
EXTRACTORS: dict[str, Callable[..., Column]] = {"classification": T.document_type, "universal": R.universal_fields, "type_specific": R.type_fields, "rewrite": R.rewritten}


def provider(kind: dict[str, Callable], name: str) -> Callable:
    """A provider by its name; an unknown one is an error that names those there are."""
    if name not in kind:
        raise ValueError(f"{name}: there are {', '.join(sorted(kind))}")
    return kind[name]
