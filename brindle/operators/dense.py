"""Exact nearest neighbours of a set of queries by blocks of matrix products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.topk import merged

#: Query vectors are sent to all tasks in blocks of at most this many numbers.
BLOCK_NUMBERS = 4_000_000
_ROWS, _QUERIES = 1024, 512


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """query_id, id, distance (cosine), rank of the k nearest rows of each query; equal distances by id.

    Filter `vectors` before the search: the k nearest are taken of what is left.
    Each task keeps the k best of its rows per query; those alone are shuffled.
    Queries must be few against the rows: they are read on the driver, block by block.
    """
    rows = queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull()).orderBy(query_id)
    size = rows.select(F.max(F.size(query_vector))).first()[0]
    schema = f"query_id {dict(rows.dtypes)[query_id]}, id {dict(vectors.dtypes)[vec_id]}, distance double"
    found = None
    if size:
        step = max(1, BLOCK_NUMBERS // int(size))
        every = rows.toLocalIterator()
        while block := list(itertools.islice(every, step)):
            part = _block(vectors, np.array([r[0] for r in block], dtype=object), np.array([r[1] for r in block], dtype=np.float64), k, vec_id, vector, schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, vec_id: str, vector: str, schema: str) -> DataFrame:
    unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list = [None] * len(range(0, len(unit), _QUERIES))
        for whole in batches:
            whole = whole[whole["v"].notna()]
            for first in range(0, len(whole), _ROWS):  # what is looked at at once is small, however many queries and rows there are
                pdf = whole.iloc[first : first + _ROWS]
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                x, i = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T, pdf["id"].to_numpy()
                for n, own in enumerate(kept):
                    d = np.round(1.0 - unit[n * _QUERIES : (n + 1) * _QUERIES] @ x, 9)
                    kept[n] = merged(own, -d, i, i, k)
        for n, own in enumerate(kept):
            if own is not None:
                yield pd.DataFrame({"query_id": np.repeat(ids[n * _QUERIES : (n + 1) * _QUERIES], own[0].shape[1]), "id": own[1].ravel(), "distance": -own[0].ravel()})

    return vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).mapInPandas(best, schema)
