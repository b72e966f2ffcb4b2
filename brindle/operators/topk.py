"""The k best of each query, kept while rows come in small blocks."""

from __future__ import annotations

import heapq

import numpy as np

Kept = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(kept: Kept | None, score: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int) -> Kept:
    """Scores, ids and orders of the k best of those kept and of new rows, best first; score has a row for each query. Equal scores by order."""
    n = score.shape[1]
    have = 0 if kept is None else kept[0].shape[1]
    width = min(k, have + n)
    if kept is not None and have == k:  # most queries have nothing new
        out, touched = kept, np.flatnonzero((score >= kept[0][:, -1:]).any(axis=1))
    else:
        out, touched = tuple(np.empty((len(score), width), dtype=x.dtype) for x in (score, ids, order)), np.arange(len(score))
    for q in touched:
        s = score[q]
        if have == k:
            near = np.flatnonzero(s >= kept[0][q, -1])
            near = near[(s[near] > kept[0][q, -1]) | (order[near] < kept[2][q, -1])]
            if not len(near):
                continue
        else:
            near = np.flatnonzero(s >= np.partition(s, n - width)[n - width]) if n > width else np.arange(n)
        rows = list(zip((-s[near]).tolist(), order[near].tolist(), near.tolist(), ids[near].tolist()))
        if have:
            rows += zip((-kept[0][q]).tolist(), kept[2][q].tolist(), range(-have, 0), kept[1][q].tolist())
        best = heapq.nsmallest(width, rows, key=lambda x: x[:3])
        out[0][q], out[1][q], out[2][q] = [-x[0] for x in best], [x[3] for x in best], [x[1] for x in best]
    return out
