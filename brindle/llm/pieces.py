"""Problem 6: cutting oversized texts at natural boundaries.

Method: dynamic programming over boundary positions. Every position after a
paragraph, line, sentence, clause or word may be cut, each at its own penalty;
inside stretches without any such position every character may be, at a high
one. The programme minimises the sum of the penalties and of the squared
relative deviation from the even size, subject to the limit and to the overlap:
each piece after the first repeats the end of the one before, up to `overlap`
characters, begun at a word where one begins there.

Every text is handled whole. Times are shared out in proportion to the
characters of the new part of a piece.

Defined results: null and blank texts and texts within the limit give no piece;
a null or reversed end time gives null piece times where they can't be shared
out; equal rows give the pieces of one row; positions count code points of the
text without outer white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread

#: Penalty by kind of boundary; the last pattern that matches a position gives its kind.
_KINDS = [
    (re.compile(r"\s+(?=\S)"), 0.35),
    (re.compile(r"[,;:)\]]\s+(?=\S)"), 0.2),
    (re.compile(r"[.!?…。]['\")\]]*\s+(?=\S)"), 0.05),
    (re.compile(r"\n\s*(?=\S)"), 0.03),
    (re.compile(r"\n\s*\n\s*(?=\S)"), 0.0),
]
_HARD = 3.0


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    cost = np.full(len(text) + 1, np.inf)
    for pattern, penalty in _KINDS:
        for m in pattern.finditer(text):
            cost[m.end()] = penalty
    cost[len(text)] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def cut_positions(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces' new parts, the last being len(text)."""
    n = len(text)
    if n <= limit:
        return [n]
    step = limit - overlap  # the most new characters of a piece after the first
    at, cost = _boundaries(text)
    gaps = np.diff(np.concatenate([[0], at]))
    if gaps.max() > step // 2:
        # stretches without a boundary: any character may be cut, but not before a combining mark
        extra = []
        for end, gap in zip(at, gaps):
            if gap > step // 2:
                extra.append(np.arange(end - gap + 1, end))
        hard = np.concatenate(extra)
        kept = hard[[unicodedata.combining(text[i]) == 0 and text[i] != "\u200d" for i in hard]]
        if np.diff(np.unique(np.concatenate([[0], at, kept]))).max() <= step:
            hard = kept
        at, cost = np.concatenate([at, hard]), np.concatenate([cost, np.full(len(hard), _HARD)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    at, cost = np.concatenate([[0], at]), np.concatenate([[0.0], cost])
    pieces = 1 + -(-(n - limit) // step)
    even = n / pieces
    best, source = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    low = np.searchsorted(at, at - step)  # first position from which each one is in reach
    for i in range(1, len(at)):
        j = low[i]
        size = at[i] - at[j:i]
        total = best[j:i] + (size / even - 1.0) ** 2
        k = int(total.argmin())
        best[i], source[i] = total[k] + cost[i], j + k
        if at[i] <= limit:  # the first piece has no overlap and may fill the limit
            alone = (at[i] / even - 1.0) ** 2 + cost[i]
            if alone < best[i]:
                best[i], source[i] = alone, 0
    ends, i = [], len(at) - 1
    while i > 0:
        ends.append(int(at[i]))
        i = source[i]
    return ends[::-1]


def _word_start(text: str, low: int, high: int) -> int:
    """The first start of a word in low..high, or low where there is none."""
    for i in range(low, high):
        if (i == 0 or text[i - 1].isspace()) and not text[i].isspace():
            return i
    return low


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, new_from, end) of each piece; text[start:new_from] repeats the piece before."""
    out, begun = [], 0
    for end in cut_positions(text, limit, overlap):
        # the overlap never reaches beyond the piece before it nor makes the piece too long
        low = max(0, begun - overlap, end - limit)
        start = _word_start(text, low, begun) if begun else 0
        out.append((start, begun, end))
        begun = end
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pieces of all rows whose text has over `limit` characters: keys, piece_no, n_pieces, piece, char_start, new_from, char_end, piece_start, piece_end."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kinds = dict(df.dtypes)
    own = df.select(*keys, F.col(text).alias("__text"), (F.col(start) if start else F.lit(None)).cast("double").alias("__start"), (F.col(end) if end else F.lit(None)).cast("double").alias("__end"))
    long = own.where(F.length("__text") > limit).distinct()
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, n_pieces int, piece string, char_start int, new_from int, char_end int, piece_start double, piece_end double"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                whole, began, ended = row[len(keys) :]
                body = whole.strip()
                if len(body) <= limit:
                    continue
                parts = split_text(body, limit, overlap)
                known = began is not None and ended is not None and ended >= began  # NaN compares false
                for i, (a, new, z) in enumerate(parts):
                    at = (began + (ended - began) * new / len(body), began + (ended - began) * z / len(body)) if known else (None, None)
                    rows.append((*row[: len(keys)], i + 1, len(parts), body[a:z].rstrip(), a, new, z, *at))
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "n_pieces", "piece", "char_start", "new_from", "char_end", "piece_start", "piece_end"])

    return spread(long).mapInPandas(cut, schema)
