"""Okapi BM25 over passages: statistics as tables, many queries scored at once.

score = sum over query words (repeats count again) of
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), with
idf = ln(N - n + 0.5) - ln(n + 0.5); words with a negative idf get epsilon times
the mean idf of all words.

Queries come in blocks of bounded size, PASS_BLOCKS of them at a time on the
driver; the weights of their words go to the tasks, which count the words of
their passages once and keep the k best of each query as they go. Queries that
share frequent words are looked at together: scores in single precision, a
matrix product over the frequent words of these queries and the postings of the
others, leave a few passages that can be among the best by the bound of their
error, and those get their scores by the formula in double precision from the
query's own words. A task passes on k rows a query however many passages it has
read, and there are two tasks a core; no posting is shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators.topk import Kept, merged
from brindle.session import cores, cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words and queries of a block at most, on an average over a pass.
BLOCK_WORDS, BLOCK_QUERIES = 4_000, 512
#: Blocks that one pass over the passages takes at most.
PASS_BLOCKS = 128
#: Passages looked at in one go; room for the rounding of sums.
_ROWS, _SLACK = 16_384, 1e-8
#: Queries looked at together; words in more than one passage in _WIDE are columns of a matrix, _COLUMNS of them at most.
_GROUP, _WIDE, _COLUMNS = 128, 12, 1024
#: Passages that may be among the best of a query up to which they are looked at one by one; passages of a set of which only the best counts for a first bound.
_NEAR, _SET = 256, 64


@dataclass
class Index:
    """docs (id, ord, words, dl), terms (term, df, idf) and scalars."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float

    def write(self, path: str, force: bool = False) -> bool:
        """Write the tables; one that is there is kept unless forced, and no passages write nothing. Tells whether it wrote."""
        spark = self.docs.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scalars")
        if self.n_docs == 0 or not force and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return False
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(self.n_docs, self.avgdl)], "n_docs long, avgdl double").write.mode("overwrite").parquet(f"{path}/scalars")
        return True

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        s = spark.read.parquet(f"{path}/scalars").first()
        return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms"), s["n_docs"], s["avgdl"])


def build(passages: DataFrame, id_col: str, text_col: str, ord_col: str | None = None) -> Index:
    """Statistics of all passages; `ord_col` is the stored order that breaks ties (the id where there is none)."""
    docs = passages.select(F.col(id_col).alias("id"), F.col(ord_col or id_col).alias("ord"), F.coalesce(tokens(text_col), F.array().cast("array<string>")).alias("words"))
    docs = docs.withColumn("dl", F.size("words").cast("long"))
    # a passage counts a word once, and once as a whole under null, so texts are split in one pass; the counts are added up before the shuffle
    every = docs.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))).alias("term"), "dl")
    counted = cut_lineage(every.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")))
    total = counted.where("term is null").first()
    n_docs, n_words = (total["df"], total["dl"]) if total else (0, 0)
    n = F.lit(float(n_docs))
    raw = counted.where("term is not null").select("term", "df").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # a frame of one row
    return Index(docs, terms, n_docs, n_words / max(n_docs, 1))


def search(index: Index, queries: DataFrame, query_id: str, query_text: str, k: int = 20) -> DataFrame:
    """The k best passages of each query: query_id, id, score, rank; ties in stored order.

    Always min(k, N) rows: passages without a common word score 0.
    """
    words = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokens(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = words.join(index.terms.select("term", "idf"), "term", "left")
    one = weighted.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", F.col("qtf") * F.col("idf"))))).alias("weights"))
    kinds = dict(index.docs.dtypes)
    schema = f"query_id {dict(words.dtypes)['query_id']}, id {kinds['id']}, ord {kinds['ord']}, score double"
    found: DataFrame | None = None
    asked = _Asked([], {}, array("q"), array("d"), array("q", [0]))
    for row in one.toLocalIterator():
        if asked.names and (len(asked.names) == PASS_BLOCKS * BLOCK_QUERIES or len(asked.terms) + sum(t not in asked.terms for t in row["weights"]) > PASS_BLOCKS * BLOCK_WORDS):
            part = _pass(index, asked, k, schema)
            found = part if found is None else found.unionByName(part)
            asked = _Asked([], {}, array("q"), array("d"), array("q", [0]))
        asked.add(row["query_id"], row["weights"])
    part = _pass(index, asked, k, schema)
    found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


@dataclass
class _Asked:
    """Queries of a pass: their names, the numbers of all words, and the word numbers and weights of one query after another."""

    names: list
    terms: dict[str, int]
    term: array
    value: array
    first: array

    def add(self, name: object, weights: dict[str, float]) -> None:
        self.names.append(name)
        for t in sorted(weights):  # sums repeat, whatever the order of arrival
            self.term.append(self.terms.setdefault(t, len(self.terms)))
            self.value.append(weights[t])
        self.first.append(len(self.term))


def _pass(index: Index, asked: _Asked, k: int, schema: str) -> DataFrame:
    """The k best of a task's passages for the queries of all blocks; words are split and counted once for all of them."""
    names, terms, avgdl = asked.names, asked.terms, index.avgdl or 1.0
    term, value, first = np.array(asked.term, dtype=np.int64), np.array(asked.value, dtype=float), np.array(asked.first)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, values = np.split(term, first[1:-1]), np.split(value, first[1:-1])
        kept: list = [None] * len(names)
        groups: list[np.ndarray] | None = None
        for pdf in _gathered(batches if names else iter(())):
            rows = _Rows(pdf, terms, avgdl)
            if groups is None:
                groups = _grouped(own, np.diff(rows.at), len(pdf))
            for some in groups:
                rows.best_of(kept, some, own, values, k)
        for a in range(0, len(names), BLOCK_QUERIES):
            some = [(name, x) for name, x in zip(names[a : a + BLOCK_QUERIES], kept[a : a + BLOCK_QUERIES]) if x is not None]
            if some:
                score, ids, order = (np.concatenate([x[i][0] for _, x in some]) for i in range(3))
                name = [name for name, x in some for _ in range(x[0].shape[1])]
                yield pd.DataFrame({"query_id": name, "id": ids, "ord": order, "score": score})

    # of more tasks than cores each would pass on k rows a query; words have no blank in them
    rows = index.docs.select("id", "ord", F.concat_ws(" ", "words").alias("words"), "dl").coalesce(2 * cores(index.docs.sparkSession))
    return rows.mapInPandas(best, schema)


def _grouped(own: list[np.ndarray], n: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Queries in groups that have frequent words in common, so that the words of a group are few. n: passages by word."""
    place = np.empty(len(n), dtype=np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(len(n))
    keys = [sorted(place[t[n[t] * _WIDE > n_rows]].tolist()) for t in own]
    order = np.array(sorted(range(len(own)), key=keys.__getitem__))
    return [order[a : a + _GROUP] for a in range(0, len(order), _GROUP)]


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_ROWS rows at a time."""
    held, n = [], 0
    for whole in batches:
        first = 0
        while first < len(whole):
            part = whole.iloc[first : first + _ROWS - n]
            held.append(part)
            first, n = first + len(part), n + len(part)
            if n == _ROWS:
                yield pd.concat(held)
                held, n = [], 0
    if n:
        yield pd.concat(held)


def _best(kept: Kept | None, score: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int) -> Kept:
    """As merged, for one query and a few rows."""
    if kept is not None:
        score, ids, order = np.append(kept[0][0], score), np.append(kept[1][0], ids), np.append(kept[2][0], order)
    rank = np.array([i for _, _, i in sorted(zip((-score).tolist(), order.tolist(), range(len(score))))][:k])
    return score[None, rank], ids[None, rank], order[None, rank]


class _Rows:
    """Postings of some passages for the words of the queries."""

    def __init__(self, pdf: pd.DataFrame, terms: dict[str, int], avgdl: float):
        lists = pc.split_pattern(pa.array(pdf["words"], type=pa.large_string()), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        known = np.array([terms.get(x, -1) for x in words.dictionary.to_pylist()], dtype=np.int64)
        term = known[words.indices.to_numpy()]
        met = np.flatnonzero(term >= 0)
        row = np.repeat(np.arange(len(pdf)), pc.list_value_length(lists).to_numpy())[met]
        self.key, n = np.unique(term[met] * len(pdf) + row, return_counts=True)  # of word and row
        self.row = self.key % len(pdf)
        self.length = K1 * (1 - B + B * pdf["dl"].to_numpy(dtype=float) / avgdl)
        self.part = n * (K1 + 1) / (n + self.length[self.row])
        self.at = np.searchsorted(self.key, np.arange(len(terms) + 1) * len(pdf))
        self.ids, self.order = pdf["id"].to_numpy(), pdf["ord"].to_numpy()
        self.sum, self.rough = np.zeros(len(pdf)), self.part.astype(np.float32)
        many = np.diff(self.at)
        wide = np.flatnonzero(many * _WIDE > len(pdf))
        wide = wide[np.argsort(-many[wide], kind="stable")[:_COLUMNS]]
        self.column = np.full(len(terms), -1)
        self.column[wide] = np.arange(len(wide))
        self.columns = np.zeros((len(wide), len(pdf)), dtype=np.float32)
        self.times = np.zeros(self.columns.shape, dtype=np.min_scalar_type(n.max(initial=0)))
        for i, t in enumerate(wide):
            own = slice(self.at[t], self.at[t + 1])
            self.columns[i, self.row[own]], self.times[i, self.row[own]] = self.rough[own], n[own]

    def best_of(self, kept: list[Kept | None], some: np.ndarray, own: list[np.ndarray], values: list[np.ndarray], k: int) -> None:
        """Put the k best of those kept and of these rows in place for some queries."""
        term, value = np.concatenate([own[q] for q in some]), np.concatenate([values[q] for q in some])
        of = np.repeat(np.arange(len(some)), [len(own[q]) for q in some])
        sums = self._sums(len(some), of, term, value)
        # more than what single precision can be off by: parts are at most K1 + 1
        n = np.bincount(of, minlength=len(some))
        off = np.bincount(of, np.abs(value), len(some)) * (K1 + 1) * (n + 4) * 2.0**-23 + _SLACK
        full = np.array([kept[q] is not None and kept[q][0].shape[1] == k for q in some])
        low = np.array([kept[q][0][0, -1] if x else -np.inf for q, x in zip(some, full)]) - off
        sets = sums.shape[1] // _SET
        if sets > k and not full.all():  # k sets of rows have a best row that is as good as this one
            best = sums[:, : sets * _SET].reshape(len(some), _SET, sets).max(axis=1)
            low = np.where(full, low, np.partition(best, sets - k, axis=1)[:, sets - k] - 2 * off)
        few, near = [], []
        for i in np.flatnonzero(sums.max(axis=1) >= low).tolist():
            rows = np.flatnonzero(sums[i] >= low[i])
            if len(rows) > _NEAR:
                kept[some[i]] = self.best(kept[some[i]], own[some[i]], values[some[i]], k)
            elif len(rows):
                few.append(i)
                near.append(rows)
        if few:
            size = [len(rows) for rows in near]
            rows = np.concatenate(near)
            score = np.round(self._exact(np.repeat(few, size), rows, n, term, value), 9)
            for i, z, m in zip(few, np.cumsum(size).tolist(), size):
                at = rows[z - m : z]
                kept[some[i]] = _best(kept[some[i]], score[z - m : z], self.ids[at], self.order[at], k)

    def _sums(self, n: int, of: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of n queries in single precision, a row for each. of: the query of a word."""
        column = self.column[term]
        wide = column >= 0
        used, place = np.unique(column[wide], return_inverse=True)
        weights = np.zeros((n, len(used)), dtype=np.float32)
        weights[of[wide], place] = value[wide]
        sums = weights @ self.columns[used]
        a, z = self.at[term], self.at[term + 1]
        few = np.flatnonzero(~wide & (z > a))
        for q, x, first, last in zip(of[few].tolist(), value[few].tolist(), a[few].tolist(), z[few].tolist()):
            rough = sums[q]
            rough[self.row[first:last]] += x * self.rough[first:last]
        return sums

    def _exact(self, of: np.ndarray, rows: np.ndarray, n: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a row, words added up one after another. n: words by query, which stand one query after another."""
        n, first = n[of], (np.cumsum(n) - n)[of]
        pair = np.repeat(np.arange(len(of)), n)
        at = np.arange(len(pair)) + np.repeat(first - (np.cumsum(n) - n), n)
        term, row, part = term[at], rows[pair], np.zeros(len(pair))
        column = self.column[term]
        wide = np.flatnonzero(column >= 0)
        times = self.times[column[wide], row[wide]]
        part[wide] = times * (K1 + 1) / (times + self.length[row[wide]])
        few = np.flatnonzero((column < 0) & (self.at[term + 1] > self.at[term]))
        if len(few):
            want = term[few] * len(self.sum) + row[few]
            place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            part[few] = np.where(self.key[place] == want, self.part[place], 0.0)
        return np.bincount(pair, value[at] * part, len(of))

    def add(self, term: int, value: float) -> None:
        a, z = self.at[term], self.at[term + 1]
        self.sum[self.row[a:z]] += value * self.part[a:z]

    def best(self, kept: Kept | None, term: np.ndarray, value: np.ndarray, k: int) -> Kept:
        """The k best of those kept and of these rows."""
        self.sum[:] = 0
        for t, x in zip(term.tolist(), value.tolist()):
            self.add(t, x)
        near = slice(None)  # rows without a word count too, until k rows are kept
        if kept is not None and kept[0].shape[1] == k:
            near = np.flatnonzero(self.sum >= kept[0][0, -1] - _SLACK)
            if not len(near):
                return kept
        return merged(kept, np.round(self.sum[near], 9)[None, :], self.ids[near], self.order[near], k)
