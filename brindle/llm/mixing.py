"""Problem 8: mixing sources to target weights.

Method: soft-membership mixing. Documents whose recorded source is one of the
targets are the labelled table; a naive Bayes classifier over hashed words,
fitted on a bounded sample of them, predicts the domain posteriors of every
document. A recorded source is trusted to LABEL_TRUST, the rest of a document's
membership follows the posterior; documents without a target source have the
posterior alone. Nonnegative rates (how often a document is used) are fitted so
that the expected tokens of the domains match the targets: projected-gradient
least squares,

    minimise  sum_d (sum_i tokens_i rate_i p_id - target_d)^2 / mass_d / 2,   0 <= rate_i <= cap_i,

with mass_d = sum_i tokens_i p_id. Scaled by the documents' tokens the gradient
is at most one in norm, so steps of one converge. The rates follow from the
memberships and the gradients of the steps before, so each step is one
distributed sum of as many numbers as there are domains, over documents that are
first added up by equal (rounded) membership.

The statement of the problem measures shares by the recorded source. By default
documents of no target source therefore stay outside (rate 0), and the fit is
carried on from the soft rates with the recorded sources as memberships, until
the tokens of each recorded source match as well; differences between the
documents of a source that come from their posteriors stay. A source whose soft
rate comes near its cap (NEAR_CAP of it) is a candidate for one that can't reach
its share; whether it does is then checked on exact sums. With soft=True
documents of no target source take part under their posteriors, and the expected
shares are what is fitted and reported.

A rate becomes a number of copies: its whole part, and one more for a share of
the documents chosen by a hash of the id. The shares reached are those of the
copies, not of the rates.

Defined results: sources are compared without outer blanks and case; null or
blank texts have no tokens; a target without documents can't be reached; equal
texts each count; null shares and repeats are 0; an empty table gives rates of 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage

from .packing import n_tokens

BUCKETS = 4096
#: The classifier is fitted on at most about this many labelled documents a source.
TRAIN_ROWS = 2000
#: Targets are a fixed table of at most this many sources; more are an error.
MOST_TARGETS = 1001
STEPS = 60
#: A fit ends when no domain's tokens move by more than this part of all tokens.
TOLERANCE = 1e-4
#: How far a recorded source decides a document's membership; the classifier's posterior has the rest.
LABEL_TRUST = 0.98
#: A domain whose soft rate comes to this part of its cap may be out of reach: the exact check follows.
NEAR_CAP = 0.5


@dataclass(frozen=True)
class Target:
    source: str
    key: str
    share: float
    repeats: int


def read_targets(table: DataFrame) -> list[Target]:
    """The targets, a small fixed table."""
    rows = table.where("source is not null").orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"there are over {MOST_TARGETS} targets")
    return [Target(r["source"], r["source"].strip().lower(), float(r["target_share"] or 0), int(r["max_repeat"] or 0)) for r in rows]


def _source_key(source: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))


def _buckets(text: str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)(\p{L}+|[^\p{L}\s\p{N}]|\n)"), F.lit(1))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_classifier(docs: DataFrame, keys: list[str], text: str, rows: int = TRAIN_ROWS, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of domains x buckets and log prior of the domains, which is their part of all labelled documents. One row per source and bucket comes to the driver."""
    counts = {r["key"]: r["n"] for r in docs.where(F.col("key").isin(keys)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.create_map(*[F.lit(x) for k in keys for x in (k, min(1.0, rows / max(1, counts.get(k, 0))))])
    chosen = docs.where(F.col("key").isin(keys)).where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(2**53) < part[F.col("key")])
    table = np.full((len(keys), BUCKETS), alpha)
    for r in chosen.select("key", F.explode(_buckets(text)).alias("b")).groupBy("key", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        table[keys.index(r["key"]), r["b"]] += r["n"]
    prior = np.array([counts.get(k, 0) + alpha for k in keys], dtype=float)
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum())


def _log_posterior(weights: np.ndarray, prior: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Up to a constant. Neighbouring words say the same: long texts count as a hundred words."""
    return prior + weights[:, buckets].sum(1, dtype=float) * min(1.0, 100 / max(1, len(buckets)))


def memberships(docs: DataFrame, targets: list[Target], soft: bool, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, key, tokens, home (number of the recorded target, -1 without), p (membership in each domain, in the order of the targets), cap."""
    keys = [t.key for t in targets]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _source_key(source).alias("key"), F.col(text).alias("text"), n_tokens(text).alias("tokens"))
    home = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key")), F.lit(0)).cast("int") - 1
    own = own.withColumn("home", home) if keys else own.withColumn("home", F.lit(-1))
    if not soft:
        own = own.where("home >= 0")
    weights, prior = fit_classifier(own, keys, "text")
    size = len(keys)

    @F.pandas_udf("array<double>")
    def membership(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for homes, rows in batches:
            out = []
            for at, b in zip(homes, rows):
                score = _log_posterior(weights, prior, np.asarray(b if b is not None else [], dtype=np.int64))
                p = np.exp(score - score.max(initial=0.0 if not size else -np.inf))
                p /= max(p.sum(), 1e-300)
                if at >= 0:
                    p *= 1 - LABEL_TRUST
                    p[at] += LABEL_TRUST
                out.append([round(float(x), 3) for x in p])
            yield pd.Series(out)

    members = own.select("doc_id", "key", "tokens", "home", membership("home", _buckets("text")).alias("p"))
    caps = F.array(*[F.lit(float(t.repeats)) for t in targets]) if targets else F.array().cast("array<double>")
    expected = F.aggregate(F.zip_with("p", caps, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return members.withColumn("cap", F.when(F.col("home") >= 0, F.element_at(caps, F.col("home") + 1)).otherwise(expected) if targets else F.lit(0.0))


@dataclass
class Fit:
    """Steps (whether memberships are soft, gradient), tokens of each domain at rate 1, all tokens, tokens by recorded source, mean soft rate of each domain."""

    steps: list[tuple[bool, np.ndarray]]
    mass: np.ndarray
    total: float
    own: np.ndarray
    soft_rate: np.ndarray


def _rates(p: np.ndarray, home: np.ndarray, cap: np.ndarray, steps: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    rate = np.minimum(1.0, cap)
    for soft, g in steps:
        rate = np.clip(rate - (p @ g if soft else np.append(g, 0.0)[home]), 0.0, cap)
    return rate


def fit_rates(members: DataFrame, targets: list[Target], soft: bool, most: int = STEPS) -> Fit:
    """The soft fit, and without `soft` the fit of the recorded sources that follows it."""
    size = len(targets)
    groups = cut_lineage(members.groupBy("p", "home", "cap").agg(F.sum("tokens").alias("tokens")))
    at_one = [F.sum(F.col("p")[d] * F.col("tokens")).alias(f"p{d}") for d in range(size)] + [F.sum(F.when(F.col("home") == d, F.col("tokens"))).alias(f"h{d}") for d in range(size)]
    sums = groups.agg(*at_one, F.sum("tokens").alias("n")).first()
    mass = np.array([float(sums[f"p{d}"] or 0.0) for d in range(size)])
    own = np.array([int(sums[f"h{d}"] or 0) for d in range(size)])
    total = float(sums["n"] or 0.0)
    goal = np.array([t.share for t in targets]) * total
    steps: list[tuple[bool, np.ndarray]] = []

    def reached(by_posterior: bool) -> np.ndarray:
        known = list(steps)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(size + 1)
            for pdf in batches:
                if len(pdf):
                    p, home = np.stack(pdf["p"].to_numpy()), pdf["home"].to_numpy()
                    used = _rates(p, home, pdf["cap"].to_numpy(), known) * pdf["tokens"].to_numpy().astype(float)
                    if by_posterior:
                        out[:size] += used @ p
                    else:
                        out += np.bincount(np.where(home < 0, size, home), used, minlength=size + 1)
            yield pd.DataFrame({"d": np.arange(size), "x": out[:size]})

        got = np.zeros(size)
        for r in groups.mapInPandas(add, "d long, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():  # a row per domain
            got[r["d"]] = r["x"]
        return got

    def descend(by_posterior: bool, weight: np.ndarray) -> np.ndarray:
        last = None
        for _ in range(most if total else 0):
            now = reached(by_posterior)
            if last is not None and np.abs(now - last).max() <= TOLERANCE * total:
                break
            last = now
            steps.append((by_posterior, (now - goal) / np.maximum(weight, 1e-9) * (weight > 0)))
        return last if last is not None else np.zeros(size)

    soft_rate = descend(True, mass) / np.maximum(mass, 1e-9)
    if not soft:
        descend(False, own.astype(float))
    return Fit(steps, mass, total, own, soft_rate)


def mixture(docs: DataFrame, targets: list[Target], soft: bool = False, **names: str) -> tuple[DataFrame, Fit]:
    """Documents with rate and copies (doc_id, key, tokens, home, p, cap, rate, copies) and the fit."""
    members = cut_lineage(memberships(docs, targets, soft, **names))
    fit = fit_rates(members, targets, soft)
    steps = fit.steps

    @F.pandas_udf("double")
    def rate(p: pd.Series, home: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.stack(p.to_numpy()), home.to_numpy(), cap.to_numpy(), steps) if len(p) else [], dtype=float)

    even = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    rated = members.withColumn("rate", F.round(rate("p", "home", "cap"), 9))
    copies = (F.floor("rate") + F.when(even < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("copies", copies), fit


def out_of_reach(targets: list[Target], fit: Fit) -> list[bool]:
    """Whether a target can't be reached: its soft rate comes near the cap, and its recorded tokens fall short of the share by exact sums."""
    near = [bool(fit.soft_rate[d] >= NEAR_CAP * t.repeats or fit.own[d] == 0) for d, t in enumerate(targets)]
    return [n and (t.repeats * int(fit.own[d]) < t.share * fit.total) for d, (t, n) in enumerate(zip(targets, near))]


def shares(docs: DataFrame, targets: list[Target], soft: bool = False, **names: str) -> DataFrame:
    """source, target_share, max_repeat, own_tokens, target_tokens, rate, mixed_tokens, share, reachable; a row per target."""
    spark = docs.sparkSession
    rows, fit = mixture(docs, targets, soft, **names)
    size = len(targets)
    part = lambda d: F.col("p")[d] if soft else F.when(F.col("home") == d, 1.0).otherwise(0.0)
    mixed = F.col("copies") * F.col("tokens")
    sums = rows.agg(*[F.sum(part(d) * mixed).alias(f"d{d}") for d in range(size)], *[F.sum(part(d) * F.col("tokens") * F.col("rate")).alias(f"r{d}") for d in range(size)], F.sum(mixed).alias("n")).first()
    made = float(sums["n"] or 0.0)
    base = fit.mass if soft else fit.own.astype(float)
    lost = out_of_reach(targets, fit)
    out = []
    for d, t in enumerate(targets):
        got, expected = float(sums[f"d{d}"] or 0.0), float(sums[f"r{d}"] or 0.0)
        if soft:
            lost[d] = expected < t.share * fit.total * (1 - 1e-3) and expected >= (t.repeats - 1e-3) * base[d]
        out.append((t.source, t.share, t.repeats, float(round(base[d], 6)), t.share * fit.total, float(expected / base[d]) if base[d] else 0.0, got, got / made if made else 0.0, bool(not lost[d])))
    return spark.createDataFrame(out, "source string, target_share double, max_repeat int, own_tokens double, target_tokens double, rate double, mixed_tokens double, share double, reachable boolean")


def held_out_accuracy(docs: DataFrame, targets: list[Target], text: str = "text", source: str = "source", doc_id: str = "doc_id") -> float:
    """Part of the labelled documents with a tenth of the hash of their id, left out of the fit, whose likeliest domain is the recorded one."""
    keys = [t.key for t in targets]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _source_key(source).alias("key"), F.col(text).alias("text")).where(F.col("key").isin(keys) & F.col(text).isNotNull())
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0
    weights, prior = fit_classifier(own.where(~held), keys, "text")

    @F.pandas_udf("int")
    def likeliest(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: int(_log_posterior(weights, prior, np.asarray(b, dtype=np.int64)).argmax())).astype("int32")

    names = F.array(*[F.lit(k) for k in keys])
    said = own.where(held).select(F.array_position(names, F.col("key")).alias("k"), likeliest(_buckets("text")).alias("said"))
    return float(said.agg(F.avg((F.col("k") - 1 == F.col("said")).cast("double"))).first()[0] or 0.0)
