"""Ordered scans over keyed rows that stay balanced when one key holds most rows.

A plain window over a key sorts all rows of that key in one task. Here every key
is cut into blocks of its order (an expression of the order column, for instance
a time bucket), windows run per (key, block), and only one summary row per block
is looked at per key. A hot key is thereby spread over as many tasks as it has
blocks. Blocks must follow the order: every row of a lower block precedes every
row of a higher one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage

BLOCK = "__block"
_FIRST = "__first"
#: Blocks that a fold takes in one go.
RUN = 12
#: Rounds in which all runs are folded at once.
ROUNDS = 2
#: Keys of several runs that are broadcast at most.
BROADCAST_KEYS = 10_000


def with_block(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn(BLOCK, block)


def blockwise_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: dict[str, str]) -> DataFrame:
    """Add, for every carry item source -> target, the source value of the preceding row.

    df needs the column __block. The first row of a key gets null. Rows of one
    block are ordered by `order`, which must be unique within a key for a defined
    result. Null blocks come first. Shuffles df once; the second exchange moves
    one row per block.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    packed = F.struct(*[F.col(s).alias(t) for s, t in carry.items()])
    rows = df.withColumn("__lag", F.lag(packed).over(own)).withColumn(_FIRST, F.row_number().over(own) == 1)
    last = df.groupBy(*keys, BLOCK).agg(F.max_by(packed, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(F.col(BLOCK).asc_nulls_first())
    edges = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("__kb"), F.lag("__last").over(across).alias("__edge"))
    edges = edges.where(F.col("__edge").isNotNull())
    on = F.col(_FIRST) & F.col(BLOCK).eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(edges, on, "left")
    value = F.when(F.col(_FIRST), F.col("__edge")).otherwise(F.col("__lag"))
    return joined.select(*[F.col(c) for c in df.columns], *[value[t].alias(t) for t in carry.values()])


def blockwise_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, target: str) -> DataFrame:
    """Carry the last non-null value of `column` forward, the row's own value included."""
    keys = list(keys)
    own = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__own", F.last(column, ignorenulls=True).over(own))
    last = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, BLOCK)
        .agg(F.max_by(column, F.struct(*order)).alias("__last"))
    )
    every = df.groupBy(*keys, BLOCK).agg(F.lit(1).alias("__n"))
    same = (every[BLOCK].eqNullSafe(last[BLOCK]))
    for k in keys:
        same = same & every[k].eqNullSafe(last[k])
    summary = every.join(last, same, "left").select(*[every[k] for k in keys], every[BLOCK], F.col("__last"))
    across = Window.partitionBy(*keys).orderBy(F.col(BLOCK).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    edges = summary.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("__kb"), F.last("__last", ignorenulls=True).over(across).alias("__edge"))
    edges = edges.where(F.col("__edge").isNotNull())
    on = F.col(BLOCK).eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(edges, on, "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("__own", "__edge").alias(target))


class Fold:
    """A sequential pass over the rows of a key: `step` takes the state (JSON values, None at first) and a row and gives the state after it and finished rows; `flush` gives the rows that are left at a key's end."""

    def step(self, state: Any, row: tuple) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def flush(self, state: Any) -> list[tuple]:
        return []


def blockwise_fold(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], fold: Fold, schema: str, target: str = "number") -> DataFrame:
    """The fold over each key's rows in order, spread over runs of RUN blocks of __block (whole numbers, not null): key, the number of the row from 1 within its key, and the columns of `schema`. Rows without a key are left out.

    All runs are folded at once, each from the state that the run before it is
    taken to leave behind: at first none, then what it left in the round before.
    Runs whose state at the beginning was another are folded again. Where states
    meet soon after a run's beginning, as windows mostly do, that is enough.
    Where they don't (segments at even distances), each round would set right
    one run more; so after ROUNDS rounds a key's runs from the first wrong one
    on are folded one after the other, in a stream, and there are ROUNDS + 1
    rounds at most, however many runs a key has. The result is that of the
    sequential pass in any case. A task holds one state and the rows it
    finishes. Only one row a run, with its state, is sorted by key; finished
    rows are written once in each round.
    """
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.floor(F.col(BLOCK) / RUN).alias("__run"), *dict.fromkeys([*order, *columns]))
    fields = ["__key", "__run", "__place", "__open", "__from", "__left", *names]

    def ended(at: tuple, start: str, state: Any, place: int) -> list[tuple]:
        # a key's last run alone keeps the rows flushed; its place tells how many others there are
        flushed = [(*at, place + i, True, None, None, *x) for i, x in enumerate(fold.flush(state))]
        return [*flushed, (*at, place, None, start, json.dumps(state), *(None,) * len(names))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, begun, state, place = None, "null", None, 0
        for pdf in batches:
            out: list[tuple] = []
            for k, b, start, *row in pdf[["__key", "__run", "__from", *columns]].itertuples(index=False, name=None):
                if (k, b) != at:
                    if at is not None:
                        out += ended(at, begun, state, place)
                    if start is None:  # goes on from the run before
                        start = json.dumps(state)
                    at, begun, state, place = (k, b), start, json.loads(start), 0
                state, done = fold.step(state, tuple(row))
                for x in done:
                    out.append((*at, place, False, None, None, *x))
                    place += 1
            yield pd.DataFrame(out, columns=fields)
        if at is not None:
            yield pd.DataFrame(ended(at, begun, state, place), columns=fields)

    def folded(some: DataFrame, number: int, *whole: str) -> DataFrame:
        # by a hash of its own: a shuffle by a join's columns would be taken out, and adaptive execution may then leave a run in pieces
        ordered = some.repartition(F.xxhash64(*whole)).sortWithinPartitions("__key", "__run", *order)
        return cut_lineage(ordered.mapInPandas(run, f"__key {kind}, __run bigint, __place int, __open boolean, __from string, __left string, {schema}").withColumn("__round", F.lit(number)))

    of_key = Window.partitionBy("__key").orderBy("__run")
    known = ["__key", "__run", "__round", "__place", "__from", "__left"]
    done: DataFrame | None = None
    states: DataFrame | None = None
    several: DataFrame | None = None
    new, number = folded(rows.withColumn("__from", F.lit("null")), 0, "__key", "__run"), 0
    while True:
        own = new.where("__open is null").select(*known)
        if states is not None:  # the newest of each run
            both = states.select(*known).unionByName(own).groupBy("__key", "__run").agg(F.max(F.struct(*known[2:])).alias("s"))
            own = both.select("__key", "__run", *[F.col(f"s.{c}").alias(c) for c in known[2:]])
        before = F.coalesce(F.lag("__left").over(of_key), F.lit("null"))
        earlier = F.coalesce(F.sum("__place").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        states = cut_lineage(own.select(*known, F.when(before != F.col("__from"), before).alias("__again"), F.lead("__run").over(of_key).isNull().alias("__last"), earlier.alias("__before")))
        found = new.where("__open is not null").drop("__from", "__left")
        done = found if done is None else done.unionByName(found)
        again = states.where("__again is not null").select(F.col("__key").alias("__k"), F.col("__run").alias("__r"), F.col("__again").alias("__from"))
        if not again.limit(1).count():
            break
        number += 1
        if several is None:
            keys = states.where("not __last").select(F.col("__key").alias("__k")).distinct()
            if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
                keys = F.broadcast(keys)  # then other keys are left out before any shuffle of the rows
            several = cut_lineage(rows.join(keys, F.col("__key") == F.col("__k"), "left_semi"))
        same = F.col("__key") == F.col("__k")
        if number < ROUNDS:
            new = folded(several.join(again, same & (F.col("__run") == F.col("__r"))).drop("__k", "__r"), number, "__key", "__run")
        else:
            first = again.groupBy("__k").agg(F.min("__r").alias("__r"), F.min_by("__from", "__r").alias("__from"))
            rest = several.join(first, same & (F.col("__run") >= F.col("__r")))
            new = folded(rest.withColumn("__from", F.when(F.col("__run") == F.col("__r"), F.col("__from"))).drop("__k", "__r"), number, "__key")
    rest = _newest(done, states).where("not __open or __last")
    return rest.select(F.col("__key").alias(key), (F.col("__before") + F.col("__place") + 1).alias(target), *names)


def _newest(done: DataFrame, states: DataFrame) -> DataFrame:
    """Finished rows of each run's newest round."""
    s = states.select(F.col("__key").alias("__k"), F.col("__run").alias("__r"), F.col("__round").alias("__n"), "__last", "__before")
    return done.join(s, (F.col("__key") == F.col("__k")) & (F.col("__run") == F.col("__r")) & (F.col("__round") == F.col("__n")))
