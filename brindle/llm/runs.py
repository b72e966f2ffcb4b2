"""Problem 5: runs of identical or nearly identical consecutive events.

Method: a sorted streaming state machine per entity. Rows are cut into blocks of
the sequence number, so that an entity of any size is spread over many tasks;
the machine runs over each sorted block, keeps the anchor of the open run and
emits finished runs. Only the runs that touch the edge of a block (two rows a
block at most) are then joined across blocks under the same test.

The anchor is the latest event of the run: each event is compared with the one
before it, as the statement of the problem wants, and so a run can be joined
across the edge of a block by its last and the next block's first event. With
single=True events that repeat nothing come out as runs of one, which makes the
whole collapsed sequence.

Defined results: null text is like nothing, also not like null; two blank texts
are alike; a null start breaks the run; rows repeated in full count once; of
rows with equal sequence numbers but other content the order is by start, then
text; an empty table gives no run. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage, fanout

BLOCK_ROWS = 512
SIMILARITY = 0.9


def squeeze(text: str | None) -> str | None:
    """Lower case without white space."""
    return None if text is None else "".join(text.lower().split())


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    start, end = 0, 0
    limit = min(len(a), len(b))
    while start < limit and a[start] == b[start]:
        start += 1
    while end < limit - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def alike(a: str | None, b: str | None, similarity: float = SIMILARITY) -> bool:
    """Whether the share `similarity` of both texts' characters can be matched in order (squeezed texts)."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    need = similarity * (len(a) + len(b)) - 1e-9
    if 2 * min(len(a), len(b)) < need:
        return False
    if 2 * sum((Counter(a) & Counter(b)).values()) < need:
        return False
    return 2 * common_length(a, b) >= need


def _machine(max_gap: float, similarity: float, single: bool):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = run = seen = None
        out: list[tuple] = []

        def finish(last_of_block: bool) -> None:
            # without `single`, events alone inside a block are done with: they can't grow any more
            if run is not None and (single or run[2] > 1 or run[5] or last_of_block):
                out.append((*key, *run[:5], run[5], last_of_block, run[6] if run[5] else None, run[7] if last_of_block else None))

        for pdf in batches:
            for entity, block, seq, start, text in zip(pdf.entity, pdf.block, pdf.seq, pdf.start, pdf.text):
                if (entity, block, seq, start, text) == seen:
                    continue  # the row was delivered again
                seen = (entity, block, seq, start, text)
                lean = squeeze(text if isinstance(text, str) else None)
                if (entity, block) != key:
                    finish(True)
                    key, run = (entity, block), [seq, seq, 1, start, start, True, lean, lean]
                    continue
                if start - run[4] <= max_gap and alike(run[7], lean, similarity):
                    run[1], run[2], run[4], run[7] = seq, run[2] + 1, start, lean
                else:
                    finish(False)
                    run = [seq, seq, 1, start, start, False, lean, lean]
            yield _frame(out)
            out.clear()
        finish(True)
        yield _frame(out)

    return step


_COLUMNS = ["entity", "block", "first_seq", "last_seq", "n", "first_start", "last_start", "at_start", "at_end", "first_text", "last_text"]
_SCHEMA = "entity string, block long, first_seq long, last_seq long, n long, first_start double, last_start double, at_start boolean, at_end boolean, first_text string, last_text string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def collapse_runs(events: DataFrame, entity: str, seq: str, start: str, text: str, max_gap: float, similarity: float = SIMILARITY, single: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per maximal run of at least two events, or of any number with `single`.

    Columns: entity, first_seq, last_seq, n_events, start, last_start, duration.
    """
    rows = events.select(F.col(entity).alias("entity"), F.col(seq).cast("long").alias("seq"), F.col(start).cast("double").alias("start"), F.col(text).alias("text"))
    rows = rows.where(F.col("seq").isNotNull()).withColumn("block", F.floor(F.col("seq") / block_rows))
    sorted_rows = rows.repartition(fanout(rows.sparkSession), "entity", "block").sortWithinPartitions("entity", "block", "seq", "start", "text")
    islands = cut_lineage(sorted_rows.mapInPandas(_machine(float(max_gap), similarity, single), _SCHEMA))
    edge = F.col("at_start") | F.col("at_end")

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x if isinstance(x, str) else None, y if isinstance(y, str) else None, similarity) for x, y in zip(a, b)], dtype=bool)

    across = Window.partitionBy("entity").orderBy("block", "first_seq")
    before = F.lag(F.struct("at_end", "last_start", "last_text", "block")).over(across)
    near: Column = F.coalesce(F.col("before.at_end") & F.col("at_start") & (F.col("before.block") != F.col("block")) & (F.col("first_start") - F.col("before.last_start") <= max_gap), F.lit(False))
    edges = islands.where(edge).withColumn("before", before).withColumn("near", near)
    edges = edges.withColumn("linked", F.when(F.col("near"), same(F.when(F.col("near"), F.col("before.last_text")), F.when(F.col("near"), F.col("first_text")))).otherwise(False))
    group = F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(across.rowsBetween(Window.unboundedPreceding, 0))
    edges = (
        edges.withColumn("group", group)
        .groupBy("entity", "group")
        .agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n").alias("n"), F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))
        .drop("group")
    )
    inner = islands.where(~edge).select(*edges.columns)
    runs = edges.unionByName(inner).where(F.lit(True) if single else F.col("n") > 1)
    return runs.select("entity", "first_seq", "last_seq", F.col("n").alias("n_events"), F.col("first_start").alias("start"), "last_start", (F.col("last_start") - F.col("first_start")).alias("duration"))
