"""Problem 7: filling containers of a fixed number of tokens.

Method: mixture-controlled packing. Documents are spread evenly; in each part
one queue per source is served by deficit round-robin: for every window of
containers each source is credited its target share of the window's tokens, and
what it could not use or overdrew is carried to the next window. The deficits
with which a part starts come from the parts before it: running sums over a
table of parts x sources, worked out in blocks of parts and joined to the items
where they are packed, so the proportions hold across parts as well and nothing
that grows with the documents comes to the driver.
What a window has chosen is laid into containers by best fit, the largest piece
first. Of containers that are not nearly full the emptiest, up to the tokens of
AGAIN_WINDOWS windows, are laid again in the next window; the others stay open
for what fits. The items of the emptiest containers of each part, up to as many
tokens, go through the same packing once more, gathered from groups of parts,
until few are left; they start with the deficits of all that has been laid into
containers by then. So no window and no rest has more than a bounded number of
tokens, whatever sizes the items have.

All documents are packed whatever the targets say: when a source is used up its
share passes to the others. A document is divided only if it alone exceeds a
container: into full pieces and a rest. Full pieces stand in their source's queue
like all others and are charged to it; each fills a container by itself.

Defined results: null and blank texts have no tokens and no container; a null
source is a queue of its own; equal texts are separate items; an empty table
gives no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage, fanout

#: A token: a run of letters, digits and underscores, or a run of other characters that are not white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
WINDOW_CONTAINERS = 64
PART_TOKENS = 2_000_000
NEARLY_FULL = 0.995
#: Tokens that are laid again in the next window, or left over by a part, at most, in windows.
AGAIN_WINDOWS = 4
GROUP_PARTS = 16
#: Parts whose running sums are worked out in one window; one row a block is then summed over all blocks.
BLOCK_PARTS = 4096


def n_tokens(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN)), F.lit(0)).cast("long")


class BestFit:
    """Open containers ordered by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.items, self.count = capacity, [], {}, 0

    def put(self, size: int, item: tuple) -> None:
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, number = self.room.pop(i)
        else:
            left, number = self.capacity, self.count
            self.count += 1
            self.items[number] = []
        self.items[number].append(item)
        if left > size:
            insort(self.room, (left - size, number))

    def release(self, fill: float, tokens: int) -> list[tuple]:
        """Take out the items of containers that are filled less, the emptiest first, up to so many tokens; other such containers stay open, the rest is closed."""
        most, keep, out = self.capacity * (1 - fill), [], []
        for left, number in reversed(self.room):
            if left <= most:
                break
            if self.capacity - left <= tokens:
                tokens -= self.capacity - left
                out += self.items.pop(number)
            else:
                keep.append((left, number))
        self.room = keep[::-1]
        return out


def _pack(items: list[tuple], shares: dict, deficits: dict, capacity: int, keep_rest: bool):
    """items: (source, size, doc, piece, begin, pieces). Yields (number, item); number -1 for items left over."""
    queues: dict = defaultdict(deque)
    for item in sorted(items, key=lambda x: (-x[1], x[2], x[3])):
        queues[item[0]].append(item)
    live = {s: shares.get(s, 0.0) for s in queues}
    credit = {s: float(deficits.get(s, 0.0)) for s in queues}
    box = BestFit(capacity)
    again: list[tuple] = []
    window = WINDOW_CONTAINERS * capacity
    while any(queues.values()):
        room = max(window // 2, window - sum(x[1] for x in again))  # every window takes something new
        chosen, again = again, []
        active = [s for s in live if queues[s]]
        weight = sum(live[s] for s in active)
        for s in active:
            credit[s] += room * (live[s] / weight if weight > 0 else 1 / len(active))
        used = 0
        while used < room and active:
            # the source with the most credit is served; from both ends of its queue, so that small items stay for the gaps
            s = max(active, key=lambda x: (credit[x], str(x)))
            item = queues[s].popleft() if len(queues[s]) % 2 else queues[s].pop()
            chosen.append(item)
            credit[s] -= item[1]
            used += item[1]
            if not queues[s]:
                active.remove(s)
        for item in sorted(chosen, key=lambda x: (-x[1], x[2], x[3])):
            box.put(item[1], item)
        if any(queues.values()):
            again = box.release(NEARLY_FULL, AGAIN_WINDOWS * window)  # or items that fill no container together would be laid again in every window
    rest = box.release(NEARLY_FULL, AGAIN_WINDOWS * window) if keep_rest else []
    for number, held in box.items.items():
        for item in held:
            yield number, item
    for item in rest:
        yield -1, item


_SCHEMA = "part long, number long, source string, size long, doc_id long, piece_no int, token_from long, n_pieces int"
_ITEM = ["source", "size", "doc_id", "piece_no", "token_from", "n_pieces"]


def _packed(items: DataFrame, credits: DataFrame, shares: dict, capacity: int, keep_rest: bool) -> DataFrame:
    """The items of each part laid into containers, from the credits with which the part starts."""

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(pdf[c].tolist() for c in _ITEM)))
        start = dict(zip(own["source"], own["credit"]))
        out = [(n, *item) for n, item in _pack(rows, shares, start, capacity, keep_rest)]
        part = int(pdf["part"].iloc[0]) if len(pdf) else 0
        return pd.DataFrame(out, columns=["number", *_ITEM]).assign(part=part)[["part", "number", *_ITEM]]

    credits = credits.toDF("for_part", "source", "credit")  # names of their own: both sides come from the same rows
    items = items.repartition(fanout(items.sparkSession), "part")
    return items.groupBy("part").cogroup(credits.groupBy("for_part")).applyInPandas(run, _SCHEMA)


def pack(docs: DataFrame, shares: dict[str, float], capacity: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per item: container_id, doc_id, piece_no, n_pieces, token_from, n_tokens.

    shares: target token share by source, compared without outer blanks and
    case; sources without one are served after the others.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.trim(F.coalesce(F.col(source), F.lit("")))).alias("source"), n_tokens(text).alias("total"))
    own = cut_lineage(own.where("total > 0"))  # texts are tokenised once; what is kept is three short columns
    tokens = own.agg(F.sum("total")).first()[0] or 0
    parts = max(1, -(-int(tokens) // part_tokens))
    items = own.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int")).withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    items = items.withColumn("token_from", ((F.col("piece_no") - 1) * capacity).cast("long")).withColumn("size", F.least(F.lit(capacity), F.col("total") - F.col("token_from")).cast("long"))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long")).select("part", *_ITEM)
    packed = cut_lineage(_packed(items, carried(items, shares), shares, capacity, parts > 1))
    out = packed.where("number >= 0").withColumn("round", F.lit(0))
    rest, round_no = packed.where("number < 0"), 0
    while parts > 1:
        # what the parts left over is packed again from groups of parts, of which there are ever fewer
        round_no, parts = round_no + 1, -(-parts // GROUP_PARTS)
        again = rest.drop("number").withColumn("part", F.pmod(F.col("part"), F.lit(parts)).cast("long"))
        # what all containers so far owe the sources comes before the first group
        placed = out.select(F.lit(-1).cast("long").alias("part"), "source", "size")
        start = carried(again.select("part", "source", "size").unionByName(placed), shares).where("part >= 0")
        packed = cut_lineage(_packed(again, start, shares, capacity, parts > 1))
        out = out.unionByName(packed.where("number >= 0").withColumn("round", F.lit(round_no)))
        rest = packed.where("number < 0")
    return out.select(F.concat_ws("-", "round", "part", "number").alias("container_id"), "doc_id", "piece_no", "n_pieces", "token_from", F.col("size").alias("n_tokens"))


def divided(containers: DataFrame) -> DataFrame:
    """doc_id of the documents that the packing laid into more than one container."""
    return containers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def carried(items: DataFrame, shares: dict[str, float], block_parts: int = BLOCK_PARTS) -> DataFrame:
    """part, source, credit: what the parts before owe a source. One row per part and source, of which no task sorts more than those of a block."""
    sums = items.groupBy("part", "source").agg(F.sum("size").alias("n"))
    per_part = Window.partitionBy("part")
    target = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("source")] if shares else F.lit(None)
    owed = sums.withColumn("share", F.coalesce(target, F.lit(0.0)))
    owed = owed.withColumn("gap", F.sum("n").over(per_part) * F.col("share") / F.greatest(F.sum("share").over(per_part), F.lit(1e-9)) - F.col("n"))
    owed = cut_lineage(owed.select("part", "source", "gap", F.floor(F.col("part") / block_parts).alias("block")))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = owed.groupBy("source", "block").agg(F.sum("gap").alias("all")).select("source", "block", F.coalesce(F.sum("all").over(before("source", "block")), F.lit(0.0)).alias("earlier"))
    within = owed.withColumn("within", F.coalesce(F.sum("gap").over(before("source", "block", "part")), F.lit(0.0)))
    return within.join(blocks, ["source", "block"]).select("part", "source", (F.col("earlier") + F.col("within")).alias("credit"))
