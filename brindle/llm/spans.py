"""Problem 9: long exact spans that stand in more than one record.

Method: recompression. Texts become sequences of symbols whose names depend on
their content alone, so equal substrings get equal symbols away from their
edges, and rounds replace runs of one symbol and pairs of a left and a right
symbol by new ones until what records share stands in few high-level symbols.

The lowest rounds need no exchange: names are hashes of what they stand for,
which all tasks agree on. Units of letters with what follows them are taken, then
short runs and short pairs are named; the symbol starts are positions on which
two records that share a passage agree. Of these the one with the least name in
every `spacing` characters begins a symbol of level 0, which names the `reach`
characters that follow. From there on rounds are Spark jobs over all records: the
names of level 0 are counted globally (map-side first), and a symbol whose name
no other record has can't be in a shared passage and is dropped. In each further
round the runs and pairs of overlapping or adjoining symbols are named, the names
are counted over all records, and those met in two records or more replace their
parts. Rounds end when little is left to replace. Two records are then compared
where they have a symbol in common that does not stand at the same place of one
common symbol of a higher level: shared high-level symbols stand for all below
them. The texts of such pairs are fetched and the match is verified and extended
to both sides, so what is reported is exact.

Why no passage is lost: a cut between symbols depends on at most `margin`
characters at either side (16 for a unit; in each local round one more run and
one more symbol of that round's limit). A shared passage of `min_chars` therefore
has `min_chars - margin` characters whose cuts agree in both records, a window
of `spacing` of them has a least name, and margin + spacing + reach = min_chars.
So both records have a symbol of level 0 in it; it is compared itself, or a
symbol above it at the same distance is. Of what such a passage needs besides a
symbol of level 0 at least half lies before or after it: of these symbols only
those are compared whose surroundings on one side agree that far.

Records with equal texts are represented by the one with the lowest id and
brought back at the end.

Symbols that are periodic in themselves stand anywhere in a periodic stretch (a
rule of dashes, padding). In their place the first and the last `reach`
characters of the exact stretch are symbols; they take no part in the rounds.
Where a passage has part of a stretch of each record, either the ends or the
beginnings of both stretches meet in it, and that symbol is common, or it has
nothing but the stretch; stretches of min_chars and more therefore have a third
symbol, named by the least of their rotations, that is compared without what
stands around it.

Defined results: null texts and texts under min_chars share nothing; positions
and lengths count code points; a record shares nothing with itself; repeated
passages within a record are all compared; tables without texts give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage, written

UNIT = 16
ROUNDS = (8, 12)
MARGIN = UNIT + sum(2 * x for x in ROUNDS)
#: Ids are broadcast up to this number of rows of eight bytes; beyond it they are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Global rounds end when one has replaced no more than this part of the symbols, and at the latest after so many.
LAST_ROUND, MOST_ROUNDS = 0.08, 16
_BATCH_CHARS = 1 << 21

_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_ROOT = 0xC2B2AE3D27D4EB4F
_cache: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _cache or len(_cache[name]) < n:
        a = np.full(n, np.uint64(base), dtype=np.uint64)
        a[0] = 1
        _cache[name] = np.cumprod(a)
    return _cache[name][:n]


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.array([chr(i).isalnum() for i in range(65536)])
        _cache["codes"] = _mix(np.arange(65536, dtype=np.uint64) + np.uint64(0x51ED270B))
    return _cache["letters"]


def _nearest(pos: np.ndarray, rank: np.ndarray, text: np.ndarray, spacing: int, step: int, strict: bool) -> np.ndarray:
    """Distance to the nearest position on one side whose rank is smaller (or equal, if not strict); spacing where there is none so near."""
    n, out = len(pos), np.full(len(pos), spacing, dtype=np.int64)
    live = np.arange(n)
    k = 0
    while len(live):
        k += step
        other = live + k
        ok = (other >= 0) & (other < n)
        live, other = live[ok], other[ok]
        gap = np.abs(pos[other] - pos[live])
        ok = (gap < spacing) & (text[other] == text[live])
        live, other, gap = live[ok], other[ok], gap[ok]
        less = rank[other] < rank[live] if strict else rank[other] <= rank[live]
        out[live[less]] = gap[less]
        live = live[~less]
    return out


def symbols(texts: list[str], spacing: int, reach: int) -> tuple[np.ndarray, ...]:
    """Index of the text, position, name, whether it is of a periodic stretch, and names of what stands before and after, of each symbol of level 0."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()
    low = c < 65536
    small = np.where(low, c, 0)
    code = _cache["codes"][small]
    letter = letters[small]
    if not low.all():
        code = np.where(low, code, _mix(c.astype(np.uint64) + np.uint64(0x7F4A7C15)))
        letter = letter & low
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(code * _powers("up", _B, n), out=prefix[1:])
    down = _powers("down", _BINV, n + 1)

    def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((prefix[b] - prefix[a]) * down[a])

    begin = np.zeros(n, dtype=bool)
    begin[1:] = letter[1:] & ~letter[:-1]
    begin[first[:-1][sizes > 0]] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.concatenate([start, [n]]))
    if (size > UNIT).any():  # units that are too long are taken character by character
        begin |= np.repeat(size > UNIT, size)
        start = np.flatnonzero(begin)
        size = np.diff(np.concatenate([start, [n]]))
    name = named(start, start + size)
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    head = opens[start]
    for number, limit in enumerate(ROUNDS):
        # runs of one symbol
        same = np.zeros(len(start), dtype=bool)
        same[1:] = (name[1:] == name[:-1]) & ~head[1:]
        if same.any():
            run = np.flatnonzero(~same)
            count = np.diff(np.concatenate([run, [len(start)]]))
            short = (count > 1) & (count * size[run] <= limit)
            keep = ~(same & np.repeat(short, count))
            name[run[short]] = _mix(name[run[short]] + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            start, name, head = start[keep], name[keep], head[keep]
            size = np.diff(np.concatenate([start, [n]]))
        # pairs of a left and a right symbol
        right = (_mix(name + np.uint64(number + 1)) >> np.uint64(63)).astype(bool)
        fits = size <= limit
        pair = np.zeros(len(start), dtype=bool)
        pair[:-1] = ~right[:-1] & fits[:-1] & right[1:] & fits[1:] & ~head[1:]
        at = np.flatnonzero(pair)
        name[at] = _mix(name[at] * np.uint64(3) + _mix(name[at + 1]))
        keep = np.ones(len(start), dtype=bool)
        keep[at + 1] = False
        start, name, head = start[keep], name[keep], head[keep]
        size = np.diff(np.concatenate([start, [n]]))
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, first)))
    # the least name of every `spacing` characters; the first one of equals
    left = _nearest(start, name, text, spacing + 1, -1, False)
    after = _nearest(start, name, text, spacing + 1, 1, True)
    chosen = (left + after > spacing) & (start + reach <= first[text + 1])
    start, text = start[chosen], text[chosen]
    name = named(start, start + reach)
    if len(start):
        gap = np.diff(start)
        repeats = np.zeros(len(start), dtype=bool)
        repeats[1:] = (text[1:] == text[:-1]) & (name[1:] == name[:-1]) & (2 * gap <= reach)
        start, text, name = start[~repeats], text[~repeats], name[~repeats]
    # periodic symbols give way to the ends of their stretches
    period = np.zeros(len(start), dtype=np.int64)
    for q in range(reach // 2, 0, -1):
        period[(prefix[start + reach] - prefix[start + q]) * down[start + q] == (prefix[start + reach - q] - prefix[start]) * down[start]] = q
    ends, roots, held = [], [], (-1, 0, 0, 0)
    for k in np.flatnonzero(period):
        i, at, q = int(text[k]), int(start[k] - first[text[k]]), int(period[k])
        if held[:2] == (i, q) and held[2] <= at and at + reach <= held[3]:
            continue
        low, high = _stretch(texts[i], at, q)
        held = (i, q, low, high)
        ends += [(int(first[i]) + low, i), (int(first[i]) + high - reach, i)]
        if high - low >= spacing + reach + MARGIN:  # long enough to be shared by itself: named by its least rotation
            turn = int(first[i]) + low + np.arange(q)
            roots.append((int(turn[np.argmin(named(turn, turn + reach))]), i))
    free = np.zeros(len(start), dtype=bool)
    if ends:
        plain = period == 0
        start = np.concatenate([start[plain], np.array([x for x, _ in ends], dtype=np.int64)])
        text = np.concatenate([text[plain], np.array([i for _, i in ends], dtype=np.int64)])
        free = np.concatenate([free[plain], np.ones(len(ends), dtype=bool)])
        start, once = np.unique(start, return_index=True)
        text, free = text[once], free[once]
        name = named(start, start + reach)
    # what stands before and after it: of a long enough common passage at least half the rest lies on one side
    half = -(-(spacing + MARGIN) // 2)
    before = np.where(start - half >= first[text], named(np.maximum(start - half, 0), start), np.uint64(0))
    behind = start + reach + half
    after = np.where(behind <= first[text + 1], named(start + reach, np.minimum(behind, n)), np.uint64(0))
    if roots:
        at = np.array([x for x, _ in roots], dtype=np.int64)
        own = np.array([i for _, i in roots], dtype=np.int64)
        none = np.zeros(len(at), dtype=np.uint64)
        start, text, free, before = np.concatenate([start, at]), np.concatenate([text, own]), np.concatenate([free, none == 0]), np.concatenate([before, none])
        name = np.concatenate([name, _mix(named(at, at + reach) + np.uint64(_ROOT))])
        after = np.concatenate([after, np.full(len(at), np.uint64(_ROOT))])
    return text, start - first[text], name, free, before, after


def _short(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 0, (x >> np.uint64(32)) | np.uint64(1)).astype(np.uint32).view(np.int32)


def lengths(min_chars: int) -> tuple[int, int]:
    """Spacing and reach of the high-level symbols."""
    spacing = max(16, (min_chars - MARGIN) // 2)
    return spacing, min_chars - MARGIN - spacing


_SYMBOL = "name long, doc_id long, pos int, free boolean, before int, after int"


def _symbol_rows(min_chars: int):
    spacing, reach = lengths(min_chars)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            a = held = 0
            for b, t in enumerate(texts, 1):
                held += len(t)
                if held >= _BATCH_CHARS or b == len(texts):
                    which, pos, name, free, before, after = symbols(texts[a:b], spacing, reach)
                    yield pd.DataFrame({"name": name.view(np.int64), "doc_id": ids[a:b][which], "pos": pos.astype(np.int32), "free": free, "before": _short(before), "after": _short(after)})
                    a, held = b, 0

    return rows


def _agree(a: str, i: int, b: str, j: int) -> int:
    """Number of equal characters from a[i:] and b[j:]."""
    most, low = min(len(a) - i, len(b) - j), 0
    step = 256
    while low < most:
        step = min(step, most - low)
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            while step > 1 and a[i + low : i + low + step] != b[j + low : j + low + step]:
                step //= 2
            if a[i + low : i + low + step] != b[j + low : j + low + step]:
                break
    return low


def _agree_back(a: str, i: int, b: str, j: int) -> int:
    """Number of equal characters that end before a[i] and b[j]."""
    most, low = min(i, j), 0
    step = 64
    while low < most:
        step = min(step, most - low)
        if a[i - low - step : i - low] == b[j - low - step : j - low]:
            low += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return low


def _stretch(t: str, at: int, period: int) -> tuple[int, int]:
    """Begin and end of the stretch of this period around t[at]."""
    return at - _agree_back(t, at, t, at + period), at + period + _agree(t, at, t, at + period)


def alignments(a: str, i: int, b: str, j: int, reach: int) -> list[tuple[int, int]]:
    """Pairs of positions to extend from, given a common symbol at a[i] and b[j].

    Within a periodic stretch the symbol stands at every period. The overlap of
    two such stretches is longest where their beginnings or their ends meet as
    near as the period allows, so these shifts are all that matter.
    """
    w = a[i : i + reach]
    period = next((q for q in range(1, len(w) // 2 + 1) if w[q:] == w[:-q]), 0)
    if not period:
        return [(i, j)]

    (sa, ea), (sb, eb) = _stretch(a, i, period), _stretch(b, j, period)
    out = set()
    for want in (sa - sb, ea - eb):
        k = (want - (i - j)) // period
        for shift in (i - j + k * period, i - j + (k + 1) * period):
            low, high = max(sa, sb + shift), min(ea, eb + shift)
            if high > low:
                out.add((low, low - shift))
    return sorted(out) or [(i, j)]


def _known(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join on doc_id with a checked table of ids, broadcast where it is small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id and rep (lowest id) of all records whose text another record has as well; checkpointed."""
    digest = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("n"))
    groups = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return cut_lineage(digest.join(groups, "digest").select("doc_id", "rep", "n"))


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """Names that stand in two records or more; checkpointed. Counted map-side first, so that a frequent name is one row a task."""
    ends = rows.groupBy(name).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return cut_lineage(ends.where("low < high").select(name))


def _common(rows: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """Rows whose name is among the names, broadcast where they are few."""
    return rows.join(F.broadcast(names) if names.count() <= BROADCAST_IDS else names, name, "left_semi")


def name_round(level: DataFrame, number: int) -> tuple[DataFrame, DataFrame, int]:
    """One global round over symbols (doc_id, pos, end, name, before, after): the level after it, the symbols that were replaced, with the place in what replaces them (parent, offset), and their number.

    Runs of one symbol at one distance are taken first, then pairs of a left and
    a right symbol; sides are a bit of the name that changes from round to round.
    """
    per = Window.partitionBy("doc_id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(per)
    rows = level.withColumn("gap", gap).withColumn("joined", F.coalesce(F.lag("end").over(per) >= F.col("pos"), F.lit(False)))
    rows = rows.withColumn("same", F.col("joined") & (F.lag("name").over(per) == F.col("name")))
    begins = ~F.col("same") | (F.lag("same").over(per) & (F.lag("gap").over(per) != F.col("gap")))
    rows = rows.withColumn("run", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(per))
    of_run = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(of_run)).withColumn("at", F.min("pos").over(of_run)).withColumn("stride", F.max(F.when(F.col("pos") > F.col("at"), F.col("gap"))).over(of_run))
    left = (F.xxhash64("name", F.lit(number)) % 2) == 0
    alone = F.col("n") == 1
    opens = alone & left & F.lead(alone & F.col("joined") & ~left).over(per)
    closes = alone & ~left & F.col("joined") & F.lag(alone & left).over(per)
    new = (
        F.when(~alone, F.xxhash64("name", "stride", "n"))
        .when(opens, F.xxhash64("name", F.lead("gap").over(per), F.lead("name").over(per), F.lit(0)))
        .when(closes, F.xxhash64(F.lag("name").over(per), "gap", "name", F.lit(0)))
    )
    rows = rows.withColumn("new", new).withColumn("at", F.when(closes, F.lag("pos").over(per)).otherwise(F.col("at")))
    rows = cut_lineage(rows.select(*level.columns, "new", "at"))
    named = rows.where("new is not null")
    names = _repeated(named, "new")
    replaced = _common(named, "new", names)
    kept = rows.where("new is null").unionByName(named.join(names, "new", "left_anti")).select(*level.columns)
    higher = replaced.groupBy("doc_id", "at").agg(F.max("end").alias("end"), F.first("new").alias("name"))
    none = F.lit(None).cast("int")
    level = cut_lineage(kept.unionByName(higher.select("doc_id", F.col("at").alias("pos"), "end", "name", none.alias("before"), none.alias("after"))))
    parts = cut_lineage(replaced.withColumn("parent", F.col("new")).withColumn("offset", F.col("pos") - F.col("at")).drop("new", "at"))
    return level, parts, parts.count()


def shared_symbols(single: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, pos, name, before, after, parent, offset of the symbols of all levels that two records have."""
    reach = lengths(min_chars)[1]
    rows = written(single.mapInPandas(_symbol_rows(min_chars), _SYMBOL))
    rows = cut_lineage(_common(rows, "name", _repeated(rows.select("name", "doc_id"), "name")))
    level = rows.where("not free").select("doc_id", "pos", (F.col("pos") + reach).alias("end"), "name", "before", "after")
    out = rows.where("free").select("doc_id", "pos", "name", "before", "after", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("offset"))
    for number in range(MOST_ROUNDS):
        size = level.count()
        level, parts, n = name_round(level, number)
        out = out.unionByName(parts.select(*out.columns))
        if n <= LAST_ROUND * size:
            break
    return out.unionByName(level.select("doc_id", "pos", "name", "before", "after", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("offset")))


def shared_spans(documents: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Maximal common spans of different texts (doc_id_a, doc_id_b, start_a, start_b, n_chars) and the copies (doc_id, rep, n)."""
    if min_chars < MARGIN + 40:
        raise ValueError(f"spans under {MARGIN + 40} characters can't be told apart by these symbols")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= min_chars)
    copies = copies_of(docs)
    single = _known(docs, copies.where("doc_id <> rep").select("doc_id"), "left_anti")
    found = shared_symbols(single, min_chars)
    # a symbol of level 0 is compared with those whose surroundings agree on one side, one above it with all of its name
    sides = F.array(F.when(F.col("before") != 0, F.xxhash64("name", "before", F.lit(1))), F.when(F.col("after") != 0, F.xxhash64("name", "after", F.lit(2))), F.when(F.col("before").isNull(), F.xxhash64("name", F.lit(3))))
    keyed = found.select("doc_id", "pos", "parent", "offset", F.explode(F.array_compact(sides)).alias("key"))
    keyed = cut_lineage(_common(keyed, "key", _repeated(keyed, "key")))
    a, b = keyed.alias("a"), keyed.alias("b")
    covered = F.coalesce((F.col("a.parent") == F.col("b.parent")) & (F.col("a.offset") == F.col("b.offset")), F.lit(False))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")) & ~covered)
    # the texts of two records are brought together once, with all places at which they may agree
    places = F.collect_set(F.struct(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b")))
    pairs = cut_lineage(pairs.groupBy(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")).agg(places.alias("places")))
    paired = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).distinct()
    texts = _known(single, cut_lineage(paired), "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("doc_id_a"), F.col("text").alias("text_a")), "doc_id_a").join(texts.select(F.col("doc_id").alias("doc_id_b"), F.col("text").alias("text_b")), "doc_id_b")

    reach = lengths(min_chars)[1]

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, e, places, x, y in zip(pdf["doc_id_a"], pdf["doc_id_b"], pdf["places"], pdf["text_a"], pdf["text_b"]):
                spans: set[tuple[int, int, int]] = set()
                for pa, pb in sorted((p["pos_a"], p["pos_b"]) for p in places):
                    if any(i <= pa < i + n and pa - i == pb - j for i, j, n in spans):
                        continue
                    for i, j in alignments(x, pa, y, pb, reach):
                        back, on = _agree_back(x, i, y, j), _agree(x, i, y, j)
                        if back + on >= min_chars:
                            spans.add((i - back, j - back, back + on))
                out += [(d, e, *span) for span in spans]
            yield pd.DataFrame(out, columns=["doc_id_a", "doc_id_b", "start_a", "start_b", "n_chars"])

    spans = both.select("doc_id_a", "doc_id_b", "places", "text_a", "text_b").mapInPandas(extend, "doc_id_a long, doc_id_b long, start_a int, start_b int, n_chars int")
    return spans, copies


def sharing_pairs(documents: DataFrame, min_chars: int, **names: str) -> DataFrame:
    """doc_id_a < doc_id_b of all records that share a span, copies of records included."""
    spans, copies = shared_spans(documents, min_chars, **names)
    links = spans.select("doc_id_a", "doc_id_b").distinct()
    for side in ("doc_id_a", "doc_id_b"):
        member = copies.select(F.col("rep").alias(side), F.col("doc_id").alias("__member"))
        links = links.join(member, side, "left").withColumn(side, F.coalesce("__member", side)).drop("__member")
    a, b = copies.alias("a"), copies.alias("b")
    equal = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
    links = links.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"))
    return links.unionByName(equal).distinct()


def shared_parts(documents: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part of every record: how much of it stands in spans that another record has."""
    spans, copies = shared_spans(documents, min_chars, doc_id, text)
    spans = cut_lineage(spans)
    every = spans.select(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("a"), (F.col("start_a") + F.col("n_chars")).alias("z")).unionByName(spans.select(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("a"), (F.col("start_b") + F.col("n_chars")).alias("z"))).distinct()
    before = Window.partitionBy("doc_id").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    new = every.withColumn("reached", F.coalesce(F.max("z").over(before), F.lit(0)))
    covered = new.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("z") - F.greatest("a", "reached"))).alias("covered"))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    copied = copies.select("doc_id", F.lit(True).alias("copied"))
    out = docs.join(covered, "doc_id", "left").join(copied, "doc_id", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_part"))
