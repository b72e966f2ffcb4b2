"""Problem 2: ordered conversations from message rows.

Method: the messages of a conversation form a reply graph. A row's parent is the
message it replies to where the table says so, else the message before it in
time. Each graph is sorted topologically with Kahn's algorithm, ties broken by
time and id; what is left over when no message is ready lies on or behind a
cycle. On the order follow the checks of roles and completeness.

A conversation is cut into blocks of time, so that one of any length is spread
over many tasks. With explicit replies a first pass peels the graph in rounds of
doubled steps, each a join on (conversation, id): it tells which messages reach a
beginning, those on or behind a cycle or a parent that is nowhere, and the latest
time among each message and those it replies to. Blocks follow that time, so a
parent is never in a later block than its replies, and Kahn's algorithm on the
graph of each block gives the same order as on the whole. Where the table has no
replies the graph is a path and the order that of time and id. Only one row per
block is looked at when the blocks are put together.

Defined results: rows with equal conversation, role, content and time (nulls
equal) count once, under their lowest id; a null time sorts first; rows with a
null conversation id belong to one conversation, which is in no table and so
broken; a null or unknown role is unusable; system rows are ignored; null, blank
and invisible content is no text; a conversation without messages is empty. An
empty table of messages leaves all conversations empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import BLOCK, blockwise_previous
from brindle.session import cut_lineage

BLOCK_SECONDS = 6 * 3600
#: Ids of a block of messages without a time.
BLOCK_IDS = 4096

# Spellings of the three usable roles, compared without case and outer characters that are no letters.
USER_ROLES = ["user", "users", "human", "customer", "client", "person", "caller", "requester", "enduser", "end user", "usr", "question", "prompter", "me", "benutzer", "nutzer", "kunde", "utilisateur", "usuario"]
ASSISTANT_ROLES = ["assistant", "assistent", "asistente", "ai", "a.i", "bot", "chatbot", "model", "agent", "gpt", "llm", "machine", "ai assistant", "support bot", "answer", "assistant bot"]
SYSTEM_ROLES = ["system", "sys", "developer", "system message"]

# What is written instead of an answer, lower case, letters and digits only, words set apart by one blank.
STAND_INS = ["n a", "na", "null", "none", "nil", "nan", "empty", "blank", "undefined", "no response", "no answer", "no reply", "no text", "no content", "no output", "empty response", "empty answer", "empty message", "blank message", "not available", "nothing", "void", "missing", "leer", "keine antwort", "vide", "aucune réponse", "sans réponse", "vacío", "sin respuesta"]


def role_class(role: Column) -> Column:
    """user, assistant, system or other."""
    r = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), r"(?U)^[^\p{L}]+|[^\p{L}]+$", ""), r"[_\s-]+", " ")
    return F.when(r.isin(USER_ROLES), "user").when(r.isin(ASSISTANT_ROLES), "assistant").when(r.isin(SYSTEM_ROLES), "system").otherwise("other")


def has_text(content: Column) -> Column:
    """Whether anything visible stands in it."""
    seen = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)[\s\p{Cf}\p{Cc}\p{Z}]+", "")
    return seen != ""


def is_empty_answer(content: Column) -> Column:
    """No text, or only a stand-in for none: marks, tags, a word for nothing."""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"<[^<>]*>|&[a-zA-Z]+;|&#\d+;", " ")
    words = F.trim(F.regexp_replace(F.lower(bare), r"(?U)[^\p{L}\p{N}]+", " "))
    return (words == "") | words.isin(STAND_INS)


def deduplicated(messages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Delivered rows once, lowest id first; `extra` columns are taken from that row."""
    key = F.sha2("content", 256)
    extra = extra or []
    kept = F.min(F.struct("id", *extra)).alias("kept")
    rows = messages.groupBy("conversation_id", "role", "created_at", key.alias("content_key")).agg(kept)
    return rows.select("conversation_id", "role", "created_at", *[F.col(f"kept.{c}").alias(c) for c in ["id", *extra]])


def block_of(time: Column, seconds: int = BLOCK_SECONDS) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000))


def kahn(nodes: list[tuple], parent_of: dict) -> tuple[list, list]:
    """Order of the nodes and what is left over. nodes: (time, id) in any order; parent_of: id -> id of a node or None."""
    waiting: dict = {}
    ready = []
    for node in nodes:
        parent = parent_of.get(node[1])
        if parent is None:
            ready.append(node)
        else:
            waiting.setdefault(parent, []).append(node)
    heapq.heapify(ready)
    order = []
    while ready:
        node = heapq.heappop(ready)
        order.append(node)
        for child in waiting.pop(node[1], ()):
            heapq.heappush(ready, child)
    return order, sorted(x for rest in waiting.values() for x in rest)


def peeled(rows: DataFrame) -> DataFrame:
    """conversation_id, id, latest (time_us, id of the latest among a message and all it replies to), lost (on or behind a cycle or a parent that is nowhere).

    rows: conversation_id, id, time_us, parent. In round k every message looks
    2**k replies back, so the rounds are as many as the logarithm of the longest
    conversation; without a cycle they end at the deepest reply.
    """
    state = cut_lineage(rows.select("conversation_id", "id", F.col("parent").alias("back"), F.struct("time_us", "id").alias("latest"), F.lit(False).alias("lost")))
    longest = state.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if not state.where("back is not null").limit(1).count():
            break
        earlier = state.select(F.col("conversation_id").alias("__c"), F.col("id").alias("__id"), F.col("back").alias("__back"), F.col("latest").alias("__latest"), F.col("lost").alias("__lost"))
        both = state.join(earlier, F.col("conversation_id").eqNullSafe(F.col("__c")) & (F.col("back") == F.col("__id")), "left")
        nowhere = F.col("back").isNotNull() & F.col("__id").isNull()
        state = cut_lineage(both.select("conversation_id", "id", F.col("__back").alias("back"), F.greatest("latest", "__latest").alias("latest"), (F.col("lost") | nowhere | F.coalesce("__lost", F.lit(False))).alias("lost")))
    return state.select("conversation_id", "id", "latest", (F.col("lost") | F.col("back").isNotNull()).alias("lost"))


_ORDERED = "conversation_id string, __block long, place long, id long, role_class string, says boolean, empty_answer boolean, cyclic boolean"


def _sort_blocks(explicit: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key = None

        def ordered(rows: list[tuple]) -> list[tuple]:
            by_id = {r[3]: r for r in rows}
            if explicit:
                # a parent outside the block is in an earlier one
                parents = {r[3]: (r[7] if r[7] in by_id else None) for r in rows}
            else:
                parents, last = {}, None
                for r in rows:  # sorted by time and id
                    parents[r[3]], last = last, r[3]
            order, left = kahn([(r[2], r[3]) for r in rows], parents)
            out = [by_id[i] for _, i in order] + [by_id[i] for _, i in left]
            return [(r[0], r[1], n, r[3], r[4], r[5], r[6], n >= len(order)) for n, r in enumerate(out)]

        for pdf in batches:
            done: list[tuple] = []
            for row in zip(pdf.conversation_id, pdf.block, pdf.time_us, pdf.id, pdf.role_class, pdf.says, pdf.empty_answer, pdf.parent):
                if (row[0], row[1]) != key:
                    done += ordered(held) if held else []
                    held, key = [], (row[0], row[1])
                held.append(row)
            yield pd.DataFrame(done, columns=_NAMES)
        if held:
            yield pd.DataFrame(ordered(held), columns=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _ORDERED.split(", ")]


def ordered_messages(messages: DataFrame, reply_to: str | None = None, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """User, assistant and unusable rows once each with their place in the block: conversation_id, __block, place, id, role_class, says, empty_answer, cyclic.

    __block and place together give the order within a conversation.
    """
    rows = messages.select("conversation_id", "role", "content", "created_at", "id", *([F.col(reply_to).cast("long").alias("parent")] if reply_to else []), has_text(F.col("content")).alias("says"), is_empty_answer(F.col("content")).alias("empty_answer"))
    rows = deduplicated(rows, ["says", "empty_answer", *(["parent"] if reply_to else [])])
    rows = rows.withColumn("role_class", role_class(F.col("role"))).where("role_class != 'system'")
    rows = rows.withColumn("time_us", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))))
    if reply_to:
        rows = cut_lineage(rows)
        back = peeled(rows.select("conversation_id", "id", "time_us", "parent")).select(F.col("conversation_id").alias("__c"), F.col("id").alias("__id"), "latest", "lost")
        rows = rows.join(back, F.col("conversation_id").eqNullSafe(F.col("__c")) & (F.col("id") == F.col("__id")))
        rows = rows.withColumn("parent", F.when(F.col("lost"), F.col("id")).otherwise(F.col("parent")))  # waits for itself: left over
    else:
        rows = rows.withColumn("parent", F.lit(None).cast("long")).withColumn("latest", F.struct("time_us", "id"))
    # messages without a time come first, by their ids
    block = F.when(F.col("latest.time_us") > -(2**62), F.floor(F.col("latest.time_us") / (block_seconds * 1_000_000))).otherwise(F.lit(-(2**62)) + F.floor(F.col("latest.id") / BLOCK_IDS))
    rows = rows.select("conversation_id", block.alias("block"), "time_us", "id", "role_class", "says", "empty_answer", "parent")
    placed = rows.repartition("conversation_id", "block").sortWithinPartitions("conversation_id", "block", "time_us", "id")
    return placed.mapInPandas(_sort_blocks(reply_to is not None), _ORDERED)


def conversation_reasons(conversations: DataFrame, messages: DataFrame, reply_to: str | None = None, block_seconds: int = BLOCK_SECONDS, ordered: DataFrame | None = None) -> DataFrame:
    """Conversations to drop: conversation_id, reason (empty, broken or missing_reply, the first that holds). ordered: ordered_messages of these messages, where it is there already."""
    ordered = cut_lineage(ordered_messages(messages, reply_to, block_seconds)) if ordered is None else ordered
    rows = blockwise_previous(ordered, ["conversation_id"], ["place"], {"role_class": "before"})
    answer = F.col("role_class") == "assistant"
    after_user = F.coalesce(F.col("before") == "user", F.lit(False))
    summary = rows.groupBy("conversation_id").agg(
        F.max(F.col("says") & F.col("role_class").isin("user", "assistant")).alias("says"),
        F.max((F.col("role_class") == "other") | (answer & ~after_user) | F.col("cyclic")).alias("broken"),
        F.max(after_user & (~answer | F.col("empty_answer"))).alias("unanswered"),
        F.max_by("role_class", F.struct(BLOCK, "place")).alias("last_role"),
    )
    known = conversations.select("conversation_id").distinct().withColumn("known", F.lit(True))
    both = known.join(summary, known["conversation_id"].eqNullSafe(summary["conversation_id"]), "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~yes("says"), "empty")
        .when(~yes("known") | yes("broken"), "broken")
        .when(yes("unanswered") | (F.col("last_role") == "user"), "missing_reply")
    )
    return both.select(F.coalesce(known["conversation_id"], summary["conversation_id"]).alias("conversation_id"), reason.alias("reason")).where("reason is not null")


def rebuilt(conversations: DataFrame, messages: DataFrame, reply_to: str | None = None, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Turns of the conversations that are kept: conversation_id, turn_no, role, id, content."""
    order = cut_lineage(ordered_messages(messages, reply_to, block_seconds))
    dropped = conversation_reasons(conversations, messages, reply_to, block_seconds, order).select("conversation_id")
    order = order.join(dropped, "conversation_id", "left_anti").where("conversation_id is not null")
    sizes = order.groupBy("conversation_id", BLOCK).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conversation_id").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conversation_id", BLOCK, F.coalesce(before, F.lit(0)).alias("offset"))
    turns = order.join(offsets, ["conversation_id", BLOCK]).select("conversation_id", (F.col("offset") + F.col("place") + 1).alias("turn_no"), F.col("role_class").alias("role"), "id")
    return turns.join(messages.select("id", "content"), "id").select("conversation_id", "turn_no", "role", "id", "content")
