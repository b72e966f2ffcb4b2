"""Queries of the nine problems; each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import table, widened

from . import conversations, mixing, packing, pairs, pieces, pii, runs, spans, turns
from .settings import setting


def _wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of which every row is CPU-heavy work, over all cores even where it is one small file."""
    return widened(table(spark, d, name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    finder = pii.Finder(table(spark, d, "staff"))
    messages = _wide(spark, d, "messages").select(F.lit("messages").alias("table_name"), F.col("id").cast("string").alias("record_id"), F.col("content").alias("text"))
    chunks = _wide(spark, d, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), pii.body("text").alias("text"))
    return finder.types(messages.unionByName(chunks), ["table_name", "record_id"], F.col("text")).distinct()


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    finder = pii.Finder(table(spark, d, "staff"))
    rows = _wide(spark, d, "messages").select("id", "conversation_id", "role", "created_at", finder.redacted(F.col("content")).alias("r"))
    return rows.select("id", "conversation_id", "role", "created_at", F.col("r.text").alias("content"), F.array_join("r.types", ", ").alias("pii_types"))


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with placeholders below their first line and pii_types_found made right, in the project's names."""
    finder = pii.Finder(table(spark, d, "staff"))
    rows = _wide(spark, d, "chunks").select("chunk_id", "doc_id", F.when(F.col("text").isNotNull(), pii.header("text")).alias("head"), finder.redacted(pii.body("text")).alias("r"))
    names = F.create_map(*[F.lit(x) for kv in pii.PROJECT_NAMES.items() for x in kv])
    types = F.array_join(F.array_sort(F.transform("r.types", lambda t: names[t])), ", ")
    return rows.select("chunk_id", "doc_id", F.concat("head", "r.text").alias("text"), types.alias("pii_types_found"), F.when(F.size("r.types") > 0, "True").otherwise("False").alias("pii_detected"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_reasons(table(spark, d, "conversations"), table(spark, d, "messages"))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuilt(table(spark, d, "conversations"), table(spark, d, "messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "messages"), table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_starts(_wide(spark, d, "segments"), table(spark, d, "staff"))


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(_wide(spark, d, "segments"), table(spark, d, "staff"))


def _runs(spark: SparkSession, d: str, single: bool) -> DataFrame:
    found = runs.collapse_runs(table(spark, d, "screen_entries"), "doc_id", "entry_no", "start_sec", "text", setting(spark, d, "run_max_gap_sec"), single=single)
    return found.withColumnRenamed("entity", "doc_id")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed sequence: an entry for each stretch, with how often it was delivered and for how long it stayed."""
    return _runs(spark, d, True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, False).select("doc_id", F.col("first_seq").cast("int").alias("first_entry"), F.col("last_seq").cast("int").alias("last_entry"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_wide(spark, d, "segments"), ["doc_id", "seg_no"], "text", setting(spark, d, "piece_max_chars"), setting(spark, d, "piece_overlap_chars"), "start_sec", "end_sec")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 1").select("doc_id", "seg_no")


def targets(spark: SparkSession, d: str) -> dict[str, float]:
    """Shares of mix_targets, a table of a few rows."""
    return {r["source"].strip().lower(): r["target_share"] for r in table(spark, d, "mix_targets").collect() if r["source"] is not None}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_wide(spark, d, "documents"), targets(spark, d), setting(spark, d, "container_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(p7_containers(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_wide(spark, d, "documents"), mixing.read_targets(table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("not reachable").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = mixing.mixture(_wide(spark, d, "documents"), mixing.read_targets(table(spark, d, "mix_targets")))
    return rows.where("copies > 0").select("doc_id", F.col("key").alias("source"), "tokens", "rate", "copies")


def p8_soft_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares with the documents of no target source taken in under their posteriors."""
    return mixing.shares(_wide(spark, d, "documents"), mixing.read_targets(table(spark, d, "mix_targets")), soft=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(_wide(spark, d, "documents"), setting(spark, d, "shared_span_min_chars"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(_wide(spark, d, "documents"), setting(spark, d, "shared_span_min_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
