"""Registered queries of the core engine. Each reads whole tables; searches take as queries the rows whose id is divisible by 50."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.config import COLLECTIONS, DEFAULT, SHEET_COLLECTIONS
from brindle.functions import guard, scrub, text
from brindle.functions.vectors import cosine_distance
from brindle.operators import bm25, chat, dense, fusion, pages, sheets, store, timeline
from brindle.plugins import LetterEmbedder, embedding, pair_score
from brindle.session import cut_lineage, ensure_checkpoint_dir, table, widened
from brindle.sources import sheet
from brindle.streaming import arrivals, sessions

from . import layout, oracle, stores

# Fixed values of the queries' own.
TERMS = ["batch certificate", "number range", "approval", "worklist"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return widened(table(spark, d, "documents")).where("text is not null")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every message whose id is divisible by 50: the stated query set of the searches."""
    m = table(spark, d, "messages")
    return m.where((F.col("id") % 50 == 0) & (F.trim("content") != "")).select(F.col("id").alias("query_id"), F.col("content").alias("query"))


# retrieval


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(bm25.build(_docs(spark, d), "doc_id", "text"), _asked(spark, d), "query_id", "query", DEFAULT.bm25_k).select("query_id", F.col("id").alias("doc_id"), "rank")


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_docs(spark, d), "doc_id", "text").terms.select("term", "df", F.round(F.col("idf"), 6).alias("idf"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), DEFAULT.dense_k).select("query_id", F.col("id").alias("vec_id"), "rank")


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the ranking, so each list is full."""
    e = table(spark, d, "embeddings")
    return dense.search(e.where("label = 3"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3).select("query_id", F.col("id").alias("vec_id"), "rank")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists for fusion: BM25 over documents and over chunks. A passage stands by the MD5 of its text, which tells equal texts and is all that is shown."""
    asked = _asked(spark, d)
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"), F.struct(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id")).alias("meta"))
    chunks = table(spark, d, "chunks").where("text is not null").distinct().select(F.col("chunk_id").alias("id"), "text", F.col("chunk_id").alias("ord"), F.struct(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")).alias("meta"))
    out = None
    for n, rows in enumerate((docs, chunks)):
        hits = bm25.search(bm25.build(rows, "id", "text", "ord"), asked, "query_id", "query", DEFAULT.bm25_k)
        one = hits.join(rows.select("id", F.md5("text").alias("text"), "meta"), "id").select("query_id", F.lit(n).alias("list_no"), "rank", "text", "meta", "score")
        out = one if out is None else out.unionByName(one)
    return cut_lineage(out)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d)).select("query_id", "rrf_rank", F.col("text").alias("text_md5"))


def rrf_best_of_list(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    both = fusion.with_list_heads(fusion.fuse(lists), lists)
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.when(F.col("place") > 100, 1).otherwise(0)).alias("n_heads"))


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25.search(bm25.build(_docs(spark, d), "doc_id", "text"), _asked(spark, d), "query_id", "query", DEFAULT.final_k)
    rows = hits.select("query_id", F.col("id").alias("doc_id"), "rank", F.col("score").alias("rerank_score"), F.lit(False).alias("pinned"))
    return fusion.with_confidence(rows).select("query_id", "doc_id", F.round("confidence", 3).alias("confidence"), "band")


def _collections(spark: SparkSession, d: str) -> DataFrame:
    """Passages of all collections with vector and meta, each once; worked out once."""
    rows = table(spark, d, "chunks").where("text is not null").distinct().withColumn("collection", F.col("source_type"))
    return cut_lineage(rows.select("chunk_id", "doc_id", "ord", "collection", "source_type", "source_file", "chunk_type", "row_key", "image_may_contain_pii", "text", embedding("text", LetterEmbedder).alias("embedding"), F.struct(*fusion.META).alias("meta")))


def _near(passages: DataFrame, asked: DataFrame, k: int, names: tuple[str, ...]) -> DataFrame:
    """query_id, list_no, rank, text, meta: a ranked list of vectors for each collection."""
    out = None
    for n, name in enumerate(COLLECTIONS):
        if name not in names:
            continue
        own = passages.where(F.col("collection") == name)
        hits = dense.search(own, asked, k, "chunk_id", query_vector="vector").join(own.select(F.col("chunk_id").alias("id"), "text", "meta"), "id")
        one = hits.select("query_id", F.lit(2 * n).alias("list_no"), "rank", "text", "meta")
        out = one if out is None else out.unionByName(one)
    return out


def _promoted(spark: SparkSession, passages: DataFrame, asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """Figures, sheet overviews and transcript overviews for the queries that ask for them, found among their own kind."""
    for intent, kind, k, names in (
        (guard.figure_intent("query"), "figure", DEFAULT.figure_candidates, COLLECTIONS),
        (guard.aggregate_intent("query"), "sheet_summary", DEFAULT.overview_candidates, SHEET_COLLECTIONS),
        (guard.transcript_intent("query"), "transcript_summary", DEFAULT.figure_candidates, ("video",)),
    ):
        wanted = asked.where(intent)
        own = passages.where(F.col("chunk_type") == kind)
        found = _near(own, wanted, k, names)
        if kind == "figure":  # those with an image
            found = found.join(own.where("image_may_contain_pii = 'True'").select("meta").distinct(), "meta", "left_semi")
        scored = found.join(asked.select("query_id", "query"), "query_id").withColumn("rerank_score", F.round(pair_score("query", "text"), 9))
        candidates = scored.select("query_id", "text", "meta", "rerank_score", (F.col("list_no") * 1000 + F.col("rank")).alias("place"))
        ranked = cut_lineage(fusion.promote(ranked, candidates, F.col("meta.chunk_type") == kind, wanted))
    return ranked


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """A vector list and a keyword list for each collection, fused by rank; each list's best reaches the reranker; an exact row is pinned, kinds asked for are promoted, and the rest is banded."""
    asked = cut_lineage(_asked(spark, d).withColumn("vector", embedding("query", LetterEmbedder)))
    passages = _collections(spark, d)
    words = None
    for n, name in enumerate(COLLECTIONS):
        own = passages.where(F.col("collection") == name)
        hits = bm25.search(bm25.build(own, "chunk_id", "text"), asked, "query_id", "query", DEFAULT.bm25_k)
        hits = hits.join(own.select(F.col("chunk_id").alias("id"), "text"), "id").withColumn("collection", F.lit(name)).withColumn("list_no", F.lit(2 * n + 1))
        words = hits if words is None else words.unionByName(hits)
    keyword = fusion.enrich(words, passages, dict(zip(COLLECTIONS, COLLECTIONS))).select("query_id", "list_no", "rank", "text", "meta")
    # the lists and what is made of them are a few rows a query; each is worked out once
    lists = cut_lineage(_near(passages, asked, DEFAULT.dense_k, COLLECTIONS).unionByName(keyword))
    candidates = fusion.with_list_heads(fusion.fuse(lists), lists).join(asked.select("query_id", "query"), "query_id")
    scored = cut_lineage(candidates.withColumn("rerank_score", F.round(pair_score("query", "text"), 9)).drop("query"))
    top = fusion.rerank(scored, F.col("rerank_score"))
    rows = passages.where("row_key is not null").withColumn("ord", F.col("chunk_id"))
    near = F.round(cosine_distance("vector", "embedding"), 9)
    exact = fusion.exact_rows(asked, rows, "query_id", text.identifier("query"), SHEET_COLLECTIONS, near)
    ranked = _promoted(spark, passages, asked, cut_lineage(fusion.pin(top, exact)))
    sure = fusion.known_sources(fusion.with_confidence(ranked), F.col("meta.source_type"))
    return sure.select("query_id", "rank", F.col("meta.chunk_id").alias("chunk_id"), "confidence", "band")


def answer_assessment(spark: SparkSession, d: str) -> DataFrame:
    """What the best passage says of an answer: its confidence and band, and whether to hand over."""
    asked = _asked(spark, d)
    hits = bm25.search(bm25.build(_docs(spark, d), "doc_id", "text"), asked, "query_id", "query", DEFAULT.final_k)
    rows = fusion.with_confidence(hits.select("query_id", F.col("id").alias("doc_id"), "rank", F.col("score").alias("rerank_score"), F.lit(False).alias("pinned")))
    return fusion.assessment(asked, rows, "query_id", "query").select("query_id", F.round("top_confidence", 4).alias("top_confidence"), "band", "escalate")


def acronym_expansions(spark: SparkSession, d: str) -> DataFrame:
    """What the short forms of teams stand for, by the best passages for "<short form> full form"; the passages tell of a person each."""
    short = F.upper(F.substring("team", 1, 3))
    staff = table(spark, d, "staff").where("length(team) > 4")
    passages = staff.select("staff_id", F.concat("given_name", F.lit(" works, in "), F.col("site"), F.lit(", with "), F.col("team"), F.lit(" ("), short, F.lit(") since spring")).alias("text")).where("text is not null")
    queries = staff.select(short.alias("query_id"), short.alias("acronym"), F.concat(short, F.lit(" full form of ("), short, F.lit(")")).alias("query")).distinct()
    hits = bm25.search(bm25.build(passages, "staff_id", "text"), queries, "query_id", "query", DEFAULT.acronym_k)
    rows = hits.join(passages.select(F.col("staff_id").alias("id"), "text"), "id").join(queries.select("query_id", "acronym"), "query_id")
    return chat.first_expansions(rows)


def exact_id_pin(spark: SparkSession, d: str) -> DataFrame:
    """Messages and the record numbers in the titles of passages as queries, against the rows of the sheets."""
    said = table(spark, d, "messages").where("content is not null").select(F.concat(F.lit("m"), "id").alias("query_id"), F.col("content").alias("query"))
    keyed = table(spark, d, "chunks").where("row_key is not null").select(F.concat(F.lit("c"), "chunk_id").alias("query_id"), F.concat(F.lit("what about "), "row_key", F.lit("?")).alias("query")).distinct()
    rows = table(spark, d, "chunks").where("row_key is not null").distinct().withColumn("collection", F.col("source_type")).withColumn("meta", F.struct("chunk_id"))
    hit = fusion.exact_rows(said.unionByName(keyed), rows.withColumn("ord", F.struct("doc_id", "ord")), "query_id", text.identifier("query"), SHEET_COLLECTIONS)
    return hit.select("query_id", F.col("meta.chunk_id").alias("chunk_id"))


# scalar functions and guards


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(text.tokens("text")).alias("n_tokens"), F.size(F.array_distinct(text.tokens("text"))).alias("n_words"))


def clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = text.clean_block("text")
    return _docs(spark, d).select("doc_id", F.md5(t).alias("text_md5"), (F.length(t) >= DEFAULT.min_block).alias("kept"))


def clean_cells(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(text.clean_cell("text")).alias("cell_md5"))


def id_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("content is not null").select("id", text.identifier("content").alias("identifier"), text.first_number("content").alias("number"))


def error_numbers_not_in_question(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("content is not null")
    role = F.lower(F.trim("role"))
    asked = m.where(role == "user").select("conversation_id", F.explode(text.error_numbers("content")).alias("number"))
    said = m.where(role == "assistant").select("conversation_id", F.explode(text.error_numbers("content")).alias("number"))
    return said.distinct().join(asked, ["conversation_id", "number"], "left_anti")


def intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("content is not null").select("id", guard.figure_intent("content").alias("figure"), guard.aggregate_intent("content").alias("aggregate"), guard.transcript_intent("content").alias("transcript"), guard.escalation_intent("content").alias("escalation"), guard.acronym("content").alias("acronym"), guard.answer_class("content").alias("reply"))


def input_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", guard.rejection("content").alias("reason")).withColumn("message", guard.rejection_message("reason"))


def output_redaction(spark: SparkSession, d: str) -> DataFrame:
    t, found = guard.redact_answer("content")
    return table(spark, d, "messages").where("content is not null").select("id", F.md5(t).alias("text_md5"), F.concat_ws(",", found).alias("found"))


def internal_terms(spark: SparkSession, d: str) -> DataFrame:
    t, found = guard.redact_internal("text", TERMS)
    return _docs(spark, d).select("doc_id", F.md5(t).alias("text_md5"), F.concat_ws(",", found).alias("found"))


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each answer against the message before it as its context."""
    m = table(spark, d, "messages")
    before = F.lag("content").over(Window.partitionBy("conversation_id").orderBy("id"))
    rows = m.select("id", "role", "content", F.coalesce(before, F.lit("")).alias("context")).where("content is not null and lower(trim(role)) = 'assistant'")
    return rows.select("id", guard.answer_check("content", F.col("context")).alias("c")).select("id", F.md5("c.text").alias("text_md5"), "c.truncated", "c.safe", F.size("c.invented").alias("n_invented"))


def truncated_words(spark: SparkSession, d: str) -> DataFrame:
    t = text.truncate_words("text", 450)
    return _docs(spark, d).select("doc_id", F.md5(t).alias("text_md5"))


def sensitivity_levels(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", guard.sensitivity("text").alias("level"))


def header_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").distinct().select("chunk_id", text.header_line("text").alias("header"), F.length(text.without_header("text")).alias("n_body"))


def timestamp_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where("start_sec is not null").distinct().select("doc_id", "seg_no", text.timestamp_label("start_sec").alias("label"), text.srt_time("start_sec").alias("srt"))


def auto_titles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("lower(trim(role)) = 'user'")
    first = m.groupBy("conversation_id").agg(F.min_by("content", "id").alias("content"))
    return first.select("conversation_id", text.auto_title("content").alias("title"))


def screen_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "screen_entries").where("text is not null").distinct().select("doc_id", "entry_no", F.md5(text.denoise_lines("text")).alias("text_md5"))


# stores


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_counts(table(spark, d, "chunks"), "source_type")


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_versions(table(spark, d, "document_registry")).select("filename", "doc_id", "version", "status")


def register_versions(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "document_registry")
    new = registry.where("status = 'ready'").select(F.concat(F.lit("new-"), "doc_id").alias("doc_id"), "filename", "source_type", F.lit("").alias("notes"))
    return store.registered(registry, new, F.lit("2024-06-01").cast("timestamp_ntz")).select("doc_id", "filename", "version", "status")


def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "document_registry")
    return store.new_files(table(spark, d, "chunks").select(F.col("source_file").alias("filename")).distinct(), registry)


def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return store.conversation_list(table(spark, d, "conversations"), table(spark, d, "messages"))


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return store.recent_messages(table(spark, d, "messages").select("conversation_id", "id", "role"), DEFAULT.memory_messages)


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = store.last_turns(table(spark, d, "messages"))
    return rows.select("conversation_id", F.md5("last_user").alias("user_md5"), F.md5("last_assistant").alias("assistant_md5"))


def followup_rewrites(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("lower(trim(role)) = 'user' and content is not null")
    own = Window.partitionBy("conversation_id").orderBy("id")
    rows = m.select("conversation_id", "id", "content", F.lag("content").over(own).alias("before"), (F.row_number().over(own) * 2 - 2).alias("n_history"))
    return rows.select("id", chat.followed_up(F.col("content"), F.col("before"), F.col("n_history")).alias("query"))


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All passages, those of each file's newest version replaced."""
    rows = table(spark, d, "chunks").distinct().select("chunk_id", "doc_id", "ord", "text")
    newest = store.latest_versions(table(spark, d, "document_registry")).select("doc_id")
    return store.upsert(rows, rows.join(newest, "doc_id", "left_semi").withColumn("text", F.upper("text"))).select("chunk_id", F.md5("text").alias("text_md5"))


def delete_by_document(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = store.without(table(spark, d, "chunks").distinct(), table(spark, d, "document_registry").where("status = 'failed'"), "doc_id")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def deleted_conversations(spark: SparkSession, d: str) -> DataFrame:
    c, m = table(spark, d, "conversations").distinct(), table(spark, d, "messages")
    _, kept = store.deleted(c, m, c.where("title = 'New chat'"))
    return kept.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


def seen_ledger(spark: SparkSession, d: str) -> DataFrame:
    return store.unseen(table(spark, d, "messages").select("conversation_id"), table(spark, d, "conversations"), "conversation_id")


def message_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.decoded(table(spark, d, "messages").select("id", "sources", "images")).select("id", F.size("sources").alias("n_sources"), F.size("images").alias("n_images"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    label = lambda x: F.when(F.col(x).isNotNull(), text.timestamp_label(x))
    line = chat.citation(F.col("source_type"), F.col("chunk_type"), F.col("source_file"), F.col("page"), F.col("section"), F.col("row_key"), F.col("page"), label("start_sec"), label("end_sec"), F.lit(0.625))
    return c.select("chunk_id", line.alias("citation"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = bm25.search(bm25.build(docs, "doc_id", "text"), _asked(spark, d), "query_id", "query", DEFAULT.final_k)
    rows = hits.join(docs.select(F.col("doc_id").alias("id"), "text", "source_file"), "id")
    return chat.context_blocks(rows, F.coalesce("source_file", F.lit("the uploaded document"))).select("query_id", F.md5("context").alias("context_md5"))


def handover_history(spark: SparkSession, d: str) -> DataFrame:
    return chat.transcripts_for_handover(table(spark, d, "messages")).select("conversation_id", F.md5("history").alias("history_md5"))


# sheets


def row_passages(spark: SparkSession, d: str) -> DataFrame:
    staff = table(spark, d, "staff").withColumn(sheets.ROW, F.col("staff_id") + 1)
    return sheets.passages(staff.select(sheets.ROW, "given_name", "family_name", "team", "site"), "staff.xlsx", "Sheet1", "d1", "incident").select("chunk_id", "row_key", "text", F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"))


def sheet_values(spark: SparkSession, d: str) -> DataFrame:
    staff = table(spark, d, "staff").withColumn(sheets.ROW, F.col("staff_id") + 1)
    return sheets.column_values(staff.select(sheets.ROW, "given_name", "team", "site")).select("column_name", "n_values", "value_list")


def sheet_overview(spark: SparkSession, d: str) -> DataFrame:
    staff = table(spark, d, "staff").withColumn(sheets.ROW, F.col("staff_id") + 1)
    return sheets.overview(staff.select(sheets.ROW, "given_name", "team"), "staff.xlsx", "Sheet1", "incident").select("n_rows", "text")


# pages, on events as placed items


def section_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("page", F.dayofmonth("ts")).withColumn("doc_id", F.col("user_id"))
    toc = e.where("event_type = 'click'").select("doc_id", F.col("event_id").alias("pos"), F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("title"), "page")
    return pages.with_section(e.where("event_type <> 'click'").select("doc_id", "page", "event_id"), toc).select("event_id", "section")


def logo_images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("doc_id"), F.col("user_id").alias("xref"), F.dayofmonth("ts").alias("page"))
    return pages.logo_xrefs(e)


# time series


def screen_interval_join(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "segments").where("start_sec is not null and end_sec is not null").distinct().select("doc_id", F.col("seg_no").alias("window_no"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    v = table(spark, d, "screen_entries").distinct().select("doc_id", "entry_no", "start_sec")
    return timeline.screen_homes(w, v).select("doc_id", "entry_no", "window_no")


def carried_screens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "segments").where("start_sec is not null and end_sec is not null").distinct().select("doc_id", F.col("seg_no").alias("window_no"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    v = table(spark, d, "screen_entries").distinct().select("doc_id", "start_sec", "text")
    return timeline.carried_screens(w, timeline.screen_homes(w, v)).select("doc_id", "window_no", "start_sec")


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "screen_entries").where("start_sec is not null").distinct()
    return timeline.gap_sessions(v, "doc_id", "start_sec", DEFAULT.window_seconds)


def speech_windows(spark: SparkSession, d: str) -> DataFrame:
    return timeline.speech_windows(table(spark, d, "segments").where("start_sec is not null").distinct()).select("doc_id", "window_no", "start", "end", "n_segments", F.length("text").alias("n_chars"))


def composed_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.composed_timeline(table(spark, d, "segments").where("start_sec is not null").distinct(), table(spark, d, "screen_entries"))
    return rows.select("doc_id", "start", "end", "kind", "inherited", F.md5("body").alias("body_md5"))


def transcript_overviews(spark: SparkSession, d: str) -> DataFrame:
    return timeline.transcript_overview(table(spark, d, "segments").where("start_sec is not null").distinct())


def distinct_figures(spark: SparkSession, d: str) -> DataFrame:
    return timeline.distinct_figures(table(spark, d, "screen_entries").distinct())


# streaming


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint place for a stream's log and result."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")


def stream_ingest_parity(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken in as a stream, counted by source from what the batches have written."""
    folder = _folder(spark)

    def take(rows: DataFrame, number: int) -> None:
        rows.select("doc_id", F.lower(F.trim("source")).alias("source")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    arrivals.table_stream(spark, d, "documents").writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def streamed_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The directory as sheets that arrive in a folder, taken in file by file; the counts are refreshed after each batch."""
    folder = _folder(spark)
    staff = table(spark, d, "staff")
    staff.repartition(3).write.option("header", True).csv(f"{folder}/in")

    def take(rows: DataFrame, number: int) -> None:
        sheet.sheets(rows).where("error is null").select(F.col("headers").alias("h"), F.col("cells").alias("c")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    def refresh(number: int) -> None:
        cell = lambda name: F.col("c")[F.array_position("h", F.lit(name)).cast("int") - 1]
        rows = spark.read.parquet(f"{folder}/out").select(cell("team").alias("team"), cell("given_name").alias("given_name"))
        rows.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("given_name").alias("n_given")).write.mode("overwrite").parquet(f"{folder}/index")

    arrivals.ingest(arrivals.arriving_files(spark, f"{folder}/in", "*.csv", 1), take, f"{folder}/log", refresh=refresh).awaitTermination()
    return spark.read.parquet(f"{folder}/index")


def session_state(spark: SparkSession, d: str) -> DataFrame:
    """What each session remembers after a stream of all messages in several batches: the last output of its state."""
    folder = _folder(spark)
    rows = table(spark, d, "messages").where("conversation_id is not null").select("conversation_id", "id", "role", "content", "status")
    bounds = rows.agg(F.percentile_approx("id", [0.34, 0.67])).first()[0] or [0, 0]
    for n, part in enumerate((F.col("id") <= bounds[0], (F.col("id") > bounds[0]) & (F.col("id") <= bounds[1]), F.col("id") > bounds[1])):
        rows.where(part).coalesce(8).write.parquet(f"{folder}/in/part={n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in/part=*")

    def take(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    sessions.session_memory(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    last = store.last_of(spark.read.parquet(f"{folder}/out"), "conversation_id", F.col("batch"))
    return last.select("conversation_id", "n_seen", "n_kept", "last_role", "pending")


def ingest_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Passages on their way into a store, with placeholders for personal data."""
    rows = table(spark, d, "chunks").where("text is not null").distinct()
    return rows.select("chunk_id", *scrub.scrubbed_passage("text", "chunk_type")).withColumn("text_md5", F.md5("text")).drop("text")


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline.composed_timeline(table(spark, d, "segments").where("start_sec is not null").distinct(), table(spark, d, "screen_entries"))


def segment_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.segment_passages(_timeline(spark, d), F.col("doc_id"))
    return rows.select("doc_id", "segment_index", "start_sec", "start_time", "has_screen_text", "inherited", F.md5("text").alias("text_md5"))


def timeline_markdown(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline_markdown(_timeline(spark, d)).select("doc_id", "n_speech", "n_screen", F.md5("markdown").alias("markdown_md5"))


_PLANS: list[Callable[[SparkSession, str], DataFrame]] = [
    bm25_topk, bm25_term_stats, dense_topk, dense_topk_filtered, rrf_fusion, rrf_best_of_list, confidence_bands, hybrid_search, answer_assessment, acronym_expansions, exact_id_pin, tokenize_counts, clean_blocks, clean_cells, id_tokens, error_numbers_not_in_question, intents, input_guard,
    output_redaction, internal_terms, answer_checks, truncated_words, sensitivity_levels, header_split, timestamp_labels, auto_titles, screen_noise, collection_stats, latest_versions, register_versions, duplicate_files, conversation_list, recent_turns,
    last_turns, followup_rewrites, upsert_chunks, delete_by_document, deleted_conversations, seen_ledger, message_sources, citations, context_blocks, handover_history, row_passages, sheet_values, sheet_overview, section_asof, logo_images,
    screen_interval_join, carried_screens, gap_sessions, speech_windows, composed_timeline, transcript_overviews, distinct_figures, stream_ingest_parity, session_state, streamed_sheets, ingest_scrub, segment_passages, timeline_markdown,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PLANS + stores.PLANS + layout.PLANS}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
