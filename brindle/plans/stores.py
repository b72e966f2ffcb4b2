"""Registered queries of stores and ingestion, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import guard, text
from brindle.operators import chat, sheets, store
from brindle.session import table
from brindle.sources import files

#: The time that queries take for now, so that results repeat.
NOW = "2024-06-01 12:30:45"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def registry_changes(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished documents get their number of passages and are ready, or failed where they have none."""
    registry = table(spark, d, "document_registry")
    counts = table(spark, d, "chunks").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    open_ = registry.where("status not in ('ready', 'failed')").select("doc_id").join(counts, "doc_id", "left")
    changes = open_.select("doc_id", F.when(F.col("n") > 0, "ready").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("chunk_count"), F.when(F.col("n").isNull(), "no passages").alias("notes"))
    return store.with_changes(registry, changes).select("doc_id", "status", "chunk_count", "notes")


def failed_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document marked failed with a reason, by its id."""
    registry = table(spark, d, "document_registry")
    first = registry.where("status = 'ready'").agg(F.min("doc_id")).first()[0]
    return store.marked_failed(store.with_status(registry, F.lit(first), "processing", chunk_count=0), F.lit(first), "the file can't be read").select("doc_id", "status", "chunk_count", "notes")


def registry_listed(spark: SparkSession, d: str) -> DataFrame:
    return store.documents_of(table(spark, d, "document_registry"), "pdf").select("doc_id", "filename", "version")


def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    """How many passages go with the files of failed documents, and how many stay of the others."""
    chunks = table(spark, d, "chunks").distinct()
    gone = table(spark, d, "document_registry").where("status = 'failed'").select(F.col("filename").alias("source_file"))
    kept, counts = store.without(chunks, gone, "source_file")
    left = kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source_file", F.lit("deleted").alias("what"), "n").unionByName(left.select("source_file", F.lit("kept").alias("what"), "n"))


def created_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of all messages are inserted where they are not there, and titled by their first question."""
    c, m = table(spark, d, "conversations").distinct(), table(spark, d, "messages")
    new = m.where("conversation_id is not null").groupBy("conversation_id").agg(F.min("created_at").alias("created_at")).select("conversation_id", F.lit("New chat").alias("title"), "created_at", F.col("created_at").alias("updated_at"))
    every = store.created(c, new)
    first = m.where("lower(trim(role)) = 'user'").groupBy("conversation_id").agg(F.min_by("content", "id").alias("content"))
    titles = every.where("coalesce(title, 'New chat') = 'New chat'").select("conversation_id").join(first, "conversation_id").select("conversation_id", text.auto_title("content").alias("title"))
    return store.listed(store.retitled(every, titles, _now())).select("conversation_id", "title", "updated_at")


def renamed_conversation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").distinct()
    first = c.agg(F.min("conversation_id")).first()[0]
    return store.renamed(c, F.lit(first), F.concat(F.lit("  "), F.repeat(F.lit("a long title "), 9)), _now()).select("conversation_id", "title", "updated_at")


def appended_messages(spark: SparkSession, d: str) -> DataFrame:
    """Assistant messages appended to a store of the others: times of change move, all rows are there."""
    c, m = table(spark, d, "conversations").distinct(), table(spark, d, "messages")
    own = F.coalesce(F.lower(F.trim("role")) == "assistant", F.lit(False))
    changed, every = store.appended(c, m.where(~own), m.where(own))
    n = every.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return changed.join(n, "conversation_id", "left").select("conversation_id", "updated_at", F.coalesce("n", F.lit(0)).alias("n_messages"))


def ingestion_summary(spark: SparkSession, d: str) -> DataFrame:
    """Passages of pages: text, tables and figures in this order, cleaned, tagged, blocked where they are sensitive, counted."""
    chunks = table(spark, d, "chunks").where("source_type = 'pdf' and text is not null").distinct()
    parts = [chunks.where(F.col("chunk_type") == kind).withColumn("branch", F.lit(n)) for n, kind in enumerate(("text", "table", "figure"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tagged = every.withColumn("text", F.when(F.col("branch") == 0, text.clean_block("text")).otherwise(F.col("text"))).withColumn("sensitivity_level", guard.sensitivity("text"))
    safe, blocked = store.split_by_sensitivity(tagged)
    return store.ingestion_summary(safe, blocked)


def handover_payloads(spark: SparkSession, d: str) -> DataFrame:
    return chat.handover_payloads(table(spark, d, "messages"), _now()).select("conversation_id", "ticket", F.md5("short_description").alias("short_md5"), F.md5("description").alias("description_md5"))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "screen_entries").where("text is not null").distinct().select("doc_id", "entry_no", F.md5(text.ocr_lines("text")).alias("text_md5"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each conversation's last question, with what is remembered before it."""
    m = table(spark, d, "messages").where("content is not null and conversation_id is not null")
    last = m.where("lower(trim(role)) = 'user'").groupBy(F.col("conversation_id").alias("query_id")).agg(F.max_by("content", "id").alias("query"), F.max("id").alias("at"))
    past = store.recent_messages(m.join(last.select(F.col("query_id").alias("conversation_id"), "at"), "conversation_id").where("id < at").drop("at"), 4)
    history = past.select(F.col("conversation_id").alias("query_id"), "place", F.lower(F.trim("role")).alias("role"), "content")
    none = last.select("query_id", F.lit(None).cast("string").alias("context"))
    made = chat.prompts(last.select("query_id", "query"), none, history, F.lit("Answer from the context alone."))
    return made.select("query_id", F.size("prompt").alias("n_parts"), F.md5(F.array_join(F.transform("prompt", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")).alias("prompt_md5"))


def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """The registry's files as they would be listed in a folder, with their kind, what is wrong with them and where sheets go."""
    rows = table(spark, d, "document_registry").select(F.concat(F.lit("/in/"), "filename").alias("path"), (F.col("chunk_count").cast("long") * 40_000_000).alias("length"), "doc_id")
    return files.with_checks(rows).select("doc_id", "filename", "kind", "problem", sheets.target_collection("path").alias("collection"))


PLANS = [file_checks, registry_changes, failed_documents, registry_listed, deleted_files, created_conversations, renamed_conversation, appended_messages, ingestion_summary, handover_payloads, ocr_lines, prompts]

HISTORY = """
    l AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM messages),
    h AS (SELECT conversation_id, string_agg(CASE WHEN lower(trim(role)) = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(coalesce(content, ''), 1, 300), chr(10) ORDER BY id) AS history FROM l WHERE n <= 6 GROUP BY 1)"""


def sql(clean: str, any_of) -> dict[str, str]:
    """clean: SQL of a cleaned block of `text`; any_of(column, words): SQL of a text that has one of the words."""
    kinds = ", ".join(f"'{x}': '{k}'" for x, k in files.KINDS.items())
    return {
        "file_checks": f"""
            WITH f AS (SELECT doc_id, filename, chunk_count::BIGINT * 40000000 AS length, MAP {{{kinds}}}[lower(regexp_extract(filename, '(\\.[^.]+)$', 1))] AS kind, lower(filename) AS low FROM document_registry)
            SELECT doc_id, filename, kind, CASE WHEN kind IS NULL THEN 'unknown_type' WHEN length = 0 THEN 'empty_file' WHEN length > 524288000 THEN 'too_large' END AS problem,
                CASE WHEN contains(low, 'incident') THEN 'incident' WHEN contains(low, 'defect') OR contains(low, 'bug') THEN 'defect' END AS collection FROM f
        """,
        "registry_changes": """
            WITH n AS (SELECT doc_id, count(*)::INT AS n FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1)
            SELECT r.doc_id, CASE WHEN r.status IN ('ready', 'failed') THEN r.status WHEN n.n > 0 THEN 'ready' ELSE 'failed' END AS status,
                CASE WHEN r.status IN ('ready', 'failed') THEN r.chunk_count ELSE coalesce(n.n, 0) END AS chunk_count, CASE WHEN r.status IN ('ready', 'failed') OR n.n IS NOT NULL THEN r.notes ELSE 'no passages' END AS notes
            FROM document_registry r LEFT JOIN n USING (doc_id)
        """,
        "failed_documents": """
            WITH f AS (SELECT min(doc_id) AS f FROM document_registry WHERE status = 'ready')
            SELECT doc_id, CASE WHEN doc_id = f THEN 'failed' ELSE status END AS status, CASE WHEN doc_id = f THEN 0 ELSE chunk_count END AS chunk_count, CASE WHEN doc_id = f THEN 'the file can''t be read' ELSE notes END AS notes FROM document_registry, f
        """,
        "registry_listed": "SELECT doc_id, filename, version FROM document_registry WHERE source_type = 'pdf' ORDER BY ingested_at DESC, doc_id",
        "deleted_files": """
            WITH g AS (SELECT DISTINCT filename AS source_file FROM document_registry WHERE status = 'failed'), c AS (SELECT DISTINCT * FROM chunks)
            SELECT g.source_file, 'deleted' AS what, count(c.chunk_id) AS n FROM g LEFT JOIN c USING (source_file) GROUP BY 1
            UNION ALL SELECT source_file, 'kept', count(*) FROM c WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM g) GROUP BY 1
        """,
        "created_conversations": f"""
            WITH c AS (SELECT DISTINCT * FROM conversations),
            e AS (SELECT conversation_id, title, updated_at FROM c UNION ALL SELECT conversation_id, 'New chat', min(created_at) FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM c) GROUP BY 1),
            f AS (SELECT conversation_id, trim(regexp_replace(coalesce(arg_min_null(content, id), ''), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM messages WHERE lower(trim(role)) = 'user' GROUP BY 1),
            a AS (SELECT conversation_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '…' END AS t FROM f),
            n AS (SELECT e.*, CASE WHEN coalesce(e.title, 'New chat') = 'New chat' AND a.t IS NOT NULL THEN substr(trim(a.t), 1, 60) END AS new FROM e LEFT JOIN a USING (conversation_id))
            SELECT conversation_id, coalesce(new, title) AS title, CASE WHEN new IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM n
        """,
        "renamed_conversation": f"""
            WITH c AS (SELECT DISTINCT * FROM conversations), f AS (SELECT min(conversation_id) AS f FROM c)
            SELECT conversation_id, CASE WHEN conversation_id = f THEN substr(trim(repeat('a long title ', 9)), 1, 60) ELSE title END AS title, CASE WHEN conversation_id = f THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM c, f
        """,
        "appended_messages": """
            WITH n AS (SELECT conversation_id, count(*) AS n, max(created_at) FILTER (lower(trim(role)) = 'assistant') AS at FROM messages GROUP BY 1)
            SELECT c.conversation_id, greatest(c.updated_at, n.at) AS updated_at, coalesce(n.n, 0) AS n_messages FROM (SELECT DISTINCT * FROM conversations) c LEFT JOIN n USING (conversation_id)
        """,
        "ingestion_summary": f"""
            WITH c AS (SELECT doc_id, chunk_type, lower(CASE WHEN chunk_type = 'text' THEN {clean} ELSE text END) AS t FROM (SELECT DISTINCT * FROM chunks) WHERE source_type = 'pdf' AND text IS NOT NULL AND chunk_type IN ('text', 'table', 'figure')),
            h AS (SELECT *, {any_of("t", ["salary", "payroll", "confidential", "executive", "password", "credential"])} AS high FROM c)
            SELECT doc_id, chunk_type, count(*) FILTER (NOT high) AS n_stored, count(*) FILTER (high) AS n_blocked FROM h GROUP BY ALL
        """,
        "handover_payloads": f"""
            WITH {HISTORY}, q AS (SELECT conversation_id, arg_max(coalesce(content, ''), id) AS q FROM messages WHERE lower(trim(role)) = 'user' GROUP BY 1)
            SELECT h.conversation_id, 'REQ20240601123045' AS ticket, md5(substr(coalesce(q, ''), 1, 100)) AS short_md5, md5('Question: ' || coalesce(q, '') || chr(10) || chr(10) || 'Last turns:' || chr(10) || history) AS description_md5
            FROM h LEFT JOIN q ON q.conversation_id IS NOT DISTINCT FROM h.conversation_id AND h.conversation_id IS NOT NULL
        """,
        "ocr_lines": r"""
            SELECT doc_id, entry_no, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(trim(regexp_replace(x, '^\s+|\s+$', '', 'g')), '[ \t]{2,}', ' ', 'g')), lambda x: regexp_matches(x, '[A-Za-z0-9]')), chr(10))) AS text_md5
            FROM (SELECT DISTINCT * FROM screen_entries) WHERE text IS NOT NULL
        """,
        "prompts": """
            WITH m AS (SELECT *, lower(trim(role)) AS r FROM messages WHERE content IS NOT NULL AND conversation_id IS NOT NULL),
            q AS (SELECT conversation_id, arg_max(content, id) AS query, max(id) AS at FROM m WHERE r = 'user' GROUP BY 1),
            p AS (SELECT m.*, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM m JOIN q USING (conversation_id) WHERE m.id < q.at),
            h AS (SELECT conversation_id, count(*) AS n, string_agg(r || ': ' || content, chr(10) ORDER BY id) AS past FROM p WHERE n <= 4 GROUP BY 1)
            SELECT q.conversation_id AS query_id, (2 + coalesce(h.n, 0))::INT AS n_parts,
                md5('system: Answer from the context alone.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || 'No relevant context found.' || coalesce(chr(10) || h.past, '') || chr(10) || 'user: ' || q.query) AS prompt_md5
            FROM q LEFT JOIN h USING (conversation_id)
        """,
    }
