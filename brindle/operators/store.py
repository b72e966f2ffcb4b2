"""Tables of passages, documents and conversations: versions, upserts, deletes, reads.

All operations are frames in, frame out: a caller writes the result as the next
snapshot, or as MERGE and DELETE where its table format has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.config import COLLECTIONS
from brindle.functions.text import rename_title


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; the last of equal keys in `new` must be chosen before."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def last_of(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the last in the given order."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("__r"))
    return last.select("__r.*")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows without those that fulfil the condition; null is not fulfilled."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def collection_counts(passages: DataFrame, collection: str = "collection", names: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """collection, n for all names, zero included."""
    every = passages.sparkSession.createDataFrame([(n,) for n in names], "collection string")
    counts = passages.groupBy(F.col(collection).alias("collection")).agg(F.count(F.lit(1)).alias("c"))
    return every.join(counts, "collection", "left").select("collection", F.coalesce("c", F.lit(0)).alias("n"))


# documents


def latest_versions(registry: DataFrame, name: str = "filename", version: str = "version") -> DataFrame:
    """The row of the highest version of each file."""
    return last_of(registry, name, F.struct(version, *[c for c in ("doc_id",) if c in registry.columns]))


def registered(registry: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows for new files (doc_id, filename, source_type, notes): the next version of each name, status processing."""
    top = registry.groupBy("filename").agg(F.max("version").alias("top"))
    order = Window.partitionBy("filename").orderBy("doc_id")
    rows = new.join(top, "filename", "left").withColumn("version", (F.coalesce("top", F.lit(0)) + F.row_number().over(order)).cast("int"))
    return rows.select("doc_id", "filename", "source_type", "version", F.lit("processing").alias("status"), F.lit(0).alias("chunk_count"), now.alias("ingested_at"), "notes")


def with_status(registry: DataFrame, doc_id: Column, status: str, chunk_count: int | None = None, notes: str | None = None) -> DataFrame:
    hit = F.col("doc_id") == doc_id
    out = registry.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    if chunk_count is not None:
        out = out.withColumn("chunk_count", F.when(hit, F.lit(chunk_count)).otherwise(F.col("chunk_count")))
    if notes is not None:
        out = out.withColumn("notes", F.when(hit, F.lit(notes)).otherwise(F.col("notes")))
    return out


def marked_failed(registry: DataFrame, doc_id: Column, reason: str) -> DataFrame:
    return with_status(registry, doc_id, "failed", notes=reason)


def with_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Status, chunk_count and notes of many documents at once: changes has doc_id and any of the three, null where a value stays."""
    own = [c for c in ("status", "chunk_count", "notes") if c in changes.columns]
    new = changes.select("doc_id", *[F.col(c).alias(f"__{c}") for c in own])
    out = registry.join(new, "doc_id", "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in own else F.col(c) for c in registry.columns])


def documents_of(registry: DataFrame, source_type: str | None = None) -> DataFrame:
    """The registry, of one source type where it is given, newest first."""
    rows = registry if source_type is None else registry.where(F.col("source_type") == source_type)
    return rows.orderBy(F.desc("ingested_at"), "doc_id")


def without(rows: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among `gone`, and key and n of those taken out; a key without rows counts 0."""
    keys = gone.select(key).distinct()
    marked = rows.join(keys.withColumn("__gone", F.lit(True)), key, "left")
    counts = keys.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")), key, "left").select(key, F.coalesce("c", F.lit(0)).alias("n"))
    return delete_where(marked, F.col("__gone")).drop("__gone").select(*rows.columns), counts


def split_by_sensitivity(passages: DataFrame, level: str = "sensitivity_level") -> tuple[DataFrame, DataFrame]:
    """Passages that may be stored, and those of high sensitivity, which are blocked."""
    high = F.coalesce(F.col(level) == "high", F.lit(False))
    return passages.where(~high), passages.where(high)


def ingestion_summary(safe: DataFrame, blocked: DataFrame) -> DataFrame:
    """doc_id, chunk_type, n_stored, n_blocked."""
    both = safe.select("doc_id", "chunk_type", F.lit(1).alias("s"), F.lit(0).alias("b")).unionByName(blocked.select("doc_id", "chunk_type", F.lit(0).alias("s"), F.lit(1).alias("b")))
    return both.groupBy("doc_id", "chunk_type").agg(F.sum("s").alias("n_stored"), F.sum("b").alias("n_blocked"))


def reset(spark: SparkSession, paths: list[str]) -> None:
    """Remove the folders of tables; conversations and figures stay where they are not named."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_files(files: DataFrame, registry: DataFrame, name: str = "filename") -> DataFrame:
    """Files whose name no ready document has."""
    return files.join(registry.where("status = 'ready'").select(F.col("filename").alias(name)), name, "left_anti")


def unseen(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger lacks, once each."""
    return rows.join(ledger.select(key), key, "left_anti").dropDuplicates([key])


# conversations


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversation_id, title, created_at, updated_at, n_messages; conversations without messages included."""
    once = conversations.distinct()
    counts = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("c"))
    return once.join(counts, "conversation_id", "left").select("conversation_id", "title", "created_at", "updated_at", F.coalesce("c", F.lit(0)).alias("n_messages"))


def created(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore."""
    return conversations.unionByName(new.join(conversations.select("conversation_id"), "conversation_id", "left_anti").dropDuplicates(["conversation_id"]).select(*conversations.columns))


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and conversations with their time of change moved."""
    moved = new.groupBy("conversation_id").agg(F.max("created_at").alias("__at"))
    changed = conversations.join(moved, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "__at")).select(*conversations.columns)
    return changed, messages.unionByName(new.select(*messages.columns))


def renamed(conversations: DataFrame, conversation_id: Column, title: Column, now: Column) -> DataFrame:
    hit = F.col("conversation_id") == conversation_id
    return conversations.withColumn("title", F.when(hit, rename_title(title)).otherwise(F.col("title"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def retitled(conversations: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """New titles (conversation_id, title) of many conversations at once, as renamed gives them."""
    new = titles.select("conversation_id", rename_title("title").alias("__title"))
    out = conversations.join(new, "conversation_id", "left")
    moved = F.when(F.col("__title").isNotNull(), now).otherwise(F.col("updated_at"))
    return out.withColumn("title", F.coalesce("__title", "title")).withColumn("updated_at", moved).select(*conversations.columns)


def listed(conversations: DataFrame) -> DataFrame:
    """The last changed first."""
    return conversations.orderBy(F.desc("updated_at"), "conversation_id")


def deleted(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in `gone`."""
    return tuple(t.join(gone.select("conversation_id"), "conversation_id", "left_anti") for t in (conversations, messages))  # type: ignore[return-value]


def recent_messages(messages: DataFrame, most: int) -> DataFrame:
    """The last `most` messages of each conversation by id, with place 1 for the oldest of them.

    The filter on the rank is pushed below the shuffle's sort as a group limit, so a long conversation sends only its last rows.
    """
    last = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    rows = messages.withColumn("__back", F.row_number().over(last)).where(F.col("__back") <= most)
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("id"))
    return rows.withColumn("place", place).drop("__back")


def last_turns(messages: DataFrame) -> DataFrame:
    """conversation_id, last_user, last_assistant: the latest content of either role."""
    role = F.lower(F.trim("role"))
    pick = lambda r: F.max_by(F.when(role == r, F.col("content")), F.when(role == r, F.col("id")))
    return messages.groupBy("conversation_id").agg(pick("user").alias("last_user"), pick("assistant").alias("last_assistant"))


def decoded(messages: DataFrame) -> DataFrame:
    """JSON lists as arrays; null or broken JSON gives an empty array."""
    items = F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>"))
    shots = F.coalesce(F.from_json("images", "array<struct<url:string,caption:string,page:int,source_file:string>>"), F.array().cast("array<struct<url:string,caption:string,page:int,source_file:string>>"))
    return messages.withColumn("sources", items).withColumn("images", shots)


def encoded(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sources", F.to_json("sources")).withColumn("images", F.to_json("images"))
