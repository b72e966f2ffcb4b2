"""From results to an answer's inputs: citations, context, prompt, follow-ups, acronyms, hand-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config
from brindle.functions.guard import HINT_STOP_WORDS
from brindle.functions.text import first_number


def percent(confidence: Column) -> Column:
    return F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))


def _or(x: Column, other: str = "?") -> Column:
    return F.coalesce(x.cast("string"), F.lit(other))


def citation(source_type: Column, chunk_type: Column, source_file: Column, page: Column, section: Column, row_key: Column, row_number: Column, start_time: Column, end_time: Column, confidence: Column) -> Column:
    """A line that names a passage's source by the kind of its file and of the passage."""
    file, sure = _or(source_file, "unknown"), F.concat(F.lit("Confidence: "), percent(confidence))
    span = F.concat(_or(start_time), F.lit("–"), _or(end_time))
    key = F.coalesce(F.nullif(row_key, F.lit("")), F.concat(F.lit("row "), _or(row_number)))
    bar = lambda *xs: F.concat_ws(" | ", *xs)
    return (
        F.when(source_type == "pdf", bar(F.concat(F.lit("📄 Source: "), file), F.concat(F.lit("Page "), _or(page)), F.concat(F.lit("Section: "), _or(section)), sure))
        .when((source_type == "video") & (chunk_type == "transcript_summary"), bar(F.concat(F.lit("🎬 Source: "), file, F.lit(" (transcript overview)")), sure))
        .when((source_type == "video") & (chunk_type == "figure"), bar(F.concat(F.lit("🎬 Source: "), file, F.lit(" (screenshot at "), _or(start_time), F.lit(")")), sure))
        .when((source_type == "video") & (chunk_type == "screen_capture"), bar(F.concat(F.lit("🎬 Source: "), file, F.lit(" (on-screen text)")), span, sure))
        .when(source_type == "video", bar(F.concat(F.lit("🎬 Source: "), file), span, sure))
        .when(source_type.isin("incident", "defect") & (chunk_type == "sheet_summary"), bar(F.concat(F.lit("📊 Source: "), file, F.lit(" (sheet overview)")), sure))
        .when(source_type.isin("incident", "defect"), bar(F.concat(F.lit("📊 Source: "), file), key, sure))
        .otherwise(bar(F.concat(F.lit("📁 Source: "), file), sure))
    )


def context_blocks(results: DataFrame, header: Column, text: str = "text", rank: str = "rank") -> DataFrame:
    """query_id, context: numbered sources in order of rank, blank lines between. A list is a few passages long."""
    block = F.concat(F.lit("[Source "), F.col(rank).cast("string"), F.lit(" — "), header, F.lit("]\n"), F.col(text))
    one = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("x"))
    return one.select("query_id", F.array_join(F.transform("x", lambda y: y["b"]), "\n\n").alias("context"))


def images_of(results: DataFrame, caption: Column) -> DataFrame:
    """query_id, rank, url, caption, page, source_file of figure passages with an image."""
    has = (F.col("chunk_type") == "figure") & (F.coalesce("image_path", F.lit("")) != "")
    return results.where(has).select("query_id", "rank", F.concat(F.lit("/figures/"), F.col("image_path")).alias("url"), caption.alias("caption"), "page", "source_file")


def followed_up(query: Column, last_user: Column, n_history: Column, config: Config = DEFAULT) -> Column:
    """The query with what a short follow-up leaves out: the error number of the last question, else up to three of its words."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != "")
    number = first_number(last_user)
    hints = F.slice(F.filter(F.transform(F.filter(F.split(F.coalesce(last_user, F.lit("")), r"\s+"), lambda w: F.length(w) > 3), F.lower), lambda w: ~w.isin(HINT_STOP_WORDS)), 1, 3)
    plain = (F.size(words) > config.short_query_words) | (n_history < 2) | (F.coalesce(last_user, F.lit("")) == "")
    return F.when(plain, query).when(number.isNotNull() & ~query.contains(number), F.concat(query, F.lit(" for error "), number)).when(F.size(hints) > 0, F.concat(query, F.lit(" "), F.concat_ws(" ", hints))).otherwise(query)


def expansion(acronym: Column, text: Column) -> Column:
    """`phrase (ACR)`, else `ACR (phrase)`, of 5 to 60 letters and blanks; null without one."""
    a = F.concat(F.lit(r"(?i)([A-Za-z\s]{5,60})\s*\("), acronym, F.lit(r"\)"))
    b = F.concat(F.lit("(?i)"), acronym, F.lit(r"\s*\(([A-Za-z\s]{5,60})\)"))
    found = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1) if isinstance(p, str) else F.call_function("regexp_extract", text, p, F.lit(1))), F.lit(""))
    return F.coalesce(found(a), found(b))


def first_expansions(hits: DataFrame) -> DataFrame:
    """query_id, expansion of the first hit in rank that has one. hits: query_id, acronym, rank, text."""
    rows = hits.withColumn("expansion", expansion(F.col("acronym"), F.col("text"))).where("expansion is not null")
    return rows.groupBy("query_id").agg(F.min_by("expansion", "rank").alias("expansion"))


def prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame, system: Column) -> DataFrame:
    """query_id, prompt: an array of role and content, the system's part, the history (query_id, place, role, content), the query."""
    turn = F.struct(F.col("role").alias("role"), F.col("content").alias("content"))
    past = history.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", turn.alias("t")))), lambda x: x["t"]).alias("past"))
    rows = queries.join(contexts, "query_id", "left").join(past, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("No relevant context found.")))
    make = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return rows.select("query_id", F.concat(make("system", F.concat(system, F.lit("\n\nCONTEXT:\n"), F.col("context"))), F.coalesce("past", none), make("user", F.col("query"))).alias("prompt"))


def transcripts_for_handover(messages: DataFrame, turns: int = 6, chars: int = 300) -> DataFrame:
    """conversation_id, history: the last turns, a line each, cut in length."""
    last = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    rows = messages.withColumn("n", F.row_number().over(last)).where(F.col("n") <= turns)
    who = F.when(F.lower(F.trim("role")) == "user", "User").otherwise("Assistant")
    line = F.concat(who, F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    one = rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    return one.select("conversation_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("history"))


def handover_payloads(messages: DataFrame, now: Column) -> DataFrame:
    """conversation_id, ticket, short_description (the last question), description (the last turns): what a hand-over to people sends."""
    role = F.lower(F.trim("role"))
    asked = messages.where(role == "user").groupBy("conversation_id").agg(F.max_by(F.coalesce("content", F.lit("")), "id").alias("question"))
    rows = transcripts_for_handover(messages).join(asked, "conversation_id", "left")
    short = F.substring(F.coalesce("question", F.lit("")), 1, 100)
    text = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n\nLast turns:\n"), F.col("history"))
    return rows.select("conversation_id", F.concat(F.lit("REQ"), F.date_format(now, "yyyyMMddHHmmss")).alias("ticket"), short.alias("short_description"), text.alias("description"))
