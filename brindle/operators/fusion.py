"""From ranked lists to a final answer list: fusion, rerank, pins, promotions, confidence.

A ranked list is rows (query_id, list_no, rank, text, meta); meta is any struct.
Equal texts are one passage, whatever list or file they come from; the meta of
the lowest list and rank stays. All orders are total, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config


def fuse(lists: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reciprocal rank fusion: query_id, text, meta, rrf, rrf_rank of the best passages."""
    capped = lists.where(F.col("rank") <= config.list_cap)
    one = capped.groupBy("query_id", "text").agg(
        F.round(F.sum(1.0 / (config.rrf_k + F.col("rank"))), 12).alias("rrf"),
        F.min_by("meta", F.struct("list_no", "rank")).alias("meta"),
        F.min(F.struct("list_no", "rank")).alias("first"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first")
    ranked = one.withColumn("rrf_rank", F.row_number().over(best)).where(F.col("rrf_rank") <= config.fused_k)
    return ranked.select("query_id", "text", "meta", "rrf", "rrf_rank")


def with_list_heads(fused: DataFrame, lists: DataFrame) -> DataFrame:
    """The fused passages and each list's own best where it is not among them; those have no rrf rank."""
    heads = lists.where("rank = 1").groupBy("query_id", "text").agg(F.min_by("meta", "list_no").alias("meta"), F.min("list_no").alias("list_no"))
    new = heads.join(fused.select("query_id", "text"), ["query_id", "text"], "left_anti")
    return fused.select("query_id", "text", "meta", "rrf", F.col("rrf_rank").alias("place")).unionByName(new.select("query_id", "text", "meta", F.lit(0.0).alias("rrf"), (F.lit(1000) + F.col("list_no")).alias("place")))


def rerank(candidates: DataFrame, score: Column, config: Config = DEFAULT) -> DataFrame:
    """The best passages by a pair score: adds rerank_score and rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    return candidates.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.final_k)


def pin(ranked: DataFrame, exact: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Put the exact hit of a query (query_id, text, meta) in front; the same text further down goes."""
    rest = ranked.join(exact.select("query_id", "text"), ["query_id", "text"], "left_anti").withColumn("pinned", F.lit(False))
    head = exact.select("query_id", "text", "meta", F.lit(0.0).alias("rrf"), F.lit(0).alias("place"), F.lit(None).cast("double").alias("rerank_score"), F.lit(0).alias("rank"), F.lit(True).alias("pinned"))
    best = Window.partitionBy("query_id").orderBy(F.desc("pinned"), "rank")
    return head.unionByName(rest.select(*head.columns)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.final_k)


def promote(ranked: DataFrame, candidates: DataFrame, kind: Column, intent: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For queries in `intent` (query_id) whose list has no passage of the kind: the candidate with the best score takes the last place.

    candidates: query_id, text, meta, rerank_score, place (their order, which
    breaks ties), found by a search of their own among passages of the kind. The
    first final_k - 1 of the list stay; then it is ordered by score again, pinned
    ones in front, equal scores as they were.
    """
    lacking = intent.select("query_id").distinct().join(ranked.where(F.coalesce(kind, F.lit(False))).select("query_id").distinct(), "query_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    best = candidates.join(lacking, "query_id", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    best = best.select("query_id", "text", "meta", F.lit(0.0).alias("rrf"), "place", "rerank_score", F.lit(config.final_k).alias("rank"), F.lit(False).alias("pinned"))
    touched = best.select("query_id")
    kept = ranked.join(touched, "query_id", "left_semi").where(F.col("rank") < config.final_k)
    both = kept.select(*best.columns).unionByName(best)
    again = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc("rerank_score"), "rank")
    return ranked.join(touched, "query_id", "left_anti").select(*best.columns).unionByName(both.withColumn("rank", F.row_number().over(again)))


def with_confidence(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Min-max of the scores within a query's list, pinned ones 1: adds confidence and band."""
    own = Window.partitionBy("query_id")
    score = F.when(~F.col("pinned"), F.col("rerank_score"))
    low, high = F.min(score).over(own), F.max(score).over(own)
    share = F.when(high - low == 0, 0.5).otherwise((score - low) / (high - low))
    share = F.when(high < config.rerank_floor, share * config.floor_penalty).otherwise(share)
    conf = F.when(F.col("pinned"), 1.0).otherwise(F.round(share, 4))
    out = ranked.withColumn("confidence", conf)
    return out.withColumn("band", F.when(F.col("confidence") >= config.high, "high").when(F.col("confidence") >= config.low, "medium").otherwise("low"))


def known_sources(ranked: DataFrame, source_type: Column) -> DataFrame:
    """Drop passages of an unknown source type, unless a query then has none."""
    known = source_type.isNotNull() & ~source_type.isin("", "unknown")
    any_known = F.max(known.cast("int")).over(Window.partitionBy("query_id"))
    return ranked.withColumn("__known", known).withColumn("__any", any_known).where("__known or __any = 0").drop("__known", "__any")


def assessment(queries: DataFrame, ranked: DataFrame, query_id: str, query_text: str, config: Config = DEFAULT) -> DataFrame:
    """query_id, top_confidence, band, escalate; short queries don't escalate for low confidence, a query without results has confidence 0."""
    head = ranked.where("rank = 1").select("query_id", F.col("confidence").alias("top_confidence"))
    rows = queries.select(F.col(query_id).alias("query_id"), F.size(F.filter(F.split(query_text, r"\s+"), lambda w: w != "")).alias("n_words")).join(head, "query_id", "left")
    top = F.coalesce("top_confidence", F.lit(0.0))
    band = F.when(top >= config.high, "high").when(top >= config.low, "medium").otherwise("low")
    short = (F.col("n_words") <= config.short_query_words) & (band == "low")
    return rows.select("query_id", top.alias("top_confidence"), F.when(short, "medium").otherwise(band).alias("band"), (~short & (band == "low")).alias("escalate"))


META = ("chunk_id", "source_type", "source_file", "chunk_type")


def enrich(hits: DataFrame, passages: DataFrame, collection_source: dict[str, str]) -> DataFrame:
    """Meta of keyword hits (query_id, collection, id, text): by id, else by text (the last row of equal ones), else the collection's source type."""
    by_id = passages.select(F.col("chunk_id").alias("id"), F.struct(*META).alias("m1"))
    by_text = passages.join(hits.select("text").distinct(), "text", "left_semi").groupBy(F.col("text")).agg(F.max_by(F.struct(*META), "ord").alias("m2"))
    guess = F.create_map(*[F.lit(x) for kv in collection_source.items() for x in kv])
    inferred = F.struct(F.col("id").cast("string").alias("chunk_id"), guess[F.col("collection")].alias("source_type"), F.lit("unknown").alias("source_file"), F.lit("").alias("chunk_type"))
    return hits.join(by_id, "id", "left").join(by_text, "text", "left").select(*hits.columns, F.coalesce("m1", "m2", inferred).alias("meta"))


def exact_rows(queries: DataFrame, sheets: DataFrame, query_id: str, identifier: Column, collections: tuple[str, ...], near: Column | None = None) -> DataFrame:
    """The row whose row_key is the query's identifier, of the first collection that has one, the nearest first where a distance of query and row is given: query_id, text, meta."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(collections) for x in (c, i)])
    keyed = queries.withColumn("row_key", identifier).where("row_key is not null").withColumnRenamed(query_id, "query_id")
    hit = keyed.join(sheets.where(F.col("collection").isin(list(collections))), "row_key")
    first = Window.partitionBy("query_id").orderBy(order[F.col("collection")], *([near] if near is not None else []), "ord")
    return hit.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "text", "meta")
