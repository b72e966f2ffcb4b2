"""Time-series operators over recordings: windows of speech, screen text, carried screens.

Transcripts have rows (doc_id, seg_no, start_sec, end_sec, text), screens rows
(doc_id, start_sec, text). Recordings are cut into blocks of time, so a long one
is spread over tasks as well.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config
from brindle.functions.text import timestamp_label
from brindle.operators.ordered import BLOCK, Fold, blockwise_fill, blockwise_fold, with_block
from brindle.session import cut_lineage

BLOCK_SECONDS = 1800


class _Speech(Fold):
    """state: start, end, size, texts of the open window."""

    def __init__(self, config: Config):
        self.chars, self.seconds = config.window_chars, config.window_seconds

    def step(self, state: list | None, row: tuple) -> tuple[list | None, list[tuple]]:
        a, z, text = row
        start, _, size, texts = state or (a, z, -1, [])
        size, texts = size + len(text) + 1, [*texts, text]
        if size >= self.chars or z - start >= self.seconds:
            return None, [(start, z, len(texts), " ".join(texts))]
        return [start, z, size, texts], []

    def flush(self, state: list | None) -> list[tuple]:
        return [(state[0], state[1], len(state[3]), " ".join(state[3]))] if state else []


def speech_windows(segments: DataFrame, config: Config = DEFAULT, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Greedy windows: doc_id, window_no, start, end, n_segments, text.

    Segments in order of start join a window until its text has window_chars
    characters or it spans window_seconds; blank segments are left out. Blocks of
    time of a recording are folded at once, so a long one is spread over tasks.
    """
    rows = segments.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", "seg_no", "start_sec", F.coalesce("end_sec", "start_sec").alias("end_sec"), F.trim("text").alias("text"))
    rows = with_block(rows, F.coalesce(F.floor(F.col("start_sec") / block_seconds), F.lit(-(2**40))))
    found = blockwise_fold(rows, "doc_id", ["start_sec", "seg_no"], ["start_sec", "end_sec", "text"], _Speech(config), "start double, end double, n_segments long, text string", "window_no")
    return found.select("doc_id", "window_no", "start", "end", "n_segments", "text")


def screen_homes(windows: DataFrame, screens: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Screens with the first window whose span, widened by the slack, holds their time; window_no is null where none does.

    The range condition is bucketed by minute, so it is an equi-join of a window
    with the few screens of its minutes rather than with all of its recording.
    """
    slack = config.slack_seconds
    w = windows.select("doc_id", "window_no", (F.col("start") - slack).alias("a"), (F.col("end") + slack).alias("z"))
    w = w.withColumn("minute", F.explode(F.sequence(F.floor(F.col("a") / 60), F.greatest(F.floor(F.col("a") / 60), F.floor(F.col("z") / 60)))))
    v = screens.withColumn("minute", F.floor(F.col("start_sec") / 60))
    hits = v.join(w, ["doc_id", "minute"], "left").withColumn("inside", (F.col("a") <= F.col("start_sec")) & (F.col("start_sec") <= F.col("z")))
    home = F.min(F.when(F.col("inside"), F.col("window_no")))
    return hits.groupBy(*[F.col(c) for c in screens.columns]).agg(home.alias("window_no"))


def carried_screens(windows: DataFrame, homes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, window_no, text, start_sec of the last screen before each window without a screen of its own, if it is not too old."""
    own = homes.where("window_no is not null").select("doc_id", "window_no").distinct()
    bare = windows.select("doc_id", "window_no", "start").join(own, ["doc_id", "window_no"], "left_anti")
    null = F.lit(None)
    marks = bare.select("doc_id", (F.col("start") + config.slack_seconds).alias("t"), F.lit(1).alias("kind"), "window_no", F.col("start").alias("w_start"), null.cast("double").alias("start_sec"), null.cast("string").alias("text"))
    shots = homes.select("doc_id", F.col("start_sec").alias("t"), F.lit(0).alias("kind"), null.cast("long").alias("window_no"), null.cast("double").alias("w_start"), "start_sec", "text")
    both = shots.unionByName(marks)
    # block by block of time, so a long recording is not carried in one task
    blocked = with_block(both.withColumn("shot", F.when(F.col("kind") == 0, F.struct("start_sec", "text"))), F.floor(F.col("t") / 1800))
    found = blockwise_fill(blocked, ["doc_id"], ["t", "kind", "window_no", "text"], "shot", "last").where((F.col("kind") == 1) & (F.col("w_start") - F.col("last.start_sec") <= config.carry_seconds))
    return found.select("doc_id", "window_no", F.col("last.text").alias("text"), F.col("last.start_sec").alias("start_sec"))


def joined_lines(texts: Column, config: Config = DEFAULT) -> Column:
    """Lines of an array of screen texts, without those that an earlier kept line has in it, joined by " | " and cut at a line.

    Once the kept lines are longer than what is shown, no further one can change
    the result and none is compared: a window of thousands of screens would
    compare all its lines with each other.
    """
    lines = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, r"\r?\n"))), lambda x: F.trim(x)), lambda x: x != "")
    full = lambda a: F.length(F.array_join(a, " | ")) > config.screen_chars
    kept = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when(full(a) | F.exists(a, lambda s: F.instr(F.lower(s), F.lower(x)) > 0), a).otherwise(F.array_append(a, x)))
    whole = F.concat_ws(" | ", kept)
    cut = F.substring(whole, 1, config.screen_chars)
    return F.when(F.length(whole) > config.screen_chars, F.concat(F.regexp_replace(cut, r"(?s) \| (?:(?! \| ).)*$", ""), F.lit(" | …"))).otherwise(whole)


def composed_body(narration: Column, screen: Column, inherited: Column) -> Column:
    label = F.when(inherited, "Still on screen").otherwise("On screen")
    n, s = F.coalesce(narration, F.lit("")), F.coalesce(screen, F.lit(""))
    return F.when((n != "") & (s != ""), F.concat(F.lit("Narration: "), n, F.lit("\n"), label, F.lit(": "), s)).when(n != "", n).otherwise(F.concat(label, F.lit(": "), s))


def composed_timeline(segments: DataFrame, screens: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, start, end, kind, inherited, has_screen_text, body: windows of speech with their screens and windows of screens alone."""
    windows = speech_windows(segments, config)
    # four parts of the plan read the homes
    homes = cut_lineage(screen_homes(windows, screens.where("start_sec is not null and text is not null").select("doc_id", "start_sec", "text").distinct(), config))
    own = homes.where("window_no is not null").groupBy("doc_id", "window_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "text"))), lambda x: x["text"]).alias("screens"), F.lit(False).alias("inherited"))
    carried = carried_screens(windows, homes, config).select("doc_id", "window_no", F.array("text").alias("screens"), F.lit(True).alias("inherited"))
    shown = windows.join(own.unionByName(carried), ["doc_id", "window_no"], "left")
    shown = shown.withColumn("inherited", F.coalesce("inherited", F.lit(False))).withColumn("line", joined_lines(F.coalesce("screens", F.array().cast("array<string>")), config))
    speech = shown.select("doc_id", "start", "end", F.lit("transcript_segment").alias("kind"), "inherited", (F.col("line") != "").alias("has_screen_text"), composed_body(F.col("text"), F.col("line"), F.col("inherited")).alias("body"))
    alone = orphan_windows(homes.where("window_no is null"), config)
    alone = alone.withColumn("line", joined_lines(F.col("texts"), config))
    screens_only = alone.select("doc_id", "start", "end", F.lit("screen_capture").alias("kind"), F.lit(False).alias("inherited"), (F.col("line") != "").alias("has_screen_text"), composed_body(F.lit(""), F.col("line"), F.lit(False)).alias("body"))
    return speech.unionByName(screens_only)


class _Orphans(Fold):
    """state: start, end, size, texts of the open session."""

    def __init__(self, config: Config):
        self.chars, self.seconds = config.window_chars, config.window_seconds

    def step(self, state: list | None, row: tuple) -> tuple[list, list[tuple]]:
        t, text = row
        if state and (t - state[1] > self.seconds or state[2] >= self.chars):
            return [t, t, len(text), [text]], self.flush(state)
        start, _, size, texts = state or (t, t, -1, [])
        return [start, t, size + len(text) + 1, [*texts, text]], []

    def flush(self, state: list | None) -> list[tuple]:
        return [(state[0], state[1], len(state[3]), state[3])] if state else []


def orphan_windows(orphans: DataFrame, config: Config = DEFAULT, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Screens outside of all windows in sessions: doc_id, session_no, start, end, n_screens, texts; a new one after a gap of over window_seconds or once window_chars are reached."""
    rows = with_block(orphans.select("doc_id", "start_sec", "text"), F.coalesce(F.floor(F.col("start_sec") / block_seconds), F.lit(-(2**40))))
    found = blockwise_fold(rows, "doc_id", ["start_sec", "text"], ["start_sec", "text"], _Orphans(config), "start double, end double, n_screens long, texts array<string>", "session_no")
    return found.select("doc_id", "session_no", "start", "end", "n_screens", "texts")


def gap_sessions(events: DataFrame, entity: str, time: str, gap_seconds: float, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Sessions by gaps alone: entity, session_no, start, end, n. A gap of exactly gap_seconds does not split. Sessions are summed per block of time before they are put together."""
    t = F.col(time)
    rows = with_block(events.select(entity, time), F.coalesce(F.floor(t.cast("double") / block_seconds), F.lit(-(2**40))))
    per = Window.partitionBy(entity, BLOCK).orderBy(time)
    new = F.coalesce((t - F.lag(t).over(per) > gap_seconds).cast("int"), F.lit(0))
    parts = rows.withColumn("__new", new).withColumn("__part", F.sum("__new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.groupBy(entity, BLOCK, "__part").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))
    # of a block's parts the first and the last may go on in its neighbours; the window is over parts, not over events
    own = Window.partitionBy(entity).orderBy(BLOCK, "__part")
    opens = F.coalesce((F.col("start") - F.lag("end").over(own) > gap_seconds).cast("int"), F.lit(0))
    numbered_ = parts.withColumn("__new", opens).withColumn("session_no", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return numbered_.groupBy(entity, "session_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def transcript_overview(segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, n_windows, duration, overview: the whole transcript in order, cut at a word."""
    windows = speech_windows(segments, config)
    # of the text no more windows are gathered than the overview can show
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1))
    shown = F.when(F.coalesce("__before", F.lit(0)) <= config.overview_chars, F.struct("window_no", "text"))
    one = windows.withColumn("__before", before).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("end").alias("duration"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"])).alias("full_text"))
    cut = F.substring("full_text", 1, config.overview_chars)
    text = F.when(F.length("full_text") > config.overview_chars, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit(" …"))).otherwise(F.col("full_text"))
    return one.select("doc_id", "n_windows", "duration", timestamp_label("duration").alias("length"), text.alias("overview"))


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks of two texts, white space collapsed, without case."""
    return difflib.SequenceMatcher(None, " ".join(a.lower().split()), " ".join(b.lower().split())).ratio()


def distinct_figures(screens: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """At most figures_most screens of a recording, longest texts first, none like one chosen before; by time.

    A streaming pass over rows sorted by length: a task holds the chosen texts
    of one recording alone, however many it has.
    """
    rows = screens.where("text is not null").select("doc_id", "start_sec", "text", F.length("text").alias("n"))
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("n"), "start_sec", "text")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chosen = None, []
        by_time = lambda: [(doc, *x) for x in sorted(chosen)]
        for pdf in batches:
            out = []
            for d, t, text in zip(pdf["doc_id"], pdf["start_sec"], pdf["text"]):
                if d != doc:
                    out += by_time()
                    doc, chosen = d, []
                if len(chosen) < config.figures_most and all(similarity(text, c) < config.figure_similarity for _, c in chosen):
                    chosen.append((t, text))
            yield pd.DataFrame(out, columns=["doc_id", "start_sec", "text"])
        yield pd.DataFrame(by_time(), columns=["doc_id", "start_sec", "text"])

    return ordered.mapInPandas(pick, "doc_id string, start_sec double, text string")


def sampled_frames(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Frames (doc_id, t, scene) kept by the sampling rule: the first, a change of scene, or a gap since the last one kept; the first frames_most."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, last, n = None, None, 0
        for pdf in batches:
            keep = []
            for d, t, scene in zip(pdf["doc_id"], pdf["t"], pdf["scene"]):
                if d != doc:
                    doc, last, n = d, None, 0
                take = n < config.frames_most and (last is None or scene > config.scene_change or t - last >= config.frame_gap_seconds)
                if take:
                    last, n = t, n + 1
                keep.append(take)
            yield pdf[keep]

    rows = frames.select("doc_id", F.col("t").cast("double").alias("t"), F.col("scene").cast("double").alias("scene"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "t").mapInPandas(fold, "doc_id string, t double, scene double")


def timeline_markdown(timeline: DataFrame) -> DataFrame:
    """doc_id, n_speech, n_screen, markdown of a composed timeline."""
    line = F.concat(F.lit("### "), timestamp_label("start"), F.lit("–"), timestamp_label("end"), F.lit("\n\n"), F.col("body"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = timeline.groupBy("doc_id").agg(count(F.col("kind") == "transcript_segment").alias("n_speech"), count(F.col("has_screen_text")).alias("n_screen"), F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))).alias("rows"))
    return one.select("doc_id", "n_speech", "n_screen", F.array_join(F.transform("rows", lambda x: x["line"]), "\n\n").alias("markdown"))


def passage_header(source_file: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), source_file, F.lit(" · "), timestamp_label(start), F.lit("–"), timestamp_label(end), F.lit("]\n"))


def segment_passages(timeline: DataFrame, source_file: Column) -> DataFrame:
    """Passages of a composed timeline with their metadata: doc_id, source_type, source_file, chunk_type, segment_index, page, start_sec, end_sec, start_time, end_time, row_key, has_screen_text, inherited, text. Numbered by start within a recording."""
    order = Window.partitionBy("doc_id").orderBy("start", "kind", "body")
    rows = timeline.withColumn("segment_index", F.row_number().over(order) - 1)
    label = timestamp_label("start")
    return rows.select("doc_id", F.lit("video").alias("source_type"), source_file.alias("source_file"), F.col("kind").alias("chunk_type"), "segment_index", F.col("segment_index").alias("page"), F.round("start", 2).alias("start_sec"), F.round("end", 2).alias("end_sec"), label.alias("start_time"), timestamp_label("end").alias("end_time"), label.alias("row_key"), "has_screen_text", "inherited", F.concat(passage_header(source_file, F.col("start"), F.col("end")), F.col("body")).alias("text"))


def figure_passages(figures: DataFrame, source_file: Column, image_path: Column) -> DataFrame:
    """Passages of screenshots (doc_id, start_sec, text) with their metadata, numbered by time within a recording."""
    label = timestamp_label("start_sec")
    text = F.concat(F.lit("["), source_file, F.lit(" · screen at "), label, F.lit("]\nScreenshot of the recording '"), source_file, F.lit("' at "), label, F.lit(".\nText on screen: "), F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("start_sec", "text")
    return figures.select("doc_id", F.lit("video").alias("source_type"), source_file.alias("source_file"), F.lit("figure").alias("chunk_type"), (F.row_number().over(order) - 1).alias("segment_index"), F.round("start_sec", 2).alias("start_sec"), label.alias("start_time"), F.lit(True).alias("has_screen_text"), image_path.alias("image_path"), text.alias("text"))
