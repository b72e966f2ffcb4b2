"""Transcripts and screen text of recordings: sidecar files, and plug-in places for speech and image models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import denoise_lines, ocr_lines, srt_time

from .files import extracted, store_of

TRANSCRIPT = "source_file string, language string, duration_sec double, model string, text string, segments array<struct<start:double,end:double,text:string>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per transcript file (JSON)."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)


def segments_of(transcripts_: DataFrame) -> DataFrame:
    """doc_id (the file's name), seg_no, start_sec, end_sec, text of all segments with text."""
    rows = transcripts_.select(F.col("source_file").alias("doc_id"), F.posexplode("segments").alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).alias("seg_no"), F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"), F.trim("s.text").alias("text")).where("text <> ''")


def transcribed(files: DataFrame, model: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """Segments that a speech model makes of media files: path, error, start_sec, end_sec, text."""
    return extracted(files, model, "start_sec double, end_sec double, text string")


def screen_text(files: DataFrame, model: Callable[[str, bytes], Iterator[dict]], min_chars: int = 15) -> DataFrame:
    """Cleaned text that an image model reads off frames: path, error, start_sec, text; too short ones dropped."""
    rows = extracted(files, model, "start_sec double, text string")
    return rows.withColumn("text", denoise_lines(ocr_lines("text"))).where(F.col("error").isNotNull() | (F.length("text") >= min_chars))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write images (doc_id, name, content) below a shared folder by document: doc_id, name, image_path, error.

    An image is written when the result is; one that is there is written anew, so
    repeated tasks do no harm. Of a name the last part alone counts. One that
    can't be written, or has no content, has an error and a null path.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = store_of(folder)
        for pdf in batches:
            out = []
            for doc, name, content in zip(pdf["doc_id"], pdf["name"], pdf["content"]):
                try:
                    place = "/".join(re.split(r"[/\\]", x)[-1] for x in (doc, name))
                    if not content or {"", ".", ".."} & set(place.split("/")):
                        raise ValueError("no content or no name")
                    files.create_dir(f"{root}/{place.split('/')[0]}", recursive=True)
                    with files.open_output_stream(f"{root}/{place}") as f:
                        f.write(content)
                    out.append((doc, name, place, None))
                except Exception as e:
                    out.append((doc, name, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["doc_id", "name", "image_path", "error"])

    return images.select("doc_id", "name", "content").mapInPandas(write, "doc_id string, name string, image_path string, error string")


def subtitles(segments: DataFrame) -> DataFrame:
    """doc_id, seg_no, entry: numbered subtitle entries; written in order they are a subtitle file."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_sec", "seg_no"))
    entry = F.concat(n.cast("string"), F.lit("\n"), srt_time("start_sec"), F.lit(" --> "), srt_time("end_sec"), F.lit("\n"), F.trim("text"), F.lit("\n"))
    return segments.select("doc_id", "seg_no", n.alias("entry_no"), entry.alias("entry"))


def write_sidecars(segments: DataFrame, path: str) -> None:
    """Text, subtitle and JSON sidecars below a folder, by recording. Lines are sorted within a recording's files; nothing is gathered."""
    text = segments.select("doc_id", "start_sec", "seg_no", F.col("text").alias("value"))
    text.repartition("doc_id").sortWithinPartitions("doc_id", "start_sec", "seg_no").select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(f"{path}/text")
    subs = subtitles(segments).select("doc_id", "entry_no", F.col("entry").alias("value"))
    subs.repartition("doc_id").sortWithinPartitions("doc_id", "entry_no").select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(f"{path}/srt")
    segments.repartition("doc_id").sortWithinPartitions("doc_id", "start_sec", "seg_no").write.mode("overwrite").partitionBy("doc_id").json(f"{path}/json")
