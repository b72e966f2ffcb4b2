"""Files as rows: listing with checks, and extractors that never fail a whole job."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config
from brindle.functions.text import extension, file_name

# The kinds of files that are taken in.
KINDS = {".pdf": "pdf", ".xlsx": "sheet", ".xls": "sheet", ".xlsm": "sheet", ".csv": "sheet", ".mp4": "media", ".mkv": "media", ".mov": "media", ".avi": "media", ".webm": "media", ".mp3": "media", ".wav": "media", ".m4a": "media", ".json": "transcript"}


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI of any store that Arrow knows, or of a local path."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def with_checks(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add filename, kind and problem (unknown_type, empty_file, too_large or null) to rows of the binaryFile source; that source itself passes over files without content."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[extension("path")]
    named = files.withColumn("filename", file_name("path")).withColumn("kind", kind)
    return named.withColumn("problem", F.when(F.col("kind").isNull(), "unknown_type").when(F.col("length") == 0, "empty_file").when(F.col("length") > config.upload_bytes, "too_large"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return with_checks(spark.read.format("binaryFile").load(path))


def extracted(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that an extractor makes of each file's bytes, with path and error; a file that fails gives one row with its error."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [{**dict.fromkeys(names), **r, "path": path, "error": None} for r in extractor(path, content)]
                except Exception:
                    rows = [{**dict.fromkeys(names), "path": path, "error": traceback.format_exc(limit=1)}]
                yield pd.DataFrame(rows, columns=["path", "error", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")
