"""Files that arrive in a folder, taken in as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.files import with_checks

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", most_a_batch: int = 1000) -> DataFrame:
    """A stream of the folder's files with their checks; files of its subfolders aren't taken."""
    stream = spark.readStream.option("maxFilesPerTrigger", most_a_batch).format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return with_checks(stream)


def ingest(files: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, refuse: Callable[[DataFrame, int], None] | None = None, refresh: Callable[[int], None] | None = None, settle_seconds: float = 0.0) -> StreamingQuery:
    """Run `take` on the good files of each batch and `refuse` on the others; the checkpoint's log sees to it that a file is taken once.

    A batch waits until its newest file has not changed for settle_seconds.
    `refresh` runs after each batch that took any file, for instance to rebuild
    an index. A batch that `take` fails on goes to `refuse` with the error as its
    problem, and the stream goes on; without `refuse` the stream fails. Batches
    may be repeated after a failure, so `take` should be idempotent in its batch id.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            good = rows.where("problem is null")
            newest, n = good.agg(F.unix_micros(F.max("modificationTime")), F.count(F.lit(1))).first()
            if newest is not None and settle_seconds > 0:
                time.sleep(max(0.0, settle_seconds - (time.time() - newest / 1e6)))
            try:
                if n:
                    take(good, number)
                    if refresh is not None:
                        refresh(number)
            except Exception as e:
                if refuse is None:
                    raise
                refuse(good.withColumn("problem", F.lit(f"failed: {str(e)[:200]}")), number)
            if refuse is not None:
                bad = rows.where("problem is not null")
                if bad.limit(1).count():
                    refuse(bad, number)
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over one table's parquet file or folder."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream is of a folder; of this one the file alone
