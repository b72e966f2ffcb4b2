"""Session, table and checkpoint helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brindle")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BRINDLE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; set one only where it is unset.

    A machine-local folder is accepted in local mode alone, since on a cluster
    the executors could not read each other's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"brindle-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as a compressed table below the checkpoint folder and read it back: for many rows of which later plans take some columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove the tables that `written` has made so far, once no plan reads them any more."""
    while _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def widened(scan: DataFrame) -> DataFrame:
    """A plain scan spread over the cores where it has too few splits for CPU-heavy work; else as it is."""
    want = cores(scan.sparkSession)
    return scan.repartition(want) if scan.rdd.getNumPartitions() * 2 <= want else scan


def fanout(spark: SparkSession) -> int:
    """Partitions for CPU-heavy work on small rows, which adaptive execution would join into few by their bytes."""
    return max(3 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Shuffle rows evenly before CPU-heavy work; spark.sql.shuffle.partitions is the least, as for any shuffle of this size."""
    spark = df.sparkSession
    return df.repartition(max(cores(spark) * per_core, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_brindle_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if not name.endswith(".pyc"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)  # fetched by the executors from the driver
    sc._brindle_shipped = True
