"""Reading of the small fixed tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from brindle.session import table


def setting(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One amount of size_limits, a table of a few rows."""
    row = table(spark, sf_dir, "size_limits").where(f"setting = '{name}'").select("amount").first()
    if row is None:
        raise ValueError(f"size_limits has no setting {name}")
    return int(row["amount"])
