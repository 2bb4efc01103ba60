"""Sessions and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session of one machine, as tests and ``bench.py`` use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def has_table(folder: str, name: str) -> bool:
    """Whether a local folder has the table."""
    return os.path.exists(f"{folder}/{name}.parquet")


__all__ = ["has_table", "local_session", "table"]
