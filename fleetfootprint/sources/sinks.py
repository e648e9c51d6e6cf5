"""Saving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> str:
    """Write in parallel; ``partition_by`` lets readers skip whole folders."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
