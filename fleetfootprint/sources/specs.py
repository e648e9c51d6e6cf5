"""Chip specification sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfootprint.operators.reshape import union_all
from fleetfootprint.schemas import CPU_SPEC_SCHEMA, GPU_SPEC_SCHEMA


def read_cpu_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CPU_SPEC_SCHEMA).option("header", True).csv(path).drop("blank")


def read_gpu_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GPU_SPEC_SCHEMA).option("header", True).csv(path)


def chip_specs(cpus: DataFrame, gpus: DataFrame) -> DataFrame:
    """Both sheets in one table, tagged by type."""
    return union_all([cpus.withColumn("type", F.lit("CPU")), gpus.withColumn("type", F.lit("GPU"))])
