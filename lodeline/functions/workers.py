"""What Python workers need of the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def visible(spark: SparkSession) -> None:
    """Python workers find this library where the driver has it, whatever folder they start in."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
