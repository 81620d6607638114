"""Country ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewarden.schemas import GEO_RANGES


def load_geo_ranges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``network, country_iso, registered_iso`` from CSV with a header, or Parquet."""
    reader = spark.read.schema(GEO_RANGES)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
