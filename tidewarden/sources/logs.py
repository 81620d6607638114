"""Service log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.functions.text import log_line_level

_STAMP = r"^\[?([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2})"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they came from and their order within it.

    One file is one ordered stream of lines, so ``wholetext`` is off and the running id
    grows along every file.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("line_no"))


def log_time(line: Column) -> Column:
    """Leading time of a line, in either of the two spellings found in logs."""
    text = F.concat_ws(
        " ",
        F.concat_ws("-", *[F.regexp_extract(line, _STAMP, i) for i in (1, 2, 3)]),
        F.regexp_extract(line, _STAMP, 4),
    )
    return F.try_to_timestamp(text)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Adds ``level``, ``logged_at`` and ``message`` (the text after time and level tag)."""
    line = F.col("line")
    return (
        lines.withColumn("level", log_line_level(line))
        .withColumn("logged_at", log_time(line))
        .withColumn("message", F.regexp_replace(line, _STAMP + r"\]? (\[[A-Z]+\] )?", ""))
    )
