"""Query-log ingest: read, normalise, deduplicate, retain."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.functions.text import strip
from tidewarden.functions.times import instant
from tidewarden.params import Params
from tidewarden.schemas import QUERY_ITEM, QUERY_LOG

EVENT_KEY = ["at", "at_ns", "client", "domain", "protocol"]

_RFC3339 = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
            r"([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Log envelopes (``{"data": [...]}``, one document per file) to one row per item."""
    envelopes = spark.read.schema(QUERY_LOG).json(path, multiLine=True)
    return envelopes.select(F.explode("data").alias("item")).select("item.*")


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines form of the log: one item per line, so large files split."""
    return spark.read.schema(QUERY_ITEM).json(path)


def stream_query_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(QUERY_ITEM)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def nanos_since(at: Column, at_ns: Column, start_us: Column) -> Column:
    """Nanoseconds from a start to an event, with the part Spark timestamps cannot hold; no far time overflows near its start."""
    return (F.unix_micros(at) - start_us) * 1000 + at_ns


def _fraction_tail(time: Column) -> Column:
    """Digits 7 to 9 of the fractional second as a number."""
    digits = F.regexp_extract(time, r"[.,]([0-9]+)", 1)
    return F.substring(F.rpad(digits, 9, "0"), 7, 3).cast("int")


def normalize_queries(items: DataFrame) -> DataFrame:
    """Typed query events; rows without a valid time, client or domain are dropped.

    Works on batch and streaming input. Two spellings of one instant with different zone
    offsets become the same event.
    """
    time = F.col("time")
    own, forwarded = strip(F.col("client")), strip(F.col("client_info.ip"))
    domain = F.coalesce(F.nullif(F.col("question.name"), F.lit("")), F.col("question.host"))
    # tested on the raw columns, so that the tests do not repeat the work of the columns below
    named = ~domain.isin("", ".") & ((own != "") | (forwarded != ""))
    return items.filter(named).select(
        # a timestamp cuts the fraction after six digits; the next three go to at_ns
        F.when(time.rlike(_RFC3339), F.try_to_timestamp(F.translate(time, ",", "."))).alias("at"),
        _fraction_tail(time).alias("at_ns"),
        F.coalesce(F.nullif(own, F.lit("")), forwarded).alias("client"),
        F.regexp_replace(F.lower(domain), r"\.$", "").alias("domain"),
        F.coalesce(F.nullif(F.col("client_proto"), F.lit("")), F.lit("dns")).alias("protocol"),
    ).filter("at IS NOT NULL")


def dedupe_queries(events: DataFrame) -> DataFrame:
    """One row per (time, client, domain, protocol)."""
    return events.dropDuplicates(EVENT_KEY)


def retain_recent(events: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    """Events younger than the longest detection window plus its slack."""
    return events.filter(F.col("at") > instant(as_of - timedelta(seconds=params.retention)))


def distinct_clients(events: DataFrame) -> DataFrame:
    """Every client once.

    The explode is a fence. Filters on a grouping column are moved below the aggregation,
    so without it the costly tests of an address would run once per query instead of once
    per client.
    """
    return events.select("client").distinct().select(F.explode(F.array("client")).alias("client"))
