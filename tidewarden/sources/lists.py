"""Allow and block lists: pick the copy to use, parse lines, resolve names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.functions.addresses import is_unspecified, parse_address
from tidewarden.functions.domains import is_hostname
from tidewarden.functions.text import strip

# Sink addresses that introduce a hosts-file line.
_SINK_ADDRESS = r"^(0\.0\.0\.0|127\..*|::|::1)$"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Text files to ``(source_name, line)``; the file is the source."""
    return spark.read.text(path).select(
        F.input_file_name().alias("source_name"), F.col("value").alias("line"))


def good_copies(fetches: DataFrame, order: str = "fetched_at") -> DataFrame:
    """``(source_name, order)`` of the newest fetch with a 2xx status of every source."""
    return fetches.filter("status BETWEEN 200 AND 299").groupBy("source_name").agg(F.max(order).alias(order))


def list_latest_good(snapshots: DataFrame, order: str = "fetched_at", fetches: DataFrame | None = None) -> DataFrame:
    """Lines of the newest copy with a 2xx status of every source.

    A failed or unchanged fetch falls back to the copy before it; a source that never had
    a good copy gives no rows. ``fetches`` has a row for every fetch (``source_name``, order, ``status``),
    also where the copy had no lines; without it such a copy does not show, and the one before is used.
    """
    good = snapshots.filter("status BETWEEN 200 AND 299")
    newest = good_copies(snapshots if fetches is None else fetches, order)
    return good.join(newest, ["source_name", order], "left_semi")


def list_candidate(line: Column) -> Column:
    """What a list line offers: its only field, or the name behind a sink address."""
    # a comment may follow the entry; a line that starts with one is left empty
    body = strip(F.regexp_replace(strip(F.regexp_replace(line, "^\ufeff", "")), r"(?s)[#;].*$", ""))
    fields = F.split(body, r"(?U)\s+")
    return F.when(F.size(fields) == 1, fields[0]).when(fields[0].rlike(_SINK_ADDRESS), F.get(fields, 1))


def parse_list(lines: DataFrame) -> DataFrame:
    """Adds ``entry`` (address, prefix or host name) and drops the lines that hold none."""
    return lines.withColumn("entry", list_candidate(F.col("line"))).filter(
        ~F.contains("entry", F.lit("://")) & (is_hostname(F.col("entry")) | parse_address("entry").isNotNull()))


def _host_key(name: str) -> Column:
    return F.regexp_replace(F.lower(name), r"\.$", "")


def resolve_list(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """``(source_name, entry, address)``: addresses as they are, host names by their answers.

    Names are compared without regard to case and to a dot at the end.
    Names without an answer and unspecified answers drop out. A literal ``0.0.0.0`` entry
    is kept.
    """
    tagged = entries.select("source_name", "entry").distinct().withColumn(
        "literal", parse_address("entry").isNotNull())
    literal = tagged.filter("literal").select("source_name", "entry", F.col("entry").alias("address"))
    resolvable = answers.select(_host_key("host").alias("host_key"), "address").distinct().filter(
        (parse_address("address")["kind"] == "address") & ~is_unspecified("address"))
    named = (tagged.filter("NOT literal").withColumn("host_key", _host_key("entry"))
             .join(resolvable, "host_key").select("source_name", "entry", "address"))
    return literal.unionByName(named)


def list_desired_set(resolved: DataFrame) -> DataFrame:
    """Distinct addresses over all sources."""
    return resolved.select("address").distinct()
