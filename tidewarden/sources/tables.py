"""State tables on a shared file system: history appends, the ban table's changes, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewarden.schemas import ACTIVE_BANS, BAN_HISTORY
from tidewarden.sources.changes import CHANGE, Log, as_changes, fold_changes

_BAN_CHANGES = T.StructType([*ACTIVE_BANS.fields, *CHANGE.fields])


#: bits of an id: number of the write, range within it, row within the range
_RANGE_BITS, _ROW_BITS = 13, 30


def history_append(rows: DataFrame, path: str, run: str, sequence: int) -> int | None:
    """Append history rows once; a repeat of the same run and sequence writes nothing.

    Rows lie in one directory per day, so that report ranges prune files. They are dealt out by time in at most
    8,192 ranges, and each gets its place, from which :func:`read_history` makes an ``id`` that grows from write
    to write and with time within a write. No task orders more than a range.
    """
    day = F.to_date(F.timestamp_seconds("timestamp_epoch"))
    order = ["timestamp_epoch", "client_ip", "action"]
    n = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << _RANGE_BITS)
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    place = F.shiftleft(F.shiftright(at, 33), _ROW_BITS) + at.bitwiseAND(F.lit((1 << 33) - 1))
    held = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BAN_HISTORY.fields]
    placed = ordered.select(*held, place.alias("place")).withColumn("day", day)
    return Log(rows.sparkSession, path).append(placed, run, sequence, ["day"])


def prune_days(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """On a table laid out by ``day``, read only the directories from one time to another."""
    if "day" not in df.columns:
        return df
    return df.filter(F.col("day").between(F.to_date(first), F.to_date(last)))


def read_history(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """History rows, filtered on the partition day as well as on the exact second.

    An end that is not given is no condition.
    """
    kept = T.StructType([*BAN_HISTORY.fields, T.StructField("place", T.LongType()), T.StructField("day", T.DateType())])
    rows = Log(spark, path).read(kept)
    for bound, end in ((since, "since"), (until, "until")):
        if bound is None:
            continue
        second, day = F.col("timestamp_epoch"), F.to_date(F.timestamp_seconds(F.lit(bound)))
        rows = rows.filter((second >= bound) & (F.col("day") >= day) if end == "since" else (second <= bound) & (F.col("day") <= day))
    number = F.shiftleft("entry", _RANGE_BITS + _ROW_BITS) + F.col("place")
    return rows.select(number.alias("id"), *BAN_HISTORY.names, "day")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: rows of ``changes`` win over rows of ``current`` with their key."""
    untouched = current.join(changes.select(*keys), keys, "left_anti")
    return untouched.unionByName(changes, allowMissingColumns=True)


def change_bans(spark: SparkSession, path: str, run: str, sequence: int, opened: DataFrame | None = None,
                lifted: DataFrame | None = None, opened_at: Column | int = 0, lifted_at: Column | int = 0) -> int | None:
    """Record opened bans and lifted ones (``client_ip``) in the ban table that all sources share.

    Times are seconds, columns of the rows or one number. A ban opened in the second in which one is lifted
    comes after it.
    """
    parts = []
    if lifted is not None:
        gone = lifted.select("client_ip", (F.lit(lifted_at).cast("long") * 2).alias("at")).groupBy("client_ip").agg(F.max("at").alias("at"))
        parts.append(as_changes(gone, F.col("at"), run, sequence, True).drop("at"))
    if opened is not None:
        held = [c for c in ACTIVE_BANS.names if c in opened.columns]
        fresh = opened.select(*held, (F.lit(opened_at).cast("long") * 2 + 1).alias("at"))
        parts.append(as_changes(fresh, F.col("at"), run, sequence).drop("at"))
    changes = parts[0] if len(parts) == 1 else parts[1].unionByName(parts[0], allowMissingColumns=True)
    whole = [F.col(f.name).cast(f.dataType) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _BAN_CHANGES.fields]
    return Log(spark, path).append(changes.select(*whole), run, sequence)


def record_step(step, spark: SparkSession, path: str, run: str, sequence: int, now: int) -> int | None:
    """Record what a ledger step opened and lifted: list syncs, manual, geo and monitor bans alike."""
    return change_bans(spark, path, run, sequence, step.opened, step.lifted, now, now)


def read_bans(spark: SparkSession, path: str) -> DataFrame:
    """The ban table: all committed changes of all writers, folded."""
    return fold_changes(Log(spark, path).read(_BAN_CHANGES), ["client_ip"])


def compact_bans(spark: SparkSession, path: str) -> int | None:
    return Log(spark, path).compact(_BAN_CHANGES, ["client_ip"])


def whitelist_replace(current: DataFrame, addresses: DataFrame, source: str) -> DataFrame:
    """Swap the entries of one source; an address another source holds stays with it."""
    kept = current.filter(F.col("source") != source).select("ip_address", "source")
    fresh = addresses.select(F.col("address").alias("ip_address")).distinct()
    added = fresh.join(kept, "ip_address", "left_anti").withColumn("source", F.lit(source))
    return kept.unionByName(added)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``; an unfinished write has no success marker."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write a whole new version next to the old ones; readers move once it is complete."""
    if version is None:
        done = _versions(df.sparkSession, path)
        version = done[-1] + 1 if done else 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest complete version (below ``before`` when given), or no rows."""
    done = [v for v in _versions(spark, path) if before is None or v < before]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={done[-1]}")


def kept_once(df: DataFrame, path: str) -> DataFrame:
    """The same rows, computed and written now; whatever uses them reads the file."""
    version = write_snapshot(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/version={version}")
