"""The ban ledger as keyed stream state: one small record per client, timers for expiry."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewarden.functions.text import MAX_DURATION, epoch_text
from tidewarden.operators.detect import detection_order
from tidewarden.operators.membership import static_whitelist, whitelist_exclude
from tidewarden.params import Params
from tidewarden.schemas import WHITELIST
from tidewarden.sources.tables import change_bans, history_append, read_snapshot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = ("client string, at timestamp, action string, target string, n long, protocol string, reason string, "
          "source string, offense_level int, ban_duration long, ban_until_epoch long, is_permanent boolean, country string")
_STATE = T.StructType([
    T.StructField("level", T.IntegerType()), T.StructField("last", T.LongType()),
    T.StructField("until", T.LongType()), T.StructField("banned", T.BooleanType()),
])


def _ledger_processor(params: Params) -> StatefulProcessor:
    base, growth, lag = params.ban_duration, max(params.progressive_multiplier, 1), params.sweep_lag
    climb, top, reset_after = params.progressive_enabled, params.progressive_max_level, params.progressive_reset_after
    dry = params.dry_run
    columns = [part.split()[0] for part in EVENTS.split(", ")]
    clamp = MAX_DURATION

    def stamp(second: int) -> pd.Timestamp:
        return pd.Timestamp(second, unit="s")

    class Ledger(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.ban = handle.getValueState("ban", _STATE)

        def _unban(self, client: str, until: int) -> list:
            return [client, stamp(until), "UNBAN", "-", 0, "-", "expired", "-", 0, 0, until, False, ""]

        def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
            (client,) = key
            level, last, until, banned = self.ban.get() if self.ban.exists() else (0, 0, 0, False)
            out = []
            found = pd.concat(list(rows)).sort_values("at_epoch")
            for row in found.itertuples(index=False):
                if dry:  # nothing marks the client
                    out.append([client, stamp(row.at_epoch), "DRY", row.target, row.n, row.protocol,
                                f"dry-run ({row.reason})", row.source, 0, 0, 0, False, row.country or ""])
                    continue
                if banned and (until == 0 or row.at_epoch < until + lag):
                    continue
                if banned:
                    out.append(self._unban(client, until))
                forever, length, shown = bool(row.permanent), base, 0
                if row.source == "monitor" and climb and not forever:
                    level = 1 if level == 0 or row.at_epoch - last > reset_after else level + 1
                    last, shown = int(row.at_epoch), level
                    if level > 1:
                        length = min(base * growth ** min(level - 1, 64), clamp)
                    if 0 < top <= level:
                        forever, length = True, 0
                banned, until = True, 0 if forever or length <= 0 else int(row.at_epoch) + length
                out.append([client, stamp(row.at_epoch), "BAN", row.target, row.n, row.protocol, row.reason,
                            row.source, shown, length, until, forever, row.country or ""])
            if dry:
                yield pd.DataFrame(out, columns=columns)
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if banned and until:
                self.handle.registerTimer(until * 1000)
            elif not banned and level:
                self.handle.registerTimer((last + reset_after + 1) * 1000)
            self.ban.update((level, last, until, banned))
            if out:
                yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
            """End of a ban, or of an offence nobody needs to remember."""
            (client,) = key
            out = []
            level, last, until, banned = self.ban.get()
            if banned and until and expired.getExpiryTimeInMs() >= until * 1000:
                out.append(self._unban(client, until))
                self.ban.update((level, last, 0, False))
                if level:
                    self.handle.registerTimer((last + reset_after + 1) * 1000)
                else:
                    self.ban.clear()
            elif not banned:
                self.ban.clear()
            if out:
                yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return Ledger()


def stream_ledger(detections: DataFrame, params: Params) -> DataFrame:
    """BAN and UNBAN events of a watermarked stream of detections, keyed by client.

    Feed it the table that :func:`detections_sink` writes: that holds at most one row per
    client and second, so no micro-batch brings a large group to one client's state. The
    state itself is a level and three numbers. A ban keeps the country of its detection, so that
    a country that is allowed later lifts it. A dry run gives one DRY event per row and keeps no state.
    """
    country = F.col("country") if "country" in detections.columns else F.lit("")
    timed = detections.withColumn("at_epoch", F.unix_seconds("at")).withColumn("country", F.coalesce(country, F.lit("")))
    return timed.groupBy("client").transformWithStateInPandas(
        _ledger_processor(params), EVENTS, "append", "eventTime")


def deciding_detections(found: DataFrame, whitelist: DataFrame, params: Params) -> DataFrame:
    """Detections of clients that are not allowed, one deciding hit per client and second."""
    kept = whitelist_exclude(static_whitelist(found, params), whitelist)
    rest = [c for c in kept.columns if c != "client"]
    return kept.groupBy("client", F.unix_seconds("at").alias("second")).agg(
        F.min_by(F.struct(*rest), F.struct(F.col("at"), detection_order())).alias("d")).select("client", "d.*")


def run_name(spark: SparkSession) -> str:
    """The running stream's id, which its checkpoint keeps; a fresh checkpoint brings another one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def detections_sink(spark: SparkSession, path: str, whitelist_path: str, params: Params):
    """``foreachBatch`` function for a stream of detections.

    The allow list is read again for every batch, so changes to it count at once. A
    repeated batch replaces its own files, those of its run.
    """

    def write(found: DataFrame, batch_id: int) -> None:
        allowed = read_snapshot(spark, whitelist_path, WHITELIST)
        deciding_detections(found, allowed, params).write.mode("overwrite").parquet(f"{path}/run={run_name(found.sparkSession)}/batch={batch_id}")

    return write


def history_rows(events: DataFrame) -> DataFrame:
    """History table rows of ledger events."""
    epoch = F.unix_seconds("at")
    ban, dry = F.col("action").isin("BAN", "DRY"), F.col("action") == "DRY"
    dash = F.lit("-")
    lasting = F.when(dry, F.lit("dry-run")).when(F.col("is_permanent") | (F.col("ban_duration") == 0), F.lit("permanent")).otherwise(
        F.concat(F.col("ban_duration").cast("string"), F.lit("s")))
    return events.select(
        epoch.alias("timestamp_epoch"), epoch_text(epoch).alias("timestamp_text"), "action",
        F.col("client").alias("client_ip"), F.col("target").alias("domain"),
        F.when(ban, F.col("n").cast("string")).otherwise(dash).alias("count"),
        F.when(ban, lasting).otherwise(dash).alias("duration"), "protocol", "reason")


def ledger_sink(spark: SparkSession, bans_path: str, history_path: str, params: Params):
    """``foreachBatch`` function that appends history and changes of the shared ban table.

    Both are logs that count every (run, batch) once: a repeated batch, another writer and a stream that starts
    over with a fresh checkpoint neither lose nor repeat a row. A batch writes what it changes, not the table.
    A dry run leaves history only.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        run = run_name(events.sparkSession)
        events = events.persist()
        history_append(history_rows(events), history_path, run, batch_id)
        if not params.dry_run:
            latest = events.groupBy("client").agg(F.max_by(F.struct(
                "action", "target", "n", "at", "ban_until_epoch", "ban_duration", "offense_level", "is_permanent",
                "reason", "protocol", "source", "country"), F.struct("at", F.col("action") == "BAN")).alias("e")).select("client", "e.*")
            now = F.unix_seconds("at")
            opened = latest.filter("action = 'BAN'").select(
                F.col("client").alias("client_ip"), F.col("target").alias("domain"), F.col("n").cast("long").alias("count"),
                epoch_text(now).alias("ban_time"), "ban_until_epoch", "ban_duration", "offense_level", "is_permanent",
                "reason", "protocol", "source", F.col("country").alias("geoip_country"), F.lit(params.geoip_mode).alias("geoip_mode"), now.alias("second"))
            lifted = latest.filter("action = 'UNBAN'").select(F.col("client").alias("client_ip"), now.alias("second"))
            change_bans(spark, bans_path, run, batch_id, opened, lifted, F.col("second"), F.col("second"))
        events.unpersist()

    return write
