"""Ban ledger: who is banned, for how long, and what the history says about it.

State lives in DataFrames. A step takes the present tables and gives back the next ones;
:func:`ledger_replay` runs a whole history of detections at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.functions.addresses import parse_address
from tidewarden.functions.text import MAX_DURATION, duration_for_level, duration_text, epoch_text
from tidewarden.operators.detect import detection_order, first_detection_per_client
from tidewarden.operators.geo import geo_auto_unban
from tidewarden.operators.membership import (
    not_already_banned, static_whitelist, whitelist_exclude, whitelist_hits,
)
from tidewarden.params import Params
from tidewarden.sources.tables import kept_once, upsert, whitelist_replace

BLOCKLIST = "external-blocklist"

# executors then need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Step:
    """Tables after one ledger step; ``history`` holds only the new rows."""

    active_bans: DataFrame
    history: DataFrame
    offenses: DataFrame | None = None
    whitelist: DataFrame | None = None
    lifted: DataFrame | None = None
    opened: DataFrame | None = None


def _history(rows: DataFrame, now: Column, action: Column, **fields: Column) -> DataFrame:
    """History rows from ban-like rows; unnamed fields are a dash."""
    text = {name: fields.get(name, F.lit("-")) for name in ("domain", "count", "duration", "protocol", "reason")}
    return rows.select(
        now.cast("long").alias("timestamp_epoch"), epoch_text(now).alias("timestamp_text"),
        action.alias("action"), F.col("client_ip"),
        *[text[name].cast("string").alias(name) for name in text])


# -- opening bans ---------------------------------------------------------------------------


def gate(detections: DataFrame, whitelist: DataFrame, bans: DataFrame, params: Params, match: str = "exact") -> DataFrame:
    """Detections that may lead to a ban: not allowed, not banned already."""
    allowed = whitelist_exclude(static_whitelist(detections, params), whitelist, match=match)
    return not_already_banned(allowed, bans)


def ban_rows(detections: DataFrame, offenses: DataFrame, params: Params, now: int) -> DataFrame:
    """Ban rows for gated detections, one per client.

    Only bans of the monitor that are not permanent anyway climb the offence ladder; all
    others keep level 0 and the base duration.
    """
    chosen = first_detection_per_client(detections)
    past = offenses.select(
        F.col("client_ip").alias("client"), F.col("offense_level").alias("past_level"),
        F.coalesce("last_offense_epoch", F.lit(0)).alias("past_at"), F.lit(True).alias("known"))
    joined = chosen.join(past, "client", "left")
    climbs = (F.col("source") == "monitor") & F.lit(params.progressive_enabled) & ~F.col("permanent")
    starts_over = F.col("known").isNull() | (
        (F.col("past_at") > 0) & (F.lit(now) - F.col("past_at") > params.progressive_reset_after))
    level = F.when(~climbs, 0).when(starts_over, 1).otherwise(F.col("past_level") + 1).cast("int")
    topped = climbs & F.lit(params.progressive_max_level > 0) & (F.col("offense_level") >= params.progressive_max_level)
    duration = F.when(topped, F.lit(0)).when(
        climbs, duration_for_level(params.ban_duration, F.col("offense_level"), params.progressive_multiplier)
    ).otherwise(F.lit(params.ban_duration)).cast("long")
    timed = joined.withColumn("offense_level", level).withColumn("is_permanent", F.col("permanent") | topped).withColumn(
        "ban_duration", duration)
    until = F.when(~F.col("is_permanent") & (F.col("ban_duration") > 0), F.lit(now) + F.col("ban_duration")).otherwise(F.lit(0))
    country = F.col("country") if "country" in detections.columns else F.lit("")
    return timed.select(
        F.col("client").alias("client_ip"), F.col("target").alias("domain"), F.col("n").cast("long").alias("count"),
        epoch_text(F.lit(now)).alias("ban_time"), until.cast("long").alias("ban_until_epoch"), "ban_duration",
        "offense_level", "is_permanent", "reason", "protocol", "source",
        F.coalesce(country, F.lit("")).alias("geoip_country"), F.lit(params.geoip_mode).alias("geoip_mode"))


def ban_history(bans: DataFrame, now: int) -> DataFrame:
    return _history(
        bans, F.lit(now), F.lit("BAN"), domain=F.col("domain"), count=F.col("count"),
        duration=duration_text(F.col("ban_duration"), F.col("is_permanent")),
        protocol=F.col("protocol"), reason=F.col("reason"))


def dry_run_history(detections: DataFrame, now: Column) -> DataFrame:
    """What a dry run writes for gated detections. It repeats while the violation lasts,
    because nothing marks the client."""
    return _history(
        detections.withColumnRenamed("client", "client_ip"), now, F.lit("DRY"), domain=F.col("target"),
        count=F.col("n"), duration=F.lit("dry-run"), protocol=F.col("protocol"),
        reason=F.concat(F.lit("dry-run ("), F.col("reason"), F.lit(")")))


def raised_offenses(bans: DataFrame, offenses: DataFrame, now: int) -> DataFrame:
    """Offence rows after new bans: level, time and the start of the present series."""
    stamp = epoch_text(F.lit(now))
    first = F.coalesce("first_offense", F.lit("")) if "first_offense" in offenses.columns else F.lit("")
    old = offenses.select("client_ip", first.alias("old_first"))
    raised = bans.filter("offense_level > 0").join(old, "client_ip", "left").select(
        "client_ip", "offense_level", F.lit(now).cast("long").alias("last_offense_epoch"),
        stamp.alias("last_offense"),
        F.when(F.col("offense_level") == 1, stamp).otherwise(F.col("old_first")).alias("first_offense"))
    return upsert(offenses, raised, ["client_ip"])


def apply_detections(detections: DataFrame, whitelist: DataFrame, bans: DataFrame, offenses: DataFrame,
                     params: Params, now: int) -> Step:
    """One evaluation: gate, choose, ban, and record."""
    open_ = gate(detections, whitelist, bans, params)
    if params.dry_run:
        return Step(bans, dry_run_history(open_, F.lit(now)), offenses, whitelist)
    opened = ban_rows(open_, offenses, params, now)
    return Step(
        upsert(bans, opened, ["client_ip"]), ban_history(opened, now),
        raised_offenses(opened, offenses, now), whitelist, opened=opened)


# -- lifting bans ---------------------------------------------------------------------------


def unban_rows(clients: DataFrame, reason: Column | str, now: int) -> DataFrame:
    """UNBAN history for ``client_ip`` rows, written whether or not a ban existed."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    return _history(clients, F.lit(now), F.lit("UNBAN"), reason=text)


def lift(bans: DataFrame, chosen: DataFrame, reason: str, now: int) -> Step:
    rest = bans.join(chosen.select("client_ip"), "client_ip", "left_anti")
    return Step(rest, unban_rows(chosen, reason, now), lifted=chosen)


def lift_where(bans: DataFrame, condition: Column, reason: str, now: int) -> Step:
    """As :func:`lift`, for bans that a condition on their own row picks: nothing is joined."""
    picked = F.coalesce(condition, F.lit(False))
    chosen = bans.filter(picked)
    return Step(bans.filter(~picked), unban_rows(chosen, reason, now), lifted=chosen)


def expire_bans(bans: DataFrame, now: int) -> Step:
    return lift_where(bans, (F.col("ban_until_epoch") > 0) & ~F.col("is_permanent") & (F.col("ban_until_epoch") <= now), "expired", now)


def lift_geo_bans(bans: DataFrame, params: Params, now: int) -> Step:
    return lift(bans, geo_auto_unban(bans, params), "geoip-auto-unban", now)


def flush_bans(bans: DataFrame, now: int, source: str | None = None) -> Step:
    """Lift every ban, or those of one source. Country bans also count by reason."""
    if source is None:
        return lift_where(bans, F.lit(True), "manual-flush", now)
    wanted = F.coalesce(F.col("source") == source, F.lit(False))
    if source == "geoip":
        wanted = wanted | (F.col("reason") == source)
    return lift_where(bans, wanted, f"{source}-flush", now)


# -- list synchronisation -------------------------------------------------------------------


def whitelist_sync(bans: DataFrame, whitelist: DataFrame, desired: DataFrame, now: int) -> Step:
    """Replace the external allow list and lift the bans it now forbids."""
    fresh = whitelist_replace(whitelist, desired, "external")
    step = lift(bans, whitelist_hits(bans, fresh), "external-whitelist", now)
    step.whitelist = fresh
    return step


def blocklist_bans(addresses: DataFrame, params: Params, now: int) -> DataFrame:
    permanent = params.blocklist_duration == 0
    until = 0 if permanent or params.blocklist_duration < 0 else now + params.blocklist_duration
    return addresses.select(
        F.col("address").alias("client_ip"), F.lit("-").alias("domain"), F.lit(0).cast("long").alias("count"),
        epoch_text(F.lit(now)).alias("ban_time"), F.lit(until).cast("long").alias("ban_until_epoch"),
        F.lit(params.blocklist_duration).cast("long").alias("ban_duration"), F.lit(0).alias("offense_level"),
        F.lit(permanent).alias("is_permanent"), F.lit(BLOCKLIST).alias("reason"), F.lit("-").alias("protocol"),
        F.lit(BLOCKLIST).alias("source"), F.lit("").alias("geoip_country"), F.lit("").alias("geoip_mode"))


def _list_actions(bans: DataFrame, whitelist: DataFrame, desired: DataFrame, params: Params, good: DataFrame) -> DataFrame:
    """Ban table, lists and allow list side by side, each exchanged once.

    ``__wanted``: the lists name ``__address`` and nothing allows it. ``__action``: what becomes of the row, ``open``,
    ``lift`` or ``keep``; null where a listed address gets no ban.
    """
    allowed = whitelist.select(F.col("ip_address").alias("__ip")).distinct().withColumn("__allowed", F.lit(True))
    listed = desired.select(F.col("address").alias("__address")).distinct().join(allowed, F.col("__address") == F.col("__ip"), "left")
    listed = listed.select("__address", "__allowed", F.lit(True).alias("__listed"))
    both = bans.withColumn("__held", F.lit(True)).join(listed, F.col("client_ip") == F.col("__address"), "full")
    wanted = F.col("__listed") & F.col("__allowed").isNull()
    if params.whitelist:
        wanted = wanted & ~F.col("__address").isin(*params.whitelist)
    held, gone = F.col("__held").isNotNull(), F.lit(False)
    if params.blocklist_auto_unban:
        any_good = good.limit(1).agg(F.count("*") > 0).scalar()
        gone = F.col("__listed").isNull() & (F.col("source") == BLOCKLIST) & any_good
    both = both.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))
    return both.withColumn("__action", F.when(held & gone, "lift").when(held, "keep").when(F.col("__wanted"), "open"))


def blocklist_sync(bans: DataFrame, whitelist: DataFrame, desired: DataFrame, params: Params, now: int,
                   good: DataFrame) -> Step:
    """Ban what the lists name, lift what they no longer name.

    ``good`` has a row for every source with a usable copy. Without any, bans stay, where lifting
    all of them would open the door on a mere download failure; a good copy that became empty lifts.
    An address that is named twice is banned once. A dry run notes all that is named, banned or not.
    """
    both = _list_actions(bans, whitelist, desired, params, good)
    opens = F.col("__wanted") if params.dry_run else F.col("__action") == "open"
    changed = both.withColumn("__opens", F.coalesce(opens, F.lit(False))).filter("__opens OR __action = 'lift'")
    made = F.col("__opens")
    ban_text = F.lit("dry-run") if params.dry_run else duration_text(F.lit(params.blocklist_duration), F.lit(params.blocklist_duration == 0))
    history = _history(
        changed.select(F.coalesce("client_ip", "__address").alias("client_ip"), "__opens"), F.lit(now),
        F.when(made, "DRY" if params.dry_run else "BAN").otherwise("UNBAN"), duration=F.when(made, ban_text).otherwise("-"),
        reason=F.when(made, f"dry-run ({BLOCKLIST})" if params.dry_run else BLOCKLIST).otherwise("external-blocklist-removed"))
    own = [F.col(f"`{c}`") for c in bans.columns]
    kept = both.filter("__action = 'keep'").select(*own)
    lifted = both.filter("__action = 'lift'").select(*own) if params.blocklist_auto_unban else None
    if params.dry_run:
        return Step(kept, history, lifted=lifted)
    opened = blocklist_bans(both.filter("__action = 'open'").select(F.col("__address").alias("address")), params, now)
    return Step(kept.unionByName(opened, allowMissingColumns=True), history, lifted=lifted, opened=opened)


# -- manual commands ------------------------------------------------------------------------


def manual_actions(commands: DataFrame, bans: DataFrame, whitelist: DataFrame, now: int,
                   params: Params = Params()) -> DataFrame:
    """History rows of ``ban`` and ``unban`` commands (``seq, target, command``), in order.

    A ban needs a client that is neither allowed nor banned at that point, where earlier
    commands count; an unban always leaves its row. A dry run bans nobody, so its bans do not count.
    """
    orders = commands.filter("command IN ('ban', 'unban')").withColumnRenamed("target", "client_ip")
    allowed = whitelist.select(F.col("ip_address").alias("client_ip"), F.lit(True).alias("allowed")).distinct()
    present = bans.select("client_ip", F.lit(True).alias("present")).distinct()
    allowed_here = F.coalesce("allowed", F.lit(False)) | F.col("client_ip").isin(*params.whitelist)
    counts = F.when((F.col("command") == "unban") | F.lit(not params.dry_run), F.col("command"))
    before = F.last(counts, ignorenulls=True).over(
        Window.partitionBy("client_ip").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    judged = orders.join(allowed, "client_ip", "left").join(present, "client_ip", "left").withColumn(
        "banned", F.when(before == "unban", F.lit(False)).when(
            (before == "ban") & F.lit(not params.dry_run), F.lit(True)).otherwise(
            F.coalesce("present", F.lit(False)))).withColumn("allowed", allowed_here)
    done = judged.filter("command = 'unban' OR NOT (allowed OR banned)")
    is_ban = F.col("command") == "ban"
    dash = F.lit("-")
    return _history(
        done, F.lit(now), F.when(is_ban, F.lit("DRY" if params.dry_run else "BAN")).otherwise(F.lit("UNBAN")),
        domain=F.when(is_ban, F.lit("manual")).otherwise(dash),
        count=F.when(is_ban, F.lit("0")).otherwise(dash),
        duration=F.when(is_ban, F.lit("dry-run" if params.dry_run else "permanent")).otherwise(dash),
        reason=F.when(is_ban & F.lit(params.dry_run), F.lit("dry-run (manual)")).otherwise(F.lit("manual")))


def manual_ban_rows(commands: DataFrame, bans: DataFrame, whitelist: DataFrame, params: Params, now: int) -> DataFrame:
    """The ban table after the commands: the last one of a client decides. A dry run opens no ban."""
    last = commands.filter("command IN ('ban', 'unban')").groupBy("target").agg(
        F.max_by("command", "seq").alias("command"), F.bool_or(F.col("command") == "unban").alias("lifted"))
    banned = last.filter("command = 'ban'").select(F.col("target").alias("client"))
    allowed = whitelist_exclude(static_whitelist(banned, params), whitelist)
    # a plain repeat of a ban keeps the present row; after an unban the row is a new one
    rest = bans.join(last.filter("lifted").select(F.col("target").alias("client_ip")), "client_ip", "left_anti")
    orders = not_already_banned(allowed, rest).select(
        F.timestamp_seconds(F.lit(now)).alias("at"), "client", F.lit("manual").alias("target"), F.lit(0).cast("long").alias("n"),
        F.lit("-").alias("protocol"), F.lit("manual").alias("reason"), F.lit("manual").alias("source"), F.lit(True).alias("permanent"))
    if params.dry_run:
        return rest
    none = bans.select("client_ip", F.lit(0).alias("offense_level"), F.lit(0).cast("long").alias("last_offense_epoch")).filter("false")
    return rest.unionByName(ban_rows(orders, none, params, now), allowMissingColumns=True)


def reset_offenses(offenses: DataFrame, commands: DataFrame) -> DataFrame:
    """Offences left after ``reset-offenses`` commands; one without a target clears all."""
    resets = commands.filter("command = 'reset-offenses'").select(F.coalesce("target", F.lit("")).alias("client_ip"))
    clears_all = resets.agg(F.coalesce(F.max(F.col("client_ip") == ""), F.lit(False))).scalar()
    return offenses.join(resets.distinct(), "client_ip", "left_anti").filter(~clears_all)


def whitelist_flush(whitelist: DataFrame) -> DataFrame:
    return whitelist.filter("source <> 'external'")


# -- enforcement ----------------------------------------------------------------------------


def enforcement_set(bans: DataFrame, now: int) -> DataFrame:
    """``family, client_ip, timeout`` of every ban in force; timeout 0 never ends."""
    live = bans.filter(~F.coalesce(
        (F.col("ban_until_epoch") > 0) & ~F.col("is_permanent") & (F.col("ban_until_epoch") <= now), F.lit(False)))
    timed = ~F.col("is_permanent") & (F.col("ban_until_epoch") > 0)
    return live.withColumn("family", parse_address("client_ip")["family"]).filter(
        "family IS NOT NULL").select(
        "family", "client_ip",
        F.when(timed, F.col("ban_until_epoch") - F.lit(now)).otherwise(F.lit(0)).cast("long").alias("timeout"))


# -- whole history --------------------------------------------------------------------------

#: of a client that is never free again, and of one that always is
_NEVER, _ALWAYS = 2 ** 62, -2 ** 62
_FOLDED = ("client string, at_epoch long, target string, n long, protocol string, reason string, source string, "
           "country string, offense_level int, ban_duration long, ban_until_epoch long, is_permanent boolean")


def _fold(params: Params):
    """Walk time-ordered detections of whole clients and keep those that open a ban.

    Batches arrive sorted by client and time, a client may span several of them, and only
    the present client's state is held. Within a batch the walk jumps from ban to ban. A row with
    ``resumed`` set holds what is known of a client beforehand and comes before its detections.
    """
    base, growth, lag = params.ban_duration, max(params.progressive_multiplier, 1), params.sweep_lag
    climb, top, reset_after = params.progressive_enabled, params.progressive_max_level, params.progressive_reset_after

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holder, level, last, eligible = None, 0, 0, None
        for batch in batches:
            if batch.empty:
                continue
            seconds = batch["at_epoch"].to_numpy()
            names = batch["client"].to_numpy()
            permanent = batch["permanent"].to_numpy()
            climbing = (batch["source"].to_numpy() == "monitor") & ~permanent & climb
            resumed = batch["resumed"].to_numpy() if "resumed" in batch else np.zeros(len(batch), bool)
            edges = np.flatnonzero(names[1:] != names[:-1]) + 1
            opened = []
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(names)]):
                if names[lo] != holder:
                    holder, level, last, eligible = names[lo], 0, 0, seconds[lo]
                i = int(lo)
                if resumed[i]:
                    level, last, free_at = (int(batch[c].iat[i]) for c in ("level", "last", "free_at"))
                    eligible, i = None if free_at == _NEVER else free_at, i + 1
                while eligible is not None:
                    i += int(np.searchsorted(seconds[i:hi], eligible))
                    if i >= hi:
                        break
                    now, shown, forever, length = int(seconds[i]), 0, bool(permanent[i]), base
                    if climbing[i]:
                        level = 1 if level == 0 or now - last > reset_after else level + 1
                        last, shown = now, level
                        if level > 1:
                            length = min(base * growth ** min(level - 1, 64), MAX_DURATION)
                        if 0 < top <= level:
                            forever, length = True, 0
                    timed = not forever and length > 0
                    opened.append((i, shown, length, now + length if timed else 0, forever))
                    eligible = now + length + lag if timed else None
            if opened:
                rows, levels, lengths, untils, forevers = zip(*opened)
                yield batch.iloc[list(rows)][["client", "at_epoch", "target", "n", "protocol", "reason", "source", "country"]].assign(
                    offense_level=np.array(levels, "int32"), ban_duration=np.array(lengths, "int64"),
                    ban_until_epoch=np.array(untils, "int64"), is_permanent=np.array(forevers))

    return walk


def replay_bans(detections: DataFrame, params: Params, bans: DataFrame | None = None,
                offenses: DataFrame | None = None) -> DataFrame:
    """Every ban a history of detections leads to, from the given state or an empty ledger. A dry run has none.

    The ledger counts in seconds, so of all detections of a client within one second only
    the first can matter. Keeping just that one is a partial aggregation: a client that
    fills a third of the log still brings at most one row per second into the fold. Bans and offences
    go in as one more row per client that has both detections and a past.
    """
    rest = ["target", "n", "protocol", "reason", "source", "permanent", "country"]
    country = F.col("country") if "country" in detections.columns else F.lit("")
    detections = detections.withColumn("country", F.coalesce(country, F.lit("")))
    if params.dry_run:
        detections = detections.filter("false")
    per_second = detections.groupBy("client", F.unix_seconds("at").alias("at_epoch")).agg(
        F.min_by(F.struct(*rest), F.struct(F.col("at"), detection_order())).alias("d")).select("client", "at_epoch", "d.*")
    order = ["client", "at_epoch"]
    if bans is not None or offenses is not None:
        past = _past(detections, bans, offenses, params)
        per_second = per_second.withColumn("resumed", F.lit(False)).unionByName(past, allowMissingColumns=True).fillna(
            {"permanent": False, "level": 0, "last": 0, "free_at": _ALWAYS, "n": 0})
        order = ["client", F.desc("resumed"), "at_epoch"]
    ordered = per_second.repartition("client").sortWithinPartitions(*order)
    return ordered.mapInPandas(_fold(params), _FOLDED)


def _past(detections: DataFrame, bans: DataFrame | None, offenses: DataFrame | None, params: Params) -> DataFrame:
    """(client, level, last, free_at): the offence and the second from which a client can be banned again."""
    known = None
    if bans is not None:
        ends = ~F.col("is_permanent") & (F.col("ban_until_epoch") > 0)
        known = bans.select(F.col("client_ip").alias("client"), F.when(ends, F.col("ban_until_epoch") + params.sweep_lag).otherwise(
            F.lit(_NEVER)).alias("free_at"))
    if offenses is not None:
        raised = offenses.select(F.col("client_ip").alias("client"), F.col("offense_level").cast("long").alias("level"),
                                 F.coalesce("last_offense_epoch", F.lit(0)).alias("last"))
        known = raised if known is None else known.join(raised, "client", "full")
    for name in sorted({"level", "last", "free_at"} - set(known.columns)):
        known = known.withColumn(name, F.lit(_ALWAYS if name == "free_at" else 0).cast("long"))
    concerned = known.join(detections.select("client").distinct(), "client", "left_semi")
    return concerned.select("client", F.lit(0).cast("long").alias("at_epoch"), F.lit(True).alias("resumed"),
                            "level", "last", "free_at")


def replay_step(detections: DataFrame, bans: DataFrame, offenses: DataFrame, params: Params, until: int,
                folder: str | None = None) -> Step:
    """The tables after all detections up to second ``until``; the next step starts from them.

    Bans that end by then are lifted. Steps one after the other give what one step over
    all of the time gives. Detections are of clients that are not allowed.

    All tables of the step come from the bans it opens. With ``folder``, a new one on a file system that all
    executors share, these are folded and written there at once and read back; without it every action on a
    table folds the detections again, twice for a table that needs the bans twice.
    """
    detections = detections.filter(F.unix_seconds("at") <= until)
    opened = replay_bans(detections, params, bans, offenses)
    if folder is not None:
        opened = kept_once(opened, folder)
    start = F.col("at_epoch")
    fresh = opened.select(
        F.col("client").alias("client_ip"), F.col("target").alias("domain"), F.col("n").alias("count"), epoch_text(start).alias("ban_time"),
        "ban_until_epoch", "ban_duration", "offense_level", "is_permanent", "reason", "protocol", "source",
        F.col("country").alias("geoip_country"), F.lit(params.geoip_mode).alias("geoip_mode"))
    both = bans.unionByName(fresh, allowMissingColumns=True)
    over = F.coalesce(~F.col("is_permanent") & (F.col("ban_until_epoch") > 0) & (F.col("ban_until_epoch") <= until), F.lit(False))
    ended = both.filter(over)
    written = _history(opened.withColumnRenamed("client", "client_ip").withColumnRenamed("target", "domain"), start, F.lit("BAN"),
                       domain=F.col("domain"), count=F.col("n"), duration=duration_text(F.col("ban_duration"), F.col("is_permanent")),
                       protocol=F.col("protocol"), reason=F.col("reason"))
    if params.dry_run:
        written = dry_run_history(detections, F.unix_seconds("at"))
    lifted = _history(ended, F.col("ban_until_epoch"), F.lit("UNBAN"), reason=F.lit("expired"))
    climbed = opened.filter("offense_level > 0").groupBy(F.col("client").alias("client_ip")).agg(
        F.max_by("offense_level", "at_epoch").alias("offense_level"), F.max("at_epoch").alias("last_offense_epoch"),
        F.max(F.when(F.col("offense_level") == 1, F.col("at_epoch"))).alias("began"))
    old = offenses.select("client_ip", (F.col("first_offense") if "first_offense" in offenses.columns else F.lit("")).alias("old_first"))
    raised = climbed.join(old, "client_ip", "left").select(
        "client_ip", "offense_level", "last_offense_epoch", epoch_text(F.col("last_offense_epoch")).alias("last_offense"),
        F.coalesce(epoch_text(F.col("began")), "old_first", F.lit("")).alias("first_offense"))
    return Step(both.filter(~over), written.unionByName(lifted), upsert(offenses, raised, ["client_ip"]), opened=fresh, lifted=ended)


def ledger_replay(detections: DataFrame, params: Params, horizon: int | None = None) -> DataFrame:
    """BAN rows of :func:`replay_bans` and the UNBAN rows of those that ran out.

    With ``horizon`` only bans that end by then are lifted. A dry run gives a DRY row per detection.
    """
    if params.dry_run:
        return dry_run_history(detections, F.unix_seconds("at")).withColumn("offense_level", F.lit(0))
    bans = replay_bans(detections, params)
    ends = ~F.col("is_permanent") & (F.col("ban_until_epoch") > 0)
    if horizon is not None:
        ends = ends & (F.col("ban_until_epoch") <= horizon)
    lasting = duration_text(F.col("ban_duration"), F.col("is_permanent"))
    dash = F.lit("-")

    def row(epoch, action, domain, count, duration, protocol, reason):
        return F.struct(
            epoch.alias("timestamp_epoch"), epoch_text(epoch).alias("timestamp_text"), F.lit(action).alias("action"),
            domain.alias("domain"), count.alias("count"), duration.alias("duration"),
            protocol.alias("protocol"), reason.alias("reason"))

    opened = row(F.col("at_epoch"), "BAN", F.col("target"), F.col("n").cast("string"), lasting, F.col("protocol"), F.col("reason"))
    closed = row(F.col("ban_until_epoch"), "UNBAN", dash, dash, dash, dash, F.lit("expired"))
    both = F.when(ends, F.array(opened, closed)).otherwise(F.array(opened))
    return bans.select(F.col("client").alias("client_ip"), "offense_level", F.inline(both))
