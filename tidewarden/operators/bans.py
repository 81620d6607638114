"""Look-ups on the ban, offence and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What a missing field of a ban reads as.
BAN_DEFAULTS = {
    "domain": "", "count": 0, "ban_until_epoch": 0, "ban_duration": 0, "offense_level": 0,
    "is_permanent": False, "reason": "", "protocol": "", "source": "", "geoip_country": "", "geoip_mode": "",
}


def _with_defaults(bans: DataFrame) -> DataFrame:
    return bans.fillna({c: v for c, v in BAN_DEFAULTS.items() if c in bans.columns})


def bans_by_source(bans: DataFrame, source: str) -> DataFrame:
    return _with_defaults(bans.filter(F.col("source") == source))


def bans_by_reason(bans: DataFrame, reason: str) -> DataFrame:
    return _with_defaults(bans.filter(F.col("reason") == reason))


def active_bans_list(bans: DataFrame, newest: str = "ban_time") -> DataFrame:
    """All bans, newest first; equal times by address."""
    return _with_defaults(bans).orderBy(F.desc(newest), "client_ip")


def expired_bans(bans: DataFrame, now: int) -> DataFrame:
    return bans.filter((F.col("ban_until_epoch") > 0) & ~F.col("is_permanent") & (F.col("ban_until_epoch") <= now))


def ban_exists(clients: DataFrame, bans: DataFrame) -> DataFrame:
    """Clients with a ban row. Presence counts, even when the row is due to expire."""
    return clients.join(bans, clients["client"] == bans["client_ip"], "left_semi")


def expired_offenses(offenses: DataFrame, reset_after: int, now: int) -> DataFrame:
    return offenses.filter(F.col("last_offense_epoch") <= now - reset_after)


def offense_cleanup(offenses: DataFrame, reset_after: int, now: int) -> DataFrame:
    """The offences that stay. A row exactly ``reset_after`` old goes, though a new
    violation at that age would still raise its level."""
    return offenses.filter(F.col("last_offense_epoch").isNull() | (F.col("last_offense_epoch") > now - reset_after))


def offense_status(offenses: DataFrame, reset_after: int, now: int) -> DataFrame:
    return offenses.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("last_offense_epoch") <= now - reset_after).alias("expired"))


def history_recent(history: DataFrame, limit: int = 50) -> DataFrame:
    shown = ["domain", "count", "duration", "protocol", "reason"]
    return history.fillna("", subset=shown).orderBy(F.desc("id")).limit(limit)
