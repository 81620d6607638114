"""Evaluation times as columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


def utc(at: datetime) -> datetime:
    """Times without a zone are UTC, whatever zone the driver's machine is in."""
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def instant(at: datetime) -> Column:
    return F.lit(utc(at))
