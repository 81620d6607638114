"""Small inputs and brute-force answers."""

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)
EVENT_SCHEMA = "at timestamp, at_ns int, client string, domain string, protocol string"


def at(seconds, micros=0):
    return T0 + timedelta(seconds=seconds, microseconds=micros)


def events(spark, rows):
    """Rows of (seconds, client, domain[, protocol])."""
    full = [(r[0] if isinstance(r[0], datetime) else at(r[0]), 0, r[1], r[2], r[3] if len(r) > 3 else "dns") for r in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def values(spark, df_rows, schema, **columns):
    """One expression list evaluated over literal rows."""
    return [tuple(r) for r in spark.createDataFrame(df_rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]
