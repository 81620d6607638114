"""Fixed schemas; no job infers one."""

from pyspark.sql import types as T

QUERY_ITEM = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("client", T.StringType()),
    T.StructField("client_proto", T.StringType()),
    T.StructField("client_info", T.StructType([T.StructField("ip", T.StringType())])),
    T.StructField("question", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("host", T.StringType()),
    ])),
])

QUERY_LOG = T.StructType([T.StructField("data", T.ArrayType(QUERY_ITEM))])

QUERIES = T.StructType([
    T.StructField("at", T.TimestampType()),
    T.StructField("at_ns", T.IntegerType()),
    T.StructField("client", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("protocol", T.StringType()),
])

DETECTIONS = T.StructType([
    T.StructField("at", T.TimestampType()),
    T.StructField("client", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("permanent", T.BooleanType()),
    T.StructField("country", T.StringType()),
])

ACTIVE_BANS = T.StructType([
    T.StructField("client_ip", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("ban_time", T.StringType()),
    T.StructField("ban_until_epoch", T.LongType()),
    T.StructField("ban_duration", T.LongType()),
    T.StructField("offense_level", T.IntegerType()),
    T.StructField("is_permanent", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("geoip_country", T.StringType()),
    T.StructField("geoip_mode", T.StringType()),
])

BAN_HISTORY = T.StructType([
    T.StructField("timestamp_epoch", T.LongType()),
    T.StructField("timestamp_text", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("count", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("reason", T.StringType()),
])

OFFENSES = T.StructType([
    T.StructField("client_ip", T.StringType()),
    T.StructField("offense_level", T.IntegerType()),
    T.StructField("last_offense_epoch", T.LongType()),
    T.StructField("last_offense", T.StringType()),
    T.StructField("first_offense", T.StringType()),
])

WHITELIST = T.StructType([
    T.StructField("ip_address", T.StringType()),
    T.StructField("source", T.StringType()),
])

GEO_RANGES = T.StructType([
    T.StructField("network", T.StringType()),
    T.StructField("country_iso", T.StringType()),
    T.StructField("registered_iso", T.StringType()),
])

GEO_CACHE = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("looked_up_at_epoch", T.LongType()),
    T.StructField("db_mtime", T.LongType()),
])
