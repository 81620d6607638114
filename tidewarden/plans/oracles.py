"""DuckDB twins of the registered queries, written from the rules and not from the jobs."""

from __future__ import annotations

import re

from tidewarden.plans.fixtures import AS_OF_EPOCH, NOW

_CLIENT = """CASE CAST(e.user_id % 5 AS INT) WHEN 0 THEN '10.' || (e.user_id // 64000) % 256
  WHEN 1 THEN '100.' || ((e.user_id // 64000) % 64 + 64) ELSE '203.' || (e.user_id % 25 + (e.user_id // 64000) % 10 * 25) END
  || '.' || (e.user_id // 250) % 256 || '.' || (e.user_id % 250 + 1)"""
_HOST = "lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1))"
_ASKED = """events e JOIN pages p ON p.page_id =
  (e.user_id * 12 + CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 12) % (SELECT count(*) FROM pages)"""


def _proto(plain: str) -> str:
    return (f"CASE e.event_type WHEN 'click' THEN '{plain}' WHEN 'view' THEN 'doh' WHEN 'purchase' THEN 'dot' "
            "WHEN 'signup' THEN 'doq' ELSE 'dnscrypt' END")


def _cust_ip(key: str) -> str:
    return f"'203.' || ({key} // 64000) % 256 || '.' || ({key} // 250) % 256 || '.' || ({key} % 250 + 1)"


_WINDOW = "INTERVAL 7 DAYS"
_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
_ORD = "CASE WHEN target LIKE '*.%' THEN 1 ELSE 0 END, n DESC, target, protocol"

# Common table expressions; each may use those above it.
CTES = {
    "raw_queries": f"""
      SELECT r.* FROM (
        SELECT b.event_id,
          CASE WHEN b.event_id % 97 = 0 THEN 'not-a-time' 
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(b.event_id % 1000 AS STRING), 3, '0') || 'Z' END AS time,
          CASE WHEN b.event_id % 13 = 0 THEN '  ' ELSE ip END AS client, ip AS client_info_ip,
          CASE WHEN b.event_id % 11 = 0 THEN '' WHEN b.event_id % 3 = 0 THEN upper(hst) || '.' ELSE hst END AS name,
          CASE WHEN b.event_id % 22 = 0 THEN '' ELSE hst END AS host, proto AS client_proto
        FROM (SELECT e.event_id, e.ts, {_CLIENT} AS ip, {_HOST} AS hst, {_proto('')} AS proto FROM {_ASKED}) b) r
      JOIN (SELECT 1 AS copy UNION ALL SELECT 2) c ON c.copy = 1 OR r.event_id % 10 = 0""",
    "tidy": r"""
      SELECT * FROM (
        SELECT epoch_us(TRY_CAST(CASE WHEN time LIKE '%T%Z' THEN time[:26] || 'Z' END AS TIMESTAMPTZ)) AS at_us, TRY_CAST(time[27:29] AS BIGINT) AS at_ns,
          CASE WHEN trim(client) <> '' THEN trim(client) ELSE trim(client_info_ip) END AS client,
          regexp_replace(lower(CASE WHEN name <> '' THEN name ELSE host END), '[.]$', '') AS domain,
          CASE WHEN client_proto = '' THEN 'dns' ELSE client_proto END AS protocol
        FROM raw_queries) WHERE at_us IS NOT NULL AND client <> '' AND domain <> ''""",
    "queries": f"""
      SELECT e.event_id, e.ts AS asked, epoch_us(e.ts) AS at_us, e.user_id, {_CLIENT} AS client, {_HOST} AS domain,
        {_proto('dns')} AS protocol FROM {_ASKED}""",
    "labelled": """
      SELECT q.*, string_split(domain, '.') AS parts FROM queries q""",
    "subs": """
      SELECT * FROM (
        SELECT event_id, asked, at_us, client, domain, protocol, CASE WHEN len(parts) < 2 THEN ''
          WHEN len(parts) >= 3 AND parts[-2] IN ('co','com','net','org','gov','edu','ac','gv','ne','or','go')
            AND strlen(parts[-1]) BETWEEN 2 AND 3 THEN parts[-3] || '.' || parts[-2] || '.' || parts[-1]
          ELSE parts[-2] || '.' || parts[-1] END AS base
        FROM labelled) WHERE base <> '' AND base <> domain""",
    "rate_snap": f"""
      SELECT client, domain AS target, count(*) AS n, arg_max(protocol, asked) AS protocol, domain AS watched, 'rate-limit' AS kind
      FROM queries WHERE asked BETWEEN {_AS_OF} - {_WINDOW} AND {_AS_OF} GROUP BY client, domain HAVING count(*) > 3""",
    "flood_snap": f"""
      SELECT client, '*.' || base AS target, count(DISTINCT domain) AS n, 'dns' AS protocol, base AS watched,
        'subdomain-flood' AS kind
      FROM subs WHERE asked BETWEEN {_AS_OF} - {_WINDOW} AND {_AS_OF} GROUP BY client, base HAVING count(DISTINCT domain) > 4""",
    "snap": f"""
      SELECT epoch_us({_AS_OF}) AS at_us, client, target, n, protocol, kind,
        watched = 'example.org' OR watched LIKE '%.example.org' AS permanent
      FROM (SELECT * FROM rate_snap UNION ALL SELECT * FROM flood_snap)""",
    "watched_snap": """
      SELECT at_us, client, target, n, protocol, CASE WHEN permanent THEN 'dns-flood-watchlist' ELSE kind END AS reason,
        'monitor' AS source, permanent FROM snap""",
    "rate_trail": f"""
      SELECT at_us, client, domain AS target, n, protocol FROM (
        SELECT *, count(*) OVER (PARTITION BY client, domain ORDER BY asked
          RANGE BETWEEN {_WINDOW} PRECEDING AND CURRENT ROW) AS n FROM queries) WHERE n > 3""",
    "flood_trail": f"""
      SELECT a.at_us, a.client, '*.' || a.base AS target, count(DISTINCT b.domain) AS n, 'dns' AS protocol
      FROM subs a JOIN subs b ON a.client = b.client AND a.base = b.base AND b.asked BETWEEN a.asked - {_WINDOW} AND a.asked
      GROUP BY a.event_id, a.at_us, a.client, a.base HAVING count(DISTINCT b.domain) > 4""",
    "ticks": """
      SELECT s.start, s.start + INTERVAL 7 DAYS AS fin FROM (
        SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events) - INTERVAL 7 DAYS,
          (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS start) s""",
    "rate_tick": """
      SELECT epoch_us(t.fin) AS at_us, q.client, q.domain AS target, count(*) AS n, arg_max(q.protocol, q.asked) AS protocol
      FROM ticks t JOIN queries q ON q.asked >= t.start AND q.asked < t.fin GROUP BY t.fin, q.client, q.domain HAVING count(*) > 3""",
    "whitelist": """
      SELECT DISTINCT client AS ip_address, CASE WHEN user_id % 40 = 7 THEN 'static' ELSE 'external' END AS source
      FROM queries WHERE user_id % 20 = 7 UNION ALL SELECT '203.0.0.0/24', 'external'""",
    "client_bans": "SELECT DISTINCT client AS client_ip FROM queries WHERE user_id % 6 = 1",
    "client_offenses": f"""
      SELECT DISTINCT client AS client_ip, user_id % 6 AS offense_level,
        {AS_OF_EPOCH} - (user_id % 9) * 216000 AS last_offense_epoch FROM queries WHERE user_id % 3 = 0""",
    "gated": """
      SELECT * FROM watched_snap WHERE client NOT IN (SELECT ip_address FROM whitelist)
        AND client NOT IN (SELECT client_ip FROM client_bans)""",
    "chosen": f"SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY client ORDER BY {_ORD}) = 1",
    "levels": f"""
      SELECT c.*, CASE WHEN permanent THEN 0
        WHEN o.client_ip IS NULL OR (o.last_offense_epoch > 0 AND {AS_OF_EPOCH} - o.last_offense_epoch > 864000) THEN 1
        ELSE o.offense_level + 1 END AS lvl
      FROM chosen c LEFT JOIN client_offenses o ON o.client_ip = c.client""",
    "opened": f"""
      SELECT client AS client_ip, target AS domain, n AS "count", '2024-01-20 00:00:00' AS ban_time,
        CASE WHEN permanent OR lvl >= 5 THEN 0 ELSE {AS_OF_EPOCH} + CAST(86400 * 2 ** (greatest(lvl, 1) - 1) AS BIGINT) END AS ban_until_epoch,
        CASE WHEN lvl >= 5 THEN 0 ELSE CAST(86400 * 2 ** (greatest(lvl, 1) - 1) AS BIGINT) END AS ban_duration,
        lvl AS offense_level, permanent OR lvl >= 5 AS is_permanent, reason, protocol, source,
        '' AS geoip_country, 'blocklist' AS geoip_mode FROM levels""",
    "geo_ranges": """
      SELECT '203.' || CAST(n_nationkey AS STRING) || '.0.0/16' AS network,
        CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE chr(65 + n_regionkey) || chr(65 + n_nationkey) END AS country_iso,
        chr(65 + n_regionkey) || chr(65 + n_nationkey) AS registered_iso FROM nation
      UNION ALL SELECT '203.' || CAST(n_nationkey AS STRING) || '.0.0/24', 'ZZ', 'ZZ' FROM nation WHERE n_nationkey % 5 = 2""",
    "geo_spans": """
      SELECT plen, lo, lo + CAST(2 ** (32 - plen) AS BIGINT) - 1 AS hi, cc FROM (
        SELECT CAST(string_split(network, '/')[2] AS INT) AS plen,
          CAST(string_split(network, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(network, '.')[2] AS BIGINT) * 65536 AS lo,
          upper(CASE WHEN country_iso = '' THEN registered_iso ELSE country_iso END) AS cc FROM geo_ranges)""",
    "client_nums": """
      SELECT client, CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536 + CAST(o[3] AS BIGINT) * 256 + CAST(o[4] AS BIGINT) AS num
      FROM (SELECT client, string_split(client, '.') AS o FROM (SELECT DISTINCT client FROM queries))""",
    "located": """
      SELECT c.client, c.num, coalesce(arg_max(g.cc, g.plen), '') AS country
      FROM client_nums c LEFT JOIN geo_spans g ON c.num BETWEEN g.lo AND g.hi GROUP BY c.client, c.num""",
    "public_located": """
      SELECT client, country FROM located WHERE NOT (num BETWEEN 167772160 AND 184549375 OR num BETWEEN 2886729728 AND 2887778303
        OR num BETWEEN 3232235520 AND 3232301055 OR num BETWEEN 2130706432 AND 2147483647 OR num BETWEEN 2851995648 AND 2852061183
        OR num BETWEEN 1681915904 AND 1686110207 OR num = 0)""",
    "geo_open": """
      SELECT * FROM public_located WHERE client NOT IN (SELECT ip_address FROM whitelist)
        AND client NOT IN (SELECT client_ip FROM client_bans) AND country <> ''""",
    "geo_cache": f"""
      SELECT DISTINCT client AS ip, 'QQ' AS country_code, {NOW} - (user_id % 3) * 86400 AS looked_up_at_epoch,
        (user_id % 2) * 123 AS db_mtime FROM queries WHERE user_id % 7 = 3""",
    "geo_valid": f"SELECT * FROM geo_cache WHERE looked_up_at_epoch >= {NOW} - 86400 AND db_mtime IN (0, 123)",
    "ban_history": f"""
      SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp_epoch,
        substr(CAST(o_orderdate AS STRING), 1, 10) || ' 00:00:00' AS timestamp_text,
        CASE WHEN o_orderkey % 11 = 0 THEN 'DRY' WHEN o_orderkey % 4 = 0 THEN 'UNBAN' ELSE 'BAN' END AS action,
        {_cust_ip('o_custkey')} AS client_ip,
        CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL
          ELSE 'd' || CAST(o_custkey % 40 AS STRING) || '.example.com' END AS domain,
        CAST(o_custkey % 100 AS STRING) AS "count",
        CASE o_orderstatus WHEN 'F' THEN 'permanent' WHEN 'O' THEN '3600s' ELSE NULL END AS duration,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'dns' WHEN '2-HIGH' THEN 'doh' WHEN '3-MEDIUM' THEN 'dot'
          WHEN '5-LOW' THEN '' ELSE NULL END AS protocol,
        CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'subdomain-flood'
          WHEN 2 THEN 'external-blocklist' WHEN 3 THEN 'geoip' WHEN 4 THEN '' ELSE 'dns-flood-watchlist' END AS reason
      FROM orders""",
    "window_bans": """
      SELECT * FROM ban_history WHERE action = 'BAN' AND timestamp_epoch BETWEEN epoch(TIMESTAMP '2000-05-16') AND epoch(TIMESTAMP '2000-06-14 23:59:59')""",
    "active_bans": f"""
      SELECT {_cust_ip('c_custkey')} AS client_ip, 'd' || CAST(c_custkey % 40 AS STRING) || '.example.com' AS domain,
        CAST(c_custkey % 100 AS BIGINT) AS "count",
        CASE WHEN c_custkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE {NOW} + (c_custkey % 11 - 5) * 600 END AS ban_until_epoch,
        CAST(3600 AS BIGINT) AS ban_duration, c_custkey % 6 AS offense_level, c_custkey % 3 = 0 AS is_permanent,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'rate-limit' WHEN 'MACHINERY' THEN 'subdomain-flood'
          WHEN 'FURNITURE' THEN 'geoip' WHEN 'BUILDING' THEN 'external-blocklist' ELSE 'manual' END AS reason,
        'doh' AS protocol,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'monitor' WHEN 'MACHINERY' THEN 'monitor'
          WHEN 'FURNITURE' THEN 'geoip' WHEN 'BUILDING' THEN 'external-blocklist' ELSE '' END AS source,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE chr(65 + c_nationkey) || 'X' END AS geoip_country,
        CASE WHEN c_custkey % 5 = 0 THEN 'allowlist' ELSE 'blocklist' END AS geoip_mode, c_custkey AS created_seq
      FROM customer""",
    "filled_bans": "SELECT * REPLACE (coalesce(geoip_country, '') AS geoip_country) FROM active_bans",
    "expired": f"SELECT * FROM active_bans WHERE ban_until_epoch > 0 AND NOT is_permanent AND ban_until_epoch <= {NOW}",
    "offenses": f"""
      SELECT client_ip, offense_level, {NOW} - (created_seq % 9) * 21600 AS last_offense_epoch
      FROM active_bans WHERE created_seq % 2 = 0""",
    "commands": """
      SELECT created_seq AS seq, client_ip AS target,
        CASE CAST(created_seq % 3 AS INT) WHEN 0 THEN 'ban' WHEN 1 THEN 'unban' ELSE 'reset-offenses' END AS command
      FROM active_bans WHERE created_seq % 10 = 0""",
    "in_force": "SELECT * FROM active_bans WHERE client_ip NOT IN (SELECT client_ip FROM expired)",
    "list_lines": """
      SELECT page_id, 'src' || CAST(page_id % 3 AS STRING) AS source_name,
        CASE CAST(page_id % 9 AS INT)
          WHEN 0 THEN '203.0.' || (page_id // 250) % 256 || '.' || (page_id % 250 + 1) || ' # reason'
          WHEN 1 THEN '0.0.0.0 ' || regexp_extract(url, '^https?://([^/:?#]+)', 1)
          WHEN 2 THEN url
          WHEN 3 THEN '198.' || ((page_id // 250) % 200 + 50) || '.' || page_id % 250 || '.0/24'
          WHEN 4 THEN '# ' || url
          WHEN 5 THEN '203.0.' || (page_id // 250) % 256 || '.' || (page_id % 250 + 1) || ':8443'
          WHEN 6 THEN regexp_extract(url, '^https?://([^/:?#]+)', 1) || ' ; note'
          WHEN 7 THEN ''
          ELSE '203.1.' || (page_id // 250) % 256 || '.' || (page_id % 250 + 1) || ' extra' END AS line
      FROM pages""",
    "list_snapshots": """
      SELECT source_name, CAST(1 AS BIGINT) AS fetched_seq, 200 AS status, line FROM list_lines
      UNION ALL SELECT source_name, 2, 203, line FROM list_lines WHERE source_name = 'src0' AND page_id % 2 = 0
      UNION ALL SELECT 'src4', 1, 200, client_ip FROM active_bans WHERE source = 'external-blocklist'
      UNION ALL SELECT 'src1', 2, 503, NULL UNION ALL SELECT 'src2', 2, 304, NULL UNION ALL SELECT 'src3', 1, 503, NULL""",
    "list_fetches": """
      SELECT DISTINCT source_name, fetched_seq, status FROM list_snapshots UNION ALL SELECT 'src4', 2, 200""",
    "latest_lines": """
      SELECT source_name, fetched_seq, line FROM list_snapshots SEMI JOIN (
        SELECT source_name, max(fetched_seq) AS fetched_seq FROM list_fetches WHERE status BETWEEN 200 AND 299 GROUP BY source_name
      ) USING (source_name, fetched_seq) WHERE status BETWEEN 200 AND 299""",
    "dns_answers": """
      SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host,
        CASE WHEN page_id % 10 = 0 THEN '0.0.0.0' ELSE '198.18.' || (page_id // 250) % 256 || '.' || page_id % 250 END AS address
      FROM pages WHERE page_id % 4 <> 3""",
    "entries": "@entries(latest_lines)",
    "resolved": r"""
      SELECT DISTINCT source_name, entry, entry AS address FROM entries WHERE regexp_matches(entry, '^[0-9]+([.][0-9]+){3}(/[0-9]+)?$')
      UNION ALL SELECT DISTINCT e.source_name, e.entry, d.address FROM entries e JOIN dns_answers d ON d.host = e.entry
      WHERE d.address <> '0.0.0.0'""",
    "desired": "SELECT DISTINCT address FROM resolved",
    "log_lines": """
      SELECT event_id,
        CASE WHEN event_id % 2 = 0 THEN '[' || substr(CAST(ts AS STRING), 1, 19) || ']'
          ELSE replace(substr(CAST(ts AS STRING), 1, 19), '-', '/') END
        || CASE event_type WHEN 'error' THEN ' [ERROR] ' WHEN 'signup' THEN ' [WARN] '
             WHEN 'click' THEN ' [INFO] ' WHEN 'view' THEN ' [DEBUG] ' ELSE ' ' END
        || CASE WHEN event_id % 5 = 0 THEN 'AbuseIPDB: 203.0.113.7 erfolgreich gemeldet' ELSE 'worker run' END AS line,
        date_trunc('second', ts) AS logged, event_type FROM events""",
    "leveled": """
      SELECT event_id, line, logged, CASE WHEN contains(line, '[ERROR]') THEN 'ERROR' WHEN contains(line, '[WARN]') THEN 'WARN'
        WHEN contains(line, '[INFO]') THEN 'INFO' WHEN contains(line, '[DEBUG]') THEN 'DEBUG' ELSE 'INFO' END AS level FROM log_lines""",
}


def _entries_of(lines: str) -> str:
    """Entries of list lines: comments off, sink address off, URLs and other text out."""
    return rf"""
      SELECT * FROM (
        SELECT * EXCLUDE (f), CASE WHEN len(f) = 1 THEN f[1] WHEN regexp_matches(f[1], '^(0[.]0[.]0[.]0|127[.].*|::|::1)$') THEN f[2] END AS entry
        FROM (SELECT *, string_split_regex(trim(regexp_replace(line, '[#;].*$', '')), '\s+') AS f FROM {lines}))
      WHERE entry <> '' AND NOT contains(entry, '://')
        AND (regexp_matches(entry, '^[0-9]+([.][0-9]+){{3}}(/[0-9]+)?$')
          OR (strlen(entry) <= 253 AND NOT regexp_matches(entry, '[/:]') AND regexp_matches(entry, '^[^.]{{1,63}}([.][^.]{{1,63}})*$')))"""


CTES["entries"] = _entries_of("latest_lines")


def _duration(seconds: str, permanent: str) -> str:
    return f"CASE WHEN {permanent} OR {seconds} = 0 THEN 'permanent' ELSE CAST({seconds} AS STRING) || 's' END"


def _event(rows: str, action: str, reason: str, now: int = NOW, **fields: str) -> str:
    f = {k: fields.get(k, "'-'") for k in ("domain", "count", "duration", "protocol")}
    return (f"SELECT CAST({now} AS BIGINT) AS timestamp_epoch, strftime(to_timestamp({now}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS timestamp_text, "
            f"'{action}' AS action, client_ip, CAST({f['domain']} AS STRING) AS domain, CAST({f['count']} AS STRING) AS \"count\", "
            f"{f['duration']} AS duration, {f['protocol']} AS protocol, {reason} AS reason FROM {rows}")


def _detections(rows: str, kind: str) -> str:
    return (f"SELECT at_us, client, target, n, protocol, '{kind}' AS reason, 'monitor' AS source, false AS permanent FROM {rows}")


def _replay(source: str, horizon: str) -> str:
    """A client's next ban is its first detection at or after the end of the last one."""
    order = f"at_us, {_ORD}"
    lvl = "CASE WHEN d.permanent THEN c.lvl WHEN c.lvl = 0 OR d.at_s - c.last > 864000 THEN c.lvl * 0 + 1 ELSE c.lvl + 1 END"
    step = """client, at_s, target, n, protocol, reason, permanent, lvl,
        CASE WHEN permanent THEN prev_last ELSE at_s END AS last,
        CAST(CASE WHEN permanent THEN 0 ELSE lvl END AS BIGINT) AS shown,
        permanent OR lvl >= 5 AS forever,
        CASE WHEN permanent THEN 86400 WHEN lvl >= 5 THEN 0 ELSE CAST(86400 * 2 ** (lvl - 1) AS BIGINT) END AS dur,
        CASE WHEN permanent OR lvl >= 5 THEN NULL ELSE at_s + CAST(86400 * 2 ** (lvl - 1) AS BIGINT) END AS fin"""
    return f"""
    det AS MATERIALIZED (SELECT *, at_us // 1000000 AS at_s FROM ({source})),
    chain AS (
      SELECT {step} FROM (SELECT *, CASE WHEN permanent THEN 0 ELSE 1 END AS lvl, CAST(0 AS BIGINT) AS prev_last,
          row_number() OVER (PARTITION BY client ORDER BY {order}) AS rn FROM det) WHERE rn = 1
      UNION ALL
      SELECT {step} FROM (SELECT d.*, {lvl} AS lvl, c.last AS prev_last,
          row_number() OVER (PARTITION BY d.client ORDER BY {order.replace('at_us', 'd.at_us').replace('target', 'd.target').replace('n DESC', 'd.n DESC').replace('protocol', 'd.protocol')}) AS rn
        FROM chain c JOIN det d ON d.client = c.client AND d.at_s >= c.fin) WHERE rn = 1)
    SELECT client AS client_ip, shown AS offense_level, at_s AS timestamp_epoch, strftime(to_timestamp(at_s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS timestamp_text,
      'BAN' AS action, target AS domain, CAST(n AS STRING) AS "count", {_duration('dur', 'forever')} AS duration, protocol, reason FROM chain
    UNION ALL
    SELECT client, shown, fin, strftime(to_timestamp(fin) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'UNBAN', '-', '-', '-', '-', 'expired'
    FROM chain WHERE fin IS NOT NULL {horizon}"""


_TOP = "SELECT {key} AS name, count(*) AS n FROM {rows} GROUP BY 1 ORDER BY n DESC, name LIMIT 20"
_BARS = ("SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS rank, n * 100 // max(n) OVER () AS width, "
         "row_number() OVER (ORDER BY n DESC, name) <= 3 AS top3 FROM ({top})")
_LABEL = ("CASE lower(trim(protocol)) WHEN 'doh' THEN 'DoH' WHEN 'dot' THEN 'DoT' WHEN 'doq' THEN 'DoQ' "
          "WHEN 'dnscrypt' THEN 'DNSCrypt' WHEN '' THEN 'DNS' WHEN 'dns' THEN 'DNS' ELSE protocol END")
_WHEN = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_HIST_COLS = ("id, timestamp_epoch, timestamp_text, action, client_ip, coalesce(domain, '') AS domain, coalesce(\"count\", '') AS \"count\", "
              "coalesce(duration, '') AS duration, coalesce(protocol, '') AS protocol, coalesce(reason, '') AS reason")
_COUNTRIES = "('BB', 'CH', 'ZZ', 'DI', 'AX', 'DX')"
_GEO_DET = ("SELECT epoch_us(" + _AS_OF + ") AS at_us, client, 'GeoIP:' || country AS target, CAST(0 AS BIGINT) AS n, '-' AS protocol, 'geoip' AS reason, "
            "'geoip' AS source, true AS permanent, country FROM geo_open WHERE country {test} " + _COUNTRIES)
_REASON = """CASE reason WHEN 'dns-flood-watchlist' THEN 'DNS-Flood-Watchlist' WHEN 'rate-limit' THEN 'Rate-Limit'
  WHEN 'subdomain-flood' THEN 'Subdomain-Flood' WHEN 'external-blocklist' THEN 'Externe Blocklist' WHEN 'geoip' THEN 'GeoIP'
  WHEN 'manual' THEN 'Manual' END"""
_URL = "'https://www.abuseipdb.com/check/' || client_ip"
_NL = "chr(10)"
_TITLE = "'🛡️ DNS Guard'"


def _bits(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


_GEO_MESSAGE = _bits(
    "'🌍 DNS Guard GeoIP-Sperre auf dns1'", "'---'", "'IP: ' || client_ip", "'Land: ' || geoip_country",
    "'Modus: ' || CASE geoip_mode WHEN 'allowlist' THEN 'Allowlist' ELSE 'Blocklist' END",
    "'Dauer: ' || CASE WHEN is_permanent THEN 'PERMANENT' ELSE '1h 0m' END", "''", f"'AbuseIPDB: ' || {_URL}")
_BAN_MESSAGE = _bits(
    "'🚫 DNS Guard Ban auf dns1' || CASE WHEN source = 'monitor' AND is_permanent THEN chr(10) || '⚠️ IP wurde an AbuseIPDB gemeldet' ELSE '' END",
    "'---'", "'IP: ' || client_ip", "'Hostname: (unbekannt)'",
    f"'Grund: ' || CASE WHEN \"count\" > 0 THEN CAST(\"count\" AS STRING) || 'x ' || domain || ' in 604800s via DOH, ' || {_REASON} ELSE {_REASON} END",
    "'Dauer: ' || CASE WHEN is_permanent THEN 'PERMANENT' ELSE '1h 0m' END || CASE WHEN offense_level > 0 THEN ' [Stufe ' || CAST(offense_level AS STRING) || '/5]' ELSE '' END",
    "''", f"'AbuseIPDB: ' || {_URL}")
_FREE_MESSAGE = _bits("'✅ DNS Guard Freigabe auf dns1'", "'---'", "'IP: ' || client_ip", "'Hostname: (unbekannt)'", "''", f"'AbuseIPDB: ' || {_URL}")
_GEO_BAN = "(reason = 'geoip' OR source = 'geoip')"
_WATCHED_HITS = """SELECT at_us, client, target, n, protocol, CASE WHEN w THEN 'dns-flood-watchlist' ELSE kind END AS reason, w AS permanent FROM (
          SELECT *, 'rate-limit' AS kind, target = 'example.org' OR target LIKE '%.example.org' AS w FROM rate_trail
          UNION ALL SELECT *, 'subdomain-flood', target = '*.example.org' OR target LIKE '*.%.example.org' FROM flood_trail)
        WHERE client NOT IN (SELECT ip_address FROM whitelist)"""
_ALLOWED_OR_BANNED = "target IN (SELECT ip_address FROM whitelist) OR target IN (SELECT client_ip FROM in_force)"


def _periods() -> str:
    day, now = "TIMESTAMP '2000-06-15'", "TIMESTAMP '2000-06-15 21:00:00'"
    rows = [("Heute", day, now), ("Gestern", f"{day} - INTERVAL 1 DAY", f"{day} - INTERVAL 1 SECOND")]
    rows += [(f"Letzte {d} Tage", f"{day} - INTERVAL {d} DAYS", now) for d in (7, 14, 30)]
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{label}' AS label, epoch({a}) AS since, epoch({b}) AS until" for i, (label, a, b) in enumerate(rows))


def _report_windows() -> str:
    rows = [("daily", 1, "Tagesbericht: 14.06.2000"), ("weekly", 7, "Wochenbericht: 08.06.2000 - 14.06.2000"),
            ("biweekly", 14, "Zweiwochenbericht: 01.06.2000 - 14.06.2000"), ("monthly", 30, "Monatsbericht: 16.05.2000 - 14.06.2000"),
            ("other", 7, "Bericht: 08.06.2000 - 14.06.2000")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, CAST(epoch(TIMESTAMP '2000-06-15' - INTERVAL {d} DAYS) AS BIGINT) AS since, "
        f"CAST(epoch(TIMESTAMP '2000-06-15') AS BIGINT) - 1 AS until, '{label}' AS label" for n, d, label in rows)


# Query name: final SELECT over the expressions above.
FINAL = {
    "normalize_queries": "SELECT at_us, at_ns, client, domain, protocol FROM tidy",
    "dedupe_queries": "SELECT DISTINCT at_us, at_ns, client, domain, protocol FROM tidy",
    "retain_recent": f"SELECT at_us, event_id % 1000 AS at_ns, client, domain, protocol FROM queries WHERE asked > {_AS_OF} - INTERVAL 604830 SECONDS",
    "distinct_clients": "SELECT DISTINCT client FROM tidy",
    "rate_limit_snapshot": f"SELECT epoch_us({_AS_OF}) AS at_us, client, target, n, protocol, kind AS reason, 'monitor' AS source, false AS permanent FROM rate_snap",
    "rate_limit_trailing": _detections("rate_trail", "rate-limit"),
    "rate_limit_ticks": _detections("rate_tick", "rate-limit"),
    "subdomain_flood_snapshot": f"SELECT epoch_us({_AS_OF}) AS at_us, client, target, n, protocol, kind AS reason, 'monitor' AS source, false AS permanent FROM flood_snap",
    "subdomain_flood_trailing": _detections("flood_trail", "subdomain-flood"),
    "subdomain_flood_ticks": _detections("""(SELECT epoch_us(t.fin) AS at_us, s.client, '*.' || s.base AS target, count(DISTINCT s.domain) AS n, 'dns' AS protocol
      FROM ticks t JOIN subs s ON s.asked >= t.start AND s.asked < t.fin GROUP BY t.fin, s.client, s.base HAVING count(DISTINCT s.domain) > 4)""", "subdomain-flood"),
    "watchlist_escalation": "SELECT * FROM watched_snap",
    "watchlist_table": """SELECT at_us, client, target, n, protocol, CASE WHEN w THEN 'dns-flood-watchlist' ELSE kind END AS reason, 'monitor' AS source, w AS permanent
      FROM (SELECT s.*, EXISTS (SELECT 1 FROM pages p WHERE p.url LIKE 'https:%' AND (s.watched = lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1))
        OR s.watched LIKE '%.' || lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1)))) AS w
        FROM (SELECT client, target, n, protocol, kind, watched, at_us FROM (SELECT * FROM rate_snap UNION ALL SELECT * FROM flood_snap) JOIN snap USING (client, target, n, protocol, kind)) s)""",
    "first_detection_per_client": f"SELECT * FROM watched_snap QUALIFY row_number() OVER (PARTITION BY client ORDER BY {_ORD}) = 1",
    "flood_pipeline": f"""SELECT at_us, client, domain AS target, n, protocol, CASE WHEN w THEN 'dns-flood-watchlist' ELSE 'rate-limit' END AS reason,
        'monitor' AS source, w AS permanent FROM (
      SELECT *, domain = 'example.org' OR domain LIKE '%.example.org' AS w, count(*) OVER (PARTITION BY client, domain ORDER BY at_us
        RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT DISTINCT * FROM tidy)) WHERE n > 3""",
    "live_top_pairs": f"""SELECT client, domain, n, protocol FROM (
      SELECT client, domain, count(*) AS n, array_to_string(list_sort(list(DISTINCT {_LABEL})), ',') AS protocol FROM queries
      WHERE asked BETWEEN {_AS_OF} - {_WINDOW} AND {_AS_OF} GROUP BY client, domain) ORDER BY n DESC, client || '|' || domain LIMIT 10""",
    "live_top_subdomain_groups": f"""SELECT client, base AS domain, n, protocol FROM (
      SELECT client, base, count(DISTINCT domain) AS n, array_to_string(list_sort(list(DISTINCT {_LABEL})), ',') AS protocol FROM subs
      WHERE asked BETWEEN {_AS_OF} - {_WINDOW} AND {_AS_OF} GROUP BY client, base) ORDER BY n DESC, client || '|' || base LIMIT 10""",
    "live_recent_queries": f"SELECT at_us, client, {_LABEL} AS protocol, domain FROM queries ORDER BY at_us DESC, client, domain, queries.protocol LIMIT 12",
    "whitelist_exclude": "SELECT * FROM watched_snap WHERE client NOT IN (SELECT ip_address FROM whitelist)",
    "whitelist_exclude_networks": """SELECT client_ip, reason FROM active_bans
      WHERE client_ip NOT IN (SELECT ip_address FROM whitelist) AND client_ip NOT LIKE '203.0.0.%'""",
    "not_already_banned": "SELECT * FROM watched_snap WHERE client NOT IN (SELECT client_ip FROM client_bans)",
    "ban_exists": "SELECT DISTINCT client_ip AS client FROM ban_history WHERE client_ip IN (SELECT client_ip FROM active_bans)",
    "list_latest_good": "SELECT * FROM latest_lines",
    "parse_list": "SELECT page_id, source_name, line, entry FROM (" + _entries_of("list_lines") + ")",
    "resolve_list": "SELECT * FROM resolved",
    "list_desired_set": "SELECT * FROM desired",
    "blocklist_new": """SELECT address FROM desired WHERE address NOT IN (SELECT ip_address FROM whitelist)
      AND address NOT IN (SELECT client_ip FROM active_bans)""",
    "blocklist_removed": "SELECT client_ip, domain, source FROM active_bans WHERE source = 'external-blocklist' AND client_ip NOT IN (SELECT address FROM desired)",
    "whitelist_hits": "SELECT client_ip, reason FROM active_bans WHERE client_ip IN (SELECT address FROM desired)",
    "whitelist_replace": """SELECT * FROM whitelist WHERE source <> 'external' UNION ALL SELECT address, 'external' FROM desired
      WHERE address NOT IN (SELECT ip_address FROM whitelist WHERE source <> 'external')""",
    "whitelist_sync": _event("""(SELECT * FROM active_bans WHERE client_ip IN (SELECT ip_address FROM whitelist WHERE source = 'static')
      OR client_ip IN (SELECT address FROM desired))""", "UNBAN", "'external-whitelist'"),
    "blocklist_sync": _event("""(SELECT address AS client_ip FROM desired WHERE address NOT IN (SELECT ip_address FROM whitelist)
      AND address NOT IN (SELECT client_ip FROM active_bans))""", "BAN", "'external-blocklist'", duration="'permanent'") + " UNION ALL " + _event(
        "(SELECT * FROM active_bans WHERE source = 'external-blocklist' AND client_ip NOT IN (SELECT address FROM desired))",
        "UNBAN", "'external-blocklist-removed'"),
    "bans_upsert": """SELECT client_ip, domain, "count", ban_until_epoch, is_permanent, reason FROM active_bans
      WHERE client_ip NOT IN (SELECT address FROM desired)
      UNION ALL SELECT address, '-', 0, 0, true, 'external-blocklist' FROM desired""",
    "geo_lookup": "SELECT client, country FROM located",
    "geo_public_clients": "SELECT client FROM public_located",
    "geo_detect": _GEO_DET.format(test="IN"),
    "geo_detect_allowlist": _GEO_DET.format(test="NOT IN"),
    "geo_cache_valid": "SELECT * FROM geo_valid",
    "geo_cache_refresh": f"""SELECT * FROM geo_cache WHERE ip IN (SELECT ip FROM geo_valid)
        OR ip NOT IN (SELECT client FROM located WHERE country <> '')
      UNION ALL SELECT client, country, {NOW}, 123 FROM located WHERE country <> '' AND client NOT IN (SELECT ip FROM geo_valid)""",
    "geo_auto_unban": _event(f"""(SELECT * FROM active_bans WHERE reason = 'geoip' AND (geoip_mode <> 'blocklist'
      OR (geoip_country IS NOT NULL AND geoip_country NOT IN {_COUNTRIES})))""", "UNBAN", "'geoip-auto-unban'"),
    "ban_rows": "SELECT * FROM opened",
    "offense_update": f"""SELECT * FROM client_offenses WHERE client_ip NOT IN (SELECT client_ip FROM opened WHERE offense_level > 0)
      UNION ALL SELECT client_ip, offense_level, {AS_OF_EPOCH} FROM opened WHERE offense_level > 0""",
    "dry_run_history": f"""SELECT at_us // 1000000 AS timestamp_epoch, {_WHEN.format('at_us // 1000000')} AS timestamp_text, 'DRY' AS action,
      client AS client_ip, target AS domain, CAST(n AS STRING) AS "count", 'dry-run' AS duration, protocol,
      CASE WHEN target = 'example.org' OR target LIKE '%.example.org' THEN 'dry-run (dns-flood-watchlist)' ELSE 'dry-run (rate-limit)' END AS reason
      FROM rate_tick WHERE client NOT IN (SELECT ip_address FROM whitelist) AND client NOT IN (SELECT client_ip FROM client_bans)""",
    "expire_bans": _event("expired", "UNBAN", "'expired'"),
    "ledger_replay_dry_run": f"""SELECT at_us // 1000000 AS timestamp_epoch, {_WHEN.format('at_us // 1000000')} AS timestamp_text, 'DRY' AS action,
      client AS client_ip, target AS domain, CAST(n AS STRING) AS "count", 'dry-run' AS duration, protocol, 'dry-run (' || reason || ')' AS reason
      FROM ({_WATCHED_HITS})""",
    "ban_changes": """SELECT client_ip, domain, "count", until AS ban_until_epoch, reason, protocol FROM (
      SELECT client_ip, x.d AS domain, x.c AS "count", x.u AS until, x.r AS reason, x.p AS protocol, x.a AS action FROM (SELECT client_ip, arg_max({'d': domain, 'c': CAST("count" AS BIGINT), 'u': timestamp_epoch, 'r': reason, 'p': protocol, 'a': action}, timestamp_epoch * 10000000 + id) AS x
        FROM ban_history GROUP BY client_ip)) WHERE action <> 'UNBAN'""",
    "whitelist_flush": "SELECT * FROM whitelist WHERE source <> 'external'",
    "manual_actions_dry_run": _event(f"(SELECT target AS client_ip FROM commands WHERE command = 'ban' AND NOT ({_ALLOWED_OR_BANNED}))", "DRY", "'dry-run (manual)'",
                             domain="'manual'", count="'0'", duration="'dry-run'") + " UNION ALL " + _event(
        "(SELECT target AS client_ip FROM commands WHERE command = 'unban')", "UNBAN", "'manual'"),
    "unban_rows": _event("active_bans", "UNBAN", "reason || '-flush'"),
    "flush_bans": _event(f"(SELECT * FROM active_bans WHERE {_GEO_BAN})", "UNBAN", "'geoip-flush'"),
    "enforcement_set": f"""SELECT CAST(4 AS BIGINT) AS family, client_ip, CASE WHEN is_permanent OR ban_until_epoch = 0 THEN 0 ELSE ban_until_epoch - {NOW} END AS timeout
      FROM active_bans WHERE client_ip NOT IN (SELECT client_ip FROM expired)""",
    "manual_actions": _event(f"(SELECT target AS client_ip FROM commands WHERE command = 'ban' AND NOT ({_ALLOWED_OR_BANNED}))", "BAN", "'manual'",
                             domain="'manual'", count="'0'", duration="'permanent'") + " UNION ALL " + _event(
        "(SELECT target AS client_ip FROM commands WHERE command = 'unban')", "UNBAN", "'manual'"),
    "manual_ban_rows": f"""SELECT client_ip, domain, "count", is_permanent, reason, source FROM in_force
        WHERE client_ip NOT IN (SELECT target FROM commands WHERE command = 'unban')
      UNION ALL SELECT target, 'manual', 0, true, 'manual', 'manual' FROM commands WHERE command = 'ban' AND NOT ({_ALLOWED_OR_BANNED})""",
    "reset_offenses": "SELECT * FROM offenses WHERE client_ip NOT IN (SELECT target FROM commands WHERE command = 'reset-offenses')",
    "bans_by_source": "SELECT * FROM filled_bans WHERE source = 'monitor'",
    "bans_by_reason": "SELECT * FROM filled_bans WHERE reason = 'geoip'",
    "active_bans_list": "SELECT * FROM filled_bans ORDER BY created_seq DESC",
    "expired_bans": "SELECT client_ip, ban_until_epoch FROM expired",
    "expired_offenses": f"SELECT * FROM offenses WHERE last_offense_epoch <= {NOW} - 86400",
    "offense_cleanup": f"SELECT * FROM offenses WHERE NOT last_offense_epoch <= {NOW} - 86400",
    "offense_status": f"SELECT count(*) AS total, count(*) FILTER (last_offense_epoch <= {NOW} - 86400) AS expired FROM offenses",
    "live_active_bans": f"""SELECT client_ip, source, CASE WHEN length(reason) > 18 THEN substr(reason, 1, 17) || '~' ELSE reason END AS reason,
      CASE WHEN is_permanent OR ban_until_epoch = 0 THEN 'permanent' ELSE {_WHEN.format('ban_until_epoch')} END AS until,
      (SELECT count(*) FROM active_bans) - 10 AS more FROM active_bans ORDER BY created_seq DESC LIMIT 10""",
    "live_counters": f"""SELECT (SELECT count(*) FROM raw_queries) AS log_rows, (SELECT count(*) FROM offenses) AS offenses,
      (SELECT count(*) FROM offenses WHERE last_offense_epoch <= {NOW} - 86400) AS expired_offenses, (SELECT count(*) FROM whitelist) AS whitelist_size,
      (SELECT count(*) FROM active_bans) AS active_bans, (SELECT count(*) FROM active_bans WHERE source = 'external-blocklist') AS blocklist_bans,
      (SELECT count(*) FROM active_bans WHERE reason = 'geoip') AS geoip_bans""",
    "history_recent": f"SELECT {_HIST_COLS} FROM ban_history ORDER BY id DESC LIMIT 50",
    "parse_log_lines": """SELECT event_id, level, epoch_us(logged) AS logged_at_us,
      CASE WHEN event_id % 5 = 0 THEN 'AbuseIPDB: 203.0.113.7 erfolgreich gemeldet' ELSE 'worker run' END AS message FROM leveled""",
    "recent_log_lines": """SELECT event_id, line FROM leveled WHERE level IN ('WARN', 'ERROR') ORDER BY event_id DESC LIMIT 12""",
    "abuse_report_count": """SELECT count(*) AS n FROM log_lines WHERE contains(line, 'AbuseIPDB:') AND contains(line, 'erfolgreich gemeldet')
      AND logged BETWEEN TIMESTAMP '2023-12-21' AND TIMESTAMP '2024-01-19 23:59:59'""",
    "report_window": f"""SELECT w.*, (SELECT count(*) FROM ban_history h WHERE h.timestamp_epoch BETWEEN w.since AND w.until) AS n FROM ({_report_windows()}) w""",
    "report_kpis": """SELECT (SELECT count(*) FROM window_bans) AS total_bans,
      (SELECT count(*) FROM ban_history WHERE action = 'UNBAN' AND timestamp_epoch BETWEEN epoch(TIMESTAMP '2000-05-16') AND epoch(TIMESTAMP '2000-06-14 23:59:59')) AS total_unbans,
      (SELECT count(DISTINCT client_ip) FROM window_bans) AS unique_ips,
      (SELECT count(*) FROM window_bans WHERE lower(coalesce(duration, '')) LIKE '%permanent%') AS permanent_bans,
      (SELECT count(*) FROM window_bans WHERE lower(coalesce(reason, '')) LIKE '%rate%limit%') AS rate_limit_bans,
      (SELECT count(*) FROM window_bans WHERE lower(coalesce(reason, '')) LIKE '%subdomain%flood%') AS subdomain_flood_bans,
      (SELECT count(*) FROM window_bans WHERE lower(coalesce(reason, '')) LIKE '%external%blocklist%') AS external_blocklist_bans,
      (SELECT count(*) FROM active_bans) AS active_bans""",
    "report_busiest_day": "SELECT substr(timestamp_text, 1, 10) AS day, count(*) AS n FROM window_bans GROUP BY 1 ORDER BY n DESC, day DESC LIMIT 1",
    "report_top_clients": _BARS.format(top=_TOP.format(key="client_ip", rows="window_bans")),
    "report_top_domains": _BARS.format(top=_TOP.format(key="domain", rows="(SELECT * FROM window_bans WHERE coalesce(domain, '') NOT IN ('', '-'))")),
    "report_protocols": "SELECT name, n, CASE WHEN name IN ('dns', 'doh', 'dot') THEN name ELSE '' END AS css_class FROM ("
                        + _TOP.format(key="coalesce(nullif(protocol, ''), 'unbekannt')", rows="window_bans") + ")",
    "report_reasons": _TOP.format(key="coalesce(nullif(reason, ''), 'unknown')", rows="window_bans"),
    "report_sources": _TOP.format(key="coalesce(nullif(source, ''), 'unknown')", rows="active_bans"),
    "report_recent_bans": """SELECT id, substr(timestamp_text, 6, 11) AS shown_at, client_ip, coalesce(nullif(domain, ''), '-') AS domain,
      coalesce(nullif(reason, ''), 'rate-limit') AS reason,
      CASE reason WHEN 'subdomain-flood' THEN 'subdomain-flood' WHEN 'external-blocklist' THEN 'external' ELSE 'rate-limit' END AS css_class
      FROM window_bans ORDER BY id DESC LIMIT 10""",
    "report_recent_events": f"SELECT {_HIST_COLS} FROM ban_history ORDER BY id DESC LIMIT 20",
    "report_period_overview": f"""SELECT p.position, p.label, count(*) FILTER (h.action = 'BAN') AS bans, count(*) FILTER (h.action = 'UNBAN') AS unbans,
      count(DISTINCT CASE WHEN h.action = 'BAN' THEN h.client_ip END) AS unique_ips,
      count(*) FILTER (h.action = 'BAN' AND h.duration = 'permanent') AS permanent_bans
      FROM ({_periods()}) p LEFT JOIN ban_history h ON h.timestamp_epoch BETWEEN p.since AND p.until GROUP BY p.position, p.label""",
    "alert_outbox": f"""SELECT client_ip, 'ban' AS action, CASE WHEN source = 'geoip' THEN {_GEO_MESSAGE.replace("'Land: ' || geoip_country", "'Land: ' || coalesce(geoip_country, '')")} ELSE {_BAN_MESSAGE} END AS message, {_TITLE} AS title
        FROM active_bans WHERE source <> 'external-blocklist'
      UNION ALL SELECT client_ip, 'unban', {_FREE_MESSAGE}, {_TITLE} FROM expired
      UNION ALL SELECT '', 'geoip-flush', {_bits("'✅ DNS Guard Bulk-Freigabe auf dns1'", "'---'", "'Freigegebene IPs: ' || CAST(count(*) AS STRING)", "'Aktion: Geoip-Flush'")}, {_TITLE}
        FROM active_bans WHERE {_GEO_BAN} HAVING count(*) > 0""",
    "abuse_candidates": """SELECT client_ip AS ip, '4' AS categories, 'DNS flooding on our DNS server: ' || CAST("count" AS STRING) || 'x ' || domain
      || ' in 604800s. Banned by DNS Guard 🔗 https://example.invalid/dns-guard' AS comment FROM active_bans WHERE source = 'monitor' AND is_permanent""",
}

def _history_replay(horizon: int) -> str:
    """History rows alone, without the level."""
    return _replay(_WATCHED_HITS, f"AND fin <= {horizon}").replace("shown AS offense_level, ", "").replace("SELECT client, shown, fin,", "SELECT client, fin,")


def _bundle(since: str, day_since: str, until: str) -> str:
    """The report on the history and the ban table of a replay over all of the log."""
    wrote = _history_replay(AS_OF_EPOCH + 40 * 86400).replace("SELECT client AS client_ip", ", wrote AS (SELECT client AS client_ip", 1) + ")"
    like = "lower(coalesce({0}, '')) LIKE '{1}'"
    lists = {"top_clients": "client_ip", "protocols": "coalesce(nullif(protocol, ''), 'unbekannt')", "reasons": "coalesce(nullif(reason, ''), 'unknown')"}
    entries = [f"SELECT '{name}' AS t, {key} AS name FROM inside" for name, key in lists.items()]
    entries += ["SELECT 'top_domains', domain FROM inside WHERE coalesce(domain, '') NOT IN ('', '-')",
                f"SELECT 'busiest_day', substr(timestamp_text, 1, 10) FROM wrote WHERE action = 'BAN' AND timestamp_epoch BETWEEN epoch({day_since}) AND epoch({until})",
                "SELECT 'sources', 'monitor' FROM lasting"]
    kpis = {"total_bans": "FROM inside", "unique_ips": "FROM (SELECT DISTINCT client_ip FROM inside)", "active_bans": "FROM lasting",
            "total_unbans": f"FROM wrote WHERE action = 'UNBAN' AND timestamp_epoch BETWEEN epoch({since}) AND epoch({until})",
            "permanent_bans": "FROM inside WHERE " + like.format("duration", "%permanent%"),
            "rate_limit_bans": "FROM inside WHERE " + like.format("reason", "%rate%limit%"),
            "subdomain_flood_bans": "FROM inside WHERE " + like.format("reason", "%subdomain%flood%"),
            "external_blocklist_bans": "FROM inside WHERE " + like.format("reason", "%external%blocklist%")}
    single = " UNION ALL ".join(f"SELECT 'kpis', '{name}', count(*) {rows}" for name, rows in kpis.items())
    periods = [("Gestern", 1, f"{_AS_OF} - INTERVAL 1 SECOND")] + [(f"Letzte {d} Tage", d, _AS_OF) for d in (7, 14, 30)]
    overview = " UNION ALL ".join(
        f"SELECT 'period_overview', '{label}', count(*) FROM wrote WHERE action = 'BAN' AND timestamp_epoch BETWEEN epoch({_AS_OF} - INTERVAL {d} DAY) AND epoch({end})"
        for label, d, end in periods)
    return f"""{wrote},
    inside AS (SELECT * FROM wrote WHERE action = 'BAN' AND timestamp_epoch BETWEEN epoch({since}) AND epoch({until})),
    lasting AS (SELECT DISTINCT client FROM chain WHERE forever OR fin > {AS_OF_EPOCH + 40 * 86400}),
    counts AS (SELECT t, name, count(*) AS n FROM ({' UNION ALL '.join(entries)}) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, CASE WHEN t = 'busiest_day' THEN name END DESC, name) AS r FROM counts)
    SELECT t AS "table", name, n FROM ranked WHERE r <= CASE t WHEN 'busiest_day' THEN 1 ELSE 20 END
    UNION ALL {single} UNION ALL {overview}
    UNION ALL SELECT 'recent_bans', client_ip, 1 FROM (FROM inside ORDER BY timestamp_epoch DESC, client_ip DESC LIMIT 10)"""


# Replays end in further common table expressions.
REPLAYS = {
    "ledger_replay": _replay("SELECT at_us, client, target, n, protocol, 'rate-limit' AS reason, false AS permanent FROM rate_trail", ""),
    "ledger_replay_watched": _replay(_WATCHED_HITS, f"AND fin <= {AS_OF_EPOCH}"),
    "ledger_replay_steps": _history_replay(AS_OF_EPOCH + 40 * 86400),
    # all of the history within a week, newest first
    "history_append": _history_replay(AS_OF_EPOCH).replace("reason FROM chain", f"reason FROM chain WHERE at_s BETWEEN {AS_OF_EPOCH - 7 * 86400} AND {AS_OF_EPOCH}")
        + f" AND fin >= {AS_OF_EPOCH - 7 * 86400} ORDER BY timestamp_epoch DESC, client_ip DESC, action DESC LIMIT 50",
    "report_bundle": _bundle("TIMESTAMP '2023-12-21'", "TIMESTAMP '2023-12-21'", "TIMESTAMP '2024-01-19 23:59:59'"),
}


def _needed(text: str) -> list[str]:
    """Names of the expressions a text uses, with what those use in turn."""


    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & CTES.keys() - found:
            found.add(name)
            todo.append(CTES[name])
    return [name for name in CTES if name in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, text in FINAL.items():
        ctes = ", ".join(f"{c} AS ({CTES[c]})" for c in _needed(text))
        out[name] = f"WITH {ctes} {text}" if ctes else text
    for name, text in REPLAYS.items():
        ctes = ", ".join(f"{c} AS ({CTES[c]})" for c in _needed(text))
        out[name] = f"WITH RECURSIVE {ctes}, {text}"
    return out
