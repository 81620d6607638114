"""Projections of the star-schema test tables onto the tables the jobs take."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.params import Params

DAY = 86_400
AS_OF = datetime(2024, 1, 20)
AS_OF_EPOCH = 1_705_708_800
REPORT_AS_OF = datetime(2000, 6, 15, 21)
NOW = 1_700_000_000

# The test log spans 30 days with few rows per client, so its windows are days long.
DEMO = Params(
    rate_limit_max_requests=3, rate_limit_window=7 * DAY, check_interval=DAY,
    subdomain_flood_max_unique=4, subdomain_flood_window=7 * DAY,
    watchlist=("example.org",), ban_duration=DAY, progressive_multiplier=2, progressive_max_level=5,
    progressive_reset_after=10 * DAY, report_interval="monthly", report_busiest_day_range=30,
)


class Tables:
    """The tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- query log --------------------------------------------------------------------------

    def _client(self) -> Column:
        """Private, shared and public addresses: different ones up to 640,000 users, valid ones for any."""
        user = F.col("user_id")
        block = F.floor(user / 64_000)
        network = F.when(user % 5 == 0, F.concat(F.lit("10."), block % 256)).when(
            user % 5 == 1, F.concat(F.lit("100."), block % 64 + 64)).otherwise(
            F.concat(F.lit("203."), user % 25 + block % 10 * 25))
        return F.concat(network, F.lit("."), F.floor(user / 250) % 256, F.lit("."), user % 250 + 1)

    def _asked(self) -> DataFrame:
        """Events with the host they ask for: every user has twelve pages, all users together have all of them."""
        pages = self.raw("pages")
        hosts = pages.select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))
        number = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
        asked = (F.col("user_id") * 12 + number % 12) % pages.agg(F.count(F.lit(1))).scalar()
        return self.raw("events").withColumn("page_id", asked).join(hosts, "page_id")

    @staticmethod
    def _proto(plain: str) -> Column:
        kind = F.col("event_type")
        return (F.when(kind == "click", F.lit(plain)).when(kind == "view", F.lit("doh")).when(kind == "purchase", F.lit("dot"))
                .when(kind == "signup", F.lit("doq")).otherwise(F.lit("dnscrypt")))

    def raw_items(self) -> DataFrame:
        """Untidy log items: bad times, blank clients, upper case, trailing dots, repeats."""
        no = F.col("event_id")
        name = F.when(no % 11 == 0, F.lit("")).when(no % 3 == 0, F.concat(F.upper("host"), F.lit("."))).otherwise(F.col("host"))
        copies = F.when(no % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return self._asked().withColumn("copy", F.explode(copies)).select(
            F.when(no % 97 == 0, F.lit("not-a-time")).otherwise(F.concat(
                F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((no % 1000).cast("string"), 3, "0"), F.lit("Z"))).alias("time"),
            F.when(no % 13 == 0, F.lit("  ")).otherwise(self._client()).alias("client"),
            self._proto("").alias("client_proto"),
            F.struct(self._client().alias("ip")).alias("client_info"),
            F.struct(name.alias("name"), F.when(no % 22 == 0, F.lit("")).otherwise(F.col("host")).alias("host")).alias("question"),
        )

    def _queries(self) -> DataFrame:
        return self._asked().select(
            "event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 1000).cast("int").alias("at_ns"),
            self._client().alias("client"), F.col("host").alias("domain"), self._proto("dns").alias("protocol"))

    def queries(self) -> DataFrame:
        return self._queries().select("at", "at_ns", "client", "domain", "protocol")

    def _users(self) -> DataFrame:
        return self._queries().select("client", "user_id").distinct()

    # -- state of the queried clients -------------------------------------------------------

    def whitelist(self) -> DataFrame:
        """Every twentieth client, and one network that exact matching must ignore."""
        listed = self._users().filter("user_id % 20 = 7").select(
            F.col("client").alias("ip_address"),
            F.when(F.col("user_id") % 40 == 7, F.lit("static")).otherwise(F.lit("external")).alias("source"))
        return listed.unionByName(self.spark.createDataFrame([("203.0.0.0/24", "external")], "ip_address string, source string"))

    def client_bans(self) -> DataFrame:
        return self._users().filter("user_id % 6 = 1").select(F.col("client").alias("client_ip"))

    def client_offenses(self) -> DataFrame:
        """Past offences, one ninth of them exactly as old as the reset limit."""
        return self._users().filter("user_id % 3 = 0").select(
            F.col("client").alias("client_ip"), (F.col("user_id") % 6).cast("int").alias("offense_level"),
            (F.lit(AS_OF_EPOCH) - (F.col("user_id") % 9) * 216_000).alias("last_offense_epoch"))

    def geo_cache(self) -> DataFrame:
        return self._users().filter("user_id % 7 = 3").select(
            F.col("client").alias("ip"), F.lit("QQ").alias("country_code"),
            (F.lit(NOW) - (F.col("user_id") % 3) * DAY).alias("looked_up_at_epoch"),
            ((F.col("user_id") % 2) * 123).alias("db_mtime"))

    def geo_ranges(self) -> DataFrame:
        k = F.col("n_nationkey")
        code = F.concat(F.char((F.col("n_regionkey") + 65).cast("long")), F.char((k + 65).cast("long")))

        def row(tail: str, country: Column, registered: Column) -> Column:
            return F.struct(F.concat(F.lit("203."), k.cast("string"), F.lit(tail)).alias("network"),
                            country.alias("country_iso"), registered.alias("registered_iso"))

        wide = row(".0.0/16", F.when(k % 7 == 0, F.lit("")).otherwise(code), code)
        narrow = row(".0.0/24", F.lit("ZZ"), F.lit("ZZ"))
        return self.raw("nation").select(F.inline(F.when(k % 5 == 2, F.array(wide, narrow)).otherwise(F.array(wide))))

    # -- ledger -----------------------------------------------------------------------------

    @staticmethod
    def _customer_ip(key: str) -> Column:
        k = F.col(key)
        return F.concat(F.lit("203."), F.floor(k / 64_000) % 256, F.lit("."), F.floor(k / 250) % 256, F.lit("."), k % 250 + 1)

    def ban_history(self) -> DataFrame:
        no, cust = F.col("o_orderkey"), F.col("o_custkey")
        rank = F.col("o_orderpriority")
        reasons = ["rate-limit", "subdomain-flood", "external-blocklist", "geoip", "", "dns-flood-watchlist"]
        reason = F
        for i, text in enumerate(reasons):
            reason = reason.when(no % 6 == i, F.lit(text))
        return self.raw("orders").select(
            no.alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp_epoch"),
            F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit(" 00:00:00")).alias("timestamp_text"),
            F.when(no % 11 == 0, F.lit("DRY")).when(no % 4 == 0, F.lit("UNBAN")).otherwise(F.lit("BAN")).alias("action"),
            self._customer_ip("o_custkey").alias("client_ip"),
            F.when(no % 9 == 0, F.lit("-")).when(no % 9 == 1, F.lit("")).when(no % 9 == 2, F.lit(None)).otherwise(
                F.concat(F.lit("d"), (cust % 40).cast("string"), F.lit(".example.com"))).alias("domain"),
            (cust % 100).cast("string").alias("count"),
            F.when(F.col("o_orderstatus") == "F", F.lit("permanent")).when(
                F.col("o_orderstatus") == "O", F.lit("3600s")).alias("duration"),
            F.when(rank == "1-URGENT", F.lit("dns")).when(rank == "2-HIGH", F.lit("doh")).when(
                rank == "3-MEDIUM", F.lit("dot")).when(rank == "5-LOW", F.lit("")).alias("protocol"),
            reason.alias("reason"))

    def active_bans(self) -> DataFrame:
        k, segment = F.col("c_custkey"), F.col("c_mktsegment")

        def by_segment(values: dict[str, str], other: str) -> Column:
            out = F
            for name, value in values.items():
                out = out.when(segment == name, F.lit(value))
            return out.otherwise(F.lit(other))

        return self.raw("customer").select(
            self._customer_ip("c_custkey").alias("client_ip"),
            F.concat(F.lit("d"), (k % 40).cast("string"), F.lit(".example.com")).alias("domain"),
            (k % 100).cast("int").alias("count"),
            F.when(k % 3 == 0, F.lit(0)).otherwise(F.lit(NOW) + (k % 11 - 5) * 600).cast("long").alias("ban_until_epoch"),
            F.lit(3600).cast("long").alias("ban_duration"), (k % 6).cast("int").alias("offense_level"),
            (k % 3 == 0).alias("is_permanent"),
            by_segment({"HOUSEHOLD": "rate-limit", "MACHINERY": "subdomain-flood", "FURNITURE": "geoip",
                        "BUILDING": "external-blocklist"}, "manual").alias("reason"),
            F.lit("doh").alias("protocol"),
            by_segment({"HOUSEHOLD": "monitor", "MACHINERY": "monitor", "FURNITURE": "geoip",
                        "BUILDING": "external-blocklist"}, "").alias("source"),
            F.when(k % 4 == 0, F.lit(None)).otherwise(
                F.concat(F.char((F.col("c_nationkey") + 65).cast("long")), F.lit("X"))).alias("geoip_country"),
            F.when(k % 5 == 0, F.lit("allowlist")).otherwise(F.lit("blocklist")).alias("geoip_mode"),
            k.alias("created_seq"))

    def offenses(self) -> DataFrame:
        return self.active_bans().filter("created_seq % 2 = 0").select(
            "client_ip", "offense_level", (F.lit(NOW) - (F.col("created_seq") % 9) * 21_600).alias("last_offense_epoch"))

    def commands(self) -> DataFrame:
        seq = F.col("created_seq")
        return self.active_bans().filter("created_seq % 10 = 0").select(
            seq.alias("seq"), F.col("client_ip").alias("target"),
            F.when(seq % 3 == 0, F.lit("ban")).when(seq % 3 == 1, F.lit("unban")).otherwise(
                F.lit("reset-offenses")).alias("command"))

    # -- lists and logs ---------------------------------------------------------------------

    def list_lines(self) -> DataFrame:
        no = F.col("page_id")
        host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
        tail = F.concat(F.floor(no / 250) % 256, F.lit("."), no % 250 + 1)
        forms = [
            F.concat(F.lit("203.0."), tail, F.lit(" # reason")),
            F.concat(F.lit("0.0.0.0 "), host),
            F.col("url"),
            F.concat(F.lit("198."), F.floor(no / 250) % 200 + 50, F.lit("."), no % 250, F.lit(".0/24")),
            F.concat(F.lit("# "), F.col("url")),
            F.concat(F.lit("203.0."), tail, F.lit(":8443")),
            F.concat(host, F.lit(" ; note")),
            F.lit(""),
            F.concat(F.lit("203.1."), tail, F.lit(" extra")),
        ]
        line = F
        for i, form in enumerate(forms):
            line = line.when(no % 9 == i, form)
        return self.raw("pages").select(
            "page_id", F.concat(F.lit("src"), (no % 3).cast("string")).alias("source_name"), line.alias("line"))

    def list_snapshots(self) -> DataFrame:
        """A first copy of three sources, a newer one of src0 with status 203, failed fetches, and src4, emptied since."""
        lines = self.list_lines()
        newer = F.when((F.col("source_name") == "src0") & (F.col("page_id") % 2 == 0), F.array(F.lit(1), F.lit(2))).otherwise(
            F.array(F.lit(1)))
        good = lines.select("source_name", F.explode(newer).alias("fetched_seq"), "line").select(
            "source_name", "fetched_seq", F.when(F.col("fetched_seq") == 2, F.lit(203)).otherwise(F.lit(200)).alias("status"), "line")
        once = self.active_bans().filter("source = 'external-blocklist'").select(
            F.lit("src4").alias("source_name"), F.lit(1).alias("fetched_seq"), F.lit(200).alias("status"), F.col("client_ip").alias("line"))
        failed = self.spark.createDataFrame(
            [("src1", 2, 503, None), ("src2", 2, 304, None), ("src3", 1, 503, None)],
            "source_name string, fetched_seq int, status int, line string")
        return good.unionByName(once).unionByName(failed)

    def list_fetches(self) -> DataFrame:
        """One row per source and copy, also where a copy has no lines."""
        emptied = self.spark.createDataFrame([("src4", 2, 200)], "source_name string, fetched_seq int, status int")
        return self.list_snapshots().select("source_name", "fetched_seq", "status").distinct().unionByName(emptied)

    def dns_answers(self) -> DataFrame:
        no = F.col("page_id")
        return self.raw("pages").filter("page_id % 4 <> 3").select(
            F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"),
            F.when(no % 10 == 0, F.lit("0.0.0.0")).otherwise(
                F.concat(F.lit("198.18."), F.floor(no / 250) % 256, F.lit("."), no % 250)).alias("address")).distinct()

    def log_lines(self) -> DataFrame:
        no, kind = F.col("event_id"), F.col("event_type")
        stamp = F.substring(F.col("ts").cast("string"), 1, 19)
        tag = (F.when(kind == "error", F.lit(" [ERROR] ")).when(kind == "signup", F.lit(" [WARN] "))
               .when(kind == "click", F.lit(" [INFO] ")).when(kind == "view", F.lit(" [DEBUG] ")).otherwise(F.lit(" ")))
        return self.raw("events").select("event_id", F.concat(
            F.when(no % 2 == 0, F.concat(F.lit("["), stamp, F.lit("]"))).otherwise(F.replace(stamp, F.lit("-"), F.lit("/"))),
            tag,
            F.when(no % 5 == 0, F.lit("AbuseIPDB: 203.0.113.7 erfolgreich gemeldet")).otherwise(F.lit("worker run")),
        ).alias("line"))
