"""Secret scans with corpus-wide ownership frequency.

Base kinds are found by fixed patterns; ``token`` candidates (long mixed-case runs with digits) are
added where the corpus shows that few owners hold them. For every value the number of distinct
repositories (documents) and owners (sources) that hold it is counted over the whole corpus: values
of many owners are copied examples, values of few owners look live.

Offsets are code points, end exclusive. Null texts count as empty: no spans, the hash of the empty
string. Null owners are one owner. Repeated rows are rows of the result of their own; a document
counts once per value. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import own_columns, staged

# The patterns of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")


def spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """All matches as (start, order, end, kind, value), leftmost first and non-overlapping.

    The texts between the matches give the positions: ``split`` and ``regexp_extract_all`` walk
    the same matches.
    """
    order = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value:string>>)")

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
        seed = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        pieces = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), lambda z: z)

        def step(acc: Column, z: Column) -> Column:
            start = acc["at"] + F.length(z["g"])
            end = start + F.length(z["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), z["v"].alias("value"),
            ))).alias("out"))

        return F.aggregate(F.filter(pieces, lambda z: z["m"].isNotNull()), seed, step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), F.transform(
        F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), located)[0]).otherwise(empty)


def candidates(docs: DataFrame, repo: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per row: repo, owner, base spans, further token spans outside of them."""
    body = own_columns(docs, repo=repo, text=text, owner=owner).withColumn("text", F.coalesce("text", F.lit("")))
    text_col = F.col("text")
    found = body.select(
        "repo", "owner",
        F.filter(spans(text_col, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        spans(text_col, "access", ACCESS).alias("access"), spans(text_col, "hex", HEX).alias("hex"),
        F.filter(spans(text_col, "token", TOKEN),
                 lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")).alias("token"))
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    outside = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select("repo", "owner", "base", outside.alias("more"))


def ownership(held: DataFrame) -> DataFrame:
    """(value_hash, repo, owner) to distinct repositories and owners of every value.

    Copies of one value shrink by partial aggregation before each shuffle.
    """
    by_owner = held.distinct().groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, max_owners: int = 2, repo: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per row: repo, base, spans (base and owner-specific tokens), n_live, n_copied.

    ``n_live`` counts spans whose value at most ``max_owners`` owners hold, ``n_copied`` the others.
    """
    found = staged(candidates(docs, repo, text, owner).withColumn("row", F.monotonically_increasing_id()))
    every = F.concat("base", "more")
    held = found.where(F.size(every) > 0).select("row", "repo", "owner", F.explode(every).alias("span"))
    held = held.withColumn("value_hash", F.sha2(F.col("span.value"), 256))
    known = ownership(held.select("value_hash", "repo", "owner"))
    live = F.col("n_owners") <= max_owners
    judged = (held.join(known, "value_hash")
              .where((F.col("span.kind") != "token") | live)
              .groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"),
                                  F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_copied")))
    return (found.join(judged, "row", "left")
            .select("repo", "base", F.coalesce("spans", "base").alias("spans"),
                    F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")))


def label(found: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
