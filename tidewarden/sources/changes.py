"""Append-only change logs on a shared file system, for several writers.

A write puts its rows into a folder of its own and then takes the next free number of the log by creating a
file that must not exist yet. Only then do readers see it, and all of it. The file names the writer's run and
the sequence within the run, so a repeated batch finds itself there and writes nothing; another run, such as a
stream with a fresh checkpoint, never meets the numbers of an earlier one. Nothing is overwritten.

Keyed tables are folded on read: of the changes of a key the latest decides, by the time of the change and not
by the order of arrival, and a deletion is a change like others. A compaction writes that fold once and says
up to which number it holds; deletions stay in it, since an older change may still arrive.

The file system has to create files atomically when told not to overwrite, as HDFS does.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: columns of a change beside the row itself
CHANGE = T.StructType([T.StructField("changed_at", T.LongType()), T.StructField("deleted", T.BooleanType()),
                       T.StructField("run", T.StringType()), T.StructField("sequence", T.LongType())])
_ORDER = ["changed_at", "run", "sequence", "deleted"]


class Log:
    """The log of one table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self, folder: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{folder}/*")) or []
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def _create(self, name: str, entry: dict) -> bool:
        """Whether the file could be made; False when it exists."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as failed:
            if "AlreadyExists" in str(failed.java_exception.getClass().getName()) or self._fs.exists(self._path(name)):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def _entry(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        # a writer that died while it wrote the entry has taken the number and nothing else
        return json.loads(text) if text else {"attempt": None, "run": None, "sequence": None}

    def state(self) -> tuple[dict | None, list[tuple[int, dict]]]:
        """The newest base and the entries after it."""
        bases = self._numbers("bases")
        base = self._entry(f"bases/{bases[-1]}") | {"number": bases[-1]} if bases else None
        after = [n for n in self._numbers("log") if base is None or n > base["number"]]
        return base, [(n, self._entry(f"log/{n}")) for n in after]

    def _written(self, rows: DataFrame, partition_by: list[str]) -> str:
        attempt = uuid.uuid4().hex
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.path}/data/attempt={attempt}")
        return attempt

    def append(self, rows: DataFrame, run: str, sequence: int, partition_by: list[str] = []) -> int | None:
        """Write ``rows`` once as ``sequence`` of ``run``; sequences of a run grow. The entry's number, None for a repeat."""
        base, entries = self.state()

        def seen() -> bool:
            done = [e["sequence"] for _, e in entries if e["run"] == run] + [(base or {}).get("runs", {}).get(run, -1)]
            return sequence <= max(done)

        if seen():
            return None
        attempt = self._written(rows, partition_by)
        while True:
            number = max([n for n, _ in entries] + [base["number"] if base else 0]) + 1
            if self._create(f"log/{number}", {"attempt": attempt, "run": run, "sequence": sequence}):
                return number
            base, entries = self.state()
            if seen():
                return None

    def read(self, schema: T.StructType, since: int = 0) -> DataFrame:
        """All committed rows with ``entry``, the number of their entry, or those of entries after ``since``."""
        base, entries = self.state()
        numbers = {e["attempt"]: n for n, e in entries if e["attempt"] and n > since}
        if base and base["number"] > since:
            numbers[base["attempt"]] = base["number"]
        full = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        if not numbers:
            return self.spark.createDataFrame([], full).withColumn("entry", F.lit(None).cast("long")).drop("attempt")
        # as many literals as entries since the last compaction
        number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("attempt")]
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(
            *[f"{self.path}/data/attempt={a}" for a in numbers])
        return rows.withColumn("entry", number.cast("long")).drop("attempt")

    def compact(self, schema: T.StructType, keys: list[str]) -> int | None:
        """Write the fold of all entries as a base; entries it covers are no longer read."""
        base, entries = self.state()
        if not entries:
            return None
        runs = dict((base or {}).get("runs", {}))
        for _, e in entries:
            if e["run"] is not None:
                runs[e["run"]] = max(runs.get(e["run"], -1), e["sequence"])
        number = entries[-1][0]
        upto = self.read(schema).filter(F.col("entry") <= number).drop("entry")
        attempt = self._written(latest_changes(upto, keys), [])
        return number if self._create(f"bases/{number}", {"attempt": attempt, "runs": runs}) else None


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The deciding change of every key, deletions included; partial aggregation keeps one per key and task."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*_ORDER)).alias("c"))
    return newest.select(*keys, "c.*").select(changes.columns)


def fold_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that the changes lead to."""
    return latest_changes(changes, keys).filter("NOT deleted").drop(*CHANGE.names, "entry")


def as_changes(rows: DataFrame, changed_at: Column, run: str, sequence: int, deleted: Column | bool = False) -> DataFrame:
    gone = F.lit(deleted) if isinstance(deleted, bool) else deleted
    return rows.select("*", changed_at.cast("long").alias("changed_at"), gone.alias("deleted"), F.lit(run).alias("run"),
                       F.lit(sequence).cast("long").alias("sequence"))
