"""Change logs under several writers, repeated batches, fresh checkpoints and compactions."""

import random

from pyspark.sql import functions as F

from tests.helpers import rows
from tidewarden.schemas import ACTIVE_BANS, BAN_HISTORY
from tidewarden.sources import changes, tables

BAN = "client_ip string, count long, second long"


def act(spark, path, run, sequence, opened=(), lifted=()):
    """Rows of (client, count, second) and (client, second)."""
    return tables.change_bans(spark, path, run, sequence, spark.createDataFrame(list(opened), BAN),
                              spark.createDataFrame(list(lifted), "client_ip string, second long"), F.col("second"), F.col("second"))


def now(spark, path):
    return rows(tables.read_bans(spark, path), "client_ip", "count")


def test_writers_do_not_meet(spark, tmp_path):
    path = str(tmp_path / "bans")
    assert now(spark, path) == []
    assert act(spark, path, "stream", 0, [("a", 1, 10), ("b", 1, 10)]) == 1
    assert act(spark, path, "lists", 0, [("c", 2, 11)], [("a", 12)]) == 2
    assert act(spark, path, "stream", 0, [("x", 9, 99)]) is None  # a repeated batch
    assert act(spark, path, "stream", 1, [("a", 3, 12)]) == 3  # banned again in the second of the unban
    assert act(spark, path, "fresh", 0, [("d", 4, 5)], [("b", 9)]) == 4  # a fresh checkpoint; an unban that came late
    assert now(spark, path) == [("a", 3), ("b", 1), ("c", 2), ("d", 4)]
    assert tables.compact_bans(spark, path) == 4 and tables.compact_bans(spark, path) is None
    assert act(spark, path, "stream", 1, [("x", 9, 99)]) is None and act(spark, path, "lists", 0) is None
    assert act(spark, path, "lists", 3, [("e", 5, 1)], [("c", 10), ("b", 10)]) == 5  # c: older than its ban; b: as old
    assert now(spark, path) == [("a", 3), ("b", 1), ("c", 2), ("d", 4), ("e", 5)]


def test_a_deletion_outlives_a_compaction(spark, tmp_path):
    path = str(tmp_path / "bans")
    act(spark, path, "one", 0, [("a", 1, 10)], [("a", 20)])
    tables.compact_bans(spark, path)
    act(spark, path, "two", 0, [("a", 2, 15)])
    assert now(spark, path) == []


def test_unfinished_writes_are_not_read(spark, tmp_path):
    path = str(tmp_path / "bans")
    act(spark, path, "one", 0, [("a", 1, 10)])
    spark.createDataFrame([("z",)], "client_ip string").write.parquet(f"{path}/data/attempt=dead")
    (tmp_path / "bans" / "log" / "2").write_text("")  # died before it said what it had written
    assert now(spark, path) == [("a", 1)]
    assert act(spark, path, "one", 1, [("b", 1, 10)]) == 3
    assert now(spark, path) == [("a", 1), ("b", 1)]


def test_a_lost_race_takes_the_next_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bans")
    act(spark, path, "one", 0, [("a", 1, 10)])
    create, raced = changes.Log._create, []

    def slow(self, name, entry):
        if not raced:
            raced.append(name)
            act(spark, path, "other", 0, [("b", 2, 10)])
        return create(self, name, entry)

    monkeypatch.setattr(changes.Log, "_create", slow)
    assert act(spark, path, "one", 1, [("c", 3, 10)]) == 3
    assert now(spark, path) == [("a", 1), ("b", 2), ("c", 3)]


def test_random_order_of_arrival(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "bans")
    made = [(f"c{rng.randrange(12)}", t, rng.random() < 0.4) for t in range(120)]
    want = {}
    for c, t, gone in made:
        want[c] = None if gone else t
    rng.shuffle(made)
    for i in range(6):
        part = made[i * 20:(i + 1) * 20]
        last = {}
        for c, t, gone in part:
            last[c] = max(last.get(c, (-1, False)), (t, gone))
        act(spark, path, f"w{i % 2}", i, [(c, t, t) for c, (t, gone) in last.items() if not gone], [(c, t) for c, (t, gone) in last.items() if gone])
        if i == 3:
            tables.compact_bans(spark, path)
    assert now(spark, path) == sorted((c, n) for c, n in want.items() if n is not None)


def test_history_ids_grow_and_days_prune(spark, tmp_path):
    path = str(tmp_path / "history")
    made = [(86_400 * d + s, "-", "BAN", f"c{s}", "-", "-", "-", "-", "-") for d in range(3) for s in (5, 1, 9)]
    for i, part in enumerate((made[:5], made[5:], made[5:])):
        tables.history_append(spark.createDataFrame(part, BAN_HISTORY), path, "r", min(i, 1))
    got = tables.read_history(spark, path)
    ids = [r.timestamp_epoch for r in got.orderBy("id").collect()]
    assert ids == sorted(m[0] for m in made[:5]) + sorted(m[0] for m in made[5:]) and got.select("id").distinct().count() == 9
    pruned = tables.read_history(spark, path, 86_400, 2 * 86_400 - 1)
    assert pruned.count() == 3
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_step_is_recorded(spark, tmp_path):
    from tidewarden.operators import ledger
    path = str(tmp_path / "bans")
    act(spark, path, "stream", 0, [("a", 1, 10), ("b", 1, 10)])
    table = tables.read_bans(spark, path).withColumn("is_permanent", F.lit(True))
    assert tables.record_step(ledger.flush_bans(table.filter("client_ip = 'a'"), 50), spark, path, "manual", 0, 50) == 2
    assert now(spark, path) == [("b", 1)]
    assert tables.read_bans(spark, path).schema.names == ACTIVE_BANS.names
