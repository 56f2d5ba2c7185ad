from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import rows
from test_changes import change
from tallyframe.operators import replicate
from tallyframe.schemas import CHANGE_LOG
from tallyframe.sources.versions import current_version
from tallyframe.streaming import fold, imports, replication, sinks


@pytest.fixture
def deliver(spark, table, tmp_path):
    """deliver([...], [...]): a stream with one micro-batch per list of changes."""
    def build(*batches):
        path = str(tmp_path / "in")
        for b in batches:
            table("change_log", *b).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(CHANGE_LOG).option("maxFilesPerTrigger", 1).parquet(path)

    return build


def test_apply_matches_the_batch_operators(spark, table, deliver, tmp_path):
    first = [change(1, category="A"), change(2, row="t2"), change(3, op="merge")]
    second = [change(4, category="B"), change(5, row="t2", op="delete"), change(6, row="t3")]
    base = {"transactions": table("transactions", {"id": "t1", "category": "Z"}, {"id": "keep"})}
    log = table("change_log", change(90, device="me"))
    root = str(tmp_path / "state")
    replication.start_apply(deliver(first, second), root, base, log).awaitTermination()
    state = replication.current_tables(spark, root, base)["transactions"]
    assert rows(state, "id", "category") == [("keep", None), ("t1", "B"), ("t3", None)]
    assert rows(replication.current_cursors(spark, root, table("sync_cursors"))) == [("s1", "peer", 6)]
    assert rows(replication.rejected_changes(spark, root), "id", "reason") == [("3", "unknown operation")]
    assert rows(replication.recorded_conflicts(spark, root), "seq", "local_value", "remote_value") == [(1, "Z", "A"), (4, "A", "B")]


def test_a_batch_without_commit_is_invisible(spark, table, deliver, tmp_path):
    root = str(tmp_path / "state")
    base = {"transactions": table("transactions")}
    replication.start_apply(deliver([change(1)]), root, base, table("change_log")).awaitTermination()
    table("change_log", change(2, row="ghost")).withColumn("batch_no", F.lit(7)).write.parquet(f"{root}/runs/l0/batch_id=7")
    assert rows(replication.current_tables(spark, root, base)["transactions"], "id") == [("t1",)]


def test_runs_are_merged_and_folded_level_by_level(spark, table, deliver, tmp_path):
    """Seven batches in runs of two: state and conflicts are those of one edit after the other."""
    at = "2024-01-01T00:00:{:02d}Z"
    batches = [[change(n, row=f"t{n % 3}", category=f"c{n}", device="ab"[n % 2], at=at.format(n))] for n in range(1, 6)]
    batches[1].append(change(50, row="t9", op="delete", device="a", at=at.format(2)))
    batches += [[change(6, row="t0", op="delete", device="a", at=at.format(6))], [change(7, row="t0", category="again", device="b", at=at.format(7))]]
    base = {"transactions": table("transactions", {"id": "t0", "category": "Z"}, {"id": "t9"}, {"id": "keep", "category": "K"})}
    root, log = str(tmp_path / "state"), table("change_log", change(90, row="t0", device="c", at=at.format(0)))
    replication.start_apply(deliver(*batches), root, base, log, fan=2).awaitTermination()
    state = replication.current_tables(spark, root, base)["transactions"]
    assert rows(state, "id", "category") == [("keep", "K"), ("t0", "again"), ("t1", "c4"), ("t2", "c5")]
    # an edit meets the value that the one before it left, whether that is in the base, a merged run or an open one
    found = rows(replication.recorded_conflicts(spark, root), "seq", "local_value", "remote_value")
    assert found == [(3, "Z", "c3"), (4, "c1", "c4"), (5, "c2", "c5")]
    # seven batches are 111 in binary: four are in the base, which was written anew once, two are merged, one is open
    assert [level for level, _ in fold.newest_state(spark, root)] == [1, 0] and fold.state_before(spark, root, 4) == []
    assert current_version(spark, f"{root}/base/transactions", "index") == 2


def test_deleted_accounts_take_stored_rows_along_in_a_fold(spark, table, deliver, tmp_path):
    base = {"transactions": table("transactions", {"id": "t1", "account_id": "a1"}, {"id": "t2", "account_id": "a2"}),
            "accounts": table("accounts", {"id": "a1", "space_id": "s1"}, {"id": "a2", "space_id": "s1"})}
    gone = {**change(1, row="a1", op="delete"), "table_name": "accounts"}
    root = str(tmp_path / "state")
    stream = deliver([gone], [change(2, row="t3")], [change(3, row="t4")], [change(4, row="t5")])
    replication.start_apply(stream, root, base, table("change_log"), fan=2).awaitTermination()
    tables = replication.current_tables(spark, root, base)
    assert rows(tables["accounts"], "id") == [("a2",)]
    assert rows(tables["transactions"], "id") == [("t2",), ("t3",), ("t4",), ("t5",)]


def test_stream_conflicts_keep_state_between_batches(spark, deliver, tmp_path):
    at = "2024-01-01T00:0{}:00Z"
    stream = deliver(
        [change(1, device="a", category="A", at=at.format(0)), change(2, device="a", category="B", at=at.format(0))],
        [change(3, device="b", category="C", at=at.format(1)), change(4, device="b", category="D", at=at.format(3))],
        [change(5, op="delete", device="a", at=at.format(3)), change(6, device="b", category="E", at=at.format(3))])
    root = str(tmp_path / "out")
    replication.start_conflicts(stream, root).awaitTermination()
    assert rows(spark.read.parquet(f"{root}/rows"), "seq", "local_value", "remote_value") == [(3, "B", "C")]


def walk(changes, tolerance):
    """Conflicts of one row's changes, one after the other, from all entries before each."""
    current, entries, found = None, [], []
    for c in changes:
        others = [e for e in entries if e["device_id"] != c["device_id"]]
        newest = max(others, key=lambda e: (e["changed_at"], e["seq"]), default=None)
        if c["operation"] != "delete":
            near = newest and None not in (newest["epoch"], c["epoch"]) and abs(newest["epoch"] - c["epoch"]) <= tolerance
            if current and near:
                found += [(c["seq"], f, current[f], c[f], newest["changed_at"]) for f in ("category", "note") if current[f] != c[f]]
            current = c
        else:
            current = None
        entries.append(c)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_replay_in_parts_equals_the_walk(seed):
    draw = random.Random(seed)
    for _ in range(60):
        changes = []
        for i in range(draw.randrange(1, 14)):
            second = draw.randrange(20)
            changes.append({"space_id": "s", "row_id": "r", "seq": i + 1, "device_id": draw.choice("abcd"), "operation": draw.choice(["update", "update", "delete"]),
                            "category": draw.choice([None, "A", "B"]), "note": draw.choice(["", "n"]), "changed_at": f"2024-01-01T00:00:{second:02d}Z",
                            "epoch": None if draw.random() < 0.1 else 1704067200 + second})
        got, state, at = [], None, 0
        while at < len(changes):
            size = draw.randrange(1, 6)
            part = changes[at: at + size]
            draw.shuffle(part)  # a batch's rows come in any order
            state, found = replication.replay(state, pd.DataFrame(part), 5)
            got += [(r.seq, r.field, None if pd.isna(r.local_value) else r.local_value, None if pd.isna(r.remote_value) else r.remote_value, r.local_changed_at)
                    for r in found.itertuples()]
            at += size
        assert sorted(got, key=repr) == sorted(walk(changes, 5), key=repr)


def test_late_rows_are_dropped_and_cursors_do_not_regress(spark, table, deliver, tmp_path):
    stream = deliver([change(1, at="2024-06-01T00:00:00Z"), change(2, at="2024-01-01T00:00:00Z")],
                     [change(3, at="2024-05-01T00:00:00Z")],
                     [change(4, at="2024-01-02T00:00:00Z"), change(1, at="2024-06-01T00:00:00Z")])
    root = str(tmp_path / "late")
    cursors = table("sync_cursors", {"space_id": "s1", "peer_device_id": "peer", "last_seq": 99})
    replication.start_late_rows(stream, root, cursors).awaitTermination()
    kept = [r.id for r in replication.kept_rows(spark, root).collect()]
    assert sorted(kept) == ["1", "2", "3"]  # 4 is behind the watermark, the second 1 a repeat
    assert rows(replication.current_cursors(spark, root, cursors)) == [("s1", "peer", 99)]


def test_high_water_updates(spark, deliver, tmp_path):
    root = str(tmp_path / "w")
    stream = replication.stream_high_water(deliver([change(5), change(2)], [change(3), change(8)]))
    sinks.run_batches(stream, root, lambda b, n: sinks.write_batch(b, root, "w", n), mode="update").awaitTermination()
    batches = sinks.read_batches(spark, root, "w", "space_id string, device_id string, max_seq long, batch_id long")
    assert rows(sinks.latest_values(batches, ["space_id", "device_id"])) == [("s1", "peer", 8)]


def test_dedupe_within_a_period(spark, deliver, tmp_path):
    def read(name, stream):
        root = str(tmp_path / name)
        sinks.append_stream(stream, root).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{root}/rows").collect())

    stream = deliver([change(1), change(1)], [change(1), change(2)]).withColumn("t", F.col("changed_at").cast("timestamp"))
    assert read("exact", imports.dedupe_import(stream)) == ["1", "2"]
    assert read("recent", imports.dedupe_recent_import(stream, "t")) == ["1", "2"]


def test_bursts_end_after_the_quiet_period(spark):
    frame = spark.createDataFrame(
        [("s", i, f"2024-01-01 00:59:{s:02d}") for i, s in enumerate((50, 54, 59))] + [("s", 8, "2024-01-01 01:00:03"), ("s", 9, "2024-01-01 01:00:08"), ("t", 10, "2024-01-01 01:00:04")],
        "space_id string, k long, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = imports.mutation_bursts(frame, "at", "k")
    assert rows(got.select("space_id", F.date_format("first_at", "HH:mm:ss").alias("f"), F.date_format("fires_at", "HH:mm:ss").alias("e"), "mutations")) == [
        ("s", "00:59:50", "00:59:59", 2), ("s", "00:59:59", "01:00:08", 2), ("s", "01:00:08", "01:00:13", 1), ("t", "01:00:04", "01:00:09", 1)]


def test_relogged_rows_keep_the_authors_numbers(table):
    changes = table("change_log", change(7, seq=70), change(8, seq=80)).withColumn("batch_no", F.lit(0))
    got = replicate.relogged(changes, 100, "2030-01-01T00:00:00Z")
    assert rows(got, "seq", "origin_seq", "changed_at") == [(101, 70, "2030-01-01T00:00:00Z"), (102, 80, "2030-01-01T00:00:00Z")]
