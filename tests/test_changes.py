from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import capture, mutate, replicate, retention
from tallyframe.schemas import LOGGED, TABLES

BASE = "2024-01-01T00:00:"


def payload(i="t1", note="", category=None, account="a", approved=0, amount=-12500):
    return json.dumps({"id": i, "booking_date": "2024-01-01", "value_date": "2024-01-01", "reference": "r",
                       "text": "x", "currency": "SEK", "amount": amount, "balance": 0, "approved": approved,
                       "note": note, "category": category, "account_id": account})


def change(i, row="t1", op="update", device="peer", seq=None, at=f"{BASE}30Z", table_name="transactions", **body):
    return {"id": str(i), "space_id": "s1", "table_name": table_name, "row_id": row, "operation": op,
            "payload": None if op == "delete" else body.pop("raw", None) or payload(row, **body), "seq": i if seq is None else seq,
            "device_id": device, "changed_at": at}


def batch(table, *changes):
    return table("change_log", *changes).withColumn("batch_no", F.lit(0))


# ---- conflicts ----------------------------------------------------------------------
def conflicts(table, incoming, stored, local):
    base = table("transactions", *([{"id": "t1", **local}] if local is not None else []))
    found = replicate.detect_conflicts(batch(table, *incoming), base, table("change_log", *stored))
    return rows(found, "seq", "field", "local_value", "remote_value")


@pytest.mark.parametrize("second, hit", [("29", True), ("30", True), ("31", False)])
def test_conflict_limit_is_inclusive(table, second, hit):
    incoming = [change(1, category="Food", at=f"2024-01-01T00:01:{second}Z")]
    got = conflicts(table, incoming, [change(9, device="me")], {"category": "Rent"})
    assert got == ([(1, "category", "Rent", "Food")] if hit else [])


@pytest.mark.parametrize("local, remote, fields", [
    ({"category": "A", "note": "n"}, {"category": "A", "note": "n"}, []),
    ({"category": None, "note": "n"}, {"category": "A", "note": "m"}, ["category", "note"]),
    ({"category": None, "note": "n"}, {"category": None, "note": "m"}, ["note"]),
    ({"category": "A", "note": "n"}, {"category": None, "note": "n"}, ["category"]),
])
def test_conflict_fields(table, local, remote, fields):
    got = conflicts(table, [change(1, **remote)], [change(9, device="me")], local)
    assert [r[1] for r in got] == fields


def test_no_conflict_without_row_other_author_or_valid_time(table):
    mine = [change(9, device="me")]
    assert conflicts(table, [change(1, category="A")], mine, None) == []
    assert conflicts(table, [change(1, category="A")], [change(9, device="peer")], {"category": "B"}) == []
    assert conflicts(table, [change(1, category="A", at="2024-01-01 00:00:30")], mine, {"category": "B"}) == []


def test_local_value_follows_the_batch(table):
    steps = [change(1, category="A"), change(2, category="B"), change(3, op="delete"), change(4, category="C"),
             change(5, category="D")]
    got = conflicts(table, steps, [change(9, device="me")], {"category": "Z"})
    assert got == [(1, "category", "Z", "A"), (2, "category", "A", "B"), (5, "category", "C", "D")]


def test_recording_is_idempotent(table):
    found = replicate.detect_conflicts(batch(table, change(1, category="A")),
                                       table("transactions", {"id": "t1", "category": "B"}),
                                       table("change_log", change(9, device="me")))
    once = replicate.record_conflicts(table("sync_conflicts"), found, "now")
    assert once.count() == 1 and replicate.record_conflicts(once, found, "later").count() == 1
    assert rows(once, "resolved", "local_value") == [(False, "B")]


# ---- validation ---------------------------------------------------------------------
def test_validation_names_each_fault(table):
    good_member = json.dumps({"space_id": "s", "user_id": "u", "role": "owner", "joined_at": "t", "user": {
        "id": "u", "name": "n", "pin_hash": None, "created_at": "c", "updated_at": "u"}})
    frame = batch(
        table, change(1), change(2, op="merge"), change(3, table_name="ghosts"),
        {**change(4), "payload": None}, change(5, raw='{"id":"t1"}'), change(6, raw="not json"),
        change(7, row="nocolon", op="delete", table_name="space_settings"),
        change(8, row="a:b", op="delete", table_name="space_settings"),
        change(9, row="s:u", table_name="space_members", raw=good_member),
        change(10, raw=payload().replace("-12500", '"abc"')))
    valid, rejected = replicate.validate_changes(frame)
    assert {r.id for r in valid.collect()} == {"1", "8", "9"}
    assert {r.id: r.reason for r in rejected.collect()} == {
        "2": "unknown operation", "3": "unknown table", "4": "missing payload",
        "5": "payload does not match the table", "6": "payload does not match the table",
        "7": "malformed composite row id", "10": "payload does not match the table"}


# ---- apply --------------------------------------------------------------------------
def test_arrival_order_overwrites_whatever_the_times_say(table):
    changes = batch(table, change(1, note="new", at="2024-06-01T00:00:00Z"), change(2, note="old", at="2023-01-01T00:00:00Z"))
    out = replicate.apply_changes({"transactions": table("transactions", {"id": "t1", "note": "was"})}, changes)
    assert rows(out["transactions"], "id", "note") == [("t1", "old")]


def test_account_delete_cascades_at_its_moment(table):
    account = json.dumps({"id": "a", "name": "n", "currency": "SEK", "account_type": "checking",
                          "account_source": "x", "color": "c", "space_id": "s1"})
    tables = {"accounts": table("accounts", {"id": "a", "space_id": "s1"}),
              "transactions": table("transactions", {"id": "stored", "account_id": "a"}, {"id": "other", "account_id": "b"}),
              "account_summaries": table("account_summaries", {"account_id": "a", "month": "2024-01"})}
    changes = batch(table, change(1, row="early"), change(2, row="a", op="delete", table_name="accounts"),
                    change(3, row="a", table_name="accounts", raw=account), change(4, row="late"))
    out = replicate.apply_changes(tables, changes)
    assert rows(out["transactions"], "id") == [("late",), ("other",)]
    assert rows(out["accounts"], "id") == [("a",)] and out["account_summaries"].count() == 0


def test_space_delete_is_soft_and_lasting(table):
    space = json.dumps({"id": "s1", "name": "again", "created_at": "c", "updated_at": "u2"})
    changes = batch(table, change(1, row="s1", op="delete", table_name="spaces"),
                    change(2, row="s1", table_name="spaces", raw=space))
    out = replicate.apply_changes({"spaces": table("spaces", {"id": "s1", "name": "n", "created_at": "c0"})}, changes)
    assert rows(out["spaces"], "id", "name", "created_at", "deleted") == [("s1", "again", "c0", True)]


def device(i, **over):
    return json.dumps({"id": i, "space_id": "s1", "device_id": "d", "display_name": "n", "cert_pem": "c",
                       "sync_enabled": 1, "paired_at": "p", **over})


@pytest.mark.parametrize("steps, want", [
    ([("up", "remote-uuid")], [("local-uuid", "n")]),
    ([("del", "local-uuid")], []),
    ([("del", "remote-uuid")], [("local-uuid", "mine")]),
    ([("del", "local-uuid"), ("up", "remote-uuid")], [("remote-uuid", "n")]),
    ([("up", "remote-uuid"), ("del", "local-uuid")], []),
])
def test_device_upsert_keeps_the_local_id(table, steps, want):
    changes = batch(table, *[
        change(n, row=i, op="delete" if s == "del" else "insert", table_name="trusted_devices",
               **({} if s == "del" else {"raw": device(i)})) for n, (s, i) in enumerate(steps)])
    local = table("trusted_devices", {"id": "local-uuid", "space_id": "s1", "device_id": "d", "display_name": "mine"})
    out = replicate.apply_changes({"trusted_devices": local}, changes)
    assert rows(out["trusted_devices"], "id", "display_name") == want


def test_member_change_brings_its_user(table):
    user = {"id": "u", "name": "New", "pin_hash": "h", "created_at": "c", "updated_at": "u2"}
    member = json.dumps({"space_id": "s1", "user_id": "u", "role": "owner", "joined_at": "j", "user": user})
    out = replicate.apply_changes(
        {"space_members": table("space_members"), "users": table("users", {"id": "u", "name": "Old", "created_at": "c0"})},
        batch(table, change(1, row="s1:u", table_name="space_members", raw=member)))
    assert rows(out["space_members"], "user_id", "role") == [("u", "owner")]
    assert rows(out["users"], "name", "pin_hash", "created_at") == [("New", "h", "c0")]


def test_random_batches_equal_sequential_apply(table):
    rng = random.Random(11)
    for _ in range(3):
        state = {f"t{i}": ("base", "a") for i in range(6)}
        base = table("transactions", *[{"id": k, "note": v[0], "account_id": v[1]} for k, v in state.items()])
        changes = []
        for seq in range(40):
            row = f"t{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                changes.append(change(seq, row=row, op="delete"))
                state.pop(row, None)
            else:
                changes.append(change(seq, row=row, note=f"n{seq}"))
                state[row] = (f"n{seq}", "a")
        out = replicate.apply_changes({"transactions": base}, batch(table, *changes))["transactions"]
        assert rows(out, "id", "note", "account_id") == sorted((k, *v) for k, v in state.items())


# ---- cursors and batches ------------------------------------------------------------
def test_cursors_never_regress_and_default_to_zero(spark, table):
    cursors = table("sync_cursors", {"space_id": "s1", "peer_device_id": "A", "last_seq": 100})
    reached = spark.createDataFrame([("s1", "A", 50), ("s1", "B", 20)], "space_id string, device_id string, max_seq long")
    assert rows(replicate.advance_cursors(cursors, reached)) == [("s1", "A", 100), ("s1", "B", 20)]
    asked = spark.createDataFrame([("s1", "A"), ("s1", "C")], "space_id string, device_id string")
    assert rows(replicate.get_cursors(asked, cursors)) == [("s1", "A", 100), ("s1", "C", 0)]


def test_read_batches_by_limit(table):
    log = table("change_log", *[change(i, seq=i * 3) for i in range(1, 12)])
    cursors = table("sync_cursors", {"space_id": "s1", "peer_device_id": "peer", "last_seq": 6})
    got = rows(replicate.read_changes_since(log, cursors, limit=4), "batch_no", "seq")
    assert sorted(got) == [(n // 4, (n + 3) * 3) for n in range(9)]


@pytest.mark.parametrize("cursor, first, mode", [(0, 5, "delta"), (3, 5, "snapshot"), (5, 5, "delta"), (9, None, "delta")])
def test_snapshot_only_below_the_retained_log(spark, table, cursor, first, mode):
    log = table("change_log", *([change(first)] if first else []))
    cursors = table("sync_cursors", {"space_id": "s1", "peer_device_id": "peer", "last_seq": cursor})
    asked = spark.createDataFrame([("s1", "peer")], "space_id string, device_id string")
    assert rows(replicate.plan_delta_or_snapshot(log, asked, cursors), "mode") == [(mode,)]


def test_batch_kinds(table):
    def kind(*changes):
        return rows(replicate.classify_batches(batch(table, *changes), "me"), "kind")

    gone = change(1, row="dev", op="delete", table_name="trusted_devices")
    assert kind(change(2), gone) == [("potential_eviction",)]
    assert kind({**gone, "device_id": "me"}) == [("normal",)]
    assert kind(gone, change(2, row="s1", op="delete", table_name="spaces")) == [("space_deletion",)]
    assert kind(change(2, row="s1", table_name="spaces", raw="{}")) == [("normal",)]


def test_eviction_is_confirmed_by_an_own_row(table):
    devices = table("trusted_devices", {"id": "mine", "space_id": "s1", "device_id": "me"}, {"id": "x", "device_id": "d"})
    frame = batch(table, change(1, row="mine", op="delete", table_name="trusted_devices"),
                  change(2, row="x", op="delete", table_name="trusted_devices"))
    assert rows(replicate.confirm_eviction(frame, devices, "me"), "own_rows") == [(1,)]
    assert rows(replicate.confirm_eviction(frame, devices, "nobody")) == []


# ---- capture ------------------------------------------------------------------------
@pytest.fixture
def world(table):
    return {
        "users": table("users", {"id": "u", "name": "U"}), "spaces": table("spaces", {"id": "s", "name": "S"}),
        "space_members": table("space_members", {"space_id": "s", "user_id": "u", "role": "owner"}),
        "space_settings": table("space_settings", {"space_id": "s", "key": "k", "value": "v"}),
        "categories": table("categories", {"id": "c", "name": "Food", "space_id": "s"}),
        "accounts": table("accounts", {"id": "a", "name": "A", "space_id": "s"}),
        "transactions": table("transactions", {"id": "t1", "account_id": "a"}, {"id": "t2", "account_id": "a", "category": "Food"}),
        "account_summaries": table("account_summaries", {"month": "2024-01", "account_id": "a"}),
        "trusted_devices": table("trusted_devices", {"id": "d1", "space_id": "s", "device_id": "d"}),
        "model_versions": table("model_versions", {"space_id": "s", "version": 1}),
        "evicted_devices": table("evicted_devices", {"space_id": "s", "device_id": "z"}),
        "sync_cursors": table("sync_cursors"), "change_log": table("change_log"),
    }


def test_equal_versions_have_no_changes(world):
    after = {**world, "transactions": world["transactions"].select("*")}
    assert capture.capture_changes(world, after, "me", 0, "now").count() == 0


def test_delete_space_logs_children_first_and_the_space_last(spark, world):
    requests = spark.createDataFrame([("s", "u")], "space_id string, user_id string")
    after, gone = mutate.delete_spaces(world, requests)
    log = capture.capture_changes(world, after, "me", 10, "now")
    children = [r.table_name for r in log.orderBy("seq").collect()]
    assert set(children) == {"transactions", "account_summaries", "accounts", "categories", "space_members", "space_settings"}
    assert max(children.index(t) for t in ("transactions", "account_summaries")) < children.index("accounts")
    assert {r.space_id for r in log.collect()} == {"s"} and {r.operation for r in log.collect()} == {"delete"}
    last = capture.space_deletion_rows(gone, log, "me", "now").first()
    assert (last.table_name, last.seq) == ("spaces", 10 + len(children) + 1)
    assert rows(after["spaces"], "id", "deleted") == [("s", True)]
    assert after["trusted_devices"].count() == 1 and after["evicted_devices"].count() == 1


def test_payloads_have_integer_flags_and_explicit_nulls(spark, world, table):
    after = {**world, "transactions": world["transactions"].withColumn("approved", F.col("id") == "t1"),
             "space_members": table("space_members", {"space_id": "s", "user_id": "u", "role": "member"})}
    log = {r.row_id: r for r in capture.capture_changes(world, after, "me", 0, "now").collect()}
    body = json.loads(log["t1"].payload)
    assert body["approved"] == 1 and body["category"] is None and len(body) == 12
    assert json.loads(log["s:u"].payload)["user"]["name"] == "U"


def test_user_change_fans_out_with_one_number(spark, world, table):
    members = table("space_members", *[{"space_id": s, "user_id": "u", "role": "member"} for s in ("s", "t")])
    after = table("users", {"id": "u", "name": "New"})
    log = capture.fan_out_user_changes(world["users"], after, members, "me", 4, "now")
    assert rows(log, "row_id", "seq") == [("s:u", 5), ("t:u", 5)]


def test_snapshot_rebuilds_an_empty_replica(world, table):
    snapshot = replicate.chunk_snapshot(replicate.collect_snapshot(world), rows=1)
    assert rows(snapshot.where("table_name = 'transactions'"), "key", "chunk") == [("t1", 0), ("t2", 1)]
    empty = {name: table(name) for name in world}
    out = replicate.apply_snapshot(empty, snapshot)
    for name in ("spaces", "users", "space_members", "categories", "accounts", "transactions", "account_summaries",
                 "space_settings", "model_versions"):
        assert rows(out[name]) == rows(world[name]), name
    assert set(LOGGED) - {"trusted_devices"} <= set(out)


def test_snapshot_carries_the_active_setting(spark, world):
    active = spark.createDataFrame([("s", 3), ("gone", 2)], "space_id string, version long")
    got = replicate.with_active_setting(replicate.collect_snapshot(world), active, "active_model_version")
    added = got.where("key = 'active_model_version'").collect()
    assert [(r.space_id, json.loads(r.payload)["value"]) for r in added] == [("s", "3")]


# ---- retention ----------------------------------------------------------------------
def test_compaction_keeps_the_highest_seq(table):
    log = table("change_log", change(1), change(2), change(3, row="t2"), {**change(4), "space_id": "s2"})
    assert {r.id for r in retention.compact_log(log).collect()} == {"2", "3", "4"}


def test_consumed_rows_need_every_enabled_peer(table):
    log = table("change_log", change(5), change(15), {**change(5), "id": "x", "space_id": "s2"})

    def left(devices, cursors):
        got = retention.drop_consumed(log, table("trusted_devices", *devices), table("sync_cursors", *cursors))
        return {r.id for r in got.collect()}

    def dev(i, enabled=True):
        return {"id": i, "space_id": "s1", "device_id": i, "sync_enabled": enabled}

    def cur(i, seq):
        return {"space_id": "s1", "peer_device_id": i, "last_seq": seq}

    assert left([], []) == {"5", "15", "x"}
    assert left([dev("a")], []) == {"5", "15", "x"}
    assert left([dev("a")], [cur("a", 10)]) == {"15", "x"}
    assert left([dev("a"), dev("b")], [cur("a", 99), cur("b", 4)]) == {"5", "15", "x"}
    assert left([dev("a"), dev("b", False)], [cur("a", 15)]) == {"x"}


def test_retention_boundary_day_survives(table):
    log = table("change_log", change(1, at="2024-01-16T00:00:00Z"), change(2, at="2024-01-15T23:59:59Z"),
                change(3, at="2024-01-16 11:59:59"), change(4, at="2024-01-16 12:00:00"))
    assert {r.id for r in retention.cap_retention(log, "2024-04-15T12:00:00Z").collect()} == {"1", "4"}


def test_passes_feed_each_other(table, world):
    tables = {
        **world,
        "spaces": table("spaces", {"id": "s1", "deleted": True}, {"id": "s2", "deleted": True}, {"id": "s3"}),
        "users": table("users", {"id": "u1"}, {"id": "u2"}),
        "space_members": table("space_members", {"space_id": "s1", "user_id": "u1"}, {"space_id": "s3", "user_id": "u2"}),
        "trusted_devices": table("trusted_devices", {"id": "d1", "space_id": "s1", "device_id": "p", "sync_enabled": True},
                                 {"id": "d2", "space_id": "s2", "device_id": "p", "sync_enabled": True}),
        "sync_cursors": table("sync_cursors", {"space_id": "s1", "peer_device_id": "p", "last_seq": 2}),
        "change_log": table("change_log", change(1, at="2024-04-01T00:00:00Z"), change(2, at="2024-04-01T00:00:00Z"),
                            {**change(3, at="2024-04-01T00:00:00Z"), "space_id": "s2"}),
    }
    out = retention.run_retention(tables, "2024-04-15T12:00:00Z")
    assert {r.id for r in out["change_log"].collect()} == {"3"}
    assert rows(out["spaces"], "id") == [("s2",), ("s3",)]
    assert rows(out["trusted_devices"], "id") == [("d2",)] and rows(out["users"], "id") == [("u2",)]


@pytest.mark.parametrize("evict", [True, False])
def test_hard_deletes_take_everything_along(spark, table, evict):
    """Two spaces with a row in every table: only the other one's rows are left."""
    def both(name, **more):
        made = []
        for s in ("s1", "s2"):
            row = {k: f"{s}-{k}" for k in TABLES[name].names if TABLES[name][k].dataType.simpleString() == "string"}
            made.append(row | {"space_id": s, "account_id": f"{s}-id", "changed_at": "2020-01-01T00:00:00Z"} | (
                {"id": s, "deleted": s == "s1"} if name == "spaces" else {}))
        return table(name, *made)

    tables = {name: both(name) for name in TABLES}
    if evict:
        out = mutate.evict_spaces(tables, spark.createDataFrame([("s1",)], "space_id string"))
        stay = {"users", "trusted_devices"}
    else:
        out, stay = retention.run_retention(tables, "2024-04-15T12:00:00Z"), set()
    for name, frame in out.items():
        left = len([r for r in frame.collect() if str(r.asDict().get("space_id") or r.asDict().get("account_id") or r.id).startswith("s1")])
        assert left == (1 if name in stay else 0), name
        assert name in ("change_log", "users") or frame.count() == 1 + left, name


def test_stored_versions_are_read_not_derived(spark, tmp_path):
    """What both versions and the application read has no join, sum or window behind it."""
    from tallyframe.plans.change_queries import _versions
    from tallyframe.sources.given import GivenLedger

    tables = {
        "region": ([(0, "r")], "r_regionkey long, r_name string"),
        "nation": ([(0, 0)], "n_nationkey long, n_regionkey long"),
        "customer": ([(1, "c", 0, "MACHINERY")], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "supplier": ([(1, "s")], "s_suppkey long, s_name string"),
        "part": ([(0, "p")], "p_partkey long, p_name string"),
        "orders": ([(11, 1, "2024-01-02", "1-URGENT", 2.5, "F"), (12, 1, "2024-12-03", "2-HIGH", 1.0, "P")],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_totalprice double, o_orderstatus string"),
        "events": ([], "event_id long, user_id long, event_type string, ts timestamp, value double"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    led = GivenLedger(spark, str(tmp_path))
    stored, derived = _versions(led, store=True), _versions(led)
    for side in (0, 1):
        for table in ("transactions", "account_summaries"):
            frame = stored[side][table]
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            assert not any(x in plan for x in ("Join", "Window", "Aggregate"))
            assert frame.schema.names == derived[side][table].schema.names
            assert sorted(map(repr, frame.collect())) == sorted(map(repr, derived[side][table].collect()))
