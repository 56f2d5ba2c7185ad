from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import mutate
from tallyframe.operators.aggregates import category_spend_by_month
from tallyframe.sources import space_files, versions

AT = "2025-01-01T00:00:00Z"


@pytest.fixture
def ledger(table):
    return {
        "spaces": table("spaces", {"id": "s", "name": 'He said "hi"'}, {"id": "t", "name": "T"}, {"id": "d", "deleted": True}),
        "accounts": table("accounts", {"id": "a", "name": "A", "space_id": "s"}, {"id": "b", "name": "B", "space_id": "t"},
                          {"id": "x", "name": "X", "space_id": "d"}),
        "categories": table("categories", {"id": "c1", "name": "Food", "space_id": "s"}, {"id": "c2", "name": "Food", "space_id": "t"}),
        "transactions": table(
            "transactions", {"id": "1", "value_date": "2024-01-01", "booking_date": "2024-01-01", "category": None, "account_id": "a", "approved": True, "amount": 1},
            {"id": "2", "value_date": "2024-01-02", "booking_date": "2024-01-02", "category": "", "account_id": "a", "approved": True, "amount": 2},
            {"id": "3", "value_date": "2024-01-03", "booking_date": "2024-01-03", "category": "Food", "account_id": "a", "approved": True, "amount": 4},
            {"id": "4", "category": "Food", "account_id": "b", "text": "line\nbreak"}, {"id": "9", "account_id": "x"}),
        "account_summaries": table("account_summaries", {"month": "2024-01", "account_id": "a", "balance": 5}),
    }


# ---- edits --------------------------------------------------------------------------
def test_upsert_takes_the_last_of_a_batch(table):
    target = table("account_summaries", {"month": "m", "account_id": "a", "balance": 1}, {"month": "m", "account_id": "b", "balance": 2})
    batch = table("account_summaries", {"month": "m", "account_id": "a", "balance": 7}, {"month": "m", "account_id": "a", "balance": 9})
    out = mutate.upsert(target, batch, ["account_id", "month"], [F.col("balance")])
    assert rows(out, "account_id", "balance") == [("a", 9), ("b", 2)]


def test_edits_can_set_null_and_unknown_ids_are_reported(spark, ledger):
    edits = spark.createDataFrame([("3", True, "n", None), ("zz", True, "n", "x")],
                                  "id string, approved boolean, note string, category string")
    out, unknown = mutate.update_transactions(ledger["transactions"], edits)
    assert rows(out.where("id = '3'"), "note", "category") == [("n", None)]
    assert rows(unknown, "id") == [("zz",)]


def test_bulk_edits_stay_in_their_space(spark, ledger):
    requests = spark.createDataFrame([("s", "3", None), ("s", "4", "Stolen")], "space_id string, id string, category string")
    out = mutate.bulk_categorize(ledger["transactions"], ledger["accounts"], requests)
    assert {r.id: r.category for r in out.collect()}["4"] == "Food"
    assert {r.id: r.category for r in out.collect()}["3"] is None
    assert rows(mutate.changed_counts(ledger["transactions"], ledger["accounts"], requests)) == [("s", 1)]


def test_rename_and_delete_match_by_name_inside_the_space(spark, ledger):
    renamed = mutate.rename_categories(ledger, spark.createDataFrame([("c1", "Meals", "#1")], "id string, name string, color string"))
    assert rows(renamed["transactions"].where("category = 'Meals'"), "id") == [("3",)]
    assert rows(renamed["categories"], "id", "name") == [("c1", "Meals"), ("c2", "Food")]
    deleted = mutate.delete_categories(ledger, spark.createDataFrame([("c2",)], "id string"))
    assert rows(deleted["transactions"].where("category = 'Food'"), "id") == [("3",)]


def test_blank_and_taken_names_are_refused(table, ledger):
    wishes = table("categories", {"id": "n1", "name": "  ", "color": "#1", "space_id": "s"}, {"id": "n2", "name": " Food ", "color": "#1", "space_id": "s"},
                   {"id": "n3", "name": " Fun ", "color": "#1", "space_id": "s"}, {"id": "n4", "name": "Fun", "color": "#1", "space_id": "s"},
                   {"id": "n5", "name": "Fun", "color": " ", "space_id": "t"})
    out, refused = mutate.create_categories(ledger["categories"], wishes)
    assert rows(out, "id", "name") == [("c1", "Food"), ("c2", "Food"), ("n3", "Fun")]
    assert {r.id for r in refused.collect()} == {"n1", "n2", "n4", "n5"}


def test_new_space_gets_owner_and_ten_categories(spark):
    out = mutate.create_spaces(spark.createDataFrame([("n", " Home ", "u"), ("m", " ", "u")], "id string, name string, user_id string"), AT)
    assert rows(out["spaces"], "id", "name", "deleted") == [("n", "Home", False)]
    assert rows(out["space_members"], "space_id", "user_id", "role") == [("n", "u", "owner")]
    assert out["categories"].count() == 10 and out["categories"].where("id = 'n_food_drinks'").count() == 1


def test_last_member_stays(spark, table):
    members = table("space_members", *[{"space_id": "s", "user_id": u, "role": "member"} for u in ("a", "b")],
                    {"space_id": "t", "user_id": "a", "role": "member"})
    asked = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "space_id string, user_id string")
    left, refused = mutate.leave_space(members, asked)
    assert rows(left, "space_id", "user_id") == [("s", "b"), ("t", "a")] == rows(refused, "space_id", "user_id")


def test_user_removal_guards(table):
    tables = {"users": table("users", {"id": "o"}, {"id": "m"}, {"id": "n"}),
              "space_members": table("space_members", {"space_id": "s", "user_id": "o", "role": "owner"}, {"space_id": "s", "user_id": "m", "role": "member"})}
    out, refused = mutate.remove_users(tables, tables["users"].select("id"))
    assert rows(out["users"], "id") == [("o",)] == rows(refused) and rows(out["space_members"], "user_id") == [("o",)]
    alone = {"users": table("users", {"id": "m"}), "space_members": table("space_members", {"space_id": "s", "user_id": "m", "role": "member"})}
    out, refused = mutate.remove_users(alone, alone["users"].select("id"))
    assert rows(out["users"], "id") == [("m",)] == rows(refused)


def test_delete_accounts_checks_the_space_and_cascades(spark, ledger):
    asked = spark.createDataFrame([("a", "s"), ("b", "s")], "id string, space_id string")
    out = mutate.delete_accounts(ledger, asked)
    assert rows(out["accounts"], "id") == [("b",), ("x",)]
    assert rows(out["transactions"], "id") == [("4",), ("9",)] and out["account_summaries"].count() == 0


def test_admitting_a_known_device_keeps_id_and_join_date(spark, table):
    tables = {"users": table("users", {"id": "u", "name": "Old", "created_at": "c"}),
              "space_members": table("space_members", {"space_id": "s", "user_id": "u", "role": "owner", "joined_at": "j"}),
              "trusted_devices": table("trusted_devices", {"id": "l", "space_id": "s", "device_id": "d", "paired_at": "p"})}
    arrival = spark.createDataFrame([("r", "s", "d", "Name", "CERT", "u", "New")],
                                    "device_row_id string, space_id string, device_id string, display_name string, cert_pem string, user_id string, user_name string")
    out = mutate.admit_devices(tables, arrival, AT)
    assert rows(out["trusted_devices"], "id", "display_name", "sync_enabled", "paired_at") == [("l", "Name", True, "p")]
    assert rows(out["space_members"], "role", "joined_at") == [("member", "j")]
    assert rows(out["users"], "name", "created_at", "updated_at") == [("New", "c", AT)]


# ---- versions -----------------------------------------------------------------------
def test_versions_are_published_by_pointer(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(3), spark.range(5)
    assert versions.current_version(spark, root, "t") == 0
    assert versions.write_version(spark, root, "t", one) == 1
    two.write.parquet(f"{root}/t/v2")  # written but never published
    assert versions.read_version(spark, root, "t").count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions.write_version(spark, root, "t", two)
    assert versions.write_versions(spark, root, {"u": two}) == {"u": 1}
    assert versions.read_version(spark, root, "u", 1).count() == 5
    with pytest.raises(ValueError):
        versions.read_version(spark, root, "nothing")


# ---- export and import --------------------------------------------------------------
def parts(path, space):
    folder = os.path.join(path, f"space_id={space}")
    text = ""
    for name in sorted(f for f in os.listdir(folder) if f.startswith("part-")):
        with open(os.path.join(folder, name)) as f:
            text += f.read()
    return json.loads(text)


def test_export_parts_are_one_document(spark, ledger, tmp_path):
    path = str(tmp_path / "out")
    space_files.export_spaces(ledger, path, AT)
    assert not os.path.exists(os.path.join(path, "space_id=d"))
    doc = parts(path, "s")
    assert doc["version"] == 1 and doc["space"] == {"name": 'He said "hi"'} and doc["exported_at"] == AT
    assert [t["id"] for t in doc["transactions"]] == ["3", "2", "1"]
    assert [t["category"] for t in doc["transactions"]] == ["Food", "", ""]
    assert doc["transactions"][0]["approved"] == 1 and len(doc["transactions"][0]) == 12
    assert doc["categories"] == [{"id": "c1", "name": "Food", "color": ""}]
    other = parts(path, "t")
    assert other["account_summaries"] == [] and other["transactions"][0]["text"] == "line\nbreak"
    assert rows(space_files.export_counts(space_files.export_rows(ledger))) == [("s", 1, 1, 3, 1), ("t", 1, 1, 1, 0)]


def test_round_trip_turns_missing_categories_into_an_empty_bucket(spark, ledger, tmp_path):
    path = str(tmp_path / "out")
    space_files.export_spaces(ledger, path, AT)
    back = space_files.import_spaces(ledger, space_files.read_export_parts(spark, path))
    for name in ("accounts", "categories", "account_summaries"):
        assert rows(back[name]) == rows(ledger[name])
    def spend(tables):
        return rows(category_spend_by_month(tables["transactions"], tables["accounts"]), "category", "amount")
    assert spend(ledger) == [("", 2), ("Food", 4)] and spend(back) == [("", 3), ("Food", 4)]


def test_foreign_document_and_wrong_version(spark, ledger, tmp_path):
    doc = {"version": 1, "exported_at": AT, "space": {"name": "n"}, "categories": [{"id": "k", "name": "New", "color": "#"}],
           "accounts": [], "transactions": [], "account_summaries": [{"month": "2024-01", "account_id": "a", "balance": 8}]}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(doc, indent=2))
    bad.write_text(json.dumps({**doc, "version": 2}))
    out = space_files.import_spaces(ledger, space_files.read_export_document(spark, str(good), "s"))
    assert rows(out["categories"], "id") == [("c2",), ("k",)]
    assert rows(out["account_summaries"], "balance") == [(8,)]
    with pytest.raises(ValueError, match="version"):
        space_files.read_export_document(spark, str(bad), "s")
