from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import aggregates as A
from tallyframe.operators import filters, joins, listing, search

TEXTS = [("1", "ICA Maxi 50%", 1250), ("2", "Coop a_b", -1250), ("3", "Åhléns City", 5000), ("4", "x 10% off", 7),
         ("5", "back\\slash", 99)]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id string, text string, amount long")


@pytest.mark.parametrize("term, want", [
    ("a%", {"1", "2", "5"}), ("50", {"1", "2", "3"}), ("X", {"1", "4"}), (" ic ", {"1"}), ("å", set()), ("Å", {"3"}),
    ("_b", {"2", "5"} - {"5"}), ("\\", {"5"}), ("-1", {"2"}),
])
def test_short_search_keeps_wildcards_and_folds_ascii_only(texts, term, want):
    assert {r.id for r in search.search(texts, term).collect()} == want


@pytest.mark.parametrize("term, want", [
    ("12.50", {"1", "2"}), ("10%", {"4"}), ("åhl", {"3"}), ("MAXI", {"1"}), ("50.00 50", {"3"}), ("a_b", {"2"}),
    ("-12.50 12.5", {"2"}), ("zzz", set()),
])
def test_long_search_is_literal_and_equals_the_index(texts, term, want):
    assert {r.id for r in search.search(texts, term).collect()} == want
    index = search.build_trigram_index(texts)
    assert {r.id for r in search.search_indexed(index, texts, term).collect()} == want


def test_index_maintenance_equals_a_rebuild(texts, spark, tmp_path):
    removed = texts.where("id in ('1', '4')")
    added = texts.where("id = '4'").withColumn("text", F.lit("rewritten"))
    index = search.maintain_trigram_index(search.build_trigram_index(texts), removed, added)
    rebuilt = search.build_trigram_index(texts.where("id not in ('1', '4')").unionByName(added))
    assert rows(index, "id", "field", "trigram") == rows(rebuilt, "id", "field", "trigram")
    search.write_trigram_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert {r.id for r in search.search_indexed(stored, added, "rewr").collect()} == {"4"}


def test_short_texts_have_no_trigrams(spark):
    frame = spark.createDataFrame([("1", "ab", 1)], "id string, text string, amount long")
    assert rows(search.build_trigram_index(frame).where("field = 'text'")) == []


def test_page_bounds():
    assert listing.page_bounds(None, None) == (0, 10)
    assert listing.page_bounds(-3, 0) == (0, 1)
    assert listing.page_bounds(2, 999) == (2, 200)


def test_pages_cover_the_listing_once(table):
    accounts = table("accounts", {"id": "a", "space_id": "s"}, {"id": "b", "space_id": "t"})
    frame = table("transactions", *[
        {"id": f"{i:02d}", "value_date": f"2024-01-{i % 5 + 1:02d}", "text": "abc"[i % 3],
         "account_id": "b" if i % 9 == 0 else "a"} for i in range(40)])
    expected = sorted((r for r in frame.where("account_id = 'a'").collect()),
                      key=lambda r: ([-int(r.value_date[-2:])], r.text, r.id))
    paged, keyed, last = [], [], ("9999-99-99", "", "")
    for page in range(6):
        one = listing.list_transactions(frame, accounts, space_id="s", page=page, limit=7).collect()
        every = listing.list_transactions(frame, accounts, page=page, limit=7).where("space_id = 's'")
        assert {r.id for r in every.collect()} == {r.id for r in one}
        paged += [r.id for r in one]
        after = listing.list_after(frame, accounts, "s", last, limit=7).collect()
        keyed += [r.id for r in after]
        if after:
            last = (after[-1].value_date, after[-1].text, after[-1].id)
    assert paged == keyed == [r.id for r in expected]
    assert rows(listing.transaction_pages(frame, accounts, limit=7)) == [("s", 35, 5), ("t", 5, 1)]


def test_page_count_floor(spark):
    frame = spark.createDataFrame([(0,), (10,), (11,)], "n long")
    assert [r[0] for r in frame.select(A.page_count(F.col("n"), 10)).collect()] == [0, 1, 2]
    assert [r[0] for r in frame.select(A.page_count(F.col("n"), 10, True)).collect()] == [1, 1, 2]


def test_sole_owner_rule_and_its_correction(table):
    members = table("space_members", {"space_id": "s", "user_id": "u1", "role": "owner"},
                    {"space_id": "s", "user_id": "u2", "role": "owner"}, {"space_id": "s", "user_id": "u3", "role": "member"},
                    {"space_id": "t", "user_id": "u1", "role": "owner"})
    assert rows(A.sole_owner_spaces(members)) == [("u1", "s"), ("u1", "t"), ("u2", "s")]
    assert rows(A.sole_owner_spaces(members, corrected=True)) == [("u1", "t")]


def test_users_never_show_the_hash(table):
    shown = filters.project_users(table("users", {"id": "u", "pin_hash": "secret"}, {"id": "v"}))
    assert "pin_hash" not in shown.columns
    assert rows(shown, "id", "has_pin") == [("u", True), ("v", False)]


def test_latest_other_author(table):
    log = table("change_log", *[
        {"id": str(i), "table_name": "transactions", "row_id": "t", "device_id": d, "changed_at": at, "seq": i}
        for i, (d, at) in enumerate([("a", "2024-01-01T00:00:09Z"), ("b", "2024-01-01T00:00:05Z"),
                                     ("c", "2024-01-01T00:00:05Z"), ("a", "2024-01-01T00:00:01Z")])])
    got = joins.latest_other_author(log, log)
    assert rows(got, "id", "other_device_id") == [("0", "c"), ("1", "a"), ("2", "a"), ("3", "c")]


def test_labels_fall_back_to_other(spark):
    classes = spark.createDataFrame([(0, "Food"), (1, "Other"), (2, "Food")], "position long, name string")
    frame = spark.createDataFrame([("1", "Food"), ("2", "Ghost"), ("3", None)], "id string, category string")
    assert rows(joins.with_label(frame, classes), "id", "label") == [("1", 0), ("2", 1), ("3", 1)]


def test_ids_in_every_list_meet_once(texts):
    """An id that many lists share is a row for each task, not for each list, when it reaches the join."""
    ids = texts.sparkSession.range(10_000).select(F.when(F.col("id") % 2 == 0, "unknown").otherwise("3").alias("id"))
    found = filters.ids_in(texts, ids)
    assert [r.id for r in found.collect()] == ["3"]
    right = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[1]
    assert "Aggregate" in right
