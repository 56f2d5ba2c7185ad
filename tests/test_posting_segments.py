from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import search
from tallyframe.operators.mutate import upsert
from tallyframe.sources import keyed_files as kf
from tallyframe.sources import posting_segments as ps

SCHEMA = "id string, text string, amount long"


def frame(spark, held):
    return spark.createDataFrame([(k, *v) for k, v in held.items()], SCHEMA)


def ids(found):
    return sorted(r.id for r in found.collect())


def check(spark, root, version, held, *terms):
    """Postings equal a rebuild, and searches equal a scan."""
    now = frame(spark, held)
    columns = ["trigram", "field", "id"]
    assert rows(ps.live_postings(spark, root, version), *columns) == rows(search.build_trigram_index(now), *columns)
    for term in terms:
        assert ids(ps.search_segments(spark, root, now, version, term)) == ids(search.search(now, term)), term


@pytest.fixture
def indexed(spark, tmp_path):
    held = {f"k{i:03d}": (f"Row {i} of shop {i % 7}", i * 10) for i in range(60)}
    root = str(tmp_path / "index")
    ps.create_index(spark, root, frame(spark, held), 1)
    return root, held


def test_an_edit_writes_one_small_segment_and_leaves_the_others(spark, indexed):
    root, held = indexed
    base = ps.segments(spark, root, 1)
    now = {**held, "k003": ("Ångström row", -5), "new": ("Row of nobody", 1250)}
    del now["k004"]
    removed, added = frame(spark, {k: held[k] for k in ("k003", "k004")}), frame(spark, {k: now[k] for k in ("k003", "new")})
    made = ps.edit_index(spark, root, 1, 2, removed, added)
    assert made.tombstones == 2 and made.postings == search.build_trigram_index(added).count()
    assert ps.segments(spark, root, 2) == [*base, made]
    check(spark, root, 2, now, "shop 3", "row", "ÅNG", "12.50", "zzz", "Ro", "")
    check(spark, root, 1, held, "shop 3", "row", "ång")  # the version before is still whole


def test_a_search_of_a_version_that_is_not_covered_is_refused(spark, indexed):
    root, held = indexed
    for term in ("shop", "Ro"):
        with pytest.raises(ps.StaleIndex, match="version 2"):
            ps.search_segments(spark, root, frame(spark, held), 2, term)
    with pytest.raises(ps.StaleIndex):
        ps.edit_index(spark, root, 5, 6, frame(spark, held), frame(spark, held))
    with pytest.raises(ValueError, match="already covers"):
        ps.create_index(spark, root, frame(spark, held), 1)


def test_a_row_that_goes_and_comes_back_counts_once(spark, indexed):
    root, held = indexed
    one = frame(spark, {"k001": held["k001"]})
    ps.edit_index(spark, root, 1, 2, one, one.limit(0))
    ps.edit_index(spark, root, 2, 3, one.limit(0), one)
    ps.edit_index(spark, root, 3, 4, one, one)
    check(spark, root, 2, {k: v for k, v in held.items() if k != "k001"}, "row 1 of")
    check(spark, root, 4, held, "row 1 of")


@pytest.mark.parametrize("sizes, first", [
    ([100], 1), ([100, 60], 2), ([100, 60, 39], 3), ([100, 60, 40], 0), ([100, 20, 20], 1), ([300, 60, 30, 30], 1),
    ([300, 60, 30, 29], 4), ([100, 40, 61], 0), ([0, 5], 0), ([5, 0], 2),
])
def test_runs_are_merged_once_they_have_caught_up(sizes, first):
    assert ps._to_merge([ps.Segment(i, "", n, 0) for i, n in enumerate(sizes)]) == first


def test_many_edits_keep_few_segments_and_equal_a_rebuild(spark, indexed):
    root, held = indexed
    draw, now = random.Random(5), dict(held)
    for version in range(2, 7):
        gone = draw.sample(sorted(now), 9)
        back = {k: (f"edited {version} {k}", version) for k in gone[:6]} | {f"n{version}-{i}": ("fresh Row", i) for i in range(3)}
        removed = frame(spark, {k: now.pop(k) for k in gone})
        ps.edit_index(spark, root, version - 1, version, removed, frame(spark, back))
        now |= back
        sizes = [s.size for s in ps.segments(spark, root, version)]
        assert all(size > sum(sizes[i + 1:]) for i, size in enumerate(sizes[:-1]))
    check(spark, root, 6, now, "edited", "fresh row", "shop 1")
    assert len(sizes) < 6  # merges took place


def test_the_index_follows_a_stored_table_by_its_replaced_files(spark, tmp_path):
    table, root = str(tmp_path / "table"), str(tmp_path / "index")
    held = {f"k{i:03d}": (f"Row {i}", i) for i in range(200)}
    kf.create_table(spark, table, frame(spark, held), ["id"], file_rows=25)
    ps.create_index(spark, root, kf.read_table(spark, table), 1)
    batch = frame(spark, {"k010": ("Changed", 3), "k011": held["k011"], "k010b": ("Inserted", 4)})
    done = kf.edit_table(spark, table, batch, lambda t: upsert(t, batch, ["id"]), inserts=True)
    before, after = kf.replaced_rows(spark, table, 1, done.version)
    assert before.count() <= 50 and after.count() == before.count() + 1
    with pytest.raises(ps.StaleIndex):
        ps.search_segments(spark, root, kf.read_table(spark, table), done.version, "Changed")
    made = ps.follow_table(spark, root, table, 1, done.version)
    assert made.tombstones == 1  # the row that was written as it was is no edit
    now = {**held, "k010": ("Changed", 3), "k010b": ("Inserted", 4)}
    check(spark, root, done.version, now, "chang", "insert", "row 10")
    old = kf.read_table(spark, table, 1)
    assert ids(ps.search_segments(spark, root, old, 1, "row 10")) == ids(old.where(F.lower("text").contains("row 10")))


def test_empty_tables_and_texts(spark, tmp_path):
    root = str(tmp_path / "index")
    none = spark.createDataFrame([], SCHEMA)
    ps.create_index(spark, root, none, 1)
    assert ps.search_segments(spark, root, none, 1, "abc").count() == 0
    odd = spark.createDataFrame([("a", None, 5), ("b", "", None), ("c", "ab", 0)], SCHEMA)
    ps.edit_index(spark, root, 1, 2, none, odd)
    columns = ["trigram", "field", "id"]
    assert rows(ps.live_postings(spark, root, 2), *columns) == rows(search.build_trigram_index(odd), *columns)
    assert ids(ps.search_segments(spark, root, odd, 2, "0.0")) == ids(search.search(odd, "0.0")) != []


def test_the_index_of_given_files_notices_that_they_changed(spark, tmp_path):
    from types import SimpleNamespace

    from tallyframe.plans.ledger_queries import _stored_index

    path, held = str(tmp_path / "given.parquet"), {"a": ("one text", 1)}
    led = SimpleNamespace(spark=spark, folder=str(tmp_path))
    frame(spark, held).write.parquet(path)
    rows_now = spark.read.parquet(path)
    first = _stored_index(led, rows_now)
    assert _stored_index(led, rows_now) == first
    frame(spark, {"b": ("another text", 2)}).write.mode("append").parquet(path)
    rows_now = spark.read.parquet(path)
    second = _stored_index(led, rows_now)
    assert second[1] != first[1]
    assert ids(ps.search_segments(spark, second[0], rows_now, second[1], "text")) == ["a", "b"]


def test_each_file_holds_the_postings_of_some_rows_in_trigram_order(spark, tmp_path, monkeypatch):
    """Postings aren't shuffled: rows are dealt before, and every file is sorted alone."""
    monkeypatch.setattr(ps, "_FILE_ROWS", 50)
    texts = ["abc zå", "é\U0001f600x abz", "￿a \U00010000b", None, "zz"]
    frame = spark.createDataFrame([(f"i{n}", texts[n % 5], n) for n in range(400)], "id string, text string, amount long")
    made = ps.create_index(spark, str(tmp_path / "index"), frame, 1)
    files = sorted((tmp_path / "index" / "postings" / made.name).glob("*.parquet"))
    assert 6 <= len(files) <= 8
    held = []
    for file in files:
        own = [tuple(r) for r in spark.read.parquet(str(file)).select("trigram", "field", "id").coalesce(1).collect()]
        grams = [g.encode() for g, _, _ in own]
        assert grams == sorted(grams)
        held += own
    assert sorted(held) == sorted(tuple(r) for r in search.build_trigram_index(frame).select("trigram", "field", "id").collect())


def test_postings_that_no_tombstone_names_are_not_shuffled(spark, indexed):
    root, held = indexed
    now = {**held, "k003": ("Other text", 7)}
    ps.edit_index(spark, root, 1, 2, frame(spark, {"k003": held["k003"]}), frame(spark, {"k003": now["k003"]}))
    check(spark, root, 2, now, "other")
    tree = ps.live_postings(spark, root, 2)._jdf.queryExecution().executedPlan().toString()
    first = tree.split("Union")[1].split("Join")[0]
    assert "getbit" in first and "Exchange" not in first
    named = ps._named(frame(spark, {"k003": now["k003"], "k005": ("", 0)}))
    assert {r.id for r in frame(spark, held).where(named).collect()} >= {"k003", "k005"}
    assert frame(spark, held).where(named).count() < 10


def test_what_differs_between_versions_is_found_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    old = [("a", "x", 1), ("a", "x", 1), ("b", None, 2), ("c", "y", None), (None, "z", 3)]
    new = [("b", None, 2), ("c", "y", 4), (None, "z", 3), ("d", "", 5), ("d", "", 5)]
    gone, fresh = (spark.createDataFrame(r, SCHEMA).mapInArrow(counted, SCHEMA) for r in (old, new))
    removed, added = ps._differing(gone, fresh)
    for _ in range(2):
        assert rows(removed) == rows(gone.subtract(fresh)) and rows(added) == rows(fresh.subtract(gone))
    before = seen.value
    removed.collect(), added.collect()
    assert seen.value == before
