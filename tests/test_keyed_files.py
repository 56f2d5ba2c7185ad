from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators.mutate import apply_edits, upsert
from tallyframe.sources import keyed_files as kf

SCHEMA = "id string, space string, amount long"


@pytest.fixture
def stored(spark, tmp_path):
    """A table of 400 rows in 8 files, and its rows."""
    held = {(f"k{i:03d}", "s"): i for i in range(400)}
    root = str(tmp_path / "table")
    frame = spark.createDataFrame([(*k, v) for k, v in held.items()], SCHEMA).repartition(3)
    assert kf.create_table(spark, root, frame, ["id", "space"], file_rows=50) == 1
    return root, held


def now(spark, root, version=None):
    return {(r.id, r.space): r.amount for r in kf.read_table(spark, root, version).collect()}


def keys(spark, *ids):
    return spark.createDataFrame([(i, "s") for i in ids], "id string, space string")


def test_an_edit_rewrites_the_files_it_hits_and_no_others(spark, stored):
    root, held = stored
    files = kf.read_table(spark, root).select(F.input_file_name()).distinct().count()
    assert files >= 6 and now(spark, root) == held
    edits = keys(spark, "k010", "k011", "k390").withColumn("amount", F.lit(-1).cast("long"))
    done = kf.edit_table(spark, root, edits, lambda t: apply_edits(t, edits, ["id", "space"]))
    assert (done.version, done.files, done.rewritten, done.written) == (2, files, 2, 2)
    want = {**held, ("k010", "s"): -1, ("k011", "s"): -1, ("k390", "s"): -1}
    assert now(spark, root) == want and now(spark, root, 1) == held
    # a second edit of the same file, and a delete
    gone = keys(spark, "k010")
    done = kf.edit_table(spark, root, gone, lambda t: t.join(gone, ["id", "space"], "left_anti"))
    assert done.rewritten == 1
    del want[("k010", "s")]
    assert now(spark, root) == want


def test_keys_that_no_filter_knows_hit_nothing(spark, stored):
    root, held = stored
    absent = keys(spark, *[f"k{i:03d}x" for i in range(0, 400, 3)])
    done = kf.edit_table(spark, root, absent, lambda t: t)
    assert done.rewritten <= 4  # one key in a hundred is let through
    assert now(spark, root) == held
    nothing = kf.edit_table(spark, root, keys(spark, "zz"), lambda t: t)
    assert nothing.rewritten == 0 and nothing.version == done.version


def test_upserts_insert_into_ranges_and_split_grown_files(spark, stored):
    root, held = stored
    batch = spark.createDataFrame([(f"k100-{i:03d}", "s", i) for i in range(230)] + [("a", "s", 1), ("zz", "s", 2), ("k399", "s", 3)], SCHEMA)
    done = kf.edit_table(spark, root, batch, lambda t: upsert(t, batch, ["id", "space"]), inserts=True)
    want = {**held, **{(r.id, r.space): r.amount for r in batch.collect()}}
    assert done.rewritten == 3 and done.written > 3 and now(spark, root) == want
    found = kf.look_up(spark, root, keys(spark, "k100-229", "a", "zz", "k050", "none"))
    assert rows(found, "id", "amount") == [("a", 1), ("k050", 50), ("k100-229", 229), ("zz", 2)]
    # what was split is still found and edited
    edit = keys(spark, "k100-000", "k100-229").withColumn("amount", F.lit(7).cast("long"))
    kf.edit_table(spark, root, edit, lambda t: apply_edits(t, edit, ["id", "space"]))
    assert now(spark, root) == {**want, ("k100-000", "s"): 7, ("k100-229", "s"): 7}


def test_an_empty_table_takes_rows(spark, tmp_path):
    root = str(tmp_path / "empty")
    none = spark.createDataFrame([], "n long, v string")
    kf.create_table(spark, root, none, ["n"])
    assert kf.read_table(spark, root).count() == 0 and kf.edit_table(spark, root, none.limit(0), lambda t: t).version == 1
    batch = spark.createDataFrame([(i, str(i)) for i in range(-5, 20)], "n long, v string")
    kf.edit_table(spark, root, batch, lambda t: upsert(t, batch, ["n"]), inserts=True)
    assert rows(kf.read_table(spark, root)) == sorted(((i, str(i)) for i in range(-5, 20)), key=repr)
    assert rows(kf.look_up(spark, root, batch.where("n in (-5, 10)")), "n") == [(-5,), (10,)]


def test_a_second_editor_of_a_version_fails(spark, stored):
    root, held = stored
    edit = keys(spark, "k001").withColumn("amount", F.lit(0).cast("long"))

    def meanwhile(t):
        kf.edit_table(spark, root, edit, lambda u: apply_edits(u, edit, ["id", "space"]))
        return apply_edits(t, edit, ["id", "space"])

    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        kf.edit_table(spark, root, edit, meanwhile)
    assert now(spark, root) == {**held, ("k001", "s"): 0}


def test_a_stored_frame_is_evaluated_once(spark, tmp_path):
    """A table is counted, sampled for its ranges and written from one evaluation of the frame."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kf.create_table(spark, str(tmp_path / "t"), spark.range(1000).mapInArrow(count, "id long"), ["id"], file_rows=100)
    assert seen.value == 1000
    assert kf.read_table(spark, str(tmp_path / "t")).count() == 1000


def test_an_edit_of_every_file_leaves_about_as_many(spark, tmp_path):
    """Small files are written many to a task: where a task's rows end no more than one file is cut in two."""
    root = str(tmp_path / "table")
    kf.create_table(spark, root, spark.range(4000).withColumn("v", F.lit(0)), ["id"], file_rows=50)
    every = spark.range(4000).withColumn("v", F.lit(1))
    done = kf.edit_table(spark, root, every, lambda t: apply_edits(t, every, ["id"]))
    assert done.rewritten == done.files >= 60 and done.files <= done.written <= done.files + spark.sparkContext.defaultParallelism
    assert kf.read_table(spark, root).agg(F.sum("v"), F.count("v")).first() == (4000, 4000)
