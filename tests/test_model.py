from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import features, model, registry


@pytest.mark.parametrize("n, want", [(2, 1), (3, 2), (5, 4), (10, 8), (11, 8), (101, 80)])
def test_train_size(spark, n, want):
    frame = spark.range(n).select(F.lit("s").alias("space_id"), F.col("id").cast("string").alias("id"))
    got = features.split_rows(frame)
    assert got.where("train").count() == want and got.count() == n
    assert rows(got.where("train"), "id") == rows(features.split_rows(frame).where("train"), "id")


def test_class_positions_by_name(spark):
    frame = spark.createDataFrame([("2", "Food"), ("1", "Food"), ("3", "Auto"), ("4", "Other")], "id string, name string")
    assert rows(features.class_list(frame)) == [(0, "Auto"), (1, "Food"), (2, "Food"), (3, "Other")]


@pytest.fixture(scope="module")
def samples(spark):
    data = [(f"{i}", "s", ["rent flat", "food shop", "bus card"][i % 3], -100 * (i % 3 + 1), "2024-01-05", i % 3) for i in range(60)]
    frame = spark.createDataFrame(data, "id string, space_id string, text string, amount long, booking_date string, label int")
    return features.build_features(frame)


def test_training_learns_separable_classes(spark, samples):
    ready = model.prepare_training(samples, 32)
    trained = model.train_head(ready, 4, 32, epochs=40)
    assert trained.samples == 60 and trained.history[-1] < trained.history[0]
    classes = spark.createDataFrame([(0, "Rent"), (1, "Food"), (2, "Bus")], "position long, name string")
    got = model.predict(ready, trained, classes)
    names = ["Rent", "Food", "Bus"]
    hits = sum(names[int(r.label)] == r.predicted for r in got.collect())
    assert hits >= 55
    assert {r.predicted for r in model.predict(samples, None, classes).collect()} == {"Other"}


def test_too_few_rows_are_refused(samples):
    few = model.prepare_training(samples.where(F.col("id").cast("int") < 19), 8)
    with pytest.raises(ValueError, match="at least 20"):
        model.train_head(few, 3, 8)


def test_unknown_class_index_is_other(spark, samples):
    ready = model.prepare_training(samples, 8)
    trained = model.train_head(ready, 3, 8, epochs=3)
    nothing = spark.createDataFrame([(99, "Far")], "position long, name string")
    assert {r.predicted for r in model.predict(ready, trained, nothing).collect()} == {"Other"}


def test_score_head_equals_a_plain_forward_pass(spark, samples):
    weights = model.seeded_weights(4, 5)
    rows_in = samples.withColumn("embedding", F.array(*[F.lit(float(i)) for i in range(4)])).limit(7)
    for r in model.score_head(rows_in, weights).collect():
        n = np.array(r.features)
        for w, b in (weights.numeric_1, weights.numeric_2):
            n = np.maximum(w @ n + b, 0)
        f = np.concatenate([np.array(r.embedding), n])
        for w, b in (weights.fuse_1, weights.fuse_2):
            f = np.maximum(w @ f + b, 0)
        want = weights.head[0] @ (f / np.linalg.norm(f)) + weights.head[1]
        assert np.allclose(r.logits, want) and r.predicted_class == int(np.argmax(want))


def test_loss_is_the_mean_of_batch_means(spark):
    frame = spark.createDataFrame(
        [(str(i), "s", True, 0, [0.0, 0.0]) for i in range(4)] + [("9", "s", False, 1, [float("inf"), 0.0])],
        "id string, space_id string, train boolean, label int, logits array<double>")
    got = {r.train: r for r in model.evaluate(frame, batch_rows=3).collect()}
    assert got[True].loss == pytest.approx(math.log(2)) and got[True].accuracy == 0.0 and got[True].rows == 4
    assert (got[False].loss, got[False].accuracy, got[False].rows) == (0.0, 0.0, 0)  # its only batch has no finite loss


def test_registry_versions_and_files(spark, table, tmp_path):
    held = table("model_versions", {"space_id": "s", "version": 4})
    trained = spark.createDataFrame([("s", "w", "c", "t"), ("n", "w", "c", "t")], "space_id string, weights string, card string, trained_at string")
    out = registry.register_versions(held, trained)
    assert rows(out, "space_id", "version") == [("n", 1), ("s", 4), ("s", 5)]
    folder = tmp_path / "models" / "s"
    folder.mkdir(parents=True)
    for name, body in {"model_v5.safetensors": "w", "model_v5.json": "{}", "model_v4.safetensors": "w",
                       "model_v9.json": "{}", "notes.txt": "x"}.items():
        (folder / name).write_text(body)
    files = registry.read_artifacts(spark, str(tmp_path / "models"))
    assert rows(registry.verify_artifacts(out, files)) == [("s", 5)]
    assert rows(registry.orphan_artifacts(out, files), "version", "kind") == [(9, "card")]


def test_deleting_the_active_version_clears_its_setting(spark, table):
    held = table("model_versions", {"space_id": "s", "version": 1}, {"space_id": "s", "version": 2}, {"space_id": "t", "version": 1})
    settings = table("space_settings", {"space_id": "s", "key": "active_model_version", "value": "2"},
                     {"space_id": "t", "key": "active_model_version", "value": "junk"}, {"space_id": "s", "key": "k", "value": "2"})
    doomed = spark.createDataFrame([("s", 2), ("t", 1)], "space_id string, version long")
    left, kept = registry.delete_versions(held, settings, doomed)
    assert rows(left, "space_id", "version") == [("s", 1)]
    assert rows(kept, "space_id", "key") == [("s", "k"), ("t", "active_model_version")]
    assert rows(registry.active_versions(held, settings)) == [("s", 2), ("t", 0)]
