from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import model, registry, training
from tallyframe.operators.features import FEATURE_SIZE

TEXT = 5
SCHEMA = "space_id string, id string, embedding array<double>, features array<float>, label long, train boolean"


def made(space, n, classes, seed):
    """Rows whose text names their class, with some noise."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = int(rng.integers(len(classes)))
        text = rng.normal(0, 0.2, TEXT)
        text[c % TEXT] += 1
        out.append((space, f"{space}-{i}", text.tolist(), rng.normal(0, 0.5, FEATURE_SIZE).astype(np.float32).astype(float).tolist(), classes[c], i % 5 > 0))
    return out


def walk(data, plan, batches):
    """Training by plain loops over rows: forward, backward by the chain rule of each row, AdamW.

    batches(epoch, rows) gives the training batches; the history is [(epoch, four figures)].
    """
    space, classes = data[0][0], sorted({r[4] for r in data})
    flat = training.initial_weights(space, TEXT, len(classes), plan.seed)
    m, v, step, history = np.zeros(len(flat)), np.zeros(len(flat)), 0, []

    def row(r, back):
        ws = training.layers(flat, TEXT, len(classes))
        x = np.array(r[3])
        a1 = ws[0][0] @ x + ws[0][1]
        h1 = np.where(a1 > 0, a1, 0)
        a2 = ws[1][0] @ h1 + ws[1][1]
        h2 = np.where(a2 > 0, a2, 0)
        j = np.concatenate([r[2], h2])
        a3 = ws[2][0] @ j + ws[2][1]
        h3 = np.where(a3 > 0, a3, 0)
        a4 = ws[3][0] @ h3 + ws[3][1]
        h4 = np.where(a4 > 0, a4, 0)
        size = math.sqrt(float(h4 @ h4))
        u = h4 / size
        z = ws[4][0] @ u + ws[4][1]
        p = np.exp(z - z.max())
        p /= p.sum()
        k = classes.index(r[4])
        hit = max(range(len(z)), key=lambda i: (z[i], i)) == k
        if not back:
            return -math.log(p[k]), hit, None
        g5 = p.copy()
        g5[k] -= 1
        gu = ws[4][0].T @ g5
        g4 = (np.eye(len(u)) - np.outer(u, u)) @ gu / size * (a4 > 0)
        g3 = ws[3][0].T @ g4 * (a3 > 0)
        g2 = (ws[2][0].T @ g3)[TEXT:] * (a2 > 0)
        g1 = ws[1][0].T @ g2 * (a1 > 0)
        parts = []
        for g, i in ((g1, x), (g2, h1), (g3, j), (g4, h3), (g5, u)):
            parts += [np.outer(g, i).ravel(), g]
        return -math.log(p[k]), hit, np.concatenate(parts)

    for epoch in range(1, plan.epochs + 1):
        rate = plan.rate * 0.5 * (1 + math.cos(math.pi * (epoch - 1) / plan.epochs))
        sides = []
        for train, parts in ((True, batches(epoch, [r for r in data if r[5]])), (False, batches(0, [r for r in data if not r[5]]))):
            losses, hits, seen = [], 0, 0
            for part in parts:
                got = [row(r, train) for r in part]
                losses.append(np.mean([g[0] for g in got]))
                hits, seen = hits + sum(g[1] for g in got), seen + len(part)
                if train:
                    g = np.mean([x[2] for x in got], axis=0)
                    norm = math.sqrt(float(g @ g))
                    if norm > 0.1:
                        g = g * (0.1 / (norm + 1e-6))
                    step += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    flat = flat - rate * plan.decay * flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            sides += [float(np.mean(losses)), hits / seen]
        history.append((epoch, *sides))
    return history


def figures(models):
    return {(r.space_id, r.epoch): (r.train_loss, r.train_accuracy, r.val_loss, r.val_accuracy)
            for r in training.epoch_figures(models).collect()}


def same(got, space, want):
    for epoch, *four in want:
        assert np.allclose(got[space, epoch], four, rtol=1e-7, atol=1e-9), (space, epoch, got[space, epoch], four)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    flat = training.initial_weights("s", TEXT, 3, 4)
    text, numeric, target = rng.normal(size=(6, TEXT)), rng.normal(size=(6, FEATURE_SIZE)), np.array([0, 1, 2, 2, 1, 0])
    loss, _, gradient = training.batch_sums(flat, TEXT, 3, text, numeric, target)
    for k in rng.integers(0, len(flat), 60):
        moved = []
        for e in (1e-6, -1e-6):
            w = flat.copy()
            w[k] += e
            moved.append(training.batch_sums(w, TEXT, 3, text, numeric, target, False)[0])
        assert gradient[k] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-5)


def test_small_spaces_train_as_the_plain_walk(spark):
    a, b, few = made("a", 70, [3, 8, 11], 1), made("b", 45, [2, 5], 2), made("few", 19, [1, 2], 3)
    plan = training.Plan(epochs=3, batch_rows=16)
    frame = spark.createDataFrame([*a, *b, *few, (None, "x", [0.0] * TEXT, [0.0] * FEATURE_SIZE, 1, True)], SCHEMA)
    models, refused = training.train_spaces(frame.repartition(5), TEXT, plan)
    assert rows(refused) == [("few", 19)]
    assert rows(models, "space_id", "samples", "classes") == [("a", 70, [3, 8, 11]), ("b", 45, [2, 5])]
    draws = {r.id: r.d for r in frame.select("id", F.xxhash64("id").alias("d")).collect()}

    def batches(epoch, own):
        own = sorted(own, key=lambda r: (draws[r[1]], r[1]))
        if epoch:
            order = np.argsort(training._scatter(np.array([draws[r[1]] for r in own]), epoch), kind="stable")
            own = [own[i] for i in order]
        return [own[i: i + 16] for i in range(0, len(own), 16)]

    got = figures(models)
    for data in (a, b):
        same(got, data[0][0], walk(data, plan, batches))


def test_large_spaces_train_as_the_plain_walk_with_the_same_batches(spark):
    a, b = made("a", 90, [3, 8, 11], 1), made("b", 60, [2, 5], 2)
    plan = training.Plan(epochs=2, small_rows=10, steps=3, piece_rows=7)
    frame = spark.createDataFrame([*a, *b], SCHEMA)
    models, _ = training.train_spaces(frame.repartition(4), TEXT, plan)
    where = {(r.id, e): r[f"s{e}"] for e in (1, 2) for r in frame.select(
        "id", *[training.step_of(F.xxhash64("id"), e, 3).alias(f"s{e}") for e in (1, 2)]).collect()}

    def batches(epoch, own):
        return [[r for r in own if where[r[1], epoch] == k] for k in range(3)] if epoch else [own]

    got = figures(models)
    for data in (a, b):
        same(got, data[0][0], walk(data, plan, batches))


def test_training_learns_and_predicts_by_space(spark):
    data = made("a", 200, [0, 1], 5) + made("b", 200, [1, 2], 6)
    frame = spark.createDataFrame(data, SCHEMA)
    models, _ = training.train_spaces(frame, TEXT, training.Plan(epochs=12, rate=5e-3))
    history = figures(models)
    assert history["a", 12][0] < history["a", 1][0] and history["a", 12][1] > 0.9 and history["b", 12][3] > 0.8
    versions = models.withColumn("version", F.lit(4).cast("long"))
    chosen = spark.createDataFrame([("a", 4), ("b", 9)], "space_id string, version long")
    classes = spark.createDataFrame([(0, "Rent"), (1, "Food"), (2, "Bus")], "position long, name string")
    extra = spark.createDataFrame([("c", "c1", *data[0][2:]), (None, "n1", *data[0][2:])], SCHEMA)
    got = training.predict_versions(frame.union(extra), versions, chosen, classes, piece_rows=30).collect()
    assert len(got) == len(data) + 2
    names = {"a": {0: "Rent", 1: "Food"}}
    truth = {r[1]: r[4] for r in data}
    a = [r for r in got if r.space_id == "a"]
    assert all(r.version == 4 for r in a) and sum(names["a"][truth[r.id]] == r.predicted for r in a) > 180
    rest = [r for r in got if r.space_id != "a"]  # no version 9, no model
    assert {(r.version, r.label, r.predicted) for r in rest} == {(None, None, "Other")}


def test_scores_equal_the_head_with_the_same_weights(spark):
    weights = model.patterned_weights(TEXT, 4, version=3, space=2)
    data = made("s2", 40, [0], 7)
    frame = spark.createDataFrame(data, SCHEMA)
    stored = spark.createDataFrame([("s2", 3, TEXT, [0, 1, 2, 3], bytearray(model.flat_weights(weights).tobytes()))],
                                   "space_id string, version long, text_size int, classes array<long>, weights binary")
    chosen = spark.createDataFrame([("s2", 3)], "space_id string, version long")
    none = spark.createDataFrame([], "position long, name string")
    got = {r.id: r.label for r in training.predict_versions(frame, stored, chosen, none).collect()}
    want = {r.id: r.predicted_class for r in model.score_head(frame, weights).collect()}
    assert got == want and len(set(want.values())) >= 1


def test_weights_are_never_broadcast(spark):
    """However small Spark takes the models to be: their weights come from Python, and it knows only the keys."""
    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([TEXT] * n, pa.int32()), pa.array([[0]] * n, pa.list_(pa.int64())),
                 pa.array([model.flat_weights(model.patterned_weights(TEXT, 1)).tobytes()] * n, pa.binary())],
                names=["space_id", "version", "text_size", "classes", "weights"])

    frame = spark.createDataFrame(made("s2", 10, [0], 7), SCHEMA)
    models = spark.createDataFrame([("s2", 3), ("s2", 4)], "space_id string, version long").mapInArrow(
        fill, "space_id string, version long, text_size int, classes array<long>, weights binary")
    chosen = spark.createDataFrame([("s2", 3)], "space_id string, version long")
    none = spark.createDataFrame([], "position long, name string")
    found = training.predict_versions(frame, models, chosen, none)
    sent = found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[1:]
    assert not [x for x in sent if "weights" in x.split("\n")[1]]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftSemi" in x]
    assert len(joins) == 1  # only the right side of a semi-join can be broadcast: the choice
    assert {r.version for r in found.collect()} == {3}


def test_chosen_versions(spark, table):
    held = table("model_versions", {"space_id": "s", "version": 1}, {"space_id": "s", "version": 2}, {"space_id": "t", "version": 1})
    settings = table("space_settings", {"space_id": "s", "key": "active_model_version", "value": "2"})
    asked = spark.createDataFrame([("t", 1)], "space_id string, version long")
    assert rows(registry.chosen_versions(held, settings, asked)) == [("s", 2), ("t", 1)]


def test_a_step_reads_its_own_rows(spark, tmp_path):
    frame = spark.createDataFrame([(f"r{i}", i * 7919) for i in range(400)], "id string, draw long")
    path, seen = str(tmp_path / "epoch"), []
    for epoch in (1, 2):  # the second is written over the first
        batch = training._dealt(frame, epoch, 4, path)
        parts = [batch(k) for k in range(4)]
        for k, part in enumerate(parts):
            want = frame.where(training.step_of(F.col("draw"), epoch, 4) == k)
            assert rows(part) == rows(want)
            read = part._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(step" in read
        seen.append([rows(p) for p in parts])
    assert seen[0] != seen[1]


def test_packed_rows_keep_their_numbers(spark):
    import pyarrow as pa

    data = [("s", "a", [1.5, None], [0.25, -3.0]), ("s", "b", [math.pi, -0.0], [1e-3, 7.0]), ("t", "c", [2.0**-40, 1e300], [0.0, 1.0])]
    frame = spark.createDataFrame(data, "space_id string, id string, embedding array<double>, features array<float>")
    held = training.packed(frame)
    assert [f.dataType.simpleString() for f in held.schema] == ["string", "string", "binary", "binary"]
    assert training.packed(held) is held
    plain, got = ({r.id: r for r in f.collect()} for f in (frame, held))
    assert {k: (len(r.embedding), len(r.features)) for k, r in got.items()} == dict.fromkeys("abc", (16, 8))
    for name, size in (("embedding", 2), ("features", 2)):
        lists = pa.chunked_array([pa.array([plain[k][name] for k in "abc"], pa.list_(pa.float64()))])
        whole = pa.chunked_array([pa.array([bytes(got[k][name]) for k in "xabc" if k in got], pa.binary())])
        for cut in (slice(0, 3), slice(1, 3), slice(0, 0)):
            n = cut.stop - cut.start
            assert np.array_equal(training._stacked(whole.slice(cut.start, n), size), training._stacked(lists.slice(cut.start, n), size), equal_nan=True)


def test_packed_rows_train_and_are_scored_alike(spark):
    frame = spark.createDataFrame(made("a", 90, [3, 8, 11], 1) + made("b", 30, [2, 5], 2), SCHEMA)
    classes = spark.createDataFrame([(3, "x"), (5, "y")], "position long, name string")
    plan, found = training.Plan(epochs=2, small_rows=50, steps=3, piece_rows=7), []
    for rows_in in (frame, training.packed(frame)):
        models = training.train_spaces(rows_in, TEXT, plan)[0].withColumn("version", F.lit(1).cast("long"))
        chosen = models.select("space_id", "version")
        found.append((figures(models), rows(training.predict_versions(rows_in, models, chosen, classes, piece_rows=20))))
    assert found[0][1] == found[1][1] and len(found[0][1]) == 120
    for key, four in found[0][0].items():
        assert np.allclose(four, found[1][0][key], rtol=1e-9)
