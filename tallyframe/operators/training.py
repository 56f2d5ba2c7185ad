"""One categorisation head per space: training, versions of models, prediction with a chosen one.

A head is a row: its space, the labels it knows and its weights as one flat vector. Spaces of up
to `SMALL_ROWS` rows are trained each in one task, batch after batch. Larger ones are trained
together, batch by batch: a batch's rows are dealt in pieces over all tasks, each piece meets its
space's weights in a cogroup, and the sums of gradients go up a tree until one row per space is
left, which moves the weights. No weights are broadcast and none pass the driver.

Optimiser: AdamW with a cosine rate per epoch and gradients clipped to a global norm. A batch
whose gradient isn't finite moves nothing; one whose loss isn't finite counts in no figure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FALLBACK_CATEGORY, MIN_TRAINING_ROWS
from ..session import scratch_dir, settle
from .features import FEATURE_SIZE

# ---- fixed values -------------------------------------------------------------------
HIDDEN, NARROW = 128, 32
EPOCHS, BATCH_ROWS, RATE, DECAY = 10, 32, 1e-3, 1e-4
CLIP = 0.1
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
# -------------------------------------------------------------------------------------
#: Rows of a space that one task trains; rows of a piece and pieces summed at once beyond that.
SMALL_ROWS = 20_000
PIECE_ROWS, FAN = 4096, 64

_EPOCH = "struct<epoch: int, train_loss: double, train_accuracy: double, val_loss: double, val_accuracy: double>"
MODEL = f"space_id string, samples long, text_size int, classes array<long>, weights binary, history array<{_EPOCH}>"


@dataclass
class Plan:
    """How to train; `steps` are the batches of an epoch for spaces of more than `small_rows` rows."""

    epochs: int = EPOCHS
    batch_rows: int = BATCH_ROWS
    rate: float = RATE
    decay: float = DECAY
    seed: int = 1
    small_rows: int = SMALL_ROWS
    steps: int = 16
    piece_rows: int = PIECE_ROWS

    def rate_of(self, epoch: int) -> float:
        return self.rate * 0.5 * (1 + np.cos(np.pi * (epoch - 1) / self.epochs))


# ---- the head, on flat weights ------------------------------------------------------
def layer_shapes(text_size: int, classes: int) -> list[tuple[int, int]]:
    """(outputs, inputs) of the five layers: two of the numeric branch, two fused, the last."""
    n = FEATURE_SIZE
    return [(n, n), (n, n), (HIDDEN, text_size + n), (NARROW, HIDDEN), (classes, NARROW)]


def layers(flat: np.ndarray, text_size: int, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of a flat vector as (weight, bias) pairs."""
    out, at = [], 0
    for rows, cols in layer_shapes(text_size, classes):
        out.append((flat[at: at + rows * cols].reshape(rows, cols), flat[at + rows * cols: at + rows * cols + rows]))
        at += rows * cols + rows
    return out


def initial_weights(space: str | None, text_size: int, classes: int, seed: int) -> np.ndarray:
    """Uniform within 1 / sqrt(inputs); equal for equal arguments."""
    rng = np.random.default_rng([seed, *(space or "").encode()])
    parts = []
    for rows, cols in layer_shapes(text_size, classes):
        parts.append(rng.uniform(-1, 1, rows * cols + rows) / np.sqrt(cols))
    return np.concatenate(parts)


def logits_of(flat: np.ndarray, text_size: int, classes: int, text: np.ndarray, numeric: np.ndarray):
    """Logits and what the way back needs."""
    (w1, b1), (w2, b2), (w3, b3), (w4, b4), (w5, b5) = layers(flat, text_size, classes)
    h1 = np.maximum(numeric @ w1.T + b1, 0)
    h2 = np.maximum(h1 @ w2.T + b2, 0)
    joined = np.hstack([text, h2])
    h3 = np.maximum(joined @ w3.T + b3, 0)
    h4 = np.maximum(h3 @ w4.T + b4, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        length = np.sqrt((h4 * h4).sum(axis=1, keepdims=True))
        unit = h4 / length
    return unit @ w5.T + b5, (h1, h2, joined, h3, h4, length, unit)


def predicted_class(logits: np.ndarray) -> np.ndarray:
    """Greatest logit of each row; the last among equals."""
    return logits.shape[1] - 1 - np.argmax(logits[:, ::-1], axis=1)


def batch_sums(flat: np.ndarray, text_size: int, classes: int, text: np.ndarray, numeric: np.ndarray,
               target: np.ndarray, back: bool = True) -> tuple[float, int, np.ndarray | None]:
    """Loss, hits and gradient of a batch, each summed over its rows."""
    if not len(target):
        return 0.0, 0, np.zeros(len(flat)) if back else None
    logits, (h1, h2, joined, h3, h4, length, unit) = logits_of(flat, text_size, classes, text, numeric)
    with np.errstate(invalid="ignore", over="ignore"):
        shifted = logits - logits.max(axis=1, keepdims=True)
        log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    rows = np.arange(len(target))
    loss, hits = float(-log_p[rows, target].sum()), int((predicted_class(logits) == target).sum())
    if not back:
        return loss, hits, None
    ws = [w for w, _ in layers(flat, text_size, classes)]
    with np.errstate(invalid="ignore"):
        g5 = np.exp(log_p)
        g5[rows, target] -= 1
        gu = g5 @ ws[4]
        g4 = (gu - unit * (gu * unit).sum(axis=1, keepdims=True)) / length * (h4 > 0)
        g3 = g4 @ ws[3] * (h3 > 0)
        g2 = g3 @ ws[2][:, text_size:] * (h2 > 0)
        g1 = g2 @ ws[1] * (h1 > 0)
        parts = []
        for g, x in ((g1, numeric), (g2, h1), (g3, joined), (g4, h3), (g5, unit)):
            parts += [(g.T @ x).ravel(), g.sum(axis=0)]
    return loss, hits, np.concatenate(parts)


def adamw(flat, m, v, step: int, gradient: np.ndarray, rate: float, decay: float):
    """Weights and moments after step number `step` (from 1) with a batch's mean gradient."""
    norm = np.sqrt(float(gradient @ gradient))
    if norm > CLIP:
        gradient = gradient * (CLIP / (norm + 1e-6))
    m, v = BETA_1 * m + (1 - BETA_1) * gradient, BETA_2 * v + (1 - BETA_2) * gradient * gradient
    move = (m / (1 - BETA_1**step)) / (np.sqrt(v / (1 - BETA_2**step)) + EPSILON)
    return flat * (1 - rate * decay) - rate * move, m, v


def packed(rows: DataFrame) -> DataFrame:
    """The rows with the arrays `embedding` and `features` as binaries of their numbers.

    A row is written, read, sorted and sent many times; its numbers are then two values, not one each.
    """
    arrays = {n for n in ("embedding", "features") if isinstance(rows.schema[n].dataType, T.ArrayType)}

    def run(batches):
        for batch in batches:
            columns = [_binary(c) if n in arrays else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name in arrays else f.dataType) for f in rows.schema])) if arrays else rows


def _binary(lists: pa.ListArray) -> pa.Array:
    numbers = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)) * numbers.itemsize
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(numbers))])


def _stacked(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Lists, or binaries of 4 or 8 bytes a number, as a matrix."""
    whole = column.combine_chunks()
    if not (pa.types.is_binary(whole.type) or pa.types.is_large_binary(whole.type)):
        return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    if not len(whole):
        return np.zeros((0, size))
    _, ends, held = whole.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(whole.type) else np.int32)[whole.offset: whole.offset + len(whole) + 1]
    numbers = np.frombuffer(held[int(at[0]): int(at[-1])], np.float32 if at[-1] - at[0] == 4 * size * len(whole) else np.float64)
    return numbers.astype(np.float64).reshape(-1, size)


def _figures(sums: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Mean of the batches' mean losses, and hits over rows, of the batches whose loss is finite."""
    good = [s for s in sums if s[2] and np.isfinite(s[0])]
    if not good:
        return 0.0, 0.0
    return float(np.mean([loss / n for loss, _, n in good])), sum(h for _, h, _ in good) / sum(n for _, _, n in good)


# ---- small spaces -------------------------------------------------------------------
def _scatter(values: np.ndarray, epoch: int) -> np.ndarray:
    """An epoch's own order of the rows' draws."""
    x = values.view(np.uint64) + np.uint64(epoch * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _train_small(plan: Plan, text_size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("id", "ascending")])
        space, labels = table["space_id"][0].as_py(), table["label"].to_numpy()
        classes = np.unique(labels)
        target, train = np.searchsorted(classes, labels), table["train"].to_numpy().astype(bool)
        text, numeric = _stacked(table["embedding"], text_size), _stacked(table["features"], FEATURE_SIZE)
        draw = table["draw"].to_numpy()
        flat = initial_weights(space, text_size, len(classes), plan.seed)
        m = v = np.zeros(len(flat))
        step, history, held_out = 0, [], np.flatnonzero(~train)
        for epoch in range(1, plan.epochs + 1):
            mine = np.flatnonzero(train)
            mine, sums = mine[np.argsort(_scatter(draw[mine], epoch), kind="stable")], []
            for at in range(0, len(mine), plan.batch_rows):
                own = mine[at: at + plan.batch_rows]
                loss, hits, gradient = batch_sums(flat, text_size, len(classes), text[own], numeric[own], target[own])
                if np.isfinite(gradient).all():
                    step += 1
                    flat, m, v = adamw(flat, m, v, step, gradient / len(own), plan.rate_of(epoch), plan.decay)
                    sums.append((loss, hits, len(own)))
            seen = []
            for at in range(0, len(held_out), plan.batch_rows):
                own = held_out[at: at + plan.batch_rows]
                seen.append((*batch_sums(flat, text_size, len(classes), text[own], numeric[own], target[own], False)[:2], len(own)))
            history.append(dict(zip(("epoch", "train_loss", "train_accuracy", "val_loss", "val_accuracy"),
                                    (epoch, *_figures(sums), *_figures(seen)))))
        return pa.Table.from_pylist([{
            "space_id": space, "samples": len(labels), "text_size": text_size, "classes": classes.tolist(),
            "weights": flat.tobytes(), "history": history}], _MODEL_ARROW)
    return run


_MODEL_ARROW = pa.schema([
    ("space_id", pa.string()), ("samples", pa.int64()), ("text_size", pa.int32()), ("classes", pa.list_(pa.int64())), ("weights", pa.binary()),
    ("history", pa.list_(pa.struct([("epoch", pa.int32()), *[(c, pa.float64()) for c in ("train_loss", "train_accuracy", "val_loss", "val_accuracy")]])))])


# ---- large spaces -------------------------------------------------------------------
_STATE_ARROW = pa.schema([*_MODEL_ARROW, ("pieces", pa.int64()), ("m", pa.binary()), ("v", pa.binary()), ("step", pa.int64()),
                          ("sums", pa.list_(pa.list_(pa.float64())))])
_STATE = MODEL + ", pieces long, m binary, v binary, step long, sums array<array<double>>"
_SUMS = "space_id string, piece long, loss double, hits long, n long, gradient binary"
_SUMS_ARROW = pa.schema([("space_id", pa.string()), ("piece", pa.int64()), ("loss", pa.float64()), ("hits", pa.int64()), ("n", pa.int64()),
                         ("gradient", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _each(step, schema: pa.Schema):
    """A mapInArrow function that turns each row (a dict) into one of `schema`."""
    def run(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_pylist([step(row)], schema)
    return run


def _start(plan: Plan, text_size: int):
    def step(row: dict) -> dict:
        flat = initial_weights(row["space_id"], text_size, len(row["classes"]), plan.seed)
        zero = np.zeros(len(flat)).tobytes()
        return {**row, "text_size": text_size, "weights": flat.tobytes(), "history": [], "m": zero, "v": zero, "step": 0, "sums": []}
    return step


def _piece_sums(back: bool):
    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:  # no such piece of this space in the state: nothing to train
            return pa.Table.from_pylist([], _SUMS_ARROW)
        s = state.to_pylist()[0]
        classes, flat = np.array(s["classes"]), np.frombuffer(s["weights"])
        piece = rows["piece"].to_numpy()
        order = np.lexsort((rows["draw"].to_numpy(), piece))
        target, loss, hits, gradient = np.searchsorted(classes, rows["label"].to_numpy()), 0.0, 0, np.zeros(len(flat))
        text, numeric = _stacked(rows["embedding"], s["text_size"]), _stacked(rows["features"], FEATURE_SIZE)
        for own in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            sums = batch_sums(flat, s["text_size"], len(classes), text[own], numeric[own], target[own], back)
            loss, hits = loss + sums[0], hits + sums[1]
            if back:
                gradient += sums[2]
        return pa.Table.from_pylist([{"space_id": s["space_id"], "piece": s["bundle"], "loss": loss, "hits": hits, "n": len(target),
                                      "gradient": gradient.tobytes() if back else b""}], _SUMS_ARROW)
    return run


def _sum_up(table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    gradient = np.sum([np.frombuffer(g) for g in table["gradient"].to_pylist()], axis=0)
    return pa.Table.from_pylist([{
        "space_id": table["space_id"][0].as_py(), "piece": table["piece"][0].as_py() // FAN, "loss": sum(table["loss"].to_pylist()),
        "hits": sum(table["hits"].to_pylist()), "n": sum(table["n"].to_pylist()), "gradient": np.asarray(gradient).tobytes()}], _SUMS_ARROW)


def _summed(rows: DataFrame, state: DataFrame, most: int, bundle: int, back: bool) -> DataFrame:
    """One row of sums for each space: over pieces first, then up a tree of FAN branches.

    `bundle` pieces meet the weights together and send one gradient: both are larger than a few hundred rows.
    """
    sized = rows.join(state.select("space_id", "pieces"), "space_id").withColumn(
        "piece", F.pmod(F.shiftright("draw", 20), F.col("pieces"))).drop("pieces").withColumn("bundle", F.floor(F.col("piece") / bundle))
    weights = state.select("space_id", "text_size", "classes", "weights",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pieces") - 1) / bundle))).alias("bundle"))
    keys, most = ["space_id", "bundle"], -(-most // bundle)
    sums = sized.groupBy(*keys).cogroup(weights.groupBy(*keys)).applyInArrow(_piece_sums(back), _SUMS)
    while most > 1:
        sums = sums.groupBy("space_id", F.floor(F.col("piece") / FAN)).applyInArrow(_sum_up, _SUMS)
        most = -(-most // FAN)
    return sums.select("space_id", F.struct("loss", "hits", "n", "gradient").alias("got"))


def _move(plan: Plan, epoch: int):
    def step(row: dict) -> dict:
        got = row.pop("got")
        if not got or not got["n"]:
            return row
        gradient = np.frombuffer(got["gradient"])
        if np.isfinite(gradient).all():
            row["step"] += 1
            flat, m, v = (np.frombuffer(row[k]) for k in ("weights", "m", "v"))
            moved = adamw(flat, m, v, row["step"], gradient / got["n"], plan.rate_of(epoch), plan.decay)
            row.update({k: x.tobytes() for k, x in zip(("weights", "m", "v"), moved)})
            row["sums"] = [*row["sums"], [got["loss"], got["hits"], got["n"]]]
        return row
    return step


def _note(epoch: int):
    def step(row: dict) -> dict:
        got = row.pop("got")
        train = _figures([tuple(s) for s in row["sums"]])
        val = _figures([(got["loss"], got["hits"], got["n"])] if got else [])
        figures = zip(("epoch", "train_loss", "train_accuracy", "val_loss", "val_accuracy"), (epoch, *train, *val))
        return {**row, "history": [*row["history"], dict(figures)], "sums": []}
    return step


def step_of(draw, epoch: int, steps: int):
    """The batch of an epoch, from 0, that a row of a large space is in."""
    return F.pmod(F.xxhash64(F.lit(epoch), draw), F.lit(steps))


def _dealt(rows: DataFrame, epoch: int, steps: int, path: str):
    """The batches of an epoch: written once, over those of the epoch before, so that each step reads its own rows and no others."""
    spark = rows.sparkSession
    rows.withColumn("step", step_of(F.col("draw"), epoch, steps)).write.mode("overwrite").partitionBy("step").parquet(path)

    def batch(k: int) -> DataFrame:
        # a step that no row falls in has no folder
        return spark.read.schema(T.StructType([*rows.schema, T.StructField("step", T.LongType())])).parquet(path).where(F.col("step") == k).drop("step")
    return batch


def _train_large(rows: DataFrame, spaces: DataFrame, plan: Plan, text_size: int) -> DataFrame:
    fresh = spaces.withColumn("pieces", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("samples") / (plan.steps * plan.piece_rows))))
    state = settle(fresh.mapInArrow(_each(_start(plan, text_size), _STATE_ARROW), _STATE), "heads")
    most = state.agg(F.max("pieces")).first()[0]
    if most is None:
        return state.select(*_MODEL_ARROW.names)
    bundle = max(1, PIECE_ROWS // plan.piece_rows)
    rows = rows.select("space_id", "label", "train", "embedding", "features", "draw")
    held_out, path = settle(rows.where("NOT train"), "held-out"), scratch_dir(rows.sparkSession, "epoch")
    for epoch in range(1, plan.epochs + 1):
        dealt = _dealt(rows.where("train"), epoch, plan.steps, path)
        for k in range(plan.steps):
            got = state.join(_summed(dealt(k), state, most, bundle, True), "space_id", "left")
            state = settle(got.mapInArrow(_each(_move(plan, epoch), _STATE_ARROW), _STATE), "heads")
        got = state.join(_summed(held_out, state, most, bundle, False), "space_id", "left")
        state = settle(got.mapInArrow(_each(_note(epoch), _STATE_ARROW), _STATE), "heads")
    return state.select(*_MODEL_ARROW.names)


def train_spaces(rows: DataFrame, text_size: int, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, refused): a trained head for every space of `rows`, and the spaces with too few.

    rows: space_id, id, embedding (array of `text_size`), features, label and train, as
    `split_rows` gives them, or `packed`. A model knows the labels of its space's rows. `history` has loss and
    accuracy on both sides for each epoch: means over batches, as `evaluate` forms them; for
    spaces of more than `plan.small_rows` rows, held-out rows are one batch. Spaces with fewer
    than 20 rows are refused: (space_id, samples). Rows without space are left out.
    """
    plan = plan or Plan()
    kept = rows.where("space_id IS NOT NULL").select(
        "space_id", F.col("id").cast("string").alias("id"), F.col("label").cast("long").alias("label"), "train", "embedding",
        "features", F.xxhash64("id").alias("draw"))
    kept = settle(packed(kept), "training-rows")
    sizes = settle(kept.groupBy("space_id").agg(F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_set("label")).alias("classes")), "spaces")
    enough = F.col("samples") >= MIN_TRAINING_ROWS
    small = sizes.where(enough & (F.col("samples") <= plan.small_rows)).select("space_id")
    large = sizes.where(enough & (F.col("samples") > plan.small_rows))
    alone = kept.join(small, "space_id", "left_semi").groupBy("space_id").applyInArrow(_train_small(plan, text_size), MODEL)
    together = _train_large(kept.join(large, "space_id", "left_semi"), large, plan, text_size)
    return settle(alone.unionByName(together), "models"), sizes.where(~enough).select("space_id", "samples")


def epoch_figures(models: DataFrame) -> DataFrame:
    """(space_id, epoch, train_loss, train_accuracy, val_loss, val_accuracy) of every model."""
    return models.select("space_id", F.explode("history").alias("h")).select("space_id", "h.*")


# ---- prediction with a chosen version -----------------------------------------------
_SCORED = "space_id string, id string, version long, label long"


def _score(rows: pa.Table, model: pa.Table) -> pa.Table:
    schema = pa.schema([("space_id", pa.string()), ("id", pa.string()), ("version", pa.int64()), ("label", pa.int64())])
    n = rows.num_rows
    label, version = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())
    if n and model.num_rows:
        m = model.to_pylist()[0]
        classes = np.array(m["classes"], np.int64)
        logits, _ = logits_of(np.frombuffer(m["weights"]), m["text_size"], len(classes), _stacked(rows["embedding"], m["text_size"]),
                              _stacked(rows["features"], FEATURE_SIZE))
        label, version = pa.array(classes[predicted_class(logits)]), pa.array(np.full(n, m["version"]))
    return pa.table([rows["space_id"], rows["id"], version, label], schema=schema)


def predict_versions(rows: DataFrame, models: DataFrame, chosen: DataFrame, classes: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(space_id, id, version, label, predicted) of all rows, by the chosen version of their space's model.

    rows: space_id, id, embedding, features, may be `packed`; models: space_id, version, text_size, classes,
    weights; chosen: space_id, version; classes: position, name. Without a model, or for an
    unknown class, the fallback is predicted; `version` and `label` are null without a model.

    A space's rows are dealt in pieces, each of which meets the weights in a cogroup. Weights are
    never broadcast: models are semi-joined with the stored choice, whose size Spark knows, and
    their number of pieces is merged to them.
    """
    wanted = models.join(settle(chosen.select("space_id", "version"), "chosen"), ["space_id", "version"], "left_semi")
    sizes = rows.groupBy("space_id").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / piece_rows)).alias("pieces"))
    sizes = settle(sizes, "pieces")
    dealt = rows.join(sizes.withColumnRenamed("space_id", "_space"), F.col("space_id").eqNullSafe(F.col("_space"))).select(
        "space_id", F.col("id").cast("string").alias("id"), "embedding", "features",
        F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"))
    weights = wanted.join(sizes.hint("merge"), "space_id").select(
        "space_id", "version", "text_size", "classes", "weights", F.explode(F.expr("sequence(0L, pieces - 1)")).alias("piece"))
    keys = ["space_id", "piece"]
    scored = dealt.groupBy(*keys).cogroup(weights.groupBy(*keys)).applyInArrow(_score, _SCORED)
    names = classes.groupBy("position").agg(F.min("name").alias("predicted"))
    named = scored.join(names, scored["label"] == names["position"], "left")
    return named.select("space_id", "id", "version", "label", F.coalesce("predicted", F.lit(FALLBACK_CATEGORY)).alias("predicted"))
