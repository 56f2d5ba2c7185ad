"""The categorisation head: text embedding, training, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import first_per_group, hash_prefix, numbered
from ..functions.scalars import argmax_last, log_softmax_at, mean_pool
from ..schemas import FALLBACK_CATEGORY, MIN_TRAINING_ROWS
from .aggregates import hit_rate
from .features import FEATURE_SIZE, split_rows

# ---- fixed values -------------------------------------------------------------------
HIDDEN_LAYERS = [128, 32]
EPOCHS = 10
BATCH_ROWS = 32


def hashed_embedding(size: int = 256) -> Pipeline:
    """Character-trigram text embedding of unit length, for use without an encoder."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_chars", pattern=".", gaps=False, minTokenLength=1),
        NGram(n=3, inputCol="_chars", outputCol="_grams"),
        HashingTF(numFeatures=size, inputCol="_grams", outputCol="_counts"),
        Normalizer(inputCol="_counts", outputCol="embedding"),
    ])


def embed_text(rows: DataFrame, size: int = 256) -> DataFrame:
    """Add `embedding` by feature hashing: one pass, no vocabulary, no shuffle."""
    model = hashed_embedding(size).fit(rows)
    return model.transform(rows).drop("_chars", "_grams", "_counts")


def attach_embeddings(rows: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Join encoder output computed once beforehand (`key`, `embedding array<float>`)."""
    vectors = embeddings.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias(
        "embedding"))
    return rows.join(vectors, key)


def pooled_embedding(tokens: Column, mask: Column, size: int) -> Column:
    """Sentence vector of a token-level encoder: masked mean, unit length."""
    return mean_pool(tokens, mask, size)


def fused_input(rows: DataFrame) -> DataFrame:
    """`input`: embedding and numeric features in one vector, `label` as double."""
    numeric = rows.withColumn("_numeric", array_to_vector(F.col("features").cast("array<double>")))
    assembled = VectorAssembler(inputCols=["embedding", "_numeric"], outputCol="input").transform(numeric)
    return assembled.withColumn("label", F.col("label").cast("double")).drop("_numeric")


@dataclass
class TrainedHead:
    model: PipelineModel
    history: list[float]
    samples: int


def train_head(rows: DataFrame, classes: int, embedding_size: int, epochs: int = EPOCHS,
               seed: int = 1) -> TrainedHead:
    """Train the fused head on one space's training rows.

    Spark's multilayer perceptron stands in for the mini-batch optimiser: same inputs,
    layer sizes and role, full-batch L-BFGS with gradients summed over all partitions.
    `rows` has `embedding`, `features`, `label`, `train`.
    """
    samples = rows.count()
    if samples < MIN_TRAINING_ROWS:
        raise ValueError(f"need at least {MIN_TRAINING_ROWS} approved transactions, found {samples}")
    ready = fused_input(rows.where("train"))
    head = MultilayerPerceptronClassifier(
        layers=[embedding_size + FEATURE_SIZE, *HIDDEN_LAYERS, classes],
        featuresCol="input", maxIter=epochs, seed=seed, blockSize=128)
    fitted = head.fit(ready)
    summary = fitted.summary()
    return TrainedHead(PipelineModel([fitted]), list(summary.objectiveHistory), samples)


def predict(rows: DataFrame, trained: TrainedHead | None, classes: DataFrame) -> DataFrame:
    """`predicted` category per row: the fallback without a model or for an unknown class."""
    if trained is None:
        return rows.withColumn("predicted", F.lit(FALLBACK_CATEGORY))
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(0))
    scored = trained.model.transform(fused_input(rows))
    names = classes.groupBy("position").agg(F.min("name").alias("predicted"))
    return scored.withColumn("position", F.col("prediction").cast("bigint")).join(
        names, "position", "left"
    ).withColumn("predicted", F.coalesce("predicted", F.lit(FALLBACK_CATEGORY))).withColumn(
        "scores", vector_to_array("probability")).drop(
        "position", "input", "rawPrediction", "probability", "prediction")


# ---- forward pass with given weights ------------------------------------------------
@dataclass
class HeadWeights:
    """(weight, bias) pairs of the five linear layers; weights are out x in."""

    numeric_1: tuple[np.ndarray, np.ndarray]
    numeric_2: tuple[np.ndarray, np.ndarray]
    fuse_1: tuple[np.ndarray, np.ndarray]
    fuse_2: tuple[np.ndarray, np.ndarray]
    head: tuple[np.ndarray, np.ndarray]


def seeded_weights(text_size: int, classes: int, seed: int = 7) -> HeadWeights:
    """Untrained weights of the right shape, for checks."""
    rng = np.random.default_rng(seed)

    def layer(out: int, size: int):
        return (rng.normal(0, size ** -0.5, (out, size)), rng.normal(0, 0.1, out))

    n = FEATURE_SIZE
    return HeadWeights(layer(n, n), layer(n, n), layer(HIDDEN_LAYERS[0], text_size + n),
                       layer(HIDDEN_LAYERS[1], HIDDEN_LAYERS[0]), layer(classes, HIDDEN_LAYERS[1]))


def patterned_weights(text_size: int, classes: int, version: int = 1, space: int = 0) -> HeadWeights:
    """Weights from a rule in whole sixty-fourths, so that other engines can compute the same head."""
    def layer(no: int, out: int, size: int):
        i, j = np.arange(out)[:, None], np.arange(size)[None, :]
        w = ((31 * i + 17 * j + 7 * no + 13 * version + 5 * space) % 23 - 11) / 64
        return w, ((29 * i[:, 0] + 7 * no + 13 * version + 5 * space) % 19 - 9) / 64

    n = FEATURE_SIZE
    return HeadWeights(layer(1, n, n), layer(2, n, n), layer(3, HIDDEN_LAYERS[0], text_size + n),
                       layer(4, HIDDEN_LAYERS[1], HIDDEN_LAYERS[0]), layer(5, classes, HIDDEN_LAYERS[1]))


def flat_weights(weights: HeadWeights) -> np.ndarray:
    """The weights as the one vector that `training` keeps in a model's row."""
    pairs = (weights.numeric_1, weights.numeric_2, weights.fuse_1, weights.fuse_2, weights.head)
    return np.concatenate([np.asarray(x, float).ravel() for pair in pairs for x in pair])


def _forward(text: np.ndarray, numeric: np.ndarray, w: HeadWeights) -> np.ndarray:
    def dense(x, layer):
        return x @ layer[0].T + layer[1]

    def rectified(x, layer):
        return np.maximum(dense(x, layer), 0.0)

    branch = rectified(rectified(numeric, w.numeric_1), w.numeric_2)
    fused = rectified(rectified(np.hstack([text, branch]), w.fuse_1), w.fuse_2)
    length = np.sqrt((fused ** 2).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return dense(fused / length, w.head)


def score_head(rows: DataFrame, weights: HeadWeights) -> DataFrame:
    """`logits` and `predicted_class` from `embedding` and `features` arrays, by Arrow batch.

    The weights are a few hundred kilobytes whatever the data, so they ship with the task.
    """

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, numeric in batches:
            if not len(text):
                yield pd.Series([], dtype=object)
                continue
            out = _forward(np.stack(text.to_numpy()).astype(float),
                           np.stack(numeric.to_numpy()).astype(float), weights)
            yield pd.Series(list(out))

    scored = rows.withColumn("logits", logits("embedding", "features"))
    return scored.withColumn("predicted_class", argmax_last(F.col("logits")))


# ---- evaluation ---------------------------------------------------------------------
def evaluate(scored: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Loss and accuracy per space and split from `logits` and `label`.

    The loss is the mean of batch means over batches of `batch_rows`, so a short last batch
    weighs more; a batch whose loss is not finite counts in neither figure. Where no batch is
    finite, loss and accuracy are 0 over 0 rows.
    """
    groups = ["space_id", "train"]
    ranked = numbered(scored, groups, [hash_prefix(F.col("id"))], [F.md5("id"), F.col("id")], out="_no")
    loss = -log_softmax_at(F.col("logits"), F.col("label").cast("int"))
    hit = argmax_last(F.col("logits")) == F.col("label").cast("int")
    batches = ranked.groupBy(*groups, F.floor((F.col("_no") - 1) / batch_rows).alias("_batch")).agg(
        F.avg(loss).alias("_loss"), F.count_if(hit).alias("_hits"), F.count(F.lit(1)).alias("_rows"))
    finite = ~F.isnan("_loss") & (F.abs("_loss") < float("inf"))
    return batches.groupBy(*groups).agg(
        F.coalesce(F.avg(F.when(finite, F.col("_loss"))), F.lit(0.0)).alias("loss"),
        F.coalesce(F.sum(F.when(finite, F.col("_hits"))) / F.sum(F.when(finite, F.col("_rows"))), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.sum(F.when(finite, F.col("_rows"))), F.lit(0)).alias("rows"))


def sample_predictions(predictions: DataFrame, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A repeatable sample of (space_id, id, actual, predicted) per space, and its hit rate."""
    drawn = first_per_group(
        predictions.withColumn("_draw", F.md5(F.concat(F.col("id"), F.lit(f"#{seed}")))),
        ["space_id"], [F.col("_draw"), F.col("id")], rows).drop("_draw", "row_no")
    return drawn, hit_rate(drawn, ["space_id"])


def prepare_training(training: DataFrame, embedding_size: int) -> DataFrame:
    """Split and embedded training rows, ready for `train_head`."""
    return embed_text(split_rows(training), embedding_size)


