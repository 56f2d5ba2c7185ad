"""Registered queries: features, training, scoring, evaluation and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_pool
from ..operators import features, ingest, model, registry, training
from ..operators.aggregates import hit_rate
from ..operators.joins import with_label
from ..session import settle
from ..sources.given import GivenLedger
from .catalog import register
from .oracle import ledger_sql

EMBEDDING_SIZE = 64


def _t(column: Column) -> Column:
    return column.cast("string")


_CLASSES = """
classes AS (SELECT row_number() OVER (ORDER BY name, id) - 1 AS position, name FROM categories),
labels_by_name AS (SELECT name, min(position) AS label FROM classes GROUP BY 1),
labelled AS (
  SELECT a.space_id, t.*, coalesce(l.label, (SELECT label FROM labels_by_name WHERE name = 'Other')) AS label
  FROM transactions t JOIN accounts a ON a.id = t.account_id
  LEFT JOIN labels_by_name l ON l.name = t.category AND t.category <> 'Transport'
  WHERE t.approved AND t.category IS NOT NULL AND t.category <> '')"""


def _classes(led: GivenLedger) -> DataFrame:
    return features.class_list(led.categories)


@register("build_features", ledger_sql("""
    SELECT id, CAST(CASE WHEN base < -100000 THEN 0 WHEN base < -10000 THEN 1 WHEN base < -1000 THEN 2
             WHEN base < -100 THEN 3 WHEN base < -10 THEN 4 WHEN base < 0 THEN 5 WHEN base < 10 THEN 6
             WHEN base < 100 THEN 7 WHEN base < 1000 THEN 8 WHEN base < 10000 THEN 9 WHEN base < 100000 THEN 10
             ELSE 11 END AS VARCHAR)
           || ',' || (13 + isodow(day)) || ',' || (20 + day(day)) || ',' || (51 + month(day)) AS hot,
           CAST(round((CASE WHEN base >= 0 THEN 1 ELSE -1 END) * ln(abs(base) + 1) * 100) AS BIGINT) AS log_hundredths
    FROM (SELECT id, amount / 100.0::DOUBLE AS base, CAST(booking_date AS DATE) AS day FROM base_transactions)"""))
def _(led: GivenLedger) -> DataFrame:
    """The set positions of each 64-float vector, and its one continuous feature."""
    rows = features.build_features(led.transactions(text=False, balance=False).select(
        "id", "amount", "booking_date"))
    numbered = F.transform("features", lambda v, i: F.when((v == 1) & (i != 13), i))
    return rows.select(
        "id", F.array_join(F.filter(numbered, lambda i: i.isNotNull()).cast("array<string>"), ",").alias("hot"),
        F.round(F.get("features", F.lit(13)).cast("double") * 100).cast("bigint").alias("log_hundredths"))


@register("class_list", ledger_sql("SELECT position, name FROM classes", _CLASSES))
def _(led: GivenLedger) -> DataFrame:
    return _classes(led)


@register("label_index", ledger_sql("""
    SELECT t.id, coalesce(l.label, (SELECT label FROM labels_by_name WHERE name = 'Other')) AS label
    FROM transactions t LEFT JOIN labels_by_name l ON l.name = t.category""", _CLASSES))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False).select("id", "category")
    return with_label(rows, _classes(led)).select("id", "label")


@register("training_set", ledger_sql("""
    SELECT space_id, id, lower(trim(split_part(text, '/', 1))) AS text, label FROM labelled""",
    _CLASSES.replace(" AND t.category <> 'Transport'\n", "\n")))
def _(led: GivenLedger) -> DataFrame:
    return features.training_set(led.transactions(balance=False), led.accounts, _classes(led)).drop("features")


@register("split_rows", ledger_sql("""
    SELECT space_id, id, r <= greatest(1, least(n - 1,
             CAST(floor(CAST(n AS FLOAT) * CAST(0.8 AS FLOAT)) AS BIGINT))) AS train
    FROM (SELECT space_id, id, count(*) OVER (PARTITION BY space_id) AS n,
                 row_number() OVER (PARTITION BY space_id ORDER BY md5(id), id) AS r FROM labelled)""", _CLASSES))
def _(led: GivenLedger) -> DataFrame:
    from ..operators.filters import approved_labelled, scope_to_space

    rows = led.transactions(text=False, balance=False).select("id", "approved", "category", "account_id")
    return features.split_rows(scope_to_space(approved_labelled(rows), led.accounts)).select(
        "space_id", "id", "train")


def _prepared(led: GivenLedger) -> tuple[DataFrame, DataFrame]:
    classes = _classes(led)
    rows = features.training_set(led.transactions(balance=False), led.accounts, classes)
    return settle(features.split_rows(rows), "training"), settle(classes, "classes")


def _embedded(led: GivenLedger) -> tuple[DataFrame, DataFrame]:
    """Training rows with plain embedding arrays, and the class list."""
    from pyspark.ml.functions import vector_to_array

    rows, classes = _prepared(led)
    return model.embed_text(rows, EMBEDDING_SIZE).withColumn("embedding", vector_to_array("embedding")), classes


@register("text_embedding", ledger_sql("""
    SELECT id, CASE WHEN length(text) < 3 THEN 0.0::DOUBLE ELSE 1.0 END AS squared_length FROM base_transactions"""))
def _(led: GivenLedger) -> DataFrame:
    """Embeddings have unit length; texts without a trigram have none."""
    from pyspark.ml.functions import vector_to_array

    rows = led.transactions(balance=False).select("id", F.lower("text").alias("text"))
    vector = vector_to_array("embedding")
    return model.embed_text(rows, EMBEDDING_SIZE).select(
        "id", F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x), 9).alias("squared_length"))


@register("attach_embeddings", ledger_sql("""
    SELECT id, vec_id, len(embedding) AS size, label AS topic
    FROM base_transactions JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)"""))
def _(led: GivenLedger) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = led.read("embeddings")
    total = vectors.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = led.transactions(text=False, balance=False).select("id", "reference").join(F.broadcast(total)).select(
        "id", (F.col("reference").cast("bigint") % F.col("n")).alias("vec_id"))
    attached = model.attach_embeddings(rows, vectors, "vec_id")
    return attached.join(vectors.select("vec_id", F.col("label").alias("topic")), "vec_id").select(
        "id", "vec_id", F.size(vector_to_array("embedding")).alias("size"), "topic")


@register("mean_pool", """
    WITH tokens AS (
      SELECT vec_id // 8 AS text_id, vec_id % 3 <> 0 AS kept, UNNEST(embedding) AS v,
             generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT text_id, i, avg(v::DOUBLE) FILTER (kept) AS m FROM tokens GROUP BY 1, 2)
    SELECT text_id, CAST(1000000 AS BIGINT) AS length_millionths,
           CAST(round(sum(m) FILTER (i = 1) / sqrt(sum(m * m)) * 10000) AS BIGINT) AS first_ten_thousandths
    FROM means GROUP BY 1""")
def _(led: GivenLedger) -> DataFrame:
    """Unit-length masked mean: eight vectors in a row are the tokens of a text, every third is masked."""
    vectors = led.read("embeddings").withColumn("text_id", F.floor(F.col("vec_id") / 8))
    token = F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 != 0).cast("int").alias("kept"))
    texts = vectors.groupBy("text_id").agg(F.sort_array(F.collect_list(token)).alias("t"))  # eight at most
    pooled = texts.select("text_id", mean_pool(F.col("t.v"), F.col("t.kept"), 64).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return pooled.select(
        "text_id", F.round(length * 1000000).cast("bigint").alias("length_millionths"),
        F.round(F.get("v", F.lit(0)) * 10000).cast("bigint").alias("first_ten_thousandths"))


@register("train_head")
def _(led: GivenLedger) -> DataFrame:
    """Loss and accuracy on both sides, for every space and epoch."""
    rows, _ = _embedded(led)
    return training.epoch_figures(training.train_spaces(rows, EMBEDDING_SIZE)[0])


@register("train_head_in_pieces")
def _(led: GivenLedger) -> DataFrame:
    """The same for spaces too large for a task: two epochs of two batches, whose pieces are summed up a tree."""
    rows, _ = _embedded(led)
    plan = training.Plan(epochs=2, steps=2, small_rows=0, piece_rows=512)
    return training.epoch_figures(training.train_spaces(rows, EMBEDDING_SIZE, plan)[0])


@register("predict")
def _(led: GivenLedger) -> DataFrame:
    """Every training row's category by its own space's new model."""
    rows, classes = _embedded(led)
    rows = settle(training.packed(rows.select("space_id", "id", "embedding", "features", "label", "train")), "embedded")
    models, _ = training.train_spaces(rows, EMBEDDING_SIZE)
    versions = models.withColumn("version", F.lit(1).cast("long"))
    return training.predict_versions(rows, versions, versions.select("space_id", "version"), classes)


@register("predict_without_model", ledger_sql("SELECT id, 'Other' AS predicted FROM transactions"))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False).select("id")
    return model.predict(rows, None, led.categories)


_PATTERN = """
rows_in AS (
  SELECT t.id, a.space_id, t.category, CAST(CAST(t.amount AS FLOAT) / 100.0::DOUBLE AS FLOAT) AS base, CAST(t.booking_date AS DATE) AS day,
         CAST(e.embedding AS DOUBLE[]) AS text_vector
  FROM transactions t JOIN accounts a ON a.id = t.account_id
  JOIN embeddings e ON e.vec_id = CAST(t.reference AS BIGINT) % (SELECT count(*) FROM embeddings)),
input AS (
  SELECT *, list_concat(
      list_transform(range(13), lambda i: CAST(i = CASE WHEN base < -100000 THEN 0 WHEN base < -10000 THEN 1 WHEN base < -1000 THEN 2
        WHEN base < -100 THEN 3 WHEN base < -10 THEN 4 WHEN base < 0 THEN 5 WHEN base < 10 THEN 6 WHEN base < 100 THEN 7
        WHEN base < 1000 THEN 8 WHEN base < 10000 THEN 9 WHEN base < 100000 THEN 10 ELSE 11 END AS DOUBLE)),
      [CAST(CAST((CASE WHEN base >= 0 THEN 1 ELSE -1 END) * ln(CAST(CAST(abs(base) + CAST(1 AS FLOAT) AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE)],
      list_transform(range(1, 8), lambda i: CAST(i = isodow(day) AS DOUBLE)),
      list_transform(range(1, 32), lambda i: CAST(i = day(day) AS DOUBLE)),
      list_transform(range(1, 13), lambda i: CAST(i = month(day) AS DOUBLE))) AS numeric_vector
  FROM rows_in),
weights AS (
  SELECT space_id, no, i, ((29 * i + 7 * no + 13 * version + 5 * space_no) % 19 - 9) / 64.0::DOUBLE AS bias,
         list_transform(range(inputs), lambda j: ((31 * i + 17 * j + 7 * no + 13 * version + 5 * space_no) % 23 - 11) / 64.0::DOUBLE) AS w
  FROM (SELECT *, UNNEST(range(outputs)) AS i FROM chosen,
        (VALUES (1, 64, 64), (2, 64, 64), (3, 128, 128), (4, 32, 128), (5, 10, 32)) l(no, outputs, inputs))),
n1 AS (SELECT id, list(greatest(0, list_inner_product(w, numeric_vector) + bias) ORDER BY i) AS v
       FROM input JOIN weights USING (space_id) WHERE no = 1 GROUP BY id),
n2 AS (SELECT id, list(greatest(0, list_inner_product(w, v) + bias) ORDER BY i) AS v
       FROM n1 JOIN input USING (id) JOIN weights USING (space_id) WHERE no = 2 GROUP BY id),
f1 AS (SELECT id, list(greatest(0, list_inner_product(w, list_concat(text_vector, v)) + bias) ORDER BY i) AS v
       FROM n2 JOIN input USING (id) JOIN weights USING (space_id) WHERE no = 3 GROUP BY id),
f2 AS (SELECT id, list(greatest(0, list_inner_product(w, v) + bias) ORDER BY i) AS v
       FROM f1 JOIN input USING (id) JOIN weights USING (space_id) WHERE no = 4 GROUP BY id),
logits AS (SELECT id, list(list_inner_product(w, v) / sqrt(list_inner_product(v, v)) + bias ORDER BY i) AS v
       FROM f2 JOIN input USING (id) JOIN weights USING (space_id) WHERE no = 5 GROUP BY id),
answers AS (SELECT id, 10 - list_position(list_reverse(v), list_max(v)) AS label FROM logits)"""
_ONE_HEAD = "\nchosen AS (SELECT id AS space_id, 1 AS version, 0 AS space_no FROM spaces)," + _PATTERN
_CHOSEN = _CLASSES + """,
chosen AS (
  SELECT v.space_id, v.version, CAST(substr(v.space_id, 2) AS BIGINT) AS space_no FROM model_versions v
  WHERE v.version = CASE v.space_id WHEN 's1' THEN 2 WHEN 's2' THEN 99
    ELSE coalesce((SELECT max(TRY_CAST(s.value AS BIGINT)) FROM space_settings s
                   WHERE s.space_id = v.space_id AND s.key = 'active_model_version'), 0) END),""" + _PATTERN + """,
predictions AS (
  SELECT r.space_id, r.id, r.category, c.version, CAST(a.label AS BIGINT) AS label, coalesce(n.name, 'Other') AS predicted
  FROM rows_in r LEFT JOIN chosen c ON c.space_id = r.space_id LEFT JOIN answers a ON a.id = r.id
  LEFT JOIN (SELECT position, min(name) AS name FROM classes GROUP BY 1) n ON n.position = a.label)"""


def _with_vectors(led: GivenLedger) -> DataFrame:
    """All transactions with features and, for want of an encoder, one of the given vectors each."""
    vectors = led.read("embeddings")
    total = vectors.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = features.build_features(led.transactions(text=False, balance=False)).join(F.broadcast(total))
    return rows.withColumn("vec_id", F.col("reference").cast("bigint") % F.col("n")).join(
        vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id", "n")


@register("score_head", ledger_sql("SELECT id, CAST(label AS INT) AS predicted_class FROM answers", _ONE_HEAD))
def _(led: GivenLedger) -> DataFrame:
    """Forward pass of a head with weights from a rule over the given vectors."""
    scored = model.score_head(_with_vectors(led), model.patterned_weights(EMBEDDING_SIZE, 10))
    return scored.select("id", "predicted_class")


def _patterned_models(led: GivenLedger) -> DataFrame:
    """Every registered version with weights from a rule on its space and number."""
    def fill(batches):
        import pyarrow as pa

        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):  # a row becomes 230 KB
            spaces, versions = batch.column("space_id").to_pylist(), batch.column("version").to_pylist()
            weights = [model.flat_weights(model.patterned_weights(EMBEDDING_SIZE, 10, v, int(s[1:]))).tobytes() for s, v in zip(spaces, versions)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("space_id"), batch.column("version"), pa.array([EMBEDDING_SIZE] * len(spaces), pa.int32()),
                 pa.array([list(range(10))] * len(spaces), pa.list_(pa.int64())), pa.array(weights, pa.binary())],
                names=["space_id", "version", "text_size", "classes", "weights"])

    tasks = int(led.spark.conf.get("spark.sql.shuffle.partitions"))  # a small file of short rows makes much work
    return led.model_versions.select("space_id", "version").repartition(tasks, "space_id", "version").mapInArrow(
        fill, "space_id string, version long, text_size int, classes array<long>, weights binary")


def _predictions(led: GivenLedger) -> DataFrame:
    """All transactions by their space's version: the one asked for, else the active one."""
    rows = features.scope_to_space(_with_vectors(led), led.accounts)
    asked = led.spaces.where("id IN ('s1', 's2')").select(F.col("id").alias("space_id"), F.when(F.col("id") == "s1", 2).otherwise(99).cast("long").alias("version"))
    chosen = registry.chosen_versions(led.model_versions, led.space_settings, asked)
    found = training.predict_versions(rows, _patterned_models(led), chosen, _classes(led))
    return found.join(rows.select("id", F.col("category").alias("actual")), "id")


@register("predict_version", ledger_sql("SELECT space_id, id, version, label, predicted FROM predictions", _CHOSEN))
def _(led: GivenLedger) -> DataFrame:
    """Predictions of every space by a chosen version; one that isn't registered gives the fallback."""
    return _predictions(led).drop("actual")


@register("sample_version", ledger_sql("""
    SELECT space_id, id, category AS actual, version, predicted FROM predictions WHERE category IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY md5(id || '#5'), id) <= 50""", _CHOSEN))
def _(led: GivenLedger) -> DataFrame:
    """A sample of labelled rows of each space with what a chosen version predicts."""
    return model.sample_predictions(_predictions(led).where("actual IS NOT NULL"), 50, 5)[0].select(
        "space_id", "id", "actual", "version", "predicted")


@register("preview_with_model", ledger_sql("SELECT id, amount, predicted AS category FROM base_transactions JOIN predictions USING (id)", _CHOSEN))
def _(led: GivenLedger) -> DataFrame:
    """What an import would add, with the categories that the chosen model predicts."""
    parsed = led.transactions(text=False, balance=False).select("id", "amount")
    found = _predictions(led).select("id", F.col("predicted").alias("category"))
    return ingest.preview_parse(parsed, found)


_LOGITS = """
scored AS (
  SELECT id, 's' || (o_orderkey % 5) AS space_id, o_orderkey % 4 <> 0 AS train, CAST(o_orderkey % 3 AS INT) AS label,
         (o_orderkey % 11) / 4.0::DOUBLE AS x0, (o_orderkey % 13) / 5.0::DOUBLE AS x1, (o_orderkey % 7) / 2.0::DOUBLE AS x2
  FROM base_transactions),
judged AS (
  SELECT *, ln(exp(x0) + exp(x1) + exp(x2)) - CASE label WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS loss,
         CASE WHEN x2 >= x1 AND x2 >= x0 THEN 2 WHEN x1 >= x0 THEN 1 ELSE 0 END AS predicted FROM scored)"""


def _scored(led: GivenLedger) -> DataFrame:
    key = F.col("reference").cast("bigint")
    return led.transactions(text=False, balance=False).select(
        "id", F.concat(F.lit("s"), _t(key % 5)).alias("space_id"), (key % 4 != 0).alias("train"),
        (key % 3).cast("int").alias("label"),
        F.array((key % 11) / F.lit(4.0), (key % 13) / F.lit(5.0), (key % 7) / F.lit(2.0)).alias("logits"))


@register("evaluate", ledger_sql("""
    SELECT space_id, train, CAST(round(avg(loss) * 1000000) AS BIGINT) AS loss_millionths,
           CAST(sum(hits) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy, CAST(sum(n) AS BIGINT) AS rows
    FROM (SELECT space_id, train, (r - 1) // 32 AS batch, avg(loss) AS loss, count(*) FILTER (predicted = label) AS hits,
                 count(*) AS n
          FROM (SELECT *, row_number() OVER (PARTITION BY space_id, train ORDER BY md5(id), id) AS r FROM judged)
          GROUP BY 1, 2, 3)
    GROUP BY 1, 2""", _LOGITS))
def _(led: GivenLedger) -> DataFrame:
    return model.evaluate(_scored(led)).select(
        "space_id", "train", F.round(F.col("loss") * 1000000).cast("bigint").alias("loss_millionths"),
        "accuracy", "rows")


@register("hit_rate", ledger_sql("""
    SELECT space_id, count(*) FILTER (predicted = label) AS correct, count(*) AS total,
           avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM judged GROUP BY 1""", _LOGITS))
def _(led: GivenLedger) -> DataFrame:
    from ..functions.scalars import argmax_last

    return hit_rate(_scored(led).select(
        "space_id", F.col("label").alias("actual"), argmax_last(F.col("logits")).alias("predicted")), ["space_id"])


@register("sample_predictions", ledger_sql("""
    SELECT space_id, count(*) FILTER (predicted = label) AS correct, count(*) AS total,
           avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END) AS rate
    FROM (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY md5(id || '#5'), id) <= 50)
    GROUP BY 1""", _LOGITS))
def _(led: GivenLedger) -> DataFrame:
    from ..functions.scalars import argmax_last

    predictions = _scored(led).select(
        "space_id", "id", F.col("label").alias("actual"), argmax_last(F.col("logits")).alias("predicted"))
    return model.sample_predictions(predictions, 50, 5)[1]


# ---- registry -----------------------------------------------------------------------
@register("register_version", ledger_sql("""
    SELECT * FROM model_versions
    UNION ALL SELECT 'n' || c_custkey, 1, md5('weights' || c_custkey), md5('card' || c_custkey), '2025-01-01T00:00:00Z'
      FROM customer
    UNION ALL SELECT space_id, max(version) + 1, md5('weights-' || space_id), md5('card-' || space_id),
      '2025-01-01T00:00:00Z' FROM model_versions GROUP BY 1"""))
def _(led: GivenLedger) -> DataFrame:
    at = F.lit("2025-01-01T00:00:00Z").alias("trained_at")
    key = _t(F.col("c_custkey"))
    fresh = led.read("customer").select(
        F.concat(F.lit("n"), key).alias("space_id"), F.concat(F.lit("weights"), key).alias("weights"),
        F.concat(F.lit("card"), key).alias("card"), at)
    known = led.model_versions.select("space_id").distinct().select(
        "space_id", F.concat(F.lit("weights-"), "space_id").alias("weights"),
        F.concat(F.lit("card-"), "space_id").alias("card"), at)
    return registry.register_versions(led.model_versions, fresh.unionByName(known))


def _cards(led: GivenLedger) -> DataFrame:
    return led.model_versions.where("version % 2 = 1").select(
        "space_id", "version", (F.col("version") * 10).alias("samples"),
        F.transform(F.sequence(F.lit(1), F.col("version") % 4 + 1), lambda e: F.struct(
            (e * 0.5).cast("double").alias("train_loss"))).alias("history"))


@register("list_models", ledger_sql("""
    SELECT space_id, version, weights_md5, version * 10 AS samples,
           version = CASE WHEN space_id = 's4' THEN 0 ELSE 3 END AS is_active
    FROM model_versions WHERE version % 2 = 1"""))
def _(led: GivenLedger) -> DataFrame:
    return registry.list_models(led.model_versions, _cards(led), led.space_settings).select(
        "space_id", "version", "weights_md5", "samples", "is_active")


@register("active_model", ledger_sql("""
    SELECT DISTINCT v.space_id, coalesce(TRY_CAST(s.value AS BIGINT), 0) AS active FROM model_versions v
    LEFT JOIN space_settings s ON s.space_id = v.space_id AND s.key = 'active_model_version'"""))
def _(led: GivenLedger) -> DataFrame:
    return registry.active_versions(led.model_versions, led.space_settings)


@register("delete_versions", ledger_sql("SELECT * FROM model_versions WHERE version % 3 <> 0"))
def _(led: GivenLedger) -> DataFrame:
    doomed = led.model_versions.where("version % 3 = 0").select("space_id", "version")
    return registry.delete_versions(led.model_versions, led.space_settings, doomed)[0]


@register("delete_versions_settings", ledger_sql("""
    SELECT * FROM space_settings WHERE NOT (key = 'active_model_version' AND space_id <> 's4'
      AND space_id IN (SELECT space_id FROM model_versions WHERE version = 3))"""))
def _(led: GivenLedger) -> DataFrame:
    doomed = led.model_versions.where("version % 3 = 0").select("space_id", "version")
    return registry.delete_versions(led.model_versions, led.space_settings, doomed)[1]


_FILES = """
files AS (
  SELECT doc_id, 's' || (doc_id % 5) AS space_id, doc_id // 5 + 1 AS version, text FROM documents)"""


def _files(led: GivenLedger) -> tuple[DataFrame, DataFrame]:
    """(registry, artefacts): each document is a weights file; some lack a card or changed."""
    key = F.col("doc_id")
    docs = led.read("documents").select(
        key, F.concat(F.lit("s"), _t(key % 5)).alias("space_id"), (F.floor(key / 5) + 1).alias("version"), "text")
    path = F.concat(F.lit("/models/"), "space_id", F.lit("/model_v"), _t(F.col("version")))
    weights = docs.select(F.concat(path, F.lit(".safetensors")).alias("path"), F.encode("text", "utf-8").alias("content"))
    cards = docs.where(key % 4 != 0).select(
        F.concat(path, F.lit(".json")).alias("path"), F.encode(F.lit("{}"), "utf-8").alias("content"))
    rows = docs.where(key % 7 != 0).select(
        "space_id", "version", F.md5(F.when(key % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("weights_md5"),
        F.lit("").alias("card_md5"), F.lit("").alias("trained_at"))
    return rows, registry.artifact_hashes(weights.unionByName(cards))


@register("verify_artifacts", """
    SELECT 's' || (doc_id % 5) AS space_id, doc_id // 5 + 1 AS version FROM documents
    WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0 AND doc_id % 6 <> 0""")
def _(led: GivenLedger) -> DataFrame:
    return registry.verify_artifacts(*_files(led))


@register("orphan_artifacts", """
    SELECT 's' || (doc_id % 5) AS space_id, doc_id // 5 + 1 AS version, kind FROM documents, (VALUES ('weights'), ('card')) k(kind)
    WHERE doc_id % 7 = 0 AND (kind = 'weights' OR doc_id % 4 <> 0)""")
def _(led: GivenLedger) -> DataFrame:
    return registry.orphan_artifacts(*_files(led)).drop("path")


@register("training_log", ledger_sql("""
    SELECT space_id, version, e AS epoch, e * 0.5::DOUBLE AS train_loss
    FROM model_versions, range(1, 6) r(e) WHERE version % 2 = 1 AND e <= version % 4 + 1"""))
def _(led: GivenLedger) -> DataFrame:
    return registry.training_log(_cards(led))
