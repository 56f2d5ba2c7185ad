"""Registry of trained model versions and their stored artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACTIVE_MODEL_SETTING
from .mutate import upsert

# ---- fixed values -------------------------------------------------------------------
ARTIFACT_PATH = r"([^/]+)/model_v([0-9]+)\.(safetensors|json)$"


def next_versions(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Next version number of each requested space."""
    top = registry.groupBy("space_id").agg(F.max("version").alias("_top"))
    return requests.join(top, "space_id", "left").withColumn(
        "version", F.coalesce("_top", F.lit(0).cast("bigint")) + 1).drop("_top")


def register_versions(registry: DataFrame, trained: DataFrame) -> DataFrame:
    """trained(space_id, weights, card, trained_at): hash the artefacts and add the rows."""
    rows = next_versions(trained, registry).select(
        "space_id", "version", F.md5("weights").alias("weights_md5"), F.md5("card").alias("card_md5"),
        "trained_at")
    return upsert(registry, rows.select(*registry.columns), ["space_id", "version"])


def active_versions(spaces: DataFrame, settings: DataFrame) -> DataFrame:
    """Active version per space; 0 when the setting is missing or not a number."""
    chosen = settings.where(F.col("key") == ACTIVE_MODEL_SETTING).select(
        "space_id", F.col("value").try_cast("bigint").alias("_v"))
    return spaces.select("space_id").distinct().join(chosen, "space_id", "left").select(
        "space_id", F.coalesce("_v", F.lit(0).cast("bigint")).alias("active"))


def chosen_versions(registry: DataFrame, settings: DataFrame, requests: DataFrame) -> DataFrame:
    """The version to predict with: the one that `requests` (space_id, version) names, else the active one."""
    asked = requests.select("space_id", F.col("version").alias("_asked"))
    return active_versions(registry, settings).join(asked, "space_id", "left").select(
        "space_id", F.coalesce("_asked", "active").alias("version"))


def list_models(registry: DataFrame, cards: DataFrame, settings: DataFrame) -> DataFrame:
    """Registered versions that have a card, with the active one marked."""
    active = active_versions(registry, settings)
    return registry.join(cards, ["space_id", "version"]).join(active, "space_id").withColumn(
        "is_active", F.col("version") == F.col("active")).drop("active")


def delete_versions(registry: DataFrame, settings: DataFrame, requests: DataFrame
                    ) -> tuple[DataFrame, DataFrame]:
    """Drop (space_id, version) rows, and the active setting of a space that pointed at one."""
    keys = ["space_id", "version"]
    active = active_versions(requests, settings).select("space_id", F.col("active").alias("version"))
    cleared = active.join(requests.select(*keys), keys, "left_semi").select(
        "space_id", F.lit(ACTIVE_MODEL_SETTING).alias("key"))
    return (registry.join(requests.select(*keys), keys, "left_anti").select(*registry.columns),
            settings.join(cleared, ["space_id", "key"], "left_anti").select(*settings.columns))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return artifact_hashes(files)


def artifact_hashes(files: DataFrame) -> DataFrame:
    """(path, content) files to (space_id, version, kind, md5); other files are ignored."""
    def part(i: int) -> Column:
        return F.regexp_extract("path", ARTIFACT_PATH, i)

    return files.where(F.col("path").rlike(ARTIFACT_PATH)).select(
        "path", part(1).alias("space_id"), part(2).cast("bigint").alias("version"),
        F.when(part(3) == "json", "card").otherwise("weights").alias("kind"),
        F.md5("content").alias("md5"))


def verify_artifacts(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Versions whose weights file matches the registry and whose card file exists.

    The card's own hash is not checked: a card may be rebuilt.
    """
    keys = ["space_id", "version"]
    held = artifacts.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "weights", F.col("md5"))).alias("_weights"),
        F.bool_or(F.col("kind") == "card").alias("_card"))
    return registry.join(held, keys).where("_card and _weights = weights_md5").select(*keys)


def orphan_artifacts(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files of versions the registry does not know."""
    keys = ["space_id", "version"]
    return artifacts.join(registry.select(*keys), keys, "left_anti").select("path", *keys, "kind")


def training_log(cards: DataFrame) -> DataFrame:
    """One row per epoch of each card's `history` array."""
    return cards.select("space_id", "version", F.posexplode("history").alias("_pos", "h")).select(
        "space_id", "version", (F.col("_pos") + 1).cast("bigint").alias("epoch"), "h.*")
