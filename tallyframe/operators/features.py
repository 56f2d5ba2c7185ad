"""Training rows, features and the train / validation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import hash_prefix, in_ranges, numbered
from ..functions.scalars import (
    amount_base, amount_bin, clean_text, date_or_default, one_hot, signed_log,
)
from ..schemas import AMOUNT_BIN_EDGES
from .filters import approved_labelled, scope_to_space
from .joins import with_label

# ---- fixed values -------------------------------------------------------------------
# Layout of the 64 features: amount bins, signed log amount, weekday from Monday, day of
# month, month. There is one bin more than the edges can produce; it is always 0.
BIN_COUNT = len(AMOUNT_BIN_EDGES) + 2
FEATURE_SIZE = BIN_COUNT + 1 + 7 + 31 + 12
TRAIN_SHARE = 0.8


def feature_vector(amount: Column, date: Column) -> Column:
    """The 64 floats of a transaction, as one array expression."""
    base, day = amount_base(amount), date_or_default(date)
    return F.concat(
        one_hot(amount_bin(base), BIN_COUNT),
        F.array(signed_log(base)),
        one_hot(F.weekday(day), 7),
        one_hot(F.dayofmonth(day), 31, start=1),
        one_hot(F.month(day), 12, start=1),
    )


def build_features(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("features", feature_vector(F.col("amount"), F.col("booking_date")))


def class_list(categories: DataFrame) -> DataFrame:
    """Class positions: category names of all spaces by name, repeats kept.

    Numbered in ranges of the sorted categories: as many as there are tasks, however many
    categories or spaces there are.
    """
    order = [F.col("name"), F.col("id")]
    ranked = numbered(in_ranges(categories.select("id", "name"), [], order), [], [F.col("__range")], order, out="_no")
    return ranked.select((F.col("_no") - 1).alias("position"), "name")


def training_set(transactions: DataFrame, accounts: DataFrame, classes: DataFrame) -> DataFrame:
    """Approved, categorised rows with cleaned text, features and class label, per space."""
    rows = scope_to_space(approved_labelled(transactions), accounts)
    return with_label(build_features(rows), classes).select(
        "space_id", "id", clean_text(F.col("text")).alias("text"), "features", "label")


def train_rows(count: Column) -> Column:
    """Size of the training part: 80 %, in single precision, at least one row on each side."""
    share = (count.cast("float") * F.lit(TRAIN_SHARE).cast("float")).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.least(count - 1, share))


def split_rows(rows: DataFrame) -> DataFrame:
    """Mark each row of a space as `train` or not, by rank of its hashed id.

    The rank is exact and repeatable; hash prefixes bucket it evenly over tasks.
    """
    sizes = rows.groupBy("space_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(rows, ["space_id"], [hash_prefix(F.col("id"))], [F.md5("id"), F.col("id")], out="_no")
    return ranked.join(sizes, "space_id").withColumn(
        "train", F.col("_no") <= train_rows(F.col("_n"))).drop("_no", "_n")
