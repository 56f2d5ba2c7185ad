"""Substring search over transaction text and amount, with and without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower, money_text


def amount_document(amount: Column) -> Column:
    """What the search sees of an amount: minor units, major units, absolute major units."""
    return F.concat_ws(" ", amount.cast("string"), money_text(amount), money_text(F.abs(amount)))


def search_short(transactions: DataFrame, term: str) -> DataFrame:
    """Terms below three characters: a LIKE in which `%` and `_` stay wildcards.

    Only ASCII letters are folded. The escape character is one that the term lacks, so a
    backslash in the term is an ordinary character.
    """
    term = term.strip()
    escape = next(chr(c) for c in range(1, 9) if chr(c) not in term)
    pattern = ascii_lower(F.lit(f"%{term}%"))
    tests = [
        F.like(ascii_lower(c), pattern, F.lit(escape))
        for c in (F.col("text"), F.col("amount").cast("string"), money_text(F.col("amount")))
    ]
    return transactions.where(tests[0] | tests[1] | tests[2])


def contains_term(term: str) -> Column:
    needle = F.lower(F.lit(term.strip()))
    return F.contains(F.lower("text"), needle) | F.contains(
        F.lower(amount_document(F.col("amount"))), needle
    )


def search_trigram(transactions: DataFrame, term: str) -> DataFrame:
    """Terms of three characters and more: a literal, case-insensitive substring."""
    return transactions.where(contains_term(term))


def search(transactions: DataFrame, term: str | None) -> DataFrame:
    if term is None or not term.strip():
        return transactions
    return (search_short if len(term.strip()) < 3 else search_trigram)(transactions, term)


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams of a text; empty for texts below three characters.

    One regular-expression pass with a look-ahead at every position, linear in the text.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def build_trigram_index(transactions: DataFrame) -> DataFrame:
    """Posting list (trigram, field, id). Trigrams are distinct per row before the explode,
    so no shuffle is needed to build it."""
    fields = F.array(
        F.struct(F.lit("text").alias("field"), trigrams(F.col("text")).alias("grams")),
        F.struct(F.lit("amount").alias("field"),
                 trigrams(amount_document(F.col("amount"))).alias("grams")),
    )
    return (
        transactions.select("id", F.explode(fields).alias("f"))
        .select("id", "f.field", F.explode("f.grams").alias("trigram"))
    )


def write_trigram_index(index: DataFrame, path: str) -> None:
    """Store the postings sorted by trigram, so that a lookup skips row groups by min/max.

    Range partitioning includes the id, which spreads a frequent trigram over many files.
    """
    (index.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id")
     .write.parquet(path))


def maintain_trigram_index(index: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Index after a batch of edits: drop the postings of `removed` ids, add those of `added`.

    An update is both: its id in `removed`, its new row in `added`.
    """
    return index.join(removed.select("id"), "id", "left_anti").unionByName(build_trigram_index(added))


def search_indexed(index: DataFrame, transactions: DataFrame, term: str) -> DataFrame:
    """Rows containing the term: candidates hold every trigram of the term in one field,
    and the literal test then removes those where the trigrams are not adjacent."""
    low = term.strip().lower()
    if len(low) < 3:
        return search(transactions, term)
    wanted = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    candidates = (
        index.where(F.col("trigram").isin(wanted))
        .groupBy("id", "field").agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") == len(wanted)).select("id").distinct()
    )
    return transactions.join(candidates, "id", "left_semi").where(contains_term(term))
