"""Change capture by comparing two versions of the synced tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import hash_prefix, numbered
from ..functions.scalars import composite_key
from ..schemas import KEYS, LOGGED, payload_schema
from ..session import settle
from .mutate import Tables, delete_spaces

_JSON = {"ignoreNullFields": "false"}


def snapshot_json(table: str, source: str = "") -> Column:
    """Logged JSON snapshot of a row whose columns are found under `source`."""
    prefix = f"{source}." if source else ""
    fields = []
    for f in payload_schema(table).fields:
        column = F.col(f"{prefix}{f.name}")
        fields.append((column if f.name == "user" else column.cast(f.dataType)).alias(f.name))
    return F.to_json(F.struct(*fields), _JSON)


def with_users(members: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships with the whole user row embedded, as they travel in the log."""
    people = users.select(F.col("id").alias("user_id"), F.struct(
        "id", "name", "pin_hash", "created_at", "updated_at").alias("user"))
    return members.join(people, "user_id", "left")


def _row_key(table: str, source: str) -> Column:
    parts = [F.col(f"{source}.{k}") for k in KEYS[table]]
    return parts[0] if len(parts) == 1 else composite_key(*parts)


def table_changes(table: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """(row_id, operation, old, new) for each row that differs between two versions.

    Rows are compared field by field, NULL equal to NULL. Only net changes are visible: a
    row rewritten to the same values, or changed back in between, leaves no entry.
    """
    keys = KEYS[table]
    compared = [c for c in after.columns if c not in keys and c != "user"]
    old = before.select(F.struct(*before.columns).alias("old"))
    new = after.select(F.struct(*after.columns).alias("new"))
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    pairs = old.join(new, same_key, "full_outer")
    changed = F.lit(False)
    for c in compared:
        changed = changed | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    operation = (
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete")
        .when(changed, "update")
    )
    tagged = pairs.withColumn("operation", operation).where("operation is not null")
    if table == "spaces":
        # Updates of a soft-deleted space are not announced.
        tagged = tagged.where("not (operation = 'update' and new.deleted)")
    return tagged


def capture_changes(before: Tables, after: Tables, author: str, base_seq: int,
                    changed_at: str) -> DataFrame:
    """Change-log rows that turn version `before` into `after`, numbered per space.

    Upserts are numbered parents first, deletes children first. Within a table the order is
    that of the hashed row id, which lets the numbering run in even buckets, however large
    the tenant is. The differing rows are written out once before they are numbered, so
    the comparison of the two versions does not run twice.
    """
    known_accounts = before["accounts"].select("id", "space_id", F.lit(0).alias("age")).unionByName(
        after["accounts"].select("id", "space_id", F.lit(1).alias("age")))
    homes = known_accounts.groupBy(F.col("id").alias("_account")).agg(
        F.max_by("space_id", "age").alias("_space"))
    logged = []
    for rank, table in enumerate(LOGGED):
        if table not in after or after[table] is before[table]:
            continue  # the very same frame on both sides has no changes
        old, new = before[table], after[table]
        if table == "space_members":
            new = with_users(new, after["users"])
        changes = table_changes(table, old, new)
        deleted = F.col("operation") == "delete"

        def pick(column: str) -> Column:
            return F.coalesce(F.col(f"new.{column}"), F.col(f"old.{column}"))

        if table in ("transactions", "account_summaries"):
            changes = changes.withColumn("_account", pick("account_id")).join(homes, "_account", "left")
            space = F.col("_space")
        else:
            space = pick("id" if table == "spaces" else "space_id")
        row_id = F.when(deleted, _row_key(table, "old")).otherwise(_row_key(table, "new"))
        logged.append(changes.select(
            space.alias("space_id"), F.lit(table).alias("table_name"), row_id.alias("row_id"),
            "operation", F.when(~deleted, snapshot_json(table, "new")).alias("payload"),
            F.when(deleted, F.lit(2 * len(LOGGED) - rank)).otherwise(F.lit(rank)).alias("_phase"),
        ))
    changes = settle(reduce(DataFrame.unionByName, logged), "captured")
    return _finish(changes, author, base_seq, changed_at)


def _finish(changes: DataFrame, author: str, base_seq: int, changed_at: str) -> DataFrame:
    digest = F.md5("row_id")
    ranked = numbered(
        changes, ["space_id"], [F.col("_phase"), hash_prefix(F.col("row_id"))],
        [digest, F.col("row_id")], out="_no",
    )
    seq = (F.lit(base_seq).cast("bigint") + F.col("_no")).alias("seq")
    return _log_row(ranked, seq, author, changed_at)


def _log_row(rows: DataFrame, seq: Column, author: str, changed_at: str) -> DataFrame:
    """Stable row ids: the same capture run again gives the same log rows."""
    identity = F.md5(F.concat_ws("|", F.lit(author), "space_id", "table_name", "row_id", seq.cast("string")))
    return rows.select(
        identity.alias("id"), "space_id", "table_name", "row_id", "operation", "payload", seq.alias("seq"),
        F.lit(author).alias("device_id"), F.lit(changed_at).alias("changed_at"))


def fan_out_user_changes(before: DataFrame, after: DataFrame, members: DataFrame, author: str,
                         base_seq: int, changed_at: str) -> DataFrame:
    """One membership update per space of every changed user, the user embedded.

    All entries of one user share a sequence number.
    """
    changed = table_changes("users", before, after).where("operation = 'update'").select("new.*")
    joined = changed.join(members.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    ranked = numbered(joined, [], [hash_prefix(F.col("id"))], [F.md5("id"), F.col("id")], out="_no")
    people = ranked.select(
        F.col("id").alias("user_id"), "_no",
        F.struct("id", "name", "pin_hash", "created_at", "updated_at").alias("user"))
    rows = members.join(people, "user_id").select(
        "space_id", F.lit("space_members").alias("table_name"),
        composite_key(F.col("space_id"), F.col("user_id")).alias("row_id"),
        F.lit("update").alias("operation"), snapshot_json("space_members").alias("payload"), "_no")
    return _log_row(rows, F.lit(base_seq).cast("bigint") + F.col("_no"), author, changed_at)


def space_deletion_rows(deleted: DataFrame, tail: DataFrame, author: str, changed_at: str,
                        base_seq: int = 0) -> DataFrame:
    """The final `spaces` delete entry of each deleted space.

    tail(space_id, seq): the highest number its child deletions got; `base_seq` where none is.
    """
    last = tail.groupBy("space_id").agg(F.max("seq").alias("_last"))
    rows = deleted.join(last, "space_id", "left").select(
        "space_id", F.lit("spaces").alias("table_name"), F.col("space_id").alias("row_id"),
        F.lit("delete").alias("operation"), F.lit(None).cast("string").alias("payload"), "_last")
    return _log_row(rows, F.coalesce("_last", F.lit(base_seq)).cast("bigint") + 1, author, changed_at)


def delete_spaces_logged(tables: Tables, requests: DataFrame, author: str, base_seq: int,
                         changed_at: str) -> tuple[Tables, DataFrame]:
    """Soft-delete spaces as one operation: tables without the children, and the log with all deletions.

    The space's own entry has the highest number of its space.
    """
    after, gone = delete_spaces(tables, requests)
    children = settle(capture_changes(tables, after, author, base_seq, changed_at), "deletions")
    last = space_deletion_rows(gone, children, author, changed_at, base_seq)
    log = tables["change_log"]
    after["change_log"] = log.unionByName(children.select(*log.columns)).unionByName(last.select(*log.columns))
    return after, gone
