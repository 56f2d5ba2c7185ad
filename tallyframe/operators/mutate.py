"""Table edits as pure functions: the current table and a batch in, the new table out.

Every batch is keyed, so each edit is an equi-join on the key. `sources.versions` makes
the result durable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACCOUNT_CHILDREN, DEFAULT_CATEGORIES, FALLBACK_COLOR, SPACE_CHILDREN
from .aggregates import sole_owner_spaces
from .filters import check_filled, check_ownership, check_role, scope_to_space, split_by

Tables = dict[str, DataFrame]


# ---- generic forms ------------------------------------------------------------------
def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None) -> DataFrame:
    """One row per key: the last by `order`, reduced on the map side before the shuffle."""
    if order is None:
        return batch
    names = batch.columns
    return batch.groupBy(*keys).agg(
        F.max_by(F.struct(*names), F.struct(*order)).alias("_row")
    ).select("_row.*")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str],
           order: Sequence[Column] | None = None) -> DataFrame:
    """Insert or replace whole rows by key. Without `order` the batch keys must be unique."""
    batch = last_per_key(batch, keys, order).select(*target.columns)
    return target.join(batch.select(*keys), list(keys), "left_anti").select(
        *target.columns).unionByName(batch)


def upsert_columns(target: DataFrame, batch: DataFrame, keys: Sequence[str], replace: Sequence[str]
                   ) -> DataFrame:
    """Upsert where a matched row takes only the `replace` columns from the batch."""
    incoming = batch.select(F.struct(*target.columns).alias("_new"))
    current = target.select(F.struct(*target.columns).alias("_old"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_old.{k}") == F.col(f"_new.{k}"))
    joined = current.join(incoming, same, "full_outer")
    had, got = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return joined.select(*[
        F.when(got & (~had | F.lit(c in replace)), F.col(f"_new.{c}"))
        .otherwise(F.col(f"_old.{c}")).alias(c)
        for c in target.columns
    ])


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = batch.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_keep_identity(devices: DataFrame, batch: DataFrame) -> DataFrame:
    """Conflict on (space, device): contents are replaced, the local id stays."""
    return upsert_columns(
        devices, batch, ["space_id", "device_id"],
        ["display_name", "cert_pem", "sync_enabled", "paired_at"],
    )


def upsert_monotone(cursors: DataFrame, batch: DataFrame) -> DataFrame:
    """Cursors never move backward."""
    return cursors.unionByName(batch.select(*cursors.columns)).groupBy(
        "space_id", "peer_device_id").agg(F.max("last_seq").alias("last_seq"))


def apply_edits(target: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the columns an edit names (keys unique in `edits`, NULL is a value)."""
    columns = [c for c in edits.columns if c not in keys]
    flagged = edits.select(*keys, F.struct(*columns).alias("_edit"))
    joined = target.join(flagged, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_edit").isNotNull(), F.col(f"_edit.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in target.columns
    ])


def unmatched_edits(target: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits that name no existing row: the caller's error list."""
    return edits.join(target.select(*keys), list(keys), "left_anti")


# ---- transactions -------------------------------------------------------------------
def _owned(transactions: DataFrame, accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested (space, id) pairs that exist, looked up by id before the account join."""
    named = transactions.select("id", "account_id").join(ids.select("id"), "id", "left_semi")
    return scope_to_space(named, accounts).join(ids, ["space_id", "id"], "left_semi").select(
        "space_id", "id")


def bulk_approve(transactions: DataFrame, accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Set `approved` for (space_id, id, approved) requests; ids of other spaces are ignored."""
    owned = _owned(transactions, accounts, requests.select("space_id", "id"))
    edits = requests.join(owned, ["space_id", "id"], "left_semi").select("id", "approved")
    return apply_edits(transactions, edits, ["id"])


def bulk_categorize(transactions: DataFrame, accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Set, or clear with NULL, the category for (space_id, id, category) requests."""
    owned = _owned(transactions, accounts, requests.select("space_id", "id"))
    edits = requests.join(owned, ["space_id", "id"], "left_semi").select("id", "category")
    return apply_edits(transactions, edits, ["id"])


def changed_counts(transactions: DataFrame, accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows touched per space by a bulk request."""
    return _owned(transactions, accounts, requests.select("space_id", "id")).groupBy(
        "space_id").agg(F.count(F.lit(1)).alias("changed"))


def update_transactions(transactions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of (id, approved, note, category); unknown ids come back as the second frame."""
    return apply_edits(transactions, edits, ["id"]), unmatched_edits(transactions, edits, ["id"])


def _recategorized(transactions: DataFrame, accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """Rewrite category names: moves(space_id, category, _to), matched by name per space."""
    homes = accounts.select(F.col("id").alias("account_id"), "space_id")
    rows = transactions.join(homes, "account_id", "left")
    marked = moves.withColumn("_moved", F.lit(True))
    joined = rows.join(marked, ["space_id", "category"], "left")
    return joined.withColumn(
        "category", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("category"))
    ).select(*transactions.columns)


def rename_categories(tables: Tables, renames: DataFrame) -> Tables:
    """renames(id, name, color): the category row and, by old name, its transactions."""
    categories = tables["categories"]
    moves = categories.select("id", "space_id", F.col("name").alias("category")).join(
        renames.select("id", F.col("name").alias("_to")), "id"
    ).drop("id")
    return {
        **tables,
        "categories": apply_edits(categories, renames, ["id"]),
        "transactions": _recategorized(tables["transactions"], tables["accounts"], moves),
    }


def delete_categories(tables: Tables, ids: DataFrame) -> Tables:
    categories = tables["categories"]
    moves = categories.join(ids.select("id"), "id", "left_semi").select(
        "space_id", F.col("name").alias("category"), F.lit(None).cast("string").alias("_to"))
    return {
        **tables,
        "categories": categories.join(ids.select("id"), "id", "left_anti").select(*categories.columns),
        "transactions": _recategorized(tables["transactions"], tables["accounts"], moves),
    }


def create_categories(categories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert trimmed, non-blank categories; returns the table and the refused requests.

    The name is unique per space; of several requests for one name the lowest id is taken.
    """
    filled, blank = check_filled(requests, "name", "color")
    one = filled.groupBy("space_id", "name").agg(
        F.min(F.struct("id", "color")).alias("_r")
    ).select("_r.id", "name", "_r.color", "space_id")
    fresh = one.join(categories.select("space_id", "name"), ["space_id", "name"], "left_anti")
    fresh = fresh.select(*categories.columns)
    taken = filled.join(fresh.select("id"), "id", "left_anti").select(*requests.columns)
    return categories.unionByName(fresh), blank.unionByName(taken)


def seed_default_categories(new_spaces: DataFrame) -> DataFrame:
    """The fixed category set for each new space."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("suffix"), F.lit(n).alias("name"), F.lit(c).alias("color"))
        for s, n, c in DEFAULT_CATEGORIES
    ])
    return new_spaces.select(F.col("id").alias("space_id"), F.explode(rows).alias("d")).select(
        F.concat_ws("_", "space_id", "d.suffix").alias("id"), "d.name", "d.color", "space_id")


# ---- accounts and summaries ---------------------------------------------------------
def update_accounts(accounts: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(id, space_id, name, color); an account of another space is not touched."""
    return apply_edits(accounts, edits, ["id", "space_id"])


def delete_accounts(tables: Tables, requests: DataFrame) -> Tables:
    """Delete requested (id, space_id) accounts with their transactions and summaries."""
    accounts = tables["accounts"]
    doomed = accounts.join(requests.select("id", "space_id"), ["id", "space_id"], "left_semi").select(
        F.col("id").alias("account_id"))

    def without(table: str) -> DataFrame:
        return tables[table].join(doomed, "account_id", "left_anti").select(*tables[table].columns)

    return {
        **tables,
        "accounts": accounts.join(
            doomed.withColumnRenamed("account_id", "id"), "id", "left_anti").select(*accounts.columns),
        "transactions": without("transactions"),
        "account_summaries": without("account_summaries"),
    }


def delete_summaries(summaries: DataFrame, accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove requested (space_id, account_id, month) rows whose account is in the space."""
    accepted, _ = check_ownership(requests, accounts)
    keys = ["account_id", "month"]
    return summaries.join(accepted.select(*keys), keys, "left_anti").select(*summaries.columns)


# ---- spaces, members, users ---------------------------------------------------------
def create_spaces(requests: DataFrame, at: str) -> Tables:
    """requests(id, name, user_id) with non-blank names: space, owner membership, categories."""
    named, _ = check_filled(requests, "name")
    stamp = F.lit(at)
    return {
        "spaces": named.select("id", "name", stamp.alias("created_at"), stamp.alias("updated_at"),
                               F.lit(False).alias("deleted")),
        "space_members": named.select(F.col("id").alias("space_id"), "user_id",
                                      F.lit("owner").alias("role"), stamp.alias("joined_at")),
        "categories": seed_default_categories(named),
    }


def rename_spaces(spaces: DataFrame, members: DataFrame, requests: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """requests(space_id, user_id, name): owners only, non-blank. Returns table and refusals.

    Of several accepted requests for one space the greatest user id decides.
    """
    named, blank = check_filled(requests, "name")
    allowed, refused = check_role(named, members, owner_only=True)
    edits = allowed.groupBy(F.col("space_id").alias("id")).agg(F.max_by("name", "user_id").alias("name"))
    return apply_edits(spaces, edits, ["id"]), blank.unionByName(refused.select(*blank.columns))


def rename_users(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(id, name): blank names and unknown users are refused."""
    named, blank = check_filled(requests, "name")
    known, unknown = split_by(named, users, ["id"])
    return apply_edits(users, known.select("id", "name"), ["id"]), blank.unionByName(
        unknown.select(*blank.columns))


def remove_users(tables: Tables, requests: DataFrame) -> tuple[Tables, DataFrame]:
    """Remove users with their memberships; refused for space owners and for the last user.

    When the requests would leave nobody, the greatest user id stays.
    """
    users, members = tables["users"], tables["space_members"]
    owners = sole_owner_spaces(members).select(F.col("user_id").alias("id")).distinct()
    wanted = users.select("id").join(requests.select("id"), "id", "left_semi").join(
        owners, "id", "left_anti")
    # Two one-row totals: how many users there are and how many would go.
    total = users.agg(F.count(F.lit(1)).alias("_users"))
    going = wanted.agg(F.count(F.lit(1)).alias("_going"), F.max("id").alias("_last"))
    free = wanted.join(F.broadcast(total)).join(F.broadcast(going)).where(
        "_going < _users or id <> _last").select("id")
    refused = requests.select("id").join(free, "id", "left_anti")
    kept_members = members.join(
        free.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*members.columns)
    return {
        **tables,
        "users": users.join(free, "id", "left_anti").select(*users.columns),
        "space_members": kept_members,
    }, refused


def edit_members(members: DataFrame, users: DataFrame, edits: DataFrame, at: str) -> DataFrame:
    """edits(space_id, by_user, user_id, action, role): add, remove or change role, by owners.

    Adding an existing member changes nothing; roles other than owner / member are refused;
    an added user must exist.
    """
    keys = ["space_id", "user_id"]
    by_owner = members.where("role = 'owner'").select("space_id", F.col("user_id").alias("by_user"))
    allowed = edits.join(by_owner, ["space_id", "by_user"], "left_semi")
    added = allowed.where("action = 'add'").select(*keys).distinct().join(
        users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    ).select(*keys, F.lit("member").alias("role"), F.lit(at).alias("joined_at"))
    removed = allowed.where("action = 'remove'").select(*keys)
    roles = allowed.where("action = 'role' and role in ('owner', 'member')").groupBy(*keys).agg(
        F.max("role").alias("role"))
    remaining = members.join(removed, keys, "left_anti").select(*members.columns)
    return insert_if_absent(apply_edits(remaining, roles, keys), added, keys)


def leave_space(members: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(space_id, user_id). The last member of a space may not leave.

    When all members ask at once, the one with the greatest id stays.
    """
    keys = ["space_id", "user_id"]
    leaving = requests.select(*keys).distinct().join(members.select(*keys), keys, "left_semi")
    sizes = members.groupBy("space_id").agg(F.count(F.lit(1)).alias("_members"))
    leavers = leaving.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("_leaving"), F.max("user_id").alias("user_id"))
    last = leavers.join(sizes, "space_id").where("_leaving = _members").select(*keys)
    granted = leaving.join(last, keys, "left_anti")
    return (members.join(granted, keys, "left_anti").select(*members.columns),
            requests.join(granted, keys, "left_anti"))


def delete_spaces(tables: Tables, requests: DataFrame) -> tuple[Tables, DataFrame]:
    """requests(space_id, user_id) by owners: soft-delete the space and drop its children.

    Devices, tombstones and cursors stay, so that peers can still fetch the deletion.
    Returns the tables and the ids of the deleted spaces.
    """
    allowed, _ = check_role(requests, tables["space_members"], owner_only=True)
    gone = allowed.select("space_id").distinct()
    accounts = tables["accounts"]
    doomed = accounts.join(gone, "space_id", "left_semi").select(F.col("id").alias("account_id"))
    spaces = tables["spaces"]
    hit = gone.select(F.col("space_id").alias("id"), F.lit(True).alias("deleted"))
    out = {**tables, "spaces": apply_edits(spaces, hit, ["id"])}
    for name in ("space_members", "space_settings", "categories", "accounts"):
        out[name] = tables[name].join(gone, "space_id", "left_anti").select(*tables[name].columns)
    for name in ("transactions", "account_summaries"):
        out[name] = tables[name].join(doomed, "account_id", "left_anti").select(*tables[name].columns)
    return out, gone


def drop_spaces(tables: Tables, gone: DataFrame) -> Tables:
    """Hard delete of spaces (space_id) with every row that hangs on them or on their accounts."""
    gone, out = gone.select("space_id"), dict(tables)
    keep_out = {name: gone for name in SPACE_CHILDREN} | {"spaces": gone.withColumnRenamed("space_id", "id")}
    if "accounts" in tables:
        doomed = tables["accounts"].join(gone, "space_id", "left_semi").select(F.col("id").alias("account_id"))
        keep_out |= {name: doomed for name in ACCOUNT_CHILDREN}
    for name, leaving in keep_out.items():
        if name in tables:
            out[name] = tables[name].join(leaving, leaving.columns, "left_anti").select(*tables[name].columns)
    return out


def evict_spaces(tables: Tables, spaces: DataFrame) -> Tables:
    """Hard delete of spaces with everything that hangs on them, their log included."""
    out = drop_spaces(tables, spaces)
    if "change_log" in tables:
        log = tables["change_log"]
        out["change_log"] = log.join(spaces.select("space_id"), "space_id", "left_anti").select(*log.columns)
    return out


# ---- devices ------------------------------------------------------------------------
def revoke_devices(tables: Tables, requests: DataFrame) -> Tables:
    """requests(space_id, device_id): tombstone each trusted device, then drop it."""
    keys = ["space_id", "device_id"]
    devices = tables["trusted_devices"]
    hit = devices.join(requests.select(*keys), keys, "left_semi").select(*keys, "cert_pem")
    return {
        **tables,
        "evicted_devices": upsert(tables["evicted_devices"], hit, keys),
        "trusted_devices": devices.join(requests.select(*keys), keys, "left_anti").select(
            *devices.columns),
    }


def clear_tombstones(evicted: DataFrame, exchanged: DataFrame) -> DataFrame:
    keys = ["space_id", "device_id"]
    return evicted.join(exchanged.select(*keys), keys, "left_anti").select(*evicted.columns)


def admit_devices(tables: Tables, arrivals: DataFrame, at: str) -> Tables:
    """Pairing's effect on the tables.

    arrivals(device_row_id, space_id, device_id, display_name, cert_pem, user_id, user_name):
    the user is added or renamed, the membership added (an existing one keeps its join
    date), the device added or re-enabled under its existing id.
    """
    stamp = F.lit(at)
    people = arrivals.groupBy(F.col("user_id").alias("id")).agg(F.max("user_name").alias("name")).select(
        "id", "name", F.lit(None).cast("string").alias("pin_hash"),
        stamp.alias("created_at"), stamp.alias("updated_at"))
    joins = arrivals.select("space_id", "user_id").distinct().select(
        "space_id", "user_id", F.lit("member").alias("role"), stamp.alias("joined_at"))
    devices = arrivals.select(
        F.col("device_row_id").alias("id"), "space_id", "device_id", "display_name", "cert_pem",
        F.lit(True).alias("sync_enabled"), stamp.alias("paired_at"))
    return {
        **tables,
        "users": upsert_columns(tables["users"], people, ["id"], ["name", "pin_hash", "updated_at"]),
        "space_members": upsert_columns(
            tables["space_members"], joins, ["space_id", "user_id"], ["role"]),
        "trusted_devices": upsert_columns(
            tables["trusted_devices"], devices, ["space_id", "device_id"],
            ["display_name", "cert_pem", "sync_enabled"]),
    }


def new_account_rows(statements: DataFrame) -> DataFrame:
    """Accounts named by imports, with the account number as name and the default colour."""
    return statements.groupBy("account_id").agg(
        F.min(F.struct("account_type", "account_source", "currency", "space_id")).alias("s")
    ).select(
        F.col("account_id").alias("id"), F.col("account_id").alias("name"), "s.currency",
        "s.account_type", "s.account_source", F.lit(FALLBACK_COLOR).alias("color"), "s.space_id")
