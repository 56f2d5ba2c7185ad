"""Reading, checking and applying change-log batches; snapshots as the fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import in_ranges, numbered, previous_value
from ..functions.scalars import differs, key_head, key_tail, let, within_tolerance
from ..schemas import KEYS, LOG_BATCH_ROWS, LOGGED, SNAPSHOT_CHUNK_ROWS, TABLES, payload_schema
from .aggregates import seq_bounds
from .capture import capture_changes, snapshot_json
from .filters import scope_to_space, visible_spaces
from .joins import latest_other_author
from .mutate import Tables, upsert, upsert_columns, upsert_monotone

_COMPOSITE = [t for t in LOGGED if len(KEYS[t]) > 1]


# ---- cursors and reading ------------------------------------------------------------
def get_cursors(requested: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursor of each requested (space, device); 0 when there is none yet."""
    seen = cursors.select("space_id", F.col("peer_device_id").alias("device_id"), "last_seq")
    return requested.select("space_id", "device_id").distinct().join(
        seen, ["space_id", "device_id"], "left"
    ).withColumn("last_seq", F.coalesce("last_seq", F.lit(0).cast("bigint")))


def read_changes_since(log: DataFrame, cursors: DataFrame, limit: int = LOG_BATCH_ROWS) -> DataFrame:
    """Log rows past each (space, device) cursor, in batches of `limit` by ascending seq.

    Positions come from ranges of sequence numbers, so one busy device's backlog is
    numbered by many tasks.
    """
    seen = cursors.select("space_id", F.col("peer_device_id").alias("device_id"), "last_seq")
    fresh = log.join(seen, ["space_id", "device_id"], "left").where(
        F.col("seq") > F.coalesce("last_seq", F.lit(0))).select(*log.columns)
    width = 16 * limit
    ranked = numbered(
        fresh, ["space_id", "device_id"], [F.floor(F.col("seq") / width)],
        [F.col("seq"), F.col("id")], out="_no")
    return ranked.withColumn("batch_no", F.floor((F.col("_no") - 1) / limit).cast("bigint")).drop("_no")


def decode_payload(changes: DataFrame, table: str) -> DataFrame:
    """Upserts of one table with their typed row as `row`."""
    return changes.where(
        (F.col("table_name") == table) & F.col("operation").isin("insert", "update")
    ).withColumn("row", F.from_json("payload", payload_schema(table)))


def advance_cursors(cursors: DataFrame, reached: DataFrame) -> DataFrame:
    """Raise cursors to reached(space_id, device_id, max_seq); never lower them."""
    return upsert_monotone(cursors, reached.select(
        "space_id", F.col("device_id").alias("peer_device_id"), F.col("max_seq").alias("last_seq")))


def plan_from_bounds(bounds: DataFrame, cursors: DataFrame) -> DataFrame:
    """bounds(space_id, device_id, min_seq, max_seq) of the retained log: what each peer needs.

    A peer whose cursor lies below the retained log needs a whole snapshot.
    """
    state = get_cursors(bounds, cursors).join(bounds, ["space_id", "device_id"])
    behind = (F.col("last_seq") > 0) & (F.col("min_seq") > 0) & (F.col("last_seq") < F.col("min_seq"))
    return state.withColumn("mode", F.when(behind, "snapshot").otherwise("delta"))


def plan_delta_or_snapshot(log: DataFrame, requested: DataFrame, cursors: DataFrame) -> DataFrame:
    """The plan for the requested (space, device) pairs, from the retained log."""
    return plan_from_bounds(seq_bounds(log, requested), cursors)


# ---- validation ---------------------------------------------------------------------
def validate_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes fit to apply, and the others with a reason."""
    operation, table = F.col("operation"), F.col("table_name")
    upserting = operation.isin("insert", "update")

    def complete(name: str) -> Column:
        """Whether the payload decodes with every required field; decoded once per row."""
        schema = payload_schema(name)
        required = [f.name for f in schema.fields if not f.nullable]
        return let(F.from_json("payload", schema), lambda row: reduce(
            Column.__and__, [row[f].isNotNull() for f in required]))

    decodable = F.lit(False)
    for name in LOGGED:
        decodable = F.when(table == name, complete(name)).otherwise(decodable)
    undecodable = ~F.coalesce(decodable, F.lit(False))
    reason = (
        F.when(~F.coalesce(operation.isin("insert", "update", "delete"), F.lit(False)), "unknown operation")
        .when(~F.coalesce(table.isin(LOGGED), F.lit(False)), "unknown table")
        .when(upserting & F.col("payload").isNull(), "missing payload")
        .when(upserting & undecodable, "payload does not match the table")
        .when((operation == "delete") & table.isin(_COMPOSITE) & (F.instr("row_id", ":") == 0),
              "malformed composite row id")
    )
    tagged = changes.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


# ---- conflicts ----------------------------------------------------------------------
def detect_conflicts(changes: DataFrame, transactions: DataFrame, log: DataFrame,
                     tolerance: int | None = None) -> DataFrame:
    """Category and note disagreements between incoming edits and what they overwrite.

    `changes` are batches in arrival order (`batch_no`, `seq`). The value being overwritten
    is that of the preceding change of the row in the batch, else the stored row; after an
    in-batch delete there is none. The stored log supplies the newest entry by another
    device, which must lie within the tolerance, limit included.
    """
    edits = changes.where(F.col("table_name") == "transactions")
    decoded = edits.withColumn(
        "row", F.when(F.col("operation") != "delete",
                      F.from_json("payload", "category string, note string")))
    state = F.struct((F.col("operation") != "delete").alias("exists"),
                     F.col("row.category").alias("category"), F.col("row.note").alias("note"))
    order = [F.col("batch_no"), F.col("seq"), F.col("id")]
    chained = previous_value(
        decoded, ["row_id"], [F.col("batch_no"), F.floor(F.col("seq") / (16 * LOG_BATCH_ROWS))],
        order, state, "_prior")
    incoming = chained.where(F.col("operation") != "delete")
    stored = transactions.select(
        F.col("id").alias("row_id"),
        F.struct(F.lit(True).alias("exists"), "category", "note").alias("_stored"))
    local = F.coalesce("_prior", "_stored")
    seen = incoming.join(stored, "row_id", "left").withColumn("_local", local).where("_local.exists")
    near = latest_other_author(seen, log)
    gap = {} if tolerance is None else {"seconds": tolerance}
    close = near.where(within_tolerance(F.col("other_changed_at"), F.col("changed_at"), **gap))
    fields = F.explode(F.filter(
        F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"_local.{f}").alias("local_value"),
                     F.col(f"row.{f}").alias("remote_value"))
            for f in ("category", "note")
        ]),
        lambda c: differs(c["local_value"], c["remote_value"]),
    )).alias("c")
    return close.select(
        "space_id", "table_name", "row_id", "seq", F.col("other_changed_at").alias("local_changed_at"),
        F.col("changed_at").alias("remote_changed_at"), fields,
    ).select("space_id", "table_name", "row_id", "seq", "c.field", "c.local_value", "c.remote_value",
             "local_changed_at", "remote_changed_at")


def record_conflicts(recorded: DataFrame, found: DataFrame, created_at: str) -> DataFrame:
    """Append conflicts as unresolved. Ids derive from the conflict, so a retry adds nothing."""
    identity = F.md5(F.concat_ws("|", "space_id", "table_name", "row_id", "field",
                                 F.col("seq").cast("string"), "remote_changed_at"))
    rows = found.select(
        identity.alias("id"), "space_id", "table_name", "row_id", "field", "local_value",
        "remote_value", "local_changed_at", "remote_changed_at", F.lit(False).alias("resolved"),
        F.lit(created_at).alias("created_at")).dropDuplicates(["id"])
    return recorded.unionByName(rows.join(recorded.select("id"), "id", "left_anti").select(
        *recorded.columns))


# ---- applying -----------------------------------------------------------------------
def _arrival() -> Column:
    return F.struct("batch_no", "seq", "id")


def last_change_per_row(changes: DataFrame) -> DataFrame:
    """The change that decides each logical row: the last to arrive.

    Upserts carry whole rows, so applying only the last one equals applying all in turn.
    """
    names = [c for c in changes.columns if c not in ("table_name", "row_id")]
    return changes.groupBy("table_name", "row_id").agg(
        F.max_by(F.struct(*names), _arrival()).alias("_last")
    ).select("table_name", "row_id", "_last.*")


def _deciding(last: DataFrame, table: str) -> DataFrame:
    """Per logical row of one table: its key columns, `_gone`, `_at` and the typed `_row`."""
    keys = KEYS[table]
    kinds = {f.name: f.dataType for f in TABLES[table].fields}
    row_id = F.col("row_id")
    parts = [row_id] if len(keys) == 1 else [key_head(row_id), key_tail(row_id)]
    decoded = last.where(F.col("table_name") == table).withColumn("_raw", F.when(
        F.col("operation") != "delete", F.from_json("payload", payload_schema(table))))
    fields = [
        (F.col(f"_raw.{f.name}") != 0 if f.name in ("approved", "sync_enabled") else F.col(f"_raw.{f.name}"))
        .alias(f.name)
        for f in TABLES[table].fields
    ]
    return decoded.select(
        *[F.coalesce(F.col(f"_raw.{k}"), p.try_cast(kinds[k])).alias(k) for k, p in zip(keys, parts)],
        (F.col("operation") == "delete").alias("_gone"), _arrival().alias("_at"),
        F.struct(*fields).alias("_row"))


def _overwrite(current: DataFrame, deciding: DataFrame, table: str, cuts: DataFrame | None) -> DataFrame:
    """One pass: replace, add or drop the rows that have a deciding change; keep the others.

    cuts(account_id, _cut): rows of these accounts survive only if written after the cut.
    """
    keys = KEYS[table]
    stored = current.select(*keys, F.struct(*current.columns).alias("_old"))
    merged = stored.join(deciding, keys, "full_outer").where("_gone is null or not _gone")
    new = F.col("_at").isNotNull()
    merged = merged.select("_at", *[
        F.when(new, F.col(f"_row.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in current.columns])
    if cuts is not None:
        merged = merged.join(cuts, "account_id", "left").where("_cut is null or _at > _cut")
    return merged.select(*current.columns)


def apply_member_changes(tables: Tables, last: DataFrame, changes: DataFrame) -> Tables:
    """Memberships from the deciding changes; embedded users from the last change that has one.

    A user keeps its creation time and takes name, PIN hash and update time.
    """
    members = _overwrite(
        tables["space_members"], _deciding(last, "space_members"), "space_members", None)
    users = decode_payload(changes, "space_members").where("row.user is not null").groupBy(
        F.col("row.user.id").alias("_id")).agg(F.max_by("row.user", _arrival()).alias("u")).select("u.*")
    return {
        **tables,
        "space_members": members,
        "users": upsert_columns(tables["users"], users, ["id"], ["name", "pin_hash", "updated_at"]),
    }


def _apply_spaces(spaces: DataFrame, last: DataFrame, changes: DataFrame) -> DataFrame:
    """Space deletes are soft and lasting: a later upsert renames but does not revive."""
    upserts = decode_payload(changes, "spaces").groupBy("row_id").agg(
        F.max_by("row", _arrival()).alias("r")).select("r.*").withColumn("deleted", F.lit(False))
    merged = upsert_columns(spaces, upserts, ["id"], ["name", "updated_at"])
    gone = changes.where("table_name = 'spaces' and operation = 'delete'").select(
        F.col("row_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    return merged.join(gone, "id", "left").select(
        "id", "name", "created_at", "updated_at",
        (F.col("deleted") | F.coalesce("_gone", F.lit(False))).alias("deleted"))


def _apply_devices(devices: DataFrame, changes: DataFrame) -> DataFrame:
    """Devices are one per (space, device) under their local id; deletes name the local id.

    Upserts that arrive before the last effective delete of their device are void.
    """
    pair = ["space_id", "device_id"]
    upserts = decode_payload(changes, "trusted_devices").select(
        _arrival().alias("_at"), F.col("row").alias("r"),
        F.col("row.space_id").alias("space_id"), F.col("row.device_id").alias("device_id"))
    removals = changes.where("table_name = 'trusted_devices' and operation = 'delete'").groupBy(
        F.col("row_id").alias("id")).agg(F.max(_arrival()).alias("_removed"))
    local = devices.select(*pair, F.col("id").alias("_local_id"))
    named = upserts.select(*pair, F.col("r.id").alias("_id")).distinct().join(
        local, pair, "left").select(*pair, F.coalesce("_local_id", "_id").alias("id"))
    targets = local.withColumnRenamed("_local_id", "id").unionByName(named).distinct()
    cut = targets.join(removals, "id").groupBy(*pair).agg(F.max("_removed").alias("_removed"))
    live = upserts.join(cut, pair, "left").where("_removed is null or _at > _removed")
    final = live.groupBy(*pair).agg(F.max_by("r", "_at").alias("r"), F.min_by("r.id", "_at").alias("_first"))
    rows = final.withColumn("r", F.col("r").withField("id", F.col("_first"))).select("r.*").withColumn(
        "sync_enabled", F.col("sync_enabled") != 0)
    kept = devices.join(removals.select("id"), "id", "left_anti").select(*devices.columns)
    return upsert_columns(kept, rows, pair, ["display_name", "cert_pem", "sync_enabled", "paired_at"])


def apply_changes(tables: Tables, changes: DataFrame) -> Tables:
    """Apply valid changes: the last arrival of each row overwrites, without comparing times.

    `changes` has `batch_no` beside the log columns. Deleting an account takes along the
    transactions and summaries it has at that moment: stored ones, and those written
    earlier in the batch.
    """
    last = last_change_per_row(changes)
    cuts = changes.where("table_name = 'accounts' and operation = 'delete'").groupBy(
        F.col("row_id").alias("account_id")).agg(F.max(_arrival()).alias("_cut"))
    out = dict(tables)
    for table in ("categories", "accounts", "transactions", "account_summaries", "space_settings",
                  "model_versions"):
        if table not in tables:
            continue
        cascading = cuts if table in ("transactions", "account_summaries") else None
        out[table] = _overwrite(tables[table], _deciding(last, table), table, cascading)
    if "space_members" in tables:
        out = apply_member_changes(out, last, changes)
    if "spaces" in tables:
        out["spaces"] = _apply_spaces(tables["spaces"], last, changes)
    if "trusted_devices" in tables:
        out["trusted_devices"] = _apply_devices(tables["trusted_devices"], changes)
    return out


def relogged(changes: DataFrame, base_seq: int, applied_at: str) -> DataFrame:
    """Applied rows as the local log keeps them: own sequence and time, author's beside it."""
    ranked = numbered(
        changes, ["space_id"], [F.col("batch_no"), F.floor(F.col("seq") / (16 * LOG_BATCH_ROWS))],
        [F.col("seq"), F.col("id")], out="_no")
    return ranked.select(
        F.md5(F.concat_ws("|", F.lit("applied"), "id")).alias("id"), "space_id", "table_name", "row_id",
        "operation", "payload", (F.lit(base_seq).cast("bigint") + F.col("_no")).alias("seq"), "device_id",
        F.lit(applied_at).alias("changed_at"), F.col("seq").alias("origin_seq"),
        F.col("changed_at").alias("origin_changed_at"))


# ---- batch kinds --------------------------------------------------------------------
def classify_batches(changes: DataFrame, local_device: str) -> DataFrame:
    """Kind of each (space, device, batch): space deletion, possible eviction, or normal."""
    deleting = F.col("operation") == "delete"
    return changes.groupBy("space_id", "device_id", "batch_no").agg(
        F.bool_or(deleting & (F.col("table_name") == "spaces")).alias("_space"),
        F.bool_or(deleting & (F.col("table_name") == "trusted_devices")
                  & (F.col("device_id") != local_device)).alias("_device"),
    ).select(
        "space_id", "device_id", "batch_no",
        F.when(F.col("_space"), "space_deletion").when(F.col("_device"), "potential_eviction")
        .otherwise("normal").alias("kind"))


def confirm_eviction(changes: DataFrame, devices: DataFrame, local_device: str) -> DataFrame:
    """Batches whose deleted device rows include one of this device."""
    deleted = changes.where("table_name = 'trusted_devices' and operation = 'delete'").select(
        "space_id", F.col("device_id").alias("author"), "batch_no", F.col("row_id").alias("id"))
    own = devices.where(F.col("device_id") == local_device).select("id")
    return deleted.join(own, "id", "left_semi").groupBy("space_id", "author", "batch_no").agg(
        F.count(F.lit(1)).alias("own_rows"))


# ---- snapshots ----------------------------------------------------------------------
SNAPSHOT_TABLES = ["spaces", "space_members", "users", "categories", "accounts", "transactions",
                   "account_summaries", "space_settings", "model_versions"]
_UNCHUNKED = {"spaces", "space_members", "users"}


def collect_snapshot(tables: Tables, spaces: DataFrame | None = None) -> DataFrame:
    """All rows of live spaces as (space_id, table_rank, table_name, lead, key, payload).

    (lead, key) is the order inside a table; `lead` is a date, name or the like that also
    serves as the numbering bucket.
    """
    live = visible_spaces(tables["spaces"])
    if spaces is not None:
        live = live.join(spaces.select(F.col("space_id").alias("id")), "id", "left_semi").select(
            *live.columns)
    accounts = tables["accounts"]
    members = tables["space_members"]
    in_space = members.select("space_id", F.col("user_id").alias("id"))
    frames = {
        "spaces": (live.withColumn("space_id", F.col("id")), "created_at", "id"),
        "space_members": (members.withColumn("user", F.lit(None).cast(payload_schema("space_members")["user"].dataType)),
                          "joined_at", "user_id"),
        "users": (tables["users"].join(in_space, "id"), "name", "id"),
        "categories": (tables["categories"], "name", "id"),
        "accounts": (accounts, "name", "id"),
        "transactions": (scope_to_space(tables["transactions"], accounts), "booking_date", "id"),
        "account_summaries": (scope_to_space(tables["account_summaries"], accounts), "month", "account_id"),
        "space_settings": (tables["space_settings"], "key", "key"),
        "model_versions": (tables["model_versions"].withColumn(
            "_v", F.lpad(F.col("version").cast("string"), 10, "0")), "_v", "_v"),
    }
    parts = []
    for rank, table in enumerate(SNAPSHOT_TABLES):
        rows, lead, key = frames[table]
        body = snapshot_json(table) if table != "users" else F.to_json(
            F.struct(*[f.name for f in TABLES["users"].fields]), {"ignoreNullFields": "false"})
        parts.append(rows.select(
            "space_id", F.lit(rank).alias("table_rank"), F.lit(table).alias("table_name"),
            F.col(lead).alias("lead"), F.col(key).alias("key"), body.alias("payload")))
    keep = live.select(F.col("id").alias("space_id"))
    return reduce(DataFrame.unionByName, parts).join(keep, "space_id", "left_semi").select(*parts[0].columns)


def chunk_snapshot(snapshot: DataFrame, rows: int = SNAPSHOT_CHUNK_ROWS) -> DataFrame:
    """Chunk number of each snapshot row within its (space, table), parents first.

    Space, member and user rows travel in one chunk each.
    """
    group, order = ["space_id", "table_rank"], [F.col("lead"), F.col("key")]
    ranked = numbered(in_ranges(snapshot, group, order), group, [F.col("__range")], order, out="_no").drop("__range")
    whole = F.col("table_name").isin(*_UNCHUNKED)
    chunk = F.when(whole, F.lit(0)).otherwise(F.floor((F.col("_no") - 1) / rows)).cast("bigint")
    return ranked.withColumn("chunk", chunk).drop("_no")


def apply_snapshot(tables: Tables, snapshot: DataFrame) -> Tables:
    """Upsert every table of a snapshot stream; rows the snapshot lacks stay."""
    def rows(table: str) -> DataFrame:
        schema = TABLES["users"] if table == "users" else payload_schema(table)
        frame = snapshot.where(F.col("table_name") == table).select(
            F.from_json("payload", schema).alias("r")).select("r.*")
        if table == "transactions":
            frame = frame.withColumn("approved", F.col("approved") != 0)
        return frame

    out = dict(tables)
    spaces = rows("spaces").withColumn("deleted", F.lit(False))
    out["spaces"] = upsert_columns(tables["spaces"], spaces, ["id"], ["name", "updated_at"])
    out["users"] = upsert_columns(
        tables["users"], rows("users").dropDuplicates(["id"]), ["id"], ["name", "pin_hash", "updated_at"])
    for table in SNAPSHOT_TABLES:
        if table not in ("spaces", "users"):
            out[table] = upsert(
                tables[table], rows(table).select(*tables[table].columns), KEYS[table])
    return out


def apply_snapshot_from(tables: Tables, snapshot: DataFrame, host: DataFrame, host_device: str, base_seq: int,
                        changed_at: str) -> Tables:
    """Apply a host's snapshot with its end frame.

    host: rows of trusted_devices, one for each space, that stand for the host itself; an
    existing one keeps its id and pairing time. What the snapshot changed is logged under the
    host's device, so that it is not sent back to the host.
    """
    out = apply_snapshot(tables, snapshot)
    log = capture_changes(tables, out, host_device, base_seq, changed_at)
    out["trusted_devices"] = upsert_columns(
        tables["trusted_devices"], host, ["space_id", "device_id"], ["display_name", "cert_pem", "sync_enabled"])
    out["change_log"] = tables["change_log"].unionByName(log.select(*tables["change_log"].columns))
    return out


def with_active_setting(snapshot: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Make sure the active model travels even when its setting row is missing.

    active(space_id, version): the version in use; 0 means none.
    """
    have = snapshot.where(F.col("table_name") == "space_settings").where(
        F.col("key") == key).select("space_id")
    spaces = snapshot.select("space_id").distinct()
    missing = active.where("version > 0").join(have, "space_id", "left_anti").join(
        spaces, "space_id", "left_semi")
    rank = SNAPSHOT_TABLES.index("space_settings")
    rows = missing.select(
        "space_id", F.lit(rank).alias("table_rank"), F.lit("space_settings").alias("table_name"),
        F.lit(key).alias("lead"), F.lit(key).alias("key"),
        F.to_json(F.struct("space_id", F.lit(key).alias("key"),
                           F.col("version").cast("string").alias("value"))).alias("payload"))
    return snapshot.unionByName(rows)
