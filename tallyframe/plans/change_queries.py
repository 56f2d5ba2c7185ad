"""Registered queries: change capture, replication and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capture, replicate, retention
from ..schemas import ACTIVE_MODEL_SETTING
from ..session import settle
from ..sources.given import GivenLedger
from .catalog import register
from .mutation_queries import kept_without, space_tables, surviving_keys
from .oracle import keys_sql, ledger_sql

AT = "2025-05-05T05:05:05Z"
AS_OF = "2024-04-15T12:00:00Z"

_JSON = {
    "transactions": "'id', id, 'booking_date', booking_date, 'value_date', value_date, 'reference', reference, "
    "'text', text, 'currency', currency, 'amount', amount, 'balance', balance, 'approved', CAST(approved AS BIGINT), "
    "'note', note, 'category', category, 'account_id', account_id",
    "accounts": "'id', id, 'name', name, 'currency', currency, 'account_type', account_type, "
    "'account_source', account_source, 'color', color, 'space_id', space_id",
    "categories": "'id', id, 'name', name, 'color', color, 'space_id', space_id",
    "spaces": "'id', id, 'name', name, 'created_at', created_at, 'updated_at', updated_at",
    "account_summaries": "'month', month, 'account_id', account_id, 'balance', balance",
    "space_settings": "'space_id', space_id, 'key', key, 'value', value",
    "model_versions": "'space_id', space_id, 'version', version, 'weights_md5', weights_md5, "
    "'card_md5', card_md5, 'trained_at', trained_at",
    "users": "'id', id, 'name', name, 'pin_hash', pin_hash, 'created_at', created_at, 'updated_at', updated_at",
}
_USER = ("json_object('id', u.id, 'name', {name}, 'pin_hash', u.pin_hash, 'created_at', u.created_at, "
         "'updated_at', u.updated_at)")


def _json(table: str) -> str:
    return f"CAST(json_object({_JSON[table]}) AS VARCHAR)"


# ---- capture ------------------------------------------------------------------------
_CAPTURED = f"""
changed_transactions AS (
  SELECT CASE WHEN right(id, 1) = '3' THEN 'x' || id ELSE id END AS id, booking_date, value_date, reference, text,
         currency, amount, balance, CASE WHEN right(id, 1) = '1' THEN NOT approved ELSE approved END AS approved,
         note, category, account_id, right(id, 1) AS kind FROM transactions),
captured AS (
  SELECT a.space_id, 'transactions' AS table_name, t.id AS row_id,
         CASE t.kind WHEN '1' THEN 'update' WHEN '2' THEN 'delete' ELSE 'insert' END AS operation,
         CASE WHEN t.kind <> '2' THEN (SELECT {_json('transactions')} FROM (SELECT t.*)) END AS payload,
         CASE t.kind WHEN '2' THEN 14 ELSE 4 END AS phase
  FROM changed_transactions t JOIN accounts a ON a.id = t.account_id WHERE t.kind IN ('1', '2', '3')
  UNION ALL
  SELECT space_id, 'accounts', id, 'update', CAST(json_object('id', id, 'name', upper(name), 'currency', currency,
         'account_type', account_type, 'account_source', account_source, 'color', color, 'space_id', space_id)
         AS VARCHAR), 3 FROM accounts WHERE right(id, 1) = '5'
  UNION ALL
  SELECT space_id, 'space_members', space_id || ':' || user_id, 'delete', NULL, 17
  FROM space_members WHERE right(user_id, 1) = '7'
  UNION ALL
  SELECT m.space_id, 'space_members', m.space_id || ':' || m.user_id, 'update', CAST(json_object(
         'space_id', m.space_id, 'user_id', m.user_id, 'role', 'owner', 'joined_at', m.joined_at,
         'user', {_USER.format(name='u.name')}) AS VARCHAR), 1
  FROM space_members m JOIN users u ON u.id = m.user_id WHERE right(m.user_id, 1) = '8' AND m.role <> 'owner'
  UNION ALL
  SELECT id, 'spaces', id, 'update', CAST(json_object('id', id, 'name', 'renamed', 'created_at', created_at,
         'updated_at', updated_at) AS VARCHAR), 0 FROM spaces WHERE id = 's1'
  UNION ALL
  SELECT a.space_id, 'account_summaries', s.account_id || ':' || s.month, 'delete', NULL, 13
  FROM account_summaries s JOIN accounts a ON a.id = s.account_id WHERE right(s.month, 2) = '12'
  UNION ALL
  SELECT space_id, 'model_versions', space_id || ':' || version, 'insert',
         CAST(json_object('space_id', space_id, 'version', version, 'weights_md5', weights_md5, 'card_md5', card_md5,
           'trained_at', trained_at) AS VARCHAR), 8
  FROM (SELECT space_id, version + 1000 AS version, weights_md5, card_md5, trained_at FROM model_versions
        WHERE version % 2 = 0))"""


def _versions(led: GivenLedger, store: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """An old and a new version of the tables.

    store: write transactions and summaries once, for queries that read them in several places;
    joins, running totals and sums behind them are else evaluated at each.
    """
    rows, summaries = led.transactions(), led.account_summaries
    if store:
        rows, summaries = settle(rows, "transactions"), settle(summaries, "summaries")
    before = {
        "spaces": led.spaces, "users": led.users, "space_members": led.space_members,
        "categories": led.categories, "accounts": led.accounts, "transactions": rows,
        "account_summaries": summaries, "space_settings": led.space_settings,
        "trusted_devices": led.trusted_devices, "model_versions": led.model_versions,
    }
    last = F.substring("id", -1, 1)
    member = F.substring("user_id", -1, 1)
    versions = led.model_versions
    edited = rows.where(last != "2").withColumn(
        "approved", F.when(last == "1", ~F.col("approved")).otherwise(F.col("approved")))
    # A rewritten id is an added row beside the untouched original.
    added = rows.where(last == "3").withColumn("id", F.concat(F.lit("x"), "id"))
    after = {
        **before,
        "transactions": edited.unionByName(added),
        "accounts": led.accounts.withColumn(
            "name", F.when(last == "5", F.upper("name")).otherwise(F.col("name"))),
        "space_members": led.space_members.where(member != "7").withColumn(
            "role", F.when(member == "8", "owner").otherwise(F.col("role"))),
        "spaces": led.spaces.withColumn(
            "name", F.when(F.col("id").isin("s1", "s2"), "renamed").otherwise(F.col("name"))
        ).withColumn("deleted", F.col("id") == "s2"),
        "account_summaries": summaries.where(F.substring("month", 6, 2) != "12"),
        "model_versions": versions.unionByName(versions.where("version % 2 = 0").withColumn(
            "version", F.col("version") + 1000)),
    }
    return before, after


@register("capture_changes", ledger_sql("""
    SELECT space_id, table_name, row_id, operation, payload, 'dev-1' AS device_id,
           100 + row_number() OVER (PARTITION BY space_id ORDER BY phase, md5(row_id), row_id) AS seq
    FROM captured""", _CAPTURED))
def _(led: GivenLedger) -> DataFrame:
    """Nine tables compared; the update of a soft-deleted space is not announced."""
    before, after = _versions(led, store=True)
    return capture.capture_changes(before, after, "dev-1", 100, AT).drop("id", "changed_at")


@register("fan_out_user_changes", ledger_sql(f"""
    SELECT m.space_id, m.space_id || ':' || m.user_id AS row_id, u.seq, CAST(json_object(
             'space_id', m.space_id, 'user_id', m.user_id, 'role', m.role, 'joined_at', m.joined_at,
             'user', {_USER.format(name='upper(u.name)')}) AS VARCHAR) AS payload
    FROM space_members m JOIN (SELECT *, 7 + row_number() OVER (ORDER BY md5(id), id) AS seq
      FROM users WHERE right(id, 1) = '3') u ON u.id = m.user_id"""))
def _(led: GivenLedger) -> DataFrame:
    after = led.users.withColumn("name", F.when(
        F.col("id").endswith("3"), F.upper("name")).otherwise(F.col("name")))
    return capture.fan_out_user_changes(led.users, after, led.space_members, "dev-1", 7, AT).select(
        "space_id", "row_id", "seq", "payload")


@register("space_deletion_rows", ledger_sql("""
    SELECT space_id, 'spaces' AS table_name, space_id AS row_id, 'delete' AS operation, max(seq) + 1 AS seq
    FROM change_log GROUP BY 1"""))
def _(led: GivenLedger) -> DataFrame:
    gone = led.change_log.select("space_id").distinct()
    return capture.space_deletion_rows(gone, led.change_log, "dev-1", AT).select(
        "space_id", "table_name", "row_id", "operation", "seq")


# ---- cursors and reading ------------------------------------------------------------
@register("read_changes_since", ledger_sql("""
    SELECT *, (row_number() OVER (PARTITION BY space_id, device_id ORDER BY seq) - 1) // 100 AS batch_no
    FROM (SELECT l.* FROM change_log l LEFT JOIN sync_cursors c
            ON c.space_id = l.space_id AND c.peer_device_id = l.device_id
          WHERE l.seq > coalesce(c.last_seq, 0))"""))
def _(led: GivenLedger) -> DataFrame:
    return replicate.read_changes_since(led.change_log, led.sync_cursors, limit=100)


@register("decode_payload", ledger_sql("""
    SELECT id, row_id, new_category AS category, new_note AS note, new_amount AS amount FROM decoded_log
    WHERE operation <> 'delete'"""))
def _(led: GivenLedger) -> DataFrame:
    return replicate.decode_payload(led.change_log, "transactions").select(
        "id", "row_id", "row.category", "row.note", "row.amount")


@register("get_cursors", ledger_sql("""
    SELECT d.space_id, d.device_id, coalesce(c.last_seq, 0) AS last_seq FROM trusted_devices d
    LEFT JOIN sync_cursors c ON c.space_id = d.space_id AND c.peer_device_id = d.device_id"""))
def _(led: GivenLedger) -> DataFrame:
    return replicate.get_cursors(led.change_log.select("space_id", "device_id"), led.sync_cursors)


@register("advance_cursors", ledger_sql("""
    SELECT space_id, device_id AS peer_device_id, max(seq) AS last_seq FROM change_log GROUP BY 1, 2"""))
def _(led: GivenLedger) -> DataFrame:
    from ..operators.aggregates import seq_bounds

    return replicate.advance_cursors(led.sync_cursors, seq_bounds(led.change_log))


@register("plan_delta_or_snapshot", ledger_sql("""
    SELECT d.space_id, d.device_id, coalesce(c.last_seq, 0) AS last_seq, b.min_seq, b.max_seq,
           CASE WHEN coalesce(c.last_seq, 0) > 0 AND b.min_seq > 0 AND coalesce(c.last_seq, 0) < b.min_seq
                THEN 'snapshot' ELSE 'delta' END AS mode
    FROM trusted_devices d LEFT JOIN sync_cursors c ON c.space_id = d.space_id AND c.peer_device_id = d.device_id
    LEFT JOIN (SELECT space_id, device_id, min(seq) AS min_seq, max(seq) AS max_seq FROM change_log
      WHERE changed_at >= '2024-01-20' OR device_id = 'd1' GROUP BY 1, 2) b
      ON b.space_id = d.space_id AND b.device_id = d.device_id"""))
def _(led: GivenLedger) -> DataFrame:
    """Most of the log before a date is gone, so some cursors lie below what is left."""
    kept = led.change_log.where("changed_at >= '2024-01-20' or device_id = 'd1'")
    return replicate.plan_delta_or_snapshot(kept, led.trusted_devices, led.sync_cursors)


# ---- validation, conflicts, apply ---------------------------------------------------
def _damaged(led: GivenLedger) -> DataFrame:
    spot = F.col("seq") % 10
    return led.change_log.withColumn(
        "operation", F.when(spot == 1, "merge").otherwise(F.col("operation"))
    ).withColumn(
        "table_name", F.when(spot == 2, "ghosts").when(spot == 3, "space_settings").otherwise(F.col("table_name"))
    ).withColumn(
        "payload", F.when(spot == 4, F.lit(None).cast("string")).when(spot == 5, '{"id":"t1"}')
        .otherwise(F.col("payload")))


@register("validate_changes", ledger_sql("""
    SELECT id, CASE WHEN spot = 1 THEN 'unknown operation' WHEN spot = 2 THEN 'unknown table'
        WHEN spot = 3 AND operation = 'delete' THEN 'malformed composite row id'
        WHEN spot = 3 THEN 'payload does not match the table'
        WHEN spot = 4 AND operation <> 'delete' THEN 'missing payload'
        WHEN spot = 5 AND operation <> 'delete' THEN 'payload does not match the table'
        ELSE 'ok' END AS reason
    FROM (SELECT *, seq % 10 AS spot FROM change_log)"""))
def _(led: GivenLedger) -> DataFrame:
    valid, rejected = replicate.validate_changes(_damaged(led))
    return valid.select("id", F.lit("ok").alias("reason")).unionByName(rejected.select("id", "reason"))


_CLOCK = ("'2024-01-01T' || lpad(CAST((seq % 86400) // 3600 AS VARCHAR), 2, '0') || ':' || "
          "lpad(CAST((seq % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || 'Z'")


def conflict_sql(seconds: int, changed_at: str = "changed_at") -> str:
    return ledger_sql(f"""
    SELECT space_id, table_name, row_id, seq, field, local_value, remote_value, local_changed_at, remote_changed_at
    FROM (
      SELECT *, UNNEST([{{'field': 'category', 'local_value': local_category, 'remote_value': new_category}},
                        {{'field': 'note', 'local_value': local_note, 'remote_value': new_note}}], recursive := true)
      FROM compared)
    WHERE local_value IS DISTINCT FROM remote_value""", f"""
flow_log AS (SELECT * REPLACE ({changed_at} AS changed_at) FROM decoded_log),
incoming AS (
  SELECT *, lag(operation) OVER w AS prior_operation, lag(new_category) OVER w AS prior_category,
         lag(new_note) OVER w AS prior_note
  FROM flow_log WHERE device_id = 'd1' WINDOW w AS (PARTITION BY row_id ORDER BY seq)),
others AS (
  SELECT row_id, arg_max(changed_at, (changed_at, seq)) AS other_changed_at FROM flow_log WHERE device_id <> 'd1' GROUP BY 1),
compared AS (
  SELECT i.space_id, i.table_name, i.row_id, i.seq, i.new_category, i.new_note,
         o.other_changed_at AS local_changed_at, i.changed_at AS remote_changed_at,
         CASE WHEN i.prior_operation IS NULL THEN t.category ELSE i.prior_category END AS local_category,
         CASE WHEN i.prior_operation IS NULL THEN t.note ELSE i.prior_note END AS local_note
  FROM incoming i LEFT JOIN transactions t ON t.id = i.row_id JOIN others o ON o.row_id = i.row_id
  WHERE i.operation <> 'delete' AND coalesce(i.prior_operation <> 'delete', t.id IS NOT NULL)
    AND abs(date_diff('second', CAST(replace(replace(o.other_changed_at, 'T', ' '), 'Z', '') AS TIMESTAMP),
        CAST(replace(replace(i.changed_at, 'T', ' '), 'Z', '') AS TIMESTAMP))) <= {seconds})""")


def _conflicts(led: GivenLedger, log: DataFrame, tolerance: int | None) -> DataFrame:
    incoming = log.where("device_id = 'd1'").withColumn("batch_no", F.lit(0))
    stored = log.where("device_id <> 'd1'")
    rows = led.transactions(text=False, balance=False)
    return replicate.detect_conflicts(incoming, rows, stored, tolerance)


@register("detect_conflicts", conflict_sql(60, _CLOCK))
def _(led: GivenLedger) -> DataFrame:
    """One device's edits against what the others wrote, 60 seconds apart at most.

    Entries are re-timed to one per second, so that many fall within the tolerance.
    """
    moment = F.make_dt_interval(secs=(F.col("seq") % 86400).cast("decimal(18,6)"))
    at = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _conflicts(led, led.change_log.withColumn("changed_at", at), None)


@register("detect_conflicts_within_day", conflict_sql(86400))
def _(led: GivenLedger) -> DataFrame:
    return _conflicts(led, led.change_log, 86400)


@register("record_conflicts", """
    SELECT DISTINCT md5(concat_ws('|', space_id, table_name, row_id, field, CAST(seq AS VARCHAR), remote_changed_at)) AS id,
           space_id, table_name, row_id, field, local_value, remote_value, local_changed_at, remote_changed_at,
           false AS resolved, '""" + AT + """' AS created_at FROM (""" + conflict_sql(86400) + ")")
def _(led: GivenLedger) -> DataFrame:
    """Recorded twice: the second time adds nothing."""
    from ..schemas import SYNC_CONFLICTS

    found = _conflicts(led, led.change_log, 86400)
    empty = led.spark.createDataFrame([], SYNC_CONFLICTS)
    return replicate.record_conflicts(replicate.record_conflicts(empty, found, AT), found, AT)


@register("apply_changes", ledger_sql("""
    SELECT t.id, t.amount, t.approved, t.note, t.category, t.account_id FROM transactions t
    WHERE t.id NOT IN (SELECT row_id FROM decoded_log)
    UNION ALL
    SELECT row_id, new_amount, event_id % 2 = 1, new_note, new_category, 'a' || user_id FROM decoded_log
    WHERE operation <> 'delete' AND seq IN (SELECT max(seq) FROM decoded_log GROUP BY row_id)"""))
def _(led: GivenLedger) -> DataFrame:
    valid, _ = replicate.validate_changes(led.change_log.withColumn("batch_no", F.lit(0)))
    changes = settle(valid, "valid")
    tables = {"transactions": led.transactions()}
    return replicate.apply_changes(tables, changes)["transactions"].select(
        "id", "amount", "approved", "note", "category", "account_id")


@register("apply_member_changes", ledger_sql(f"""
    SELECT m.space_id, m.user_id, CASE WHEN right(m.user_id, 1) = '8' THEN 'owner' ELSE m.role END AS role,
           upper(u.name) AS name, u.created_at
    FROM space_members m JOIN users u ON u.id = m.user_id WHERE right(m.user_id, 1) <> '7'"""))
def _(led: GivenLedger) -> DataFrame:
    """Captured membership changes and user renames applied to the old version."""
    before, after = _versions(led)
    members_only = {k: v for k, v in after.items() if k in ("space_members", "users", "accounts")}
    renamed = led.users.withColumn("name", F.upper("name"))
    log = capture.capture_changes(before, members_only, "dev-1", 0, AT).where("table_name = 'space_members'")
    fan = capture.fan_out_user_changes(led.users, renamed, after["space_members"], "dev-1", 10_000_000, AT)
    changes = settle(log.unionByName(fan), "log").withColumn("batch_no", F.lit(0))
    tables = {"space_members": led.space_members, "users": led.users}
    out = replicate.apply_changes(tables, changes)
    return out["space_members"].join(
        out["users"].select(F.col("id").alias("user_id"), "name", "created_at"), "user_id"
    ).select("space_id", "user_id", "role", "name", "created_at")


@register("replicate_round_trip", ledger_sql("""
    SELECT 'transactions' AS table_name, id AS row_id, CAST(approved AS VARCHAR) AS value
    FROM changed_transactions WHERE kind <> '2'
    UNION ALL SELECT 'transactions', id, CAST(approved AS VARCHAR) FROM transactions WHERE right(id, 1) = '3'
    UNION ALL SELECT 'accounts', id, CASE WHEN right(id, 1) = '5' THEN upper(name) ELSE name END FROM accounts
    UNION ALL SELECT 'account_summaries', account_id || ':' || month, CAST(balance AS VARCHAR)
      FROM account_summaries WHERE right(month, 2) <> '12'
    UNION ALL SELECT 'model_versions', space_id || ':' || version, weights_md5 FROM model_versions
    UNION ALL SELECT 'model_versions', space_id || ':' || (version + 1000), weights_md5 FROM model_versions
      WHERE version % 2 = 0
    UNION ALL SELECT 'spaces', id, CASE WHEN id = 's1' THEN 'renamed' ELSE name END FROM spaces""", _CAPTURED))
def _(led: GivenLedger) -> DataFrame:
    """Changes captured between two versions, applied to the first, give the second."""
    before, after = _versions(led, store=True)
    log = settle(capture.capture_changes(before, after, "dev-1", 0, AT), "log")
    out = replicate.apply_changes(before, log.withColumn("batch_no", F.lit(0)))

    def rows(table: str, key: F.Column, value: F.Column) -> DataFrame:
        return out[table].select(F.lit(table).alias("table_name"), key.alias("row_id"),
                                 value.cast("string").alias("value"))

    return (
        rows("transactions", F.col("id"), F.col("approved"))
        .unionByName(rows("accounts", F.col("id"), F.col("name")))
        .unionByName(rows("account_summaries", F.concat_ws(":", "account_id", "month"), F.col("balance")))
        .unionByName(rows("model_versions", F.concat_ws(":", "space_id", F.col("version").cast("string")),
                          F.col("weights_md5")))
        .unionByName(rows("spaces", F.col("id"), F.col("name")))
    )


@register("relogged_changes", ledger_sql("""
    SELECT row_id, 500 + row_number() OVER (PARTITION BY space_id ORDER BY batch_no, seq, id) AS seq,
           seq AS origin_seq, changed_at AS origin_changed_at
    FROM (SELECT *, seq // 3000 AS batch_no FROM change_log)"""))
def _(led: GivenLedger) -> DataFrame:
    changes = led.change_log.withColumn("batch_no", F.floor(F.col("seq") / 3000))
    return replicate.relogged(changes, 500, AT).select("row_id", "seq", "origin_seq", "origin_changed_at")


_MIXED = """
mixed AS (
  SELECT *, seq // 40 AS batch_no, CASE WHEN seq % 97 = 0 THEN 'spaces' WHEN seq % 31 = 0 THEN 'trusted_devices'
    ELSE table_name END AS kind_table,
    CASE WHEN seq % 31 = 0 AND seq % 97 <> 0 THEN space_id || '-d' || (seq % 4) ELSE row_id END AS kind_row
  FROM change_log)"""


def _mixed(led: GivenLedger) -> DataFrame:
    seq = F.col("seq")
    device_row = F.concat("space_id", F.lit("-d"), (seq % 4).cast("string"))
    return led.change_log.withColumn("batch_no", F.floor(seq / 40)).withColumn(
        "table_name", F.when(seq % 97 == 0, "spaces").when(seq % 31 == 0, "trusted_devices")
        .otherwise(F.col("table_name"))
    ).withColumn("row_id", F.when((seq % 31 == 0) & (seq % 97 != 0), device_row).otherwise(F.col("row_id")))


@register("classify_batches", ledger_sql("""
    SELECT space_id, device_id, batch_no,
      CASE WHEN bool_or(kind_table = 'spaces' AND operation = 'delete') THEN 'space_deletion'
           WHEN bool_or(kind_table = 'trusted_devices' AND operation = 'delete' AND device_id <> 'd1')
             THEN 'potential_eviction' ELSE 'normal' END AS kind
    FROM mixed GROUP BY 1, 2, 3""", _MIXED))
def _(led: GivenLedger) -> DataFrame:
    return replicate.classify_batches(_mixed(led), "d1")


@register("confirm_eviction", ledger_sql("""
    SELECT m.space_id, m.device_id AS author, m.batch_no, count(*) AS own_rows
    FROM mixed m JOIN trusted_devices d ON d.id = m.kind_row AND d.device_id = 'd1'
    WHERE m.kind_table = 'trusted_devices' AND m.operation = 'delete' GROUP BY 1, 2, 3""", _MIXED))
def _(led: GivenLedger) -> DataFrame:
    return replicate.confirm_eviction(_mixed(led), led.trusted_devices, "d1")


# ---- snapshots ----------------------------------------------------------------------
_SNAPSHOT = f"""
snapshot AS (
  SELECT id AS space_id, 0 AS table_rank, 'spaces' AS table_name, created_at AS lead, id AS key,
         {_json('spaces')} AS payload FROM spaces
  UNION ALL SELECT space_id, 1, 'space_members', joined_at, user_id, CAST(json_object('space_id', space_id,
         'user_id', user_id, 'role', role, 'joined_at', joined_at, 'user', NULL) AS VARCHAR) FROM space_members
  UNION ALL SELECT m.space_id, 2, 'users', name, id, {_json('users')}
         FROM (SELECT space_id, user_id FROM space_members) m JOIN users u ON u.id = m.user_id
  UNION ALL SELECT space_id, 3, 'categories', name, id, {_json('categories')} FROM categories
  UNION ALL SELECT space_id, 4, 'accounts', name, id, {_json('accounts')} FROM accounts
  UNION ALL SELECT h.home, 5, 'transactions', booking_date, id, {_json('transactions')}
         FROM transactions t JOIN (SELECT id AS acc, space_id AS home FROM accounts) h ON h.acc = t.account_id
  UNION ALL SELECT h.home, 6, 'account_summaries', month, account_id, {_json('account_summaries')}
         FROM account_summaries s JOIN (SELECT id AS acc, space_id AS home FROM accounts) h ON h.acc = s.account_id
  UNION ALL SELECT space_id, 7, 'space_settings', key, key, {_json('space_settings')} FROM space_settings
  UNION ALL SELECT space_id, 8, 'model_versions', lpad(CAST(version AS VARCHAR), 10, '0'),
         lpad(CAST(version AS VARCHAR), 10, '0'), {_json('model_versions')} FROM model_versions)"""


def _all_tables(led: GivenLedger) -> dict[str, DataFrame]:
    return _versions(led)[0]


@register("collect_snapshot", ledger_sql(
    "SELECT space_id, table_rank, table_name, key, payload FROM snapshot WHERE space_id <> 's3'", _SNAPSHOT))
def _(led: GivenLedger) -> DataFrame:
    tables = _all_tables(led)
    tables["spaces"] = led.spaces.withColumn("deleted", F.col("id") == "s3")
    return replicate.collect_snapshot(tables).drop("lead")


@register("chunk_snapshot", ledger_sql("""
    SELECT space_id, table_name, key, lead, CASE WHEN table_rank < 3 THEN 0 ELSE
      (row_number() OVER (PARTITION BY space_id, table_rank ORDER BY lead, key) - 1) // 500 END AS chunk
    FROM snapshot""", _SNAPSHOT))
def _(led: GivenLedger) -> DataFrame:
    return replicate.chunk_snapshot(replicate.collect_snapshot(_all_tables(led))).select(
        "space_id", "table_name", "key", "lead", "chunk")


@register("apply_snapshot", ledger_sql("""
    SELECT id, amount, balance, approved, category, account_id FROM transactions"""))
def _(led: GivenLedger) -> DataFrame:
    """A snapshot restores a replica that lost a third of its rows and flipped the rest."""
    tables = _all_tables(led)
    snapshot = replicate.with_active_setting(
        replicate.collect_snapshot(tables),
        led.model_versions.groupBy("space_id").agg(F.max("version").alias("version")), ACTIVE_MODEL_SETTING)
    stale = dict(tables)
    stale["transactions"] = tables["transactions"].where(F.crc32("id") % 3 != 0).withColumn(
        "approved", ~F.col("approved"))
    return replicate.apply_snapshot(stale, snapshot)["transactions"].select(
        "id", "amount", "balance", "approved", "category", "account_id")


@register("apply_snapshot_from", ledger_sql("""
    SELECT 'device' AS what, space_id, 'host' AS row_id, 'CERT-host' AS detail FROM (SELECT id AS space_id FROM spaces)
    UNION ALL SELECT 'device', space_id, device_id, cert_pem FROM trusted_devices
    UNION ALL SELECT 'host', a.space_id, t.id, 'insert' FROM base_transactions t JOIN accounts a ON a.id = t.account_id
      WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'host', a.space_id, t.id, 'update' FROM base_transactions t JOIN accounts a ON a.id = t.account_id
      WHERE o_orderkey % 3 <> 0"""))
def _(led: GivenLedger) -> DataFrame:
    """Devices after a host's snapshot, and the log rows it left: stamped with the host."""
    tables = {**_all_tables(led), "trusted_devices": led.trusted_devices, "change_log": led.change_log}
    stale = {**tables, "transactions": tables["transactions"].where(F.substring("id", 2, 20).cast("long") % 3 != 0).withColumn(
        "approved", ~F.col("approved"))}
    host = led.spaces.select(
        F.concat(F.lit("host-"), "id").alias("id"), F.col("id").alias("space_id"), F.lit("host").alias("device_id"),
        F.lit("Host").alias("display_name"), F.lit("CERT-host").alias("cert_pem"), F.lit(True).alias("sync_enabled"),
        F.lit(AS_OF).alias("paired_at"))
    out = replicate.apply_snapshot_from(stale, replicate.collect_snapshot(tables), host, "host", 0, AS_OF)
    devices = out["trusted_devices"].select(
        F.lit("device").alias("what"), "space_id", F.col("device_id").alias("row_id"), F.col("cert_pem").alias("detail"))
    logged = out["change_log"].where("device_id = 'host' and table_name = 'transactions'").select(
        F.col("device_id").alias("what"), "space_id", "row_id", F.col("operation").alias("detail"))
    return devices.unionByName(logged)


# ---- retention ----------------------------------------------------------------------
_PASSES = f"""
compacted AS (
  SELECT * FROM change_log QUALIFY row_number() OVER (PARTITION BY space_id, table_name, row_id
    ORDER BY seq DESC, id DESC) = 1),
bounds AS (
  SELECT d.space_id, min(coalesce(c.last_seq, -1)) AS consumed FROM trusted_devices d
  LEFT JOIN sync_cursors c ON c.space_id = d.space_id AND c.peer_device_id = d.device_id
  WHERE d.sync_enabled GROUP BY 1),
unconsumed AS (
  SELECT l.* FROM compacted l LEFT JOIN bounds b ON b.space_id = l.space_id
  WHERE b.consumed IS NULL OR l.seq > b.consumed),
capped AS (SELECT * FROM unconsumed WHERE changed_at >= '2024-01-16 12:00:00')"""


@register("compact_log", ledger_sql("SELECT * FROM compacted", _PASSES))
def _(led: GivenLedger) -> DataFrame:
    return retention.compact_log(led.change_log)


@register("drop_consumed", ledger_sql("""
    SELECT l.* FROM change_log l LEFT JOIN bounds b ON b.space_id = l.space_id
    WHERE b.consumed IS NULL OR l.seq > b.consumed""", _PASSES))
def _(led: GivenLedger) -> DataFrame:
    return retention.drop_consumed(led.change_log, led.trusted_devices, led.sync_cursors)


@register("cap_retention", ledger_sql(
    "SELECT * FROM change_log WHERE changed_at >= '2024-01-16 12:00:00'"))
def _(led: GivenLedger) -> DataFrame:
    return retention.cap_retention(led.change_log, AS_OF)


@register("purge_deleted_spaces", ledger_sql(keys_sql(kept_without("SELECT id FROM spaces WHERE id IN ('s1', 's3', 's4') AND id NOT IN (SELECT space_id FROM change_log)"))))
def _(led: GivenLedger) -> DataFrame:
    """Keys of all tables after soft-deleted spaces without log rows have gone."""
    spaces = led.spaces.withColumn("deleted", F.col("id").isin("s1", "s3", "s4"))
    return surviving_keys(retention.purge_spaces({**space_tables(led), "spaces": spaces}))


@register("purge_orphan_devices", ledger_sql("SELECT * FROM trusted_devices WHERE space_id <> 's0'"))
def _(led: GivenLedger) -> DataFrame:
    return retention.purge_orphan_devices(led.trusted_devices, led.spaces.where("id <> 's0'"))


@register("purge_orphan_users", ledger_sql("""
    SELECT * FROM users WHERE id IN (SELECT user_id FROM space_members WHERE role = 'owner')"""))
def _(led: GivenLedger) -> DataFrame:
    return retention.purge_orphan_users(led.users, led.space_members.where("role = 'owner'"))


_RETAINED = kept_without("SELECT id FROM purged") | {
    "trusted_devices": "space_id NOT IN (SELECT id FROM purged)",
    "users": "id IN (SELECT user_id FROM space_members WHERE space_id NOT IN (SELECT id FROM purged))"}
del _RETAINED["change_log"]


@register("run_retention", ledger_sql(
    f"SELECT 'change_log' AS table_name, id AS key FROM capped UNION ALL {keys_sql(_RETAINED)}", _PASSES, """
purged AS (SELECT id FROM spaces WHERE id IN ('s1', 's3') AND id NOT IN (SELECT space_id FROM capped))"""))
def _(led: GivenLedger) -> DataFrame:
    """Keys of all tables after every pass."""
    tables = {**space_tables(led), "spaces": led.spaces.withColumn("deleted", F.col("id").isin("s1", "s3"))}
    return surviving_keys(retention.run_retention(tables, AS_OF))
