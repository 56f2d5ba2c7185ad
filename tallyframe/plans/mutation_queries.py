"""Registered queries: table edits and the export / import of spaces.

The edit batches are derived from the given tables, so they grow with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import capture, mutate
from ..operators.filters import scope_to_space
from ..schemas import ACCOUNT_CHILDREN, KEYS, SPACE_CHILDREN, TABLES
from ..session import scratch_dir, settle
from ..sources import keyed_files, space_files
from ..sources.given import GivenLedger
from .catalog import register
from .oracle import keys_sql, ledger_sql

AT = "2025-05-05T05:05:05Z"


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *[p.cast("string") for p in parts])


def _slim(led: GivenLedger) -> DataFrame:
    return led.transactions(text=False, balance=False).select(
        "id", "amount", "approved", "note", "category", "account_id")


# ---- generic forms ------------------------------------------------------------------
_UPSERTED = ledger_sql("""
    SELECT coalesce(b.month, s.month) AS month, coalesce(b.account_id, s.account_id) AS account_id,
           coalesce(b.balance, s.balance) AS balance
    FROM account_summaries s FULL JOIN batch b ON b.account_id = s.account_id AND b.month = s.month""", """
batch AS (
  SELECT substr(value_date, 1, 7) AS month, account_id, amount AS balance FROM base_transactions
  WHERE approved QUALIFY row_number() OVER (PARTITION BY account_id, substr(value_date, 1, 7)
    ORDER BY value_date DESC, o_orderkey DESC) = 1)""")


def _month_values(led: GivenLedger) -> DataFrame:
    return led.transactions(text=False, balance=False).where("approved").select(
        F.substring("value_date", 1, 7).alias("month"), "account_id", F.col("amount").alias("balance"),
        "value_date", F.col("reference").cast("bigint").alias("key"))


@register("upsert", _UPSERTED)
def _(led: GivenLedger) -> DataFrame:
    """Summaries overwritten by the last approved amount of the month."""
    return mutate.upsert(led.account_summaries, _month_values(led), ["account_id", "month"],
                         [F.col("value_date"), F.col("key")])


@register("upsert_stored", _UPSERTED)
def _(led: GivenLedger) -> DataFrame:
    """The same into a stored table: files of the batch's key ranges are written anew, grown ones in parts."""
    keys = ["account_id", "month"]
    batch = mutate.last_per_key(_month_values(led), keys, [F.col("value_date"), F.col("key")]).select(*led.account_summaries.columns)
    root, batch = _stored(led, led.account_summaries, keys), settle(batch, "batch")
    keyed_files.edit_table(led.spark, root, batch, lambda t: mutate.upsert(t, batch, keys), inserts=True)
    return keyed_files.read_table(led.spark, root)


@register("insert_if_absent", ledger_sql("""
    SELECT id, name FROM users
    UNION ALL SELECT 'u' || o_orderkey, 'order ' || o_orderkey FROM orders
    WHERE 'u' || o_orderkey NOT IN (SELECT id FROM users)"""))
def _(led: GivenLedger) -> DataFrame:
    key = F.col("o_orderkey")
    batch = led.read("orders").select(_id("u", key).alias("id"), _id("order ", key).alias("name"))
    return mutate.insert_if_absent(led.users.select("id", "name"), batch, ["id"])


@register("upsert_keep_identity", ledger_sql("""
    SELECT coalesce(d.id, b.id) AS id, b.space_id, b.device_id, b.display_name, b.cert_pem, b.sync_enabled,
           b.paired_at
    FROM (SELECT DISTINCT 'remote-' || (user_id % 4) || '-' || (event_id % 5) AS id,
            's' || (user_id % 4) AS space_id, 'd' || (event_id % 5) AS device_id,
            'renamed' AS display_name, 'NEW' AS cert_pem, false AS sync_enabled,
            '2025-05-05T05:05:05Z' AS paired_at FROM events) b
    LEFT JOIN trusted_devices d ON d.space_id = b.space_id AND d.device_id = b.device_id"""))
def _(led: GivenLedger) -> DataFrame:
    space, device = F.col("user_id") % 4, F.col("event_id") % 5
    batch = led.read("events").select(
        F.concat(F.lit("remote-"), space.cast("string"), F.lit("-"), device.cast("string")).alias("id"),
        _id("s", space).alias("space_id"), _id("d", device).alias("device_id"),
        F.lit("renamed").alias("display_name"), F.lit("NEW").alias("cert_pem"),
        F.lit(False).alias("sync_enabled"), F.lit(AT).alias("paired_at")).distinct()
    return mutate.upsert_keep_identity(led.trusted_devices, batch)


@register("upsert_monotone", ledger_sql("""
    SELECT space_id, peer_device_id, max(last_seq) AS last_seq FROM (
      SELECT space_id, peer_device_id, last_seq FROM sync_cursors
      UNION ALL SELECT space_id, device_id, seq - 4000 FROM change_log) GROUP BY 1, 2"""))
def _(led: GivenLedger) -> DataFrame:
    batch = led.change_log.select(
        "space_id", F.col("device_id").alias("peer_device_id"), (F.col("seq") - 4000).alias("last_seq"))
    return mutate.upsert_monotone(led.sync_cursors, batch)


# ---- transactions -------------------------------------------------------------------
# an order's space is its customer's; the whole table with its texts is not needed for that
_REQUESTS = """
owned AS MATERIALIZED (
  SELECT 's' || n_regionkey AS space_id, 't' || o_orderkey AS id, o_orderkey % 2 = 0 AS approved,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Leisure' END AS new_category
  FROM orders JOIN customers ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = n_regionkey)"""


def _requests(led: GivenLedger) -> DataFrame:
    """Every third order asks for a change, most of them in a space that is not theirs."""
    key = F.col("o_orderkey")
    return led.read("orders").where(key % 3 == 0).select(
        _id("s", key % 5).alias("space_id"), _id("t", key).alias("id"), (key % 2 == 0).alias("approved"),
        F.when(key % 4 != 0, "Leisure").alias("category"))


_APPROVED = ledger_sql("""
    SELECT t.id, t.amount, coalesce(o.approved, t.approved) AS approved, t.note, t.category, t.account_id
    FROM base_transactions t LEFT JOIN owned o ON o.id = t.id""", _REQUESTS)
_CATEGORIZED = ledger_sql("""
    SELECT t.id, t.amount, t.approved, t.note,
           CASE WHEN o.id IS NULL THEN t.category ELSE o.new_category END AS category, t.account_id
    FROM base_transactions t LEFT JOIN owned o ON o.id = t.id""", _REQUESTS)


@register("bulk_approve", _APPROVED)
def _(led: GivenLedger) -> DataFrame:
    return mutate.bulk_approve(_slim(led), led.accounts, _requests(led).select("space_id", "id", "approved"))


@register("bulk_categorize", _CATEGORIZED)
def _(led: GivenLedger) -> DataFrame:
    return mutate.bulk_categorize(
        _slim(led), led.accounts, _requests(led).select("space_id", "id", "category"))


def _stored(led: GivenLedger, frame: DataFrame, keys: list[str]) -> str:
    """A frame as a table of keyed files; small ones, so that also small data has several."""
    root = scratch_dir(led.spark, "keyed")
    keyed_files.create_table(led.spark, root, frame, keys, file_rows=4000)
    return root


@register("bulk_approve_stored", _APPROVED)
def _(led: GivenLedger) -> DataFrame:
    """The same on a stored table, of which only the files with requested ids are written anew."""
    root, requests = _stored(led, _slim(led), ["id"]), _requests(led).select("space_id", "id", "approved")
    keyed_files.edit_table(led.spark, root, requests, lambda t: mutate.bulk_approve(t, led.accounts, requests))
    return keyed_files.read_table(led.spark, root)


@register("bulk_categorize_stored", _CATEGORIZED)
def _(led: GivenLedger) -> DataFrame:
    root, requests = _stored(led, _slim(led), ["id"]), _requests(led).select("space_id", "id", "category")
    keyed_files.edit_table(led.spark, root, requests, lambda t: mutate.bulk_categorize(t, led.accounts, requests))
    return keyed_files.read_table(led.spark, root)


@register("bulk_changed_counts", ledger_sql(
    "SELECT space_id, count(*) AS changed FROM owned GROUP BY 1", _REQUESTS))
def _(led: GivenLedger) -> DataFrame:
    return mutate.changed_counts(_slim(led), led.accounts, _requests(led))


_EDITS = """
edits AS (SELECT 't' || l_orderkey AS id, bool_or(l_returnflag = 'R') AS approved,
            'lines ' || count(*) AS note, min(l_linestatus) AS category
          FROM (SELECT l_orderkey * 2 AS l_orderkey, l_returnflag, l_linestatus FROM lineitem)
          GROUP BY l_orderkey)"""


def _edits(led: GivenLedger) -> DataFrame:
    return led.read("lineitem").groupBy(_id("t", F.col("l_orderkey") * 2).alias("id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("approved"),
        F.concat(F.lit("lines "), F.count(F.lit(1)).cast("string")).alias("note"),
        F.min("l_linestatus").alias("category"))


@register("update_transactions", ledger_sql("""
    SELECT t.id, t.amount, coalesce(e.approved, t.approved) AS approved, coalesce(e.note, t.note) AS note,
           CASE WHEN e.id IS NULL THEN t.category ELSE e.category END AS category, t.account_id
    FROM transactions t LEFT JOIN edits e ON e.id = t.id""", _EDITS))
def _(led: GivenLedger) -> DataFrame:
    return mutate.update_transactions(_slim(led), _edits(led))[0]


@register("unknown_transaction_edits", ledger_sql(
    "SELECT * FROM edits WHERE id NOT IN (SELECT id FROM transactions)", _EDITS))
def _(led: GivenLedger) -> DataFrame:
    return mutate.update_transactions(_slim(led), _edits(led))[1].select(
        "id", "approved", "note", "category")


# ---- categories ---------------------------------------------------------------------
def _category_tables(led: GivenLedger) -> dict[str, DataFrame]:
    return {"categories": led.categories, "transactions": _slim(led), "accounts": led.accounts}


_RENAMED = ledger_sql("""
    SELECT t.id, t.amount, t.approved, t.note,
           CASE WHEN t.category = 'Transport' AND a.space_id IN ('s1', 's3') THEN 'Travel'
                ELSE t.category END AS category, t.account_id
    FROM transactions t JOIN accounts a ON a.id = t.account_id""")


def _renames(led: GivenLedger) -> DataFrame:
    return led.categories.where("name = 'Transport' and space_id in ('s1', 's3')").select(
        "id", F.lit("Travel").alias("name"), F.lit("#000000").alias("color"))


@register("rename_category", _RENAMED)
def _(led: GivenLedger) -> DataFrame:
    return mutate.rename_categories(_category_tables(led), _renames(led))["transactions"]


@register("rename_category_stored", _RENAMED)
def _(led: GivenLedger) -> DataFrame:
    """The same on a stored table: three columns of it name the rows, and their files are written anew."""
    root = _stored(led, _slim(led), ["id"])
    moved = led.categories.join(_renames(led).select("id"), "id").select("space_id", F.col("name").alias("category"))
    slim = keyed_files.read_table(led.spark, root).select("id", "account_id", "category")
    touched = scope_to_space(slim, led.accounts).join(moved, ["space_id", "category"], "left_semi").select("id")

    def change(rows: DataFrame) -> DataFrame:
        return mutate.rename_categories({**_category_tables(led), "transactions": rows}, _renames(led))["transactions"]

    keyed_files.edit_table(led.spark, root, touched, change)
    return keyed_files.read_table(led.spark, root)


@register("renamed_categories", ledger_sql("""
    SELECT id, CASE WHEN color = '#123456' THEN upper(name) ELSE name END AS name,
           CASE WHEN color = '#123456' THEN '#fedcba' ELSE color END AS color, space_id FROM categories"""))
def _(led: GivenLedger) -> DataFrame:
    renames = led.part_categories.select(
        "id", F.upper("name").alias("name"), F.lit("#fedcba").alias("color"))
    return mutate.rename_categories(_category_tables(led), renames)["categories"]


@register("delete_category", ledger_sql("""
    SELECT t.id, t.amount, t.approved, t.note,
           CASE WHEN t.category IN ('Other', 'Salary') AND a.space_id <> 's0' THEN NULL
                ELSE t.category END AS category, t.account_id
    FROM transactions t JOIN accounts a ON a.id = t.account_id"""))
def _(led: GivenLedger) -> DataFrame:
    ids = led.categories.where("name in ('Other', 'Salary') and space_id <> 's0'").select("id")
    return mutate.delete_categories(_category_tables(led), ids)["transactions"]


_WISHES = """
wishes AS (
  SELECT 'n' || p_partkey AS id, trim(CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END) AS name,
         '#' || p_size AS color, 's' || (p_partkey % 7) AS space_id FROM part),
picked AS (
  SELECT id, name, color, space_id FROM wishes WHERE name <> ''
  QUALIFY row_number() OVER (PARTITION BY space_id, name ORDER BY id) = 1)"""


@register("create_categories", ledger_sql("""
    SELECT id, name, color, space_id FROM categories
    UNION ALL SELECT p.* FROM picked p WHERE NOT EXISTS
      (SELECT 1 FROM categories c WHERE c.space_id = p.space_id AND c.name = p.name)""", _WISHES))
def _(led: GivenLedger) -> DataFrame:
    key = F.col("p_partkey")
    wishes = led.read("part").select(
        _id("n", key).alias("id"),
        F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"),
        F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("color"),
        _id("s", key % 7).alias("space_id"))
    return mutate.create_categories(led.categories, wishes)[0]


@register("seed_default_categories", ledger_sql("""
    SELECT 'n' || c_custkey || '_' || substr(d.id, 4) AS id, d.name, d.color, 'n' || c_custkey AS space_id
    FROM customer CROSS JOIN (SELECT * FROM default_categories WHERE space_id = 's0') d"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.seed_default_categories(
        led.read("customer").select(_id("n", F.col("c_custkey")).alias("id")))


# ---- accounts and summaries ---------------------------------------------------------
@register("update_accounts", ledger_sql("""
    SELECT a.id, CASE WHEN hit THEN upper(a.name) ELSE a.name END AS name, a.currency, a.account_type,
           a.account_source, CASE WHEN hit THEN '#0f0' ELSE a.color END AS color, a.space_id
    FROM (SELECT *, space_id = 's' || (CAST(substr(id, 2) AS BIGINT) % 5) AS hit FROM accounts) a"""))
def _(led: GivenLedger) -> DataFrame:
    edits = led.accounts.select(
        "id", _id("s", F.substr("id", F.lit(2)).cast("bigint") % 5).alias("space_id"),
        F.upper("name").alias("name"), F.lit("#0f0").alias("color"))
    return mutate.update_accounts(led.accounts, edits)


_DOOMED = "doomed AS (SELECT id FROM accounts WHERE account_type = 'credit' AND space_id = 's' || (CAST(substr(id, 2) AS BIGINT) % 5))"


def _account_tables(led: GivenLedger) -> tuple[dict[str, DataFrame], DataFrame]:
    requests = led.accounts.where("account_type = 'credit'").select(
        "id", _id("s", F.substr("id", F.lit(2)).cast("bigint") % 5).alias("space_id"))
    return {"accounts": led.accounts, "transactions": _slim(led),
            "account_summaries": led.account_summaries}, requests


@register("delete_accounts", ledger_sql("""
    SELECT id, amount, account_id FROM transactions WHERE account_id NOT IN (SELECT id FROM doomed)""", _DOOMED))
def _(led: GivenLedger) -> DataFrame:
    tables, requests = _account_tables(led)
    return mutate.delete_accounts(tables, requests)["transactions"].select("id", "amount", "account_id")


@register("delete_accounts_remaining", ledger_sql(
    "SELECT id, name, space_id FROM accounts WHERE id NOT IN (SELECT id FROM doomed)", _DOOMED))
def _(led: GivenLedger) -> DataFrame:
    tables, requests = _account_tables(led)
    return mutate.delete_accounts(tables, requests)["accounts"].select("id", "name", "space_id")


@register("delete_summaries", ledger_sql("""
    SELECT * FROM account_summaries s WHERE NOT (substr(month, 6) IN ('01', '06') AND EXISTS (
      SELECT 1 FROM accounts a WHERE a.id = s.account_id AND a.space_id IN ('s0', 's1')))"""))
def _(led: GivenLedger) -> DataFrame:
    wanted = led.account_summaries.where(F.substring("month", 6, 2).isin("01", "06")).select(
        "account_id", "month", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("space_id"))
    return mutate.delete_summaries(led.account_summaries, led.accounts, wanted)


# ---- spaces, members, users ---------------------------------------------------------
def _space_wishes(led: GivenLedger) -> DataFrame:
    key = F.col("c_custkey")
    return led.read("customer").select(
        _id("n", key).alias("id"),
        F.when(key % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"),
        _id("u", key).alias("user_id"))


@register("create_spaces", ledger_sql(f"""
    SELECT 'n' || c_custkey AS id, c_name AS name, '{AT}' AS created_at, '{AT}' AS updated_at, false AS deleted
    FROM customer WHERE c_custkey % 7 <> 0"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.create_spaces(_space_wishes(led), AT)["spaces"]


@register("create_spaces_members", ledger_sql(f"""
    SELECT 'n' || c_custkey AS space_id, 'u' || c_custkey AS user_id, 'owner' AS role, '{AT}' AS joined_at
    FROM customer WHERE c_custkey % 7 <> 0"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.create_spaces(_space_wishes(led), AT)["space_members"]


def _rename_requests(led: GivenLedger) -> DataFrame:
    return led.space_members.select(
        "space_id", "user_id",
        F.when(F.col("user_id").endswith("5"), " ").otherwise(F.concat("space_id", F.lit("/"), "user_id"))
        .alias("name"))


@register("rename_spaces", ledger_sql("""
    SELECT s.id, coalesce(s.id || '/' || r.user_id, s.name) AS name, s.created_at, s.updated_at, s.deleted
    FROM spaces s LEFT JOIN (SELECT space_id, max(user_id) AS user_id FROM space_members
      WHERE role = 'owner' AND NOT ends_with(user_id, '5') GROUP BY 1) r ON r.space_id = s.id"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.rename_spaces(led.spaces, led.space_members, _rename_requests(led))[0]


@register("rename_spaces_refused", ledger_sql("""
    SELECT space_id, user_id FROM space_members WHERE role <> 'owner' OR ends_with(user_id, '5')"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.rename_spaces(led.spaces, led.space_members, _rename_requests(led))[1].select(
        "space_id", "user_id")


def _user_renames(led: GivenLedger) -> DataFrame:
    key = F.col("s_suppkey")
    return led.read("supplier").select(
        _id("u", key * 20).alias("id"), F.when(key % 9 == 0, "").otherwise(F.col("s_name")).alias("name"))


@register("rename_users", ledger_sql("""
    SELECT u.id, coalesce(s.s_name, u.name) AS name, u.pin_hash, u.created_at, u.updated_at FROM users u
    LEFT JOIN supplier s ON u.id = 'u' || (s_suppkey * 20) AND s_suppkey % 9 <> 0"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.rename_users(led.users, _user_renames(led))[0]


@register("rename_users_refused", ledger_sql("""
    SELECT 'u' || (s_suppkey * 20) AS id FROM supplier
    WHERE s_suppkey % 9 = 0 OR 'u' || (s_suppkey * 20) NOT IN (SELECT id FROM users)"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.rename_users(led.users, _user_renames(led))[1].select("id")


def _people(led: GivenLedger) -> dict[str, DataFrame]:
    return {"users": led.users, "space_members": led.space_members}


@register("remove_users", ledger_sql("""
    SELECT space_id, user_id, role FROM space_members WHERE NOT (ends_with(user_id, '0') OR ends_with(user_id, '3'))
      OR user_id IN (SELECT user_id FROM space_members WHERE role = 'owner')"""))
def _(led: GivenLedger) -> DataFrame:
    requests = led.users.where(F.col("id").endswith("0") | F.col("id").endswith("3")).select("id")
    return mutate.remove_users(_people(led), requests)[0]["space_members"].select(
        "space_id", "user_id", "role")


@register("remove_users_refused", ledger_sql("""
    SELECT id FROM users WHERE (ends_with(id, '0') OR ends_with(id, '3'))
      AND id IN (SELECT user_id FROM space_members WHERE role = 'owner')"""))
def _(led: GivenLedger) -> DataFrame:
    requests = led.users.where(F.col("id").endswith("0") | F.col("id").endswith("3")).select("id")
    return mutate.remove_users(_people(led), requests)[1]


@register("edit_members", ledger_sql(f"""
    SELECT m.space_id, m.user_id, CASE WHEN m.user_id LIKE '%4' THEN 'owner' ELSE m.role END AS role, m.joined_at
    FROM space_members m WHERE m.user_id NOT LIKE '%7'
    UNION ALL SELECT 's0', u.id, 'member', '{AT}' FROM users u
    WHERE u.id LIKE '%9' AND u.id NOT IN (SELECT user_id FROM space_members WHERE space_id = 's0')"""))
def _(led: GivenLedger) -> DataFrame:
    """Users ending in 7 are removed, in 4 promoted; those ending in 9 are added to one space.

    Half of the edits are signed by someone who is no owner and must have no effect.
    """
    members = led.space_members
    owners = members.where("role = 'owner'").groupBy("space_id").agg(F.min("user_id").alias("by_user"))
    ending = F.substring("user_id", -1, 1)
    own = members.where(ending.isin("7", "4")).select(
        "space_id", "user_id", F.when(ending == "7", "remove").otherwise("role").alias("action"),
        F.lit("owner").alias("role"))
    added = led.users.where(F.col("id").endswith("9")).select(
        F.lit("s0").alias("space_id"), F.col("id").alias("user_id"), F.lit("add").alias("action"),
        F.lit("member").alias("role"))
    signed = own.unionByName(added).join(owners, "space_id")
    forged = members.where(ending == "1").select(
        "space_id", "user_id", F.lit("remove").alias("action"), F.lit("owner").alias("role"),
        F.lit("u1").alias("by_user"))
    return mutate.edit_members(members, led.users, signed.unionByName(forged.select(*signed.columns)), AT)


@register("leave_space", ledger_sql(
    "SELECT space_id, user_id, role FROM space_members WHERE NOT (role = 'member' AND space_id <> 's1')"))
def _(led: GivenLedger) -> DataFrame:
    requests = led.space_members.where("role = 'member' and space_id <> 's1'").select("space_id", "user_id")
    return mutate.leave_space(led.space_members, requests)[0].select("space_id", "user_id", "role")


@register("leave_space_refused", """
    SELECT 'p' || s_suppkey AS space_id, 'u' || s_suppkey AS user_id FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(led: GivenLedger) -> DataFrame:
    """Private spaces with one or two members; the last member may not leave."""
    key = F.col("s_suppkey")
    supplier = led.read("supplier")
    role = F.lit("member").alias("role")
    alone = supplier.select(_id("p", key).alias("space_id"), _id("u", key).alias("user_id"), role)
    second = supplier.where(key % 3 == 0).select(
        _id("p", key).alias("space_id"), _id("v", key).alias("user_id"), role)
    members = alone.unionByName(second)
    return mutate.leave_space(members, alone.select("space_id", "user_id"))[1]


def space_tables(led: GivenLedger) -> dict[str, DataFrame]:
    """Every table that has to do with spaces; transactions without their texts."""
    return {
        "spaces": led.spaces, "users": led.users, "space_members": led.space_members, "space_settings": led.space_settings,
        "categories": led.categories, "accounts": led.accounts, "transactions": _slim(led),
        "account_summaries": led.account_summaries, "trusted_devices": led.trusted_devices,
        "evicted_devices": led.evicted_devices, "sync_cursors": led.sync_cursors, "change_log": led.change_log,
        "sync_conflicts": led.sync_conflicts, "model_versions": led.model_versions,
    }


def surviving_keys(tables: dict[str, DataFrame], names=None) -> DataFrame:
    """(table_name, key) of every row of every table."""
    frames = [f.select(F.lit(n).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS[n]]).alias("key"))
              for n, f in tables.items() if names is None or n in names]
    return reduce(DataFrame.unionByName, frames)


def kept_without(spaces: str) -> dict[str, str]:
    """Conditions, for each table, of what is left when these spaces go for good."""
    in_space, of_account = f"space_id NOT IN ({spaces})", f"account_id IN (SELECT id FROM accounts WHERE space_id NOT IN ({spaces}))"
    return {n: f"id NOT IN ({spaces})" if n == "spaces" else in_space if n in SPACE_CHILDREN
            else of_account if n in ACCOUNT_CHILDREN else "true" for n in TABLES}


_GONE = "'s1', 's3'"
_DELETED = kept_without(_GONE) | {n: "true" for n in ("spaces", "evicted_devices", "sync_cursors", "sync_conflicts", "model_versions")}
del _DELETED["change_log"]


@register("delete_space", ledger_sql(f"""
    {keys_sql(_DELETED)}
    UNION ALL SELECT 'deleted', id FROM spaces WHERE id IN ({_GONE})
    UNION ALL SELECT 'logged ' || table_name, row_id FROM change_log
    UNION ALL SELECT 'logged space_members', space_id || ':' || user_id FROM space_members WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged space_settings', space_id || ':' || key FROM space_settings WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged categories', id FROM categories WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged accounts', id FROM accounts WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged transactions', t.id FROM base_transactions t JOIN accounts a ON a.id = account_id WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged account_summaries', account_id || ':' || month FROM account_summaries
      JOIN accounts a ON a.id = account_id WHERE space_id IN ({_GONE})
    UNION ALL SELECT 'logged spaces', id FROM spaces WHERE id IN ({_GONE})
    UNION ALL SELECT 'last', id FROM spaces WHERE id IN ({_GONE})"""))
def _(led: GivenLedger) -> DataFrame:
    """Owners delete two spaces; a member's request for a third is refused. Keys of all tables and of the log."""
    by_owner = led.space_members.where("role = 'owner' and space_id in ('s1', 's3')")
    by_member = led.space_members.where("role = 'member' and space_id = 's2'")
    requests = by_owner.unionByName(by_member).select("space_id", "user_id")
    before = {**space_tables(led), "transactions": led.transactions(text=False, balance=False).withColumns(
        {"text": F.lit(""), "balance": F.lit(0).cast("long")})}
    after, _gone = capture.delete_spaces_logged(before, requests, "host", 10**9, AT)
    log = after.pop("change_log")
    keys = surviving_keys(after).unionByName(
        after["spaces"].where("deleted").select(F.lit("deleted").alias("table_name"), F.col("id").alias("key")))
    logged = log.select(F.concat(F.lit("logged "), "table_name").alias("table_name"), F.col("row_id").alias("key"))
    last = log.groupBy("space_id").agg(F.max_by("table_name", "seq").alias("t")).where("t = 'spaces'").select(
        F.lit("last").alias("table_name"), F.col("space_id").alias("key"))
    return keys.unionByName(logged).unionByName(last)


@register("evict_space", ledger_sql(keys_sql(kept_without(_GONE) | {"change_log": f"space_id NOT IN ({_GONE})"})))
def _(led: GivenLedger) -> DataFrame:
    spaces = led.spaces.where("id in ('s1', 's3')").select(F.col("id").alias("space_id"))
    return surviving_keys(mutate.evict_spaces(space_tables(led), spaces))


# ---- devices ------------------------------------------------------------------------
@register("revoke_devices", ledger_sql("""
    SELECT space_id, device_id, cert_pem FROM evicted_devices
    UNION SELECT space_id, device_id, cert_pem FROM trusted_devices WHERE device_id IN ('d0', 'd3')"""))
def _(led: GivenLedger) -> DataFrame:
    requests = led.change_log.where("device_id in ('d0', 'd3')").select("space_id", "device_id").distinct()
    tables = {"trusted_devices": led.trusted_devices, "evicted_devices": led.evicted_devices}
    return mutate.revoke_devices(tables, requests)["evicted_devices"]


@register("clear_tombstones", ledger_sql("""
    SELECT * FROM evicted_devices WHERE space_id NOT IN (SELECT space_id FROM change_log WHERE row_id = 't4')"""))
def _(led: GivenLedger) -> DataFrame:
    exchanged = led.change_log.where("row_id = 't4'").select(
        "space_id", F.lit("d9").alias("device_id")).distinct()
    return mutate.clear_tombstones(led.evicted_devices, exchanged)


def _arrivals(led: GivenLedger) -> tuple[dict[str, DataFrame], DataFrame]:
    key = F.col("s_suppkey")
    arrivals = led.read("supplier").select(
        _id("r", key).alias("device_row_id"), _id("s", key % 5).alias("space_id"),
        _id("d", key).alias("device_id"), F.col("s_name").alias("display_name"),
        F.lit("CERT").alias("cert_pem"), _id("u", key * 40).alias("user_id"),
        F.col("s_name").alias("user_name"))
    tables = {"users": led.users, "space_members": led.space_members,
              "trusted_devices": led.trusted_devices}
    return tables, arrivals


@register("admit_devices", ledger_sql(f"""
    SELECT coalesce(d.id, 'r' || s.s_suppkey) AS id, coalesce(d.space_id, 's' || (s_suppkey % 5)) AS space_id,
           coalesce(d.device_id, 'd' || s_suppkey) AS device_id, coalesce(s.s_name, d.display_name) AS display_name,
           CASE WHEN s.s_name IS NULL THEN d.cert_pem ELSE 'CERT' END AS cert_pem,
           s.s_name IS NOT NULL OR d.sync_enabled AS sync_enabled, coalesce(d.paired_at, '{AT}') AS paired_at
    FROM trusted_devices d FULL JOIN supplier s
      ON d.space_id = 's' || (s_suppkey % 5) AND d.device_id = 'd' || s_suppkey"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.admit_devices(*_arrivals(led), AT)["trusted_devices"]


@register("admit_devices_users", ledger_sql(f"""
    SELECT coalesce(u.id, 'u' || s_suppkey * 40) AS id, coalesce(s.s_name, u.name) AS name,
           CASE WHEN s.s_name IS NULL THEN u.pin_hash END AS pin_hash,
           coalesce(u.created_at, '{AT}') AS created_at,
           CASE WHEN s.s_name IS NULL THEN u.updated_at ELSE '{AT}' END AS updated_at
    FROM users u FULL JOIN supplier s ON u.id = 'u' || (s_suppkey * 40)"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.admit_devices(*_arrivals(led), AT)["users"]


@register("admit_devices_members", ledger_sql(f"""
    SELECT coalesce(m.space_id, 's' || (s_suppkey % 5)) AS space_id, coalesce(m.user_id, 'u' || s_suppkey * 40) AS user_id,
           CASE WHEN s.s_name IS NULL THEN m.role ELSE 'member' END AS role, coalesce(m.joined_at, '{AT}') AS joined_at
    FROM space_members m FULL JOIN supplier s
      ON m.space_id = 's' || (s_suppkey % 5) AND m.user_id = 'u' || (s_suppkey * 40)"""))
def _(led: GivenLedger) -> DataFrame:
    return mutate.admit_devices(*_arrivals(led), AT)["space_members"]


# ---- export and import --------------------------------------------------------------
def _export_tables(led: GivenLedger) -> dict[str, DataFrame]:
    return {"spaces": led.spaces.withColumn("deleted", F.col("id") == "s4"), "categories": led.categories,
            "accounts": led.accounts, "transactions": led.transactions(),
            "account_summaries": led.account_summaries}


@register("export_counts", ledger_sql("""
    SELECT s.id AS space_id, (SELECT count(*) FROM categories c WHERE c.space_id = s.id) AS categories,
      (SELECT count(*) FROM accounts a WHERE a.space_id = s.id) AS accounts,
      (SELECT count(*) FROM transactions t JOIN accounts a ON a.id = t.account_id WHERE a.space_id = s.id) AS transactions,
      (SELECT count(*) FROM account_summaries t JOIN accounts a ON a.id = t.account_id WHERE a.space_id = s.id)
        AS account_summaries
    FROM spaces s WHERE s.id <> 's4'"""))
def _(led: GivenLedger) -> DataFrame:
    return space_files.export_counts(space_files.export_rows(_export_tables(led)))


@register("import_space", ledger_sql("""
    SELECT t.id, t.booking_date, t.text, t.amount, t.balance, t.approved,
           CASE WHEN a.space_id <> 's4' THEN coalesce(t.category, '') ELSE t.category END AS category, t.account_id
    FROM transactions t JOIN accounts a ON a.id = t.account_id"""))
def _(led: GivenLedger) -> DataFrame:
    """Export all live spaces to files and import them again over the ledger.

    A missing category comes back as an empty text; the deleted space stays as it was.
    """
    tables = _export_tables(led)
    path = scratch_dir(led.spark, "export")
    space_files.export_spaces(tables, path, AT)
    merged = space_files.import_spaces(tables, space_files.read_export_parts(led.spark, path))
    return merged["transactions"].select(
        "id", "booking_date", "text", "amount", "balance", "approved", "category", "account_id")


@register("table_versions", ledger_sql("""
    SELECT id, approved OR substr(id, -1) = '1' AS approved FROM transactions"""))
def _(led: GivenLedger) -> DataFrame:
    """Write two versions of a table and read the published one."""
    from ..sources.versions import read_version, write_version

    root = scratch_dir(led.spark, "versions")
    rows = led.transactions(text=False, balance=False).select("id", "approved")
    write_version(led.spark, root, "transactions", rows, ["id"])
    first = read_version(led.spark, root, "transactions")
    edited = first.withColumn("approved", F.col("approved") | (F.substring("id", -1, 1) == "1"))
    write_version(led.spark, root, "transactions", edited, ["id"])
    return read_version(led.spark, root, "transactions")
