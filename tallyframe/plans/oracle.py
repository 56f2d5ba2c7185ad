"""The ledger mapping as DuckDB common table expressions, for the comparison queries."""

from __future__ import annotations

from ..schemas import DEFAULT_CATEGORIES, KEYS

_EPOCH = "'2024-01-01T00:00:00Z'"
_DEFAULTS = ", ".join(f"('{s}', '{n}', '{c}')" for s, n, c in DEFAULT_CATEGORIES)

LEDGER = f"""
spaces AS (
  SELECT 's' || r_regionkey AS id, r_name AS name, {_EPOCH} AS created_at,
         {_EPOCH} AS updated_at, false AS deleted FROM region),
customers AS (
  SELECT c.*, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
users AS (
  SELECT 'u' || c_custkey AS id, c_name AS name,
         CASE WHEN c_custkey % 2 = 1 THEN md5(c_name) END AS pin_hash,
         {_EPOCH} AS created_at, {_EPOCH} AS updated_at FROM customer),
space_members AS (
  SELECT 's' || n_regionkey AS space_id, 'u' || c_custkey AS user_id,
         CASE WHEN c_custkey % 5 = 0 THEN 'owner' ELSE 'member' END AS role,
         {_EPOCH} AS joined_at FROM customers
  UNION ALL
  SELECT 's' || ((n_regionkey + 1) % 5), 'u' || c_custkey,
         CASE WHEN c_custkey % 10 = 0 THEN 'owner' ELSE 'member' END, {_EPOCH}
  FROM customers WHERE c_custkey % 3 = 0),
accounts AS (
  SELECT 'a' || c_custkey AS id, c_name AS name, 'SEK' AS currency,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'checking' WHEN 'BUILDING' THEN 'savings'
           WHEN 'MACHINERY' THEN 'investment' WHEN 'AUTOMOBILE' THEN 'credit' ELSE 'other' END
           AS account_type,
         'import' AS account_source, '#6b7280' AS color, 's' || n_regionkey AS space_id
  FROM customers),
default_categories AS (
  SELECT s.id || '_' || d.suffix AS id, d.name, d.color, s.id AS space_id
  FROM spaces s CROSS JOIN (VALUES {_DEFAULTS}) d(suffix, name, color)),
categories AS (
  SELECT id, name, color, space_id FROM default_categories
  UNION ALL
  SELECT DISTINCT 's' || (p_partkey % 5) || '_' || p_name, p_name, '#123456',
         's' || (p_partkey % 5) FROM part),
base_transactions AS (
  SELECT 't' || o_orderkey AS id, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS booking_date,
         substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS value_date,
         CAST(o_orderkey AS VARCHAR) AS reference, p_name || '/' || o_orderkey AS text,
         'SEK' AS currency,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE -1 END
           * CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         o_orderstatus <> 'P' AS approved, '' AS note,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'Salary'
           WHEN o_orderpriority = '2-HIGH' THEN 'Transport'
           WHEN o_orderpriority = '3-MEDIUM' THEN 'Food & Drinks'
           WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Other' ELSE 'Shopping' END AS category,
         'a' || o_custkey AS account_id, o_orderkey
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
transactions AS (
  SELECT id, booking_date, value_date, reference, text, currency, amount,
         CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY value_date, o_orderkey
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance,
         approved, note, category, account_id
  FROM base_transactions),
account_summaries AS (
  SELECT substr(value_date, 1, 7) AS month, account_id, CAST(sum(amount) AS BIGINT) AS balance
  FROM base_transactions
  WHERE account_id IN (SELECT 'a' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'
    OR (c_mktsegment = 'HOUSEHOLD' AND c_custkey % 5 = 0))
  GROUP BY 1, 2),
space_settings AS (
  SELECT 's' || (s_suppkey % 5) AS space_id, 'k' || s_suppkey AS key, s_name AS value FROM supplier
  UNION ALL
  SELECT id, 'active_model_version', CASE WHEN id = 's4' THEN 'x' ELSE '3' END FROM spaces),
model_versions AS (
  SELECT 's' || (s_suppkey % 5) AS space_id, s_suppkey // 5 + 1 AS version,
         md5('w' || s_suppkey) AS weights_md5, md5('c' || s_suppkey) AS card_md5,
         {_EPOCH} AS trained_at FROM supplier),
event_rows AS (
  SELECT *, replace(substr(CAST(ts AS VARCHAR), 1, 19), ' ', 'T') || 'Z' AS at_text FROM events),
change_log AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 's' || (user_id % 3) AS space_id,
         'transactions' AS table_name, 't' || user_id AS row_id,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END
           AS operation,
         CASE WHEN event_type <> 'error' THEN CAST(json_object(
           'id', 't' || user_id, 'booking_date', substr(at_text, 1, 10), 'value_date', substr(at_text, 1, 10),
           'reference', CAST(event_id AS VARCHAR), 'text', event_type || ' ' || user_id,
           'currency', 'SEK', 'amount', CAST(round(value * 100) AS BIGINT), 'balance', 0,
           'approved', event_id % 2, 'note', 'n' || (event_id % 3),
           'category', CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'Shopping'
              WHEN 'purchase' THEN 'Transport' ELSE 'Other' END,
           'account_id', 'a' || user_id) AS VARCHAR) END AS payload,
         event_id + 1 AS seq, 'd' || (event_id % 4) AS device_id, at_text AS changed_at
  FROM event_rows),
decoded_log AS (
  SELECT l.*, e.event_type, e.event_id, e.user_id,
         CASE e.event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'Shopping'
           WHEN 'purchase' THEN 'Transport' ELSE 'Other' END AS new_category,
         'n' || (e.event_id % 3) AS new_note, CAST(round(e.value * 100) AS BIGINT) AS new_amount
  FROM change_log l JOIN event_rows e ON l.id = CAST(e.event_id AS VARCHAR)),
trusted_devices AS (
  SELECT DISTINCT space_id || '-' || device_id AS id, space_id, device_id,
         'device ' || device_id AS display_name, 'CERT-' || space_id || '-' || device_id AS cert_pem,
         device_id <> 'd3' AS sync_enabled, {_EPOCH} AS paired_at FROM change_log),
evicted_devices AS (
  SELECT space_id, 'd9' AS device_id, cert_pem FROM trusted_devices WHERE device_id = 'd3'),
sync_cursors AS (
  SELECT space_id, device_id AS peer_device_id, max(seq) // 2 AS last_seq FROM change_log
  WHERE NOT (space_id = 's2' AND device_id = 'd2') GROUP BY 1, 2),
sync_conflicts AS (
  SELECT 'c' || id AS id, space_id, row_id FROM change_log WHERE seq % 10 = 0)
"""
# The key of each table's rows, as one text.
KEY_SQL = {name: " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) for name, keys in KEYS.items()}


def keys_sql(kept: dict[str, str]) -> str:
    """(table_name, key) of the rows that a condition keeps, for each table."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, {KEY_SQL[n]} AS key FROM {n} WHERE {w}" for n, w in kept.items())



def ledger_sql(body: str, *more: str) -> str:
    """`body` (a SELECT) over the ledger tables, with further CTEs in between."""
    ctes = ",\n".join([LEDGER.strip(), *[m.strip() for m in more]])
    return f"WITH {ctes}\n{body.strip()}"
