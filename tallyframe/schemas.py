"""Table shapes shared by sources, operators and streams.

Dates and timestamps stay ISO text at the table boundary because their string order is
part of the contract; money is a signed count of minor units.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, FLAG = T.StringType(), T.LongType(), T.BooleanType()


def _table(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else False) for c in columns])


USERS = _table(
    ("id", TEXT), ("name", TEXT), ("pin_hash", TEXT, True),
    ("created_at", TEXT), ("updated_at", TEXT),
)
SPACES = _table(
    ("id", TEXT), ("name", TEXT), ("created_at", TEXT), ("updated_at", TEXT), ("deleted", FLAG),
)
SPACE_MEMBERS = _table(("space_id", TEXT), ("user_id", TEXT), ("role", TEXT), ("joined_at", TEXT))
SPACE_SETTINGS = _table(("space_id", TEXT), ("key", TEXT), ("value", TEXT))
CATEGORIES = _table(("id", TEXT), ("name", TEXT), ("color", TEXT), ("space_id", TEXT))
ACCOUNTS = _table(
    ("id", TEXT), ("name", TEXT), ("currency", TEXT), ("account_type", TEXT),
    ("account_source", TEXT), ("color", TEXT), ("space_id", TEXT),
)
TRANSACTIONS = _table(
    ("id", TEXT), ("booking_date", TEXT), ("value_date", TEXT), ("reference", TEXT),
    ("text", TEXT), ("currency", TEXT), ("amount", LONG), ("balance", LONG),
    ("approved", FLAG), ("note", TEXT), ("category", TEXT, True), ("account_id", TEXT),
)
ACCOUNT_SUMMARIES = _table(("month", TEXT), ("account_id", TEXT), ("balance", LONG))
TRUSTED_DEVICES = _table(
    ("id", TEXT), ("space_id", TEXT), ("device_id", TEXT), ("display_name", TEXT),
    ("cert_pem", TEXT), ("sync_enabled", FLAG), ("paired_at", TEXT),
)
EVICTED_DEVICES = _table(("space_id", TEXT), ("device_id", TEXT), ("cert_pem", TEXT))
SYNC_CURSORS = _table(("space_id", TEXT), ("peer_device_id", TEXT), ("last_seq", LONG))
CHANGE_LOG = _table(
    ("id", TEXT), ("space_id", TEXT), ("table_name", TEXT), ("row_id", TEXT),
    ("operation", TEXT), ("payload", TEXT, True), ("seq", LONG), ("device_id", TEXT),
    ("changed_at", TEXT),
)
SYNC_CONFLICTS = _table(
    ("id", TEXT), ("space_id", TEXT), ("table_name", TEXT), ("row_id", TEXT), ("field", TEXT),
    ("local_value", TEXT, True), ("remote_value", TEXT, True), ("local_changed_at", TEXT),
    ("remote_changed_at", TEXT), ("resolved", FLAG), ("created_at", TEXT),
)
MODEL_VERSIONS = _table(
    ("space_id", TEXT), ("version", LONG), ("weights_md5", TEXT), ("card_md5", TEXT),
    ("trained_at", TEXT),
)

TABLES = {
    "users": USERS, "spaces": SPACES, "space_members": SPACE_MEMBERS,
    "space_settings": SPACE_SETTINGS, "categories": CATEGORIES, "accounts": ACCOUNTS,
    "transactions": TRANSACTIONS, "account_summaries": ACCOUNT_SUMMARIES,
    "trusted_devices": TRUSTED_DEVICES, "evicted_devices": EVICTED_DEVICES,
    "sync_cursors": SYNC_CURSORS, "change_log": CHANGE_LOG,
    "sync_conflicts": SYNC_CONFLICTS, "model_versions": MODEL_VERSIONS,
}

KEYS = {
    "users": ["id"], "spaces": ["id"], "space_members": ["space_id", "user_id"],
    "space_settings": ["space_id", "key"], "categories": ["id"], "accounts": ["id"],
    "transactions": ["id"], "account_summaries": ["account_id", "month"],
    "trusted_devices": ["id"], "evicted_devices": ["space_id", "device_id"],
    "sync_cursors": ["space_id", "peer_device_id"], "change_log": ["id"],
    "sync_conflicts": ["id"], "model_versions": ["space_id", "version"],
}

# What a hard-deleted space takes with it: the tables that name a space, and those that name an
# account of one. The change log and the trusted devices don't follow; they have passes of
# their own.
SPACE_CHILDREN = [t for t, s in TABLES.items()
                  if "space_id" in s.names and t not in ("change_log", "trusted_devices")]
ACCOUNT_CHILDREN = [t for t, s in TABLES.items() if "account_id" in s.names]

# Tables whose row changes are logged, parents before children. The position is the
# order in which upserts are numbered; deletes are numbered in the opposite order.
LOGGED = [
    "spaces", "space_members", "categories", "accounts", "transactions",
    "account_summaries", "space_settings", "trusted_devices", "model_versions",
]

ACCOUNT_TYPES = ["checking", "savings", "investment", "credit", "loan", "other"]

_INT_IN_JSON = {"approved", "sync_enabled"}


def payload_schema(table: str) -> T.StructType:
    """The JSON snapshot of a logged row; flags travel as 0/1 integers."""
    fields = [
        T.StructField(f.name, LONG if f.name in _INT_IN_JSON else f.dataType, f.nullable)
        for f in TABLES[table].fields
        if not (table == "spaces" and f.name == "deleted")
    ]
    if table == "space_members":
        fields.append(T.StructField("user", USERS, True))
    return T.StructType(fields)


# ---- fixed values -------------------------------------------------------------------
# Default categories seeded into a new space: id suffix, name, colour.
DEFAULT_CATEGORIES = [
    ("salary", "Salary", "#22c55e"),
    ("other_income", "Other Income", "#10b981"),
    ("savings_investments", "Savings & Investments", "#06b6d4"),
    ("household_services", "Household & Services", "#3b82f6"),
    ("transport", "Transport", "#6366f1"),
    ("food_drinks", "Food & Drinks", "#f97316"),
    ("shopping", "Shopping", "#ec4899"),
    ("health_beauty", "Health & Beauty", "#8b5cf6"),
    ("leisure", "Leisure", "#eab308"),
    ("other", "Other", "#6b7280"),
]
FALLBACK_COLOR = "#6b7280"
FALLBACK_CATEGORY = "Other"
CONFLICT_TOLERANCE_SECONDS = 60
RETENTION_DAYS = 90
LOG_BATCH_ROWS = 5000
SNAPSHOT_CHUNK_ROWS = 500
MIN_TRAINING_ROWS = 20
QUIET_SECONDS = 5
DEFAULT_PAGE_ROWS = 10
MAX_PAGE_ROWS = 200
EXPORT_VERSION = 1
ACTIVE_MODEL_SETTING = "active_model_version"
AMOUNT_BIN_EDGES = [
    -100000.0, -10000.0, -1000.0, -100.0, -10.0, 0.0,
    10.0, 100.0, 1000.0, 10000.0, 100000.0,
]
