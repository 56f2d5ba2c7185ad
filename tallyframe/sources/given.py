"""The given star-schema tables seen as a multi-tenant ledger.

Columns a query does not need cost nothing: the product join that builds the statement
text and the running balance are only part of the plan when asked for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import running_total
from ..schemas import DEFAULT_CATEGORIES

EPOCH_TEXT = "2024-01-01T00:00:00Z"


def _text(prefix: str, *parts) -> F.Column:
    return F.concat(F.lit(prefix), *[p.cast("string") for p in parts])


class GivenLedger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def read(self, table: str) -> DataFrame:
        """A given table; its file footers are read once per ledger."""
        if table not in self._tables:
            self._tables[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._tables[table]

    # ---- tenants and people ----
    @cached_property
    def spaces(self) -> DataFrame:
        return self.read("region").select(
            _text("s", F.col("r_regionkey")).alias("id"),
            F.col("r_name").alias("name"),
            F.lit(EPOCH_TEXT).alias("created_at"),
            F.lit(EPOCH_TEXT).alias("updated_at"),
            F.lit(False).alias("deleted"),
        )

    @cached_property
    def _customers(self) -> DataFrame:
        nations = self.read("nation").select("n_nationkey", "n_regionkey")
        return self.read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def users(self) -> DataFrame:
        return self.read("customer").select(
            _text("u", F.col("c_custkey")).alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 2 == 1, F.md5(F.col("c_name"))).alias("pin_hash"),
            F.lit(EPOCH_TEXT).alias("created_at"),
            F.lit(EPOCH_TEXT).alias("updated_at"),
        )

    @cached_property
    def space_members(self) -> DataFrame:
        """Each customer is in the space of its region; every third also in the next one."""
        home = self._customers.select(
            _text("s", F.col("n_regionkey")).alias("space_id"),
            _text("u", F.col("c_custkey")).alias("user_id"),
            F.when(F.col("c_custkey") % 5 == 0, "owner").otherwise("member").alias("role"),
            F.lit(EPOCH_TEXT).alias("joined_at"),
        )
        guest = self._customers.where(F.col("c_custkey") % 3 == 0).select(
            _text("s", (F.col("n_regionkey") + 1) % 5).alias("space_id"),
            _text("u", F.col("c_custkey")).alias("user_id"),
            F.when(F.col("c_custkey") % 10 == 0, "owner").otherwise("member").alias("role"),
            F.lit(EPOCH_TEXT).alias("joined_at"),
        )
        return home.unionByName(guest)

    @cached_property
    def accounts(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        kind = (
            F.when(segment == "HOUSEHOLD", "checking").when(segment == "BUILDING", "savings")
            .when(segment == "MACHINERY", "investment").when(segment == "AUTOMOBILE", "credit")
            .otherwise("other")
        )
        return self._customers.select(
            _text("a", F.col("c_custkey")).alias("id"),
            F.col("c_name").alias("name"),
            F.lit("SEK").alias("currency"),
            kind.alias("account_type"),
            F.lit("import").alias("account_source"),
            F.lit("#6b7280").alias("color"),
            _text("s", F.col("n_regionkey")).alias("space_id"),
        )

    @cached_property
    def default_categories(self) -> DataFrame:
        rows = F.explode(F.array(*[
            F.struct(F.lit(s).alias("suffix"), F.lit(n).alias("name"), F.lit(c).alias("color"))
            for s, n, c in DEFAULT_CATEGORIES
        ])).alias("d")
        return self.spaces.select(F.col("id").alias("space_id"), rows).select(
            F.concat_ws("_", "space_id", "d.suffix").alias("id"), "d.name", "d.color", "space_id"
        )

    @cached_property
    def part_categories(self) -> DataFrame:
        """One user-made category per product name and space, beside the defaults."""
        return self.read("part").select(
            F.col("p_name").alias("name"), _text("s", F.col("p_partkey") % 5).alias("space_id")
        ).distinct().select(
            F.concat_ws("_", "space_id", "name").alias("id"), "name",
            F.lit("#123456").alias("color"), "space_id",
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self.default_categories.unionByName(self.part_categories)

    # ---- ledger rows ----
    def transactions(self, text: bool = True, balance: bool = True) -> DataFrame:
        key = F.col("o_orderkey")
        day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
        priority = F.col("o_orderpriority")
        amount = F.round(F.col("o_totalprice") * 100).cast("bigint")
        category = (
            F.when(key % 7 == 0, F.lit(None).cast("string"))
            .when(priority == "1-URGENT", "Salary").when(priority == "2-HIGH", "Transport")
            .when(priority == "3-MEDIUM", "Food & Drinks")
            .when(priority == "4-NOT SPECIFIED", "Other").otherwise("Shopping")
        )
        columns = [
            _text("t", key).alias("id"),
            day.alias("booking_date"), day.alias("value_date"),
            key.cast("string").alias("reference"),
            F.lit("SEK").alias("currency"),
            F.when(priority == "1-URGENT", amount).otherwise(-amount).alias("amount"),
            (F.col("o_orderstatus") != "P").alias("approved"),
            F.lit("").alias("note"),
            category.alias("category"),
            _text("a", F.col("o_custkey")).alias("account_id"),
            key.alias("_key"),
        ]
        orders = self.read("orders")
        if text:
            parts = self.read("part").select("p_partkey", "p_name")
            total = parts.agg(F.count(F.lit(1)).alias("_parts"))
            # One-row total: the broadcast side of this join can never grow.
            orders = orders.join(F.broadcast(total)).join(
                parts, F.col("p_partkey") == key % F.col("_parts")
            )
            columns.append(F.concat_ws("/", F.col("p_name"), key.cast("string")).alias("text"))
        rows = orders.select(*columns)
        if balance:
            rows = running_total(
                rows, ["account_id"], [F.col("value_date")], [F.col("_key")], F.col("amount"), "balance"
            )
        names = ["id", "booking_date", "value_date", "reference", "text", "currency", "amount",
                 "balance", "approved", "note", "category", "account_id"]
        return rows.select(*[n for n in names if n in rows.columns])

    @cached_property
    def account_summaries(self) -> DataFrame:
        """Monthly values of investment accounts, and of some checking accounts as overrides."""
        owners = self.read("customer").where(
            (F.col("c_mktsegment") == "MACHINERY")
            | ((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_custkey") % 5 == 0))
        ).select(_text("a", F.col("c_custkey")).alias("account_id"))
        monthly = self.transactions(text=False, balance=False).groupBy(
            F.substring("value_date", 1, 7).alias("month"), "account_id"
        ).agg(F.sum("amount").alias("balance"))
        return monthly.join(owners, "account_id", "left_semi").select("month", "account_id", "balance")

    @cached_property
    def space_settings(self) -> DataFrame:
        """The active model of each space, plus one plain setting per supplier."""
        supplier = self.read("supplier")
        space = _text("s", F.col("s_suppkey") % 5)
        plain = supplier.select(
            space.alias("space_id"), _text("k", F.col("s_suppkey")).alias("key"),
            F.col("s_name").alias("value"),
        )
        active = self.spaces.select(
            F.col("id").alias("space_id"), F.lit("active_model_version").alias("key"),
            F.when(F.col("id") == "s4", "x").otherwise("3").alias("value"),
        )
        return plain.unionByName(active)

    @cached_property
    def model_versions(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            _text("s", key % 5).alias("space_id"),
            (F.floor(key / 5) + 1).cast("bigint").alias("version"),
            F.md5(_text("w", key)).alias("weights_md5"),
            F.md5(_text("c", key)).alias("card_md5"),
            F.lit(EPOCH_TEXT).alias("trained_at"),
        )

    # ---- change log and devices ----
    @cached_property
    def change_log(self) -> DataFrame:
        return change_rows(self.read("events"))

    @cached_property
    def trusted_devices(self) -> DataFrame:
        pairs = self.change_log.select("space_id", "device_id").distinct()
        return pairs.select(
            F.concat_ws("-", "space_id", "device_id").alias("id"), "space_id", "device_id",
            F.concat(F.lit("device "), "device_id").alias("display_name"),
            F.concat(F.lit("CERT-"), "space_id", F.lit("-"), "device_id").alias("cert_pem"),
            (F.col("device_id") != "d3").alias("sync_enabled"),
            F.lit(EPOCH_TEXT).alias("paired_at"),
        )

    @cached_property
    def evicted_devices(self) -> DataFrame:
        return self.trusted_devices.where("device_id = 'd3'").select(
            "space_id", F.lit("d9").alias("device_id"), "cert_pem"
        )

    @cached_property
    def sync_cursors(self) -> DataFrame:
        top = self.change_log.groupBy("space_id", "device_id").agg(F.max("seq").alias("top"))
        return top.where("not (space_id = 's2' and device_id = 'd2')").select(
            "space_id", F.col("device_id").alias("peer_device_id"),
            F.floor(F.col("top") / 2).cast("bigint").alias("last_seq"),
        )

    @cached_property
    def sync_conflicts(self) -> DataFrame:
        """Every tenth change of the log stands for a noted conflict."""
        log = self.change_log.where("seq % 10 = 0")
        none = F.lit(None).cast("string")
        return log.select(
            F.concat(F.lit("c"), "id").alias("id"), "space_id", "table_name", "row_id", F.lit("note").alias("field"),
            none.alias("local_value"), none.alias("remote_value"), F.col("changed_at").alias("local_changed_at"),
            F.col("changed_at").alias("remote_changed_at"), F.lit(False).alias("resolved"),
            F.col("changed_at").alias("created_at"))


def change_rows(events: DataFrame) -> DataFrame:
    """Events as change-log rows; works on a batch or a streaming frame."""
    ts = F.concat(F.translate(F.substring(F.col("ts").cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    kind, user = F.col("event_type"), F.col("user_id")
    category = (
        F.when(kind == "click", F.lit(None).cast("string")).when(kind == "view", "Shopping")
        .when(kind == "purchase", "Transport").otherwise("Other")
    )
    payload = F.to_json(F.struct(
        _text("t", user).alias("id"),
        F.substring(ts, 1, 10).alias("booking_date"), F.substring(ts, 1, 10).alias("value_date"),
        F.col("event_id").cast("string").alias("reference"),
        F.concat(kind, F.lit(" "), user.cast("string")).alias("text"),
        F.lit("SEK").alias("currency"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.lit(0).cast("bigint").alias("balance"),
        (F.col("event_id") % 2).cast("bigint").alias("approved"),
        F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("note"),
        category.alias("category"),
        _text("a", user).alias("account_id"),
    ), {"ignoreNullFields": "false"})
    operation = F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        _text("s", user % 3).alias("space_id"),
        F.lit("transactions").alias("table_name"),
        _text("t", user).alias("row_id"),
        operation.alias("operation"),
        F.when(kind != "error", payload).alias("payload"),
        (F.col("event_id") + 1).alias("seq"),
        _text("d", F.col("event_id") % 4).alias("device_id"),
        ts.alias("changed_at"),
    )
