"""Registered queries: streams drained over the given tables.

The tables are first laid out as three deliveries in time order, one per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir, settle
from ..sources.given import GivenLedger, change_rows
from ..streaming import bursts, imports, replication, sinks
from .catalog import register
from .change_queries import conflict_sql
from .oracle import ledger_sql
from .series_queries import SPEND


def deliveries(led: GivenLedger, rows: DataFrame, key: str) -> DataFrame:
    """A stream of three deliveries in the order of `key`, each of as many files as there are tasks.

    The rows are evaluated and stored once; the borders lie evenly between the least and the
    greatest key. A micro-batch takes a delivery's files, which bounds it.
    """
    stored = settle(rows, "to-deliver")
    low, high = stored.agg(F.min(key), F.max(key)).first()
    path, files = scratch_dir(led.spark, "deliveries"), int(led.spark.conf.get("spark.sql.shuffle.partitions"))
    if low is not None:
        step, value = (high - low) / 3, F.col(key)
        first, second = low + step, low + 2 * step
        for part in (value <= first, (value > first) & (value <= second), value > second):
            stored.where(part).repartition(files).write.mode("append").parquet(path)
    else:
        stored.write.parquet(path)
    return led.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _events(led: GivenLedger) -> DataFrame:
    return change_rows(deliveries(led, led.read("events"), "event_id"))


@register("stream_apply", ledger_sql("""
    SELECT t.id, t.approved, t.note, t.category, t.amount FROM transactions t
    WHERE t.id NOT IN (SELECT row_id FROM decoded_log)
    UNION ALL
    SELECT row_id, event_id % 2 = 1, new_note, new_category, new_amount FROM decoded_log
    WHERE operation <> 'delete' AND seq IN (SELECT max(seq) FROM decoded_log GROUP BY row_id)"""))
def _(led: GivenLedger) -> DataFrame:
    """The table after the stream: runs of changes over a base into which the older ones are folded."""
    root, base = scratch_dir(led.spark, "apply"), {"transactions": led.transactions()}
    replication.start_apply(_events(led), root, base, led.change_log, fan=2).awaitTermination()
    return replication.current_tables(led.spark, root, base)["transactions"].select(
        "id", "approved", "note", "category", "amount")


@register("stream_apply_cursors", ledger_sql("""
    SELECT space_id, device_id AS peer_device_id, max(seq) AS last_seq FROM change_log GROUP BY 1, 2"""))
def _(led: GivenLedger) -> DataFrame:
    root = scratch_dir(led.spark, "apply")
    base = {"transactions": led.transactions(text=False, balance=False).withColumns({"text": F.lit(""), "balance": F.lit(0).cast("long")})}
    replication.start_apply(_events(led), root, base, led.change_log).awaitTermination()
    return replication.current_cursors(led.spark, root, led.sync_cursors)


@register("stream_apply_conflicts", conflict_sql(86400))
def _(led: GivenLedger) -> DataFrame:
    """What the applied stream recorded: one device's edits, against all that the others have stored."""
    root = scratch_dir(led.spark, "apply")
    base = {"transactions": led.transactions(text=False, balance=False).withColumns({"text": F.lit(""), "balance": F.lit(0).cast("long")})}
    own, others = F.col("device_id") == "d1", led.change_log.where("device_id <> 'd1'")
    replication.start_apply(_events(led).where(own), root, base, others, tolerance=86400, fan=2).awaitTermination()
    return replication.recorded_conflicts(led.spark, root).drop("batch_id")


@register("stream_apply_rejects", ledger_sql("""
    SELECT id, CASE WHEN seq % 10 = 1 THEN 'unknown operation' WHEN seq % 10 = 2 THEN 'unknown table' WHEN operation = 'delete' THEN NULL
                    WHEN seq % 10 = 3 THEN 'missing payload' WHEN seq % 10 = 4 THEN 'payload does not match the table' END AS reason
    FROM change_log WHERE seq % 10 BETWEEN 1 AND 4 AND (seq % 10 <= 2 OR operation <> 'delete')"""))
def _(led: GivenLedger) -> DataFrame:
    """What the applied stream refused: four of ten changes are spoilt on the way."""
    root, kind = scratch_dir(led.spark, "apply"), F.col("seq") % 10
    spoilt = _events(led).withColumns({
        "operation": F.when(kind == 1, "merge").otherwise(F.col("operation")),
        "table_name": F.when(kind == 2, "wishes").otherwise(F.col("table_name")),
        "payload": F.when(kind == 4, F.when(F.col("payload").isNotNull(), "{}")).when(kind != 3, F.col("payload"))})
    base = {"transactions": led.transactions(text=False, balance=False).withColumns({"text": F.lit(""), "balance": F.lit(0).cast("long")})}
    replication.start_apply(spoilt, root, base, led.change_log).awaitTermination()
    return replication.rejected_changes(led.spark, root).select("id", "reason")


@register("stream_conflicts", ledger_sql("""
    SELECT space_id, row_id, seq, field, local_value, remote_value, local_changed_at, remote_changed_at FROM (
      SELECT *, UNNEST([{'field': 'category', 'local_value': old_category, 'remote_value': new_category},
                        {'field': 'note', 'local_value': old_note, 'remote_value': new_note}], recursive := true)
      FROM paired)
    WHERE local_value IS DISTINCT FROM remote_value""", """
stepped AS (
  SELECT *, lag(operation) OVER w AS old_operation, lag(new_category) OVER w AS old_category,
         lag(new_note) OVER w AS old_note
  FROM decoded_log WINDOW w AS (PARTITION BY row_id ORDER BY seq)),
paired AS (
  SELECT s.*, o.changed_at AS local_changed_at, s.changed_at AS remote_changed_at FROM stepped s
  JOIN decoded_log o ON o.row_id = s.row_id AND o.seq < s.seq AND o.device_id <> s.device_id
  WHERE s.operation <> 'delete' AND s.old_operation <> 'delete'
    AND date_diff('second', CAST(replace(replace(o.changed_at, 'T', ' '), 'Z', '') AS TIMESTAMP),
        CAST(replace(replace(s.changed_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) <= 7200
  QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY o.changed_at DESC, o.seq DESC) = 1)"""))
def _(led: GivenLedger) -> DataFrame:
    """Live conflicts within two hours, from per-row state."""
    root = scratch_dir(led.spark, "conflicts")
    replication.start_conflicts(_events(led), root, 7200).awaitTermination()
    return led.spark.read.parquet(f"{root}/rows")


@register("stream_dedupe_import", ledger_sql("""
    SELECT DISTINCT md5(CAST(l_partkey AS VARCHAR) || '/' || l_suppkey) AS id FROM lineitem"""))
def _(led: GivenLedger) -> DataFrame:
    root = scratch_dir(led.spark, "dedupe")
    stream = deliveries(led, led.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey")
    hashed = stream.select(F.md5(F.concat_ws(
        "/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("id"))
    sinks.append_stream(imports.dedupe_import(hashed), root).awaitTermination()
    return led.spark.read.parquet(f"{root}/rows")


@register("stream_monthly_spend", ledger_sql("SELECT * FROM spend", SPEND))
def _(led: GivenLedger) -> DataFrame:
    root = scratch_dir(led.spark, "spend")
    rows = led.transactions(text=False, balance=False).withColumn("key", F.col("reference").cast("bigint"))
    updates = imports.stream_monthly_spend(deliveries(led, rows, "key"), led.accounts)
    sinks.run_batches(
        updates, root, lambda batch, n: sinks.write_batch(batch, root, "spend", n), mode="update"
    ).awaitTermination()
    batches = sinks.read_batches(
        led.spark, root, "spend", "space_id string, month string, category string, amount long, batch_id long")
    return sinks.latest_values(batches, ["space_id", "month", "category"])


@register("stream_high_water", ledger_sql("""
    SELECT space_id, device_id, max(seq) AS max_seq FROM change_log GROUP BY 1, 2"""))
def _(led: GivenLedger) -> DataFrame:
    root = scratch_dir(led.spark, "water")
    sinks.run_batches(
        replication.stream_high_water(_events(led)), root,
        lambda batch, n: sinks.write_batch(batch, root, "water", n), mode="update").awaitTermination()
    batches = sinks.read_batches(
        led.spark, root, "water", "space_id string, device_id string, max_seq long, batch_id long")
    return sinks.latest_values(batches, ["space_id", "device_id"])


_OLD = 120  # days that the late delivery lies behind the rest

_LATE = """
kept AS (SELECT * FROM change_log),
bounds AS (SELECT space_id, device_id, min(seq) AS low, max(seq) AS high FROM kept GROUP BY 1, 2)"""


@register("stream_late_rows", ledger_sql("SELECT 'kept' AS what, id FROM kept", _LATE))
def _(led: GivenLedger) -> DataFrame:
    """Every row delivered twice, and a third of them once more under new ids from long ago.

    The old copies come last, when the watermark has passed them: each is late. The others are
    kept once.
    """
    root = scratch_dir(led.spark, "late")
    events = led.read("events")
    old = events.where("event_id % 3 = 0").withColumns({
        "event_id": F.col("event_id") + 10**12,
        "ts": (F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {_OLD} DAYS")).cast(events.schema["ts"].dataType)})
    path, files = scratch_dir(led.spark, "deliveries"), int(led.spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (events, events, old):
        # the watermark moves between batches: the second delivery lies between the new rows and the old
        part.repartition(files).write.mode("append").parquet(path)
    stream = change_rows(led.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path))
    replication.start_late_rows(stream, root, led.sync_cursors).awaitTermination()
    return replication.kept_rows(led.spark, root).select(F.lit("kept").alias("what"), "id")


_AHEAD = 1000  # sequence numbers that the authors' logs have already dropped


@register("stream_snapshot_plans", ledger_sql(f"""
    SELECT CAST(0 AS BIGINT) AS batch_id, b.space_id, b.device_id, c.last_seq % {2 * _AHEAD} AS last_seq, min_seq, max_seq, 'snapshot' AS mode
    FROM bounds b JOIN sync_cursors c ON c.space_id = b.space_id AND c.peer_device_id = b.device_id
    WHERE c.last_seq % {2 * _AHEAD} > 0 AND c.last_seq % {2 * _AHEAD} < min_seq""", f"""
bounds AS (SELECT space_id, device_id, min(seq) + {_AHEAD} AS min_seq, max(seq) + {_AHEAD} AS max_seq FROM change_log GROUP BY 1, 2)"""))
def _(led: GivenLedger) -> DataFrame:
    """Who is behind what the stream retains: planned with the first of two equal deliveries, caught up by the second."""
    root = scratch_dir(led.spark, "late")
    events, path, files = led.read("events"), scratch_dir(led.spark, "deliveries"), int(led.spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(2):
        events.repartition(files).write.mode("append").parquet(path)
    stream = change_rows(led.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path))
    cursors = led.sync_cursors.withColumn("last_seq", F.col("last_seq") % (2 * _AHEAD))
    replication.start_late_rows(stream.withColumn("seq", F.col("seq") + _AHEAD), root, cursors).awaitTermination()
    return replication.snapshot_plans(led.spark, root).withColumn("batch_id", F.col("batch_id").cast("long"))


_BURSTS = """
gaps AS (
  SELECT 's' || (user_id % 3) AS space_id, date_trunc('second', ts) AS ts, event_id FROM events),
marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL 120 SECOND > ts THEN 0 ELSE 1 END AS starts
  FROM gaps WINDOW w AS (PARTITION BY space_id ORDER BY ts, event_id)),
bursts AS (
  SELECT space_id, min(ts) AS first_ts, max(ts) + INTERVAL 120 SECOND AS last_ts, count(*) AS mutations
  FROM (SELECT *, sum(starts) OVER (PARTITION BY space_id ORDER BY ts, event_id) AS burst FROM marked)
  GROUP BY space_id, burst)"""
_BURST_ROWS = """
    SELECT space_id, CAST(epoch(first_ts) AS BIGINT) AS first_at, CAST(epoch(last_ts) AS BIGINT) AS fires_at,
           mutations FROM bursts"""


def _mutations(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("space_id"), "event_id",
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))


def _epochs(found: DataFrame) -> DataFrame:
    return found.select(
        "space_id", F.unix_timestamp("first_at").alias("first_at"), F.unix_timestamp("fires_at").alias("fires_at"),
        "mutations")


@register("mutation_bursts", ledger_sql(_BURST_ROWS, _BURSTS))
def _(led: GivenLedger) -> DataFrame:
    return _epochs(imports.mutation_bursts(_mutations(led.read("events")), "at", "event_id", 120))


@register("stream_bursts", ledger_sql(_BURST_ROWS, _BURSTS))
def _(led: GivenLedger) -> DataFrame:
    """Bursts of a live stream that ends with a mutation two days later, which fires all before it."""
    root = scratch_dir(led.spark, "bursts")
    events = led.read("events")
    closing = events.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id")).where("ts IS NOT NULL")  # one row
    closing = closing.select(*[
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).cast(f.dataType).alias("ts") if f.name == "ts"
        else (F.col("event_id") + 1).cast(f.dataType).alias("event_id") if f.name == "event_id"
        else F.lit(0 if f.name == "user_id" else None).cast(f.dataType).alias(f.name) for f in events.schema])
    stream = _mutations(deliveries(led, events.unionByName(closing), "event_id"))
    bursts.start_bursts(stream, root, "at", 120).awaitTermination()
    return _epochs(led.spark.read.parquet(f"{root}/rows"))
