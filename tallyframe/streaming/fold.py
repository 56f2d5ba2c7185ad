"""The state behind a stream of applied changes, as a log-structured fold.

Every micro-batch's valid changes are an open run. `FAN` runs of a level are merged into one of
the next, which keeps only the changes that still decide something; the runs of the last level
are folded into base tables of keyed files, of which just the files with changed rows are
written anew. So a batch looks its rows up in the base and in at most FAN runs a level, however
long the stream has been going.

Beside the tables the base holds, for each row, the newest entries of its two newest authors:
all that conflict detection asks of the log.

A batch's state, the list of open runs, is written last. A retried batch starts from the state
of the batch before it and overwrites its own output; folding the same changes again leaves the
tables as they are, because the last arrival decides.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import latest_by_author
from ..operators.mutate import Tables
from ..operators.replicate import _deciding, apply_changes, last_change_per_row
from ..schemas import CHANGE_LOG, KEYS
from ..sources import keyed_files
from ..sources.versions import current_version
from .sinks import write_batch

#: Runs of a level that are merged into one of the next, and levels of runs.
FAN, LEVELS = 4, 2
#: Tables whose rows the last arrival overwrites. The others have rules of their own and stay small.
PLAIN = ["categories", "accounts", "transactions", "account_summaries", "space_settings", "model_versions"]
_ENTRY = ["device_id", "changed_at", "seq"]
_AUTHORS = "table_name string, row_id string, entries array<struct<device_id: string, changed_at: string, seq: long>>"
_RUN = T.StructType([*CHANGE_LOG.fields, T.StructField("batch_no", T.LongType())])
_STATE = "level int, path string"


def create_base(spark: SparkSession, root: str, base: Tables, log: DataFrame) -> None:
    """Store the tables that the stream starts from, and the authors of the log; once."""
    for name in [n for n in PLAIN if n in base]:
        if not current_version(spark, f"{root}/base/{name}", "index"):
            keyed_files.create_table(spark, f"{root}/base/{name}", base[name], KEYS[name])
    if not current_version(spark, f"{root}/base/authors", "index"):
        keyed_files.create_table(spark, f"{root}/base/authors", _authors(log), ["table_name", "row_id"])


def _authors(log: DataFrame) -> DataFrame:
    entries = F.filter(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in _ENTRY]) for x in ("first", "second")]),
                       lambda e: e["device_id"].isNotNull())
    return latest_by_author(log).select("table_name", "row_id", entries.alias("entries"))


def _as_log(authors: DataFrame) -> DataFrame:
    return authors.select("table_name", "row_id", F.explode("entries").alias("e")).select(
        "table_name", "row_id", *[F.col(f"e.{c}").alias(c) for c in _ENTRY])


def state_before(spark: SparkSession, root: str, batch_id: int) -> list[tuple[int, str]]:
    """(level, path) of the runs that are open when a batch begins, oldest first."""
    if batch_id == 0:
        return []
    rows = spark.read.schema(_STATE).parquet(f"{root}/states/batch_id={batch_id - 1}").collect()
    return sorted(((r["level"], r["path"]) for r in rows if r["path"]), key=lambda r: (-r[0], r[1]))


def newest_state(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """The open runs after the last batch whose state was written."""
    try:
        last = spark.read.option("basePath", f"{root}/states").schema(f"{_STATE}, batch_id long").parquet(f"{root}/states").agg(F.max("batch_id")).first()[0]
    except AnalysisException:
        last = None
    return [] if last is None else state_before(spark, root, last + 1)


def open_changes(spark: SparkSession, root: str, state: list[tuple[int, str]]) -> DataFrame:
    if not state:
        return spark.createDataFrame([], _RUN)
    return spark.read.schema(_RUN).parquet(*[f"{root}/runs/{path}" for _, path in state])


def rows_before(spark: SparkSession, root: str, state: list[tuple[int, str]], touched: DataFrame, name: str) -> tuple[Tables, DataFrame]:
    """The rows `touched` (id) of a table as earlier batches left them, and their authors' log."""
    runs = open_changes(spark, root, state).join(touched.withColumnRenamed("id", "row_id"), "row_id", "left_semi")
    cuts = open_changes(spark, root, state).where("table_name = 'accounts' and operation = 'delete'")
    stored = keyed_files.look_up(spark, f"{root}/base/{name}", touched)
    local = apply_changes({name: stored}, runs.where(F.col("table_name") == name).unionByName(cuts))
    asked = touched.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"))
    log = _as_log(keyed_files.look_up(spark, f"{root}/base/authors", asked))
    return local, log.unionByName(runs.select(*log.columns))


def deciding_changes(changes: DataFrame) -> DataFrame:
    """The changes of a run that still matter: each row's last and its two newest authors' newest,
    each account's last delete (which took its rows along), and all of tables with rules of their own."""
    marked = changes.withColumn("_mark", F.struct("batch_no", "seq", "id"))  # the order of arrival
    last = marked.groupBy("table_name", "row_id").agg(F.max("_mark").alias("_mark")).select("_mark")
    deletes = marked.where("table_name = 'accounts' and operation = 'delete'").groupBy("row_id").agg(F.max("_mark").alias("_mark")).select("_mark")
    authors = marked.groupBy("table_name", "row_id", "device_id").agg(F.max(F.struct("changed_at", "seq", "_mark")).alias("top"))
    newest = Window.partitionBy("table_name", "row_id").orderBy(F.col("top.changed_at").desc(), F.col("top.seq").desc(), F.col("device_id").desc())
    named = authors.withColumn("_rank", F.row_number().over(newest)).where("_rank <= 2").select(F.col("top._mark").alias("_mark"))
    own = marked.where(~F.col("table_name").isin(PLAIN)).select("_mark")
    wanted = last.union(deletes).union(named).union(own).distinct()
    return marked.join(wanted, "_mark", "left_semi").select(*_RUN.names)


def _fold(spark: SparkSession, root: str, runs: DataFrame) -> None:
    """Put the changes of runs into the base."""
    last = last_change_per_row(runs)
    cuts = runs.where("table_name = 'accounts' and operation = 'delete'").select(F.col("row_id").alias("account_id")).distinct()
    cascading = not cuts.isEmpty()
    for name in PLAIN:
        table = f"{root}/base/{name}"
        if not current_version(spark, table, "index"):
            continue
        touched = _deciding(last, name).select(*KEYS[name])
        if cascading and name in ("transactions", "account_summaries"):
            slim = keyed_files.read_table(spark, table).select(*dict.fromkeys([*KEYS[name], "account_id"]))
            touched = touched.union(slim.join(cuts, "account_id", "left_semi").select(*KEYS[name]))
        keyed_files.edit_table(spark, table, touched, lambda rows, name=name: apply_changes({name: rows}, runs)[name], inserts=True)
    entries = runs.select("table_name", "row_id", *_ENTRY)
    keyed_files.edit_table(spark, f"{root}/base/authors", entries.select("table_name", "row_id"),
                           lambda rows: _authors(_as_log(rows).unionByName(entries)), inserts=True)


def advance(spark: SparkSession, root: str, batch_id: int, state: list[tuple[int, str]], valid: DataFrame, fan: int = FAN) -> None:
    """Add a batch's valid changes as a run, merge what is due and write the state, the batch's last act."""
    own = f"l0/batch_id={batch_id}"
    valid.withColumn("batch_no", F.lit(batch_id).cast("long")).select(*_RUN.names).write.mode("overwrite").parquet(f"{root}/runs/{own}")
    state = [*state, (0, own)]
    for level in range(LEVELS):
        full = [run for run in state if run[0] == level]
        if len(full) < fan:
            break
        runs = open_changes(spark, root, full)
        state = [run for run in state if run[0] != level]
        if level + 1 < LEVELS:
            path = f"l{level + 1}/batch_id={batch_id}"
            deciding_changes(runs).write.mode("overwrite").parquet(f"{root}/runs/{path}")
            state.append((level + 1, path))
        else:
            _fold(spark, root, runs)
    marks = state or [(0, "")]  # a state without runs is a row too
    write_batch(spark.createDataFrame(marks, _STATE).coalesce(1), root, "states", batch_id)
