"""Line deduplication with levelled sorted runs of line hashes.

DataFrame functions only. A run is a table of line hashes, bucketed and sorted by hash, with the
number of documents that a hash was found in and the largest doc_id among them. Documents come
in batches. A batch is reduced to one row for each of its hashes and merge-joined with the runs:
what they settle already (enough documents, and a keeper beyond the batch's) is anti-joined away;
the rest becomes the batch's own run. Runs stand on levels like the digits of a binary counter:
two of one level are merged into one of the next, so that there are few of them and each hash is
rewritten log(batches) times. Counts add up and keepers are greatest ids, so that neither the
order of the batches nor that of the merges matters.

All runs have the same buckets, in the order of which a merge reads them; only the new batch is
shuffled. A line that stands in a third of all documents is one row of a batch, counted before
the shuffle, and its lines are dealt by document where they are taken out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, settle

# ---- fixed values -------------------------------------------------------------------
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's limit of buckets of a table.
MOST_BUCKETS = 100_000
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # a line of single bytes holds no other capitals than A-Z
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, keeper) in the warehouse.

    `least` is the number of documents from which on a hash is settled. A document's lines must all
    be in one batch, or it counts once for each batch. `close` drops the tables.
    """

    def __init__(self, spark: SparkSession, least: int, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        self.levels: dict[int, str] = {}
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, frame: DataFrame) -> str:
        self._made += 1
        name = f"{self.name}_{self._made}"
        frame.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of lines (h1, h2, doc_id); its rows may repeat."""
        held = lines.select(*_HASH, "doc_id").distinct()
        found = held.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        fresh = found.repartition(self.buckets, *_HASH)
        for name in self.levels.values():
            run = self.spark.table(name).select(*_HASH, F.col("n_docs").alias("had"), F.col("keeper").alias("kept"))
            settled = (run["had"] >= self.least) & (F.coalesce(run["kept"] > fresh["keeper"], fresh["keeper"].isNull()))
            fresh = fresh.join(run.hint("merge"), (fresh["h1"] == run["h1"]) & (fresh["h2"] == run["h2"]) & settled, "left_anti")
        new, level = self._write(fresh), 0
        while level in self.levels:
            old = self.levels.pop(level)
            merged = self._write(self._merge(old, new))
            self._drop(old)
            self._drop(new)
            new, level = merged, level + 1
        self.levels[level] = new

    def _merge(self, one: str, other: str) -> DataFrame:
        """Both runs as one: a merge join of equally bucketed tables, without a shuffle."""
        a, b = self.spark.table(one).alias("a"), self.spark.table(other).alias("b")
        both = a.join(b.hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
        return both.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"),
                           (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
                           F.greatest("a.keeper", "b.keeper").alias("keeper"))

    def compacted(self) -> DataFrame:
        """All runs merged into one."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            merged = self._write(self._merge(self.levels[low], self.levels[high]))
            for level in (low, high):
                self._drop(self.levels.pop(level))
            self.levels[high] = merged
        name = next(iter(self.levels.values()), None)
        return self.spark.table(name) if name else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, keeper long")

    def close(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        self.levels = {}


def hashed_lines(documents: DataFrame, least_length: int) -> DataFrame:
    """(doc_id, digest, at, h1, h2) of every line whose key has `least_length` code points or more.

    `digest` tells rows of one doc_id apart by their texts; `at` counts the lines from 0. Hashes
    have 128 bits.
    """
    lines = documents.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = lines.select("doc_id", "digest", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_length)
    return keyed.select("doc_id", "digest", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup_lines(documents: DataFrame, least_length: int = 20, least_docs: int = 3, batches: int = 4) -> DataFrame:
    """`documents` (doc_id, text and any others) without repeated lines; `n_lines` and `n_dropped` are added.

    Lines end at \\n; a null or empty text is one empty line. Lines whose keys are equal (`line_key`),
    have `least_length` code points and stand in `least_docs` documents are dropped but in the
    largest doc_id that holds one, which keeps all of its own. Other lines stay as they are, joined
    by \\n; a null text becomes an empty one.

    Rows of one doc_id are one document; so are those without doc_id, which comes before all others.
    Repeated rows stay, each without the same lines. Columns of the documents that are named
    n_lines or n_dropped give way. An empty table gives an empty result.

    The batches are ranges of doc_id, the greatest first, so that what a batch finds in the runs
    is mostly settled; their borders are approximate quantiles.
    """
    spark = documents.sparkSession
    cuts = documents.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    below = sum((F.coalesce(F.col("doc_id") <= F.lit(q), F.lit(True)).cast("int") for q in sorted(set(cuts or []))), F.lit(0))
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batched, path = hashed_lines(slim, least_length).withColumn("batch", below), scratch_dir(spark, "lines")
    batched.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(batched.schema).parquet(path)
    runs = LineRuns(spark, least_docs)
    try:
        for i in range(len(set(cuts or [])) + 1):
            runs.add(lines.where(F.col("batch") == i))
        repeated = settle(runs.compacted().where(F.col("n_docs") >= least_docs).select(*_HASH, "keeper"), "repeated-lines")
    finally:
        runs.close()
    hits = lines.join(repeated, _HASH).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("digest"))
    gone = hits.groupBy(row.alias("__row")).agg(F.array_sort(F.collect_set("at")).alias("__gone"))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    kept = documents.drop("n_lines", "n_dropped").withColumn("__row", own)
    split = _lines(F.col("text").cast("string"))
    # the dropped lines' numbers as flags of all lines: each one's gap to the one before, then itself
    before = F.array_prepend(F.slice("__gone", 1, F.size("__gone") - 1), F.lit(-1))
    flags = F.flatten(F.zip_with("__gone", before, lambda d, p: F.array_append(F.array_repeat(F.lit(True), d - p - 1), F.lit(False))))
    flags = F.concat(flags, F.array_repeat(F.lit(True), F.size(split) - 1 - F.element_at("__gone", -1)))
    left = F.array_join(F.zip_with(split, flags, lambda line, stays: F.when(stays, line)), "\n")
    columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return kept.join(gone, "__row", "left").select(
        *[F.when(F.col("__gone").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(left).alias("text") if c == "text" else F.col(c) for c in columns],
        F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
