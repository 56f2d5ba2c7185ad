"""The stored trigram index: immutable segments of postings, tied to the table versions they cover.

The index of a table version is a list of segments, oldest first. A segment holds postings
(trigram, field, id), sorted by trigram, and tombstones: ids whose postings in older segments no
longer count. A batch of edits writes one segment with the postings of the rows it leaves and
tombstones of the rows it found; nothing older is read for that. The postings of a row all lie in
one segment, so a look-up counts trigrams per row and segment, and only then drops the few
candidates that a newer tombstone names.

Segments are merged when the newer ones together have grown as large as the one before them.
So each segment is larger than all newer ones together, their number follows the logarithm of the
index, and a posting is written again only when what holds it has at least doubled.

The list for a table version is published last, under that version's number. A search names the
version of the rows it reads; without a list for it, the search is refused. Readers of
an older version keep its segments. Of two writers for one version the second fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import build_trigram_index, contains_term, search
from ..session import settle
from . import keyed_files
from .versions import current_version, read_version, write_version

_POSTING = "trigram string, field string, id string, place long"
_TOMBSTONE = "id string, place long"
#: Rows whose postings go to one file, and postings of a file where segments are merged.
_FILE_ROWS, _FILE_POSTINGS = 1 << 17, 1 << 22
#: Bits, in words of 64, that tell which ids may be in tombstones: 4 MB, whatever the number of tombstones.
_WORDS = 1 << 19
_SEGMENT = "place long, name string, postings long, tombstones long"


class StaleIndex(ValueError):
    """The index has no segments for the table version that a search names."""


@dataclass(frozen=True)
class Segment:
    """Place in the order of edits, folder, and size. A merged segment has its newest part's place."""

    place: int
    name: str
    postings: int
    tombstones: int

    @property
    def size(self) -> int:
        return self.postings + self.tombstones


def _list_name(table_version: int) -> str:
    return f"covers-{table_version}"


def covered(spark: SparkSession, root: str, table_version: int) -> bool:
    return current_version(spark, root, _list_name(table_version)) > 0


def segments(spark: SparkSession, root: str, table_version: int) -> list[Segment]:
    """The segments for a table version, oldest first; refuses a version without a list."""
    try:
        found = read_version(spark, root, _list_name(table_version)).collect()
    except ValueError:
        raise StaleIndex(f"the index under {root} doesn't cover version {table_version} of its table") from None
    return sorted((Segment(*r) for r in found), key=lambda s: s.place)


def _publish(spark: SparkSession, root: str, table_version: int, held: list[Segment]) -> None:
    if covered(spark, root, table_version):
        raise ValueError(f"the index under {root} already covers version {table_version}")
    rows = [(s.place, s.name, s.postings, s.tombstones) for s in held]
    write_version(spark, root, _list_name(table_version), spark.createDataFrame(rows, _SEGMENT).coalesce(1))


def _dealt(frame: DataFrame, rows: int, each: int) -> DataFrame:
    """About `each` rows to a task, by id, which holds for any trigram however frequent it is."""
    return frame.repartition(max(1, -(-rows // each)), "id")


def _index_of(rows: DataFrame) -> DataFrame:
    """Postings of rows. Rows are dealt before their postings, many for each, are made."""
    slim = rows.select("id", "text", "amount")
    return build_trigram_index(_dealt(slim, slim.count(), _FILE_ROWS))


def _in_trigram_order() -> Column:
    """The three characters as one number in the order of the text: numbers are sorted without comparisons."""
    at = [F.ascii(F.substring("trigram", i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(at[0], 42) + F.shiftleft(at[1], 21) + at[2]


def _write(spark: SparkSession, root: str, place: int, postings: DataFrame, tombstones: DataFrame) -> Segment:
    """One new segment. Each task sorts its postings into a file of its own; look-ups skip by min/max in each."""
    name = f"s{place}-{uuid.uuid4().hex}"
    own = F.lit(place).cast("long").alias("place")
    (postings.select("trigram", "field", "id", own).sortWithinPartitions(_in_trigram_order())
     .write.parquet(f"{root}/postings/{name}"))
    tombstones.select("id", own).distinct().write.parquet(f"{root}/tombstones/{name}")
    made = Segment(place, name, 0, 0)
    return Segment(place, name, _postings(spark, root, [made]).count(), _tombstones(spark, root, [made]).count())


def _postings(spark: SparkSession, root: str, held: list[Segment]) -> DataFrame:
    return spark.read.schema(_POSTING).parquet(*[f"{root}/postings/{s.name}" for s in held])


def _tombstones(spark: SparkSession, root: str, held: list[Segment]) -> DataFrame:
    return spark.read.schema(_TOMBSTONE).parquet(*[f"{root}/tombstones/{s.name}" for s in held])


def _living(found: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of (id, place, ...) that no tombstone of a newer segment names."""
    last = tombstones.groupBy("id").agg(F.max("place").alias("ended"))
    return found.join(last, (found.id == last.id) & (last.ended > found.place), "left_anti")


def _bit() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(64 * _WORDS))


def _named(tombstones: DataFrame) -> Column:
    """Whether a row's id may be in the tombstones: true for all that are, and for some that aren't."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_bit(), F.lit(64)).cast("int"))
    words = tombstones.select(F.shiftright(_bit(), 6).alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = tombstones.sparkSession.range(_WORDS).join(words, F.col("id") == F.col("word"), "left")
    held = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    bits = settle(held.select(F.col("w.bits").alias("bits")), "ended").scalar()  # one row
    return F.getbit(F.get(bits, F.shiftright(_bit(), 6).cast("int")), F.pmod(_bit(), F.lit(64)).cast("int")) == 1


def _living_postings(spark: SparkSession, root: str, held: list[Segment]) -> DataFrame:
    """The postings of segments that no tombstone of a newer one ends.

    Only postings whose id may be in a newer tombstone are joined. The others, which are nearly
    all after small edits, stay in the tasks that read them.
    """
    postings, ends = _postings(spark, root, held), [s.place for s in held if s.tombstones]
    if not ends:
        return postings
    tombstones = _tombstones(spark, root, held)
    asked = (F.col("place") < max(ends)) & _named(tombstones)
    return postings.where(~asked).unionByName(_living(postings.where(asked), tombstones))


def create_index(spark: SparkSession, root: str, rows: DataFrame, table_version: int) -> Segment:
    """Index all rows (unique, non-null `id`, `text`, `amount`) of a table version as the first segment."""
    base = _write(spark, root, 0, _index_of(rows), rows.select("id").limit(0))
    _publish(spark, root, table_version, [base])
    return base


def _to_merge(held: list[Segment]) -> int:
    """Where the run of newest segments begins that is to become one: the oldest segment that
    the newer ones together have caught up with; the number of segments if there is none."""
    newer = 0
    first = len(held)
    for at in range(len(held) - 1, -1, -1):
        if at < len(held) - 1 and held[at].size <= newer:
            first = at
        newer += held[at].size
    return first


def _merged(spark: SparkSession, root: str, run: list[Segment], oldest: bool) -> Segment:
    """One segment for a run of them. Tombstones stay unless nothing older is left for them to end."""
    tombstones = _tombstones(spark, root, run)
    dealt = _dealt(_living_postings(spark, root, run), sum(s.postings for s in run), _FILE_POSTINGS)
    return _write(spark, root, run[-1].place, dealt, tombstones.limit(0) if oldest else tombstones)


def edit_index(spark: SparkSession, root: str, before: int, after: int, removed: DataFrame, added: DataFrame) -> Segment:
    """Cover version `after` by the segments of `before` and one for the edits; returns that one.

    removed: rows whose `id` is gone or changed. added: rows that are new or changed. An update is in
    both. Merging follows in the same step where segments have grown for it.
    """
    held = segments(spark, root, before)
    made = _write(spark, root, held[-1].place + 1, _index_of(added), removed)
    held.append(made)
    first = _to_merge(held)
    if first < len(held):
        held[first:] = [_merged(spark, root, held[first:], first == 0)]
    _publish(spark, root, after, held)
    return made


def follow_table(spark: SparkSession, root: str, table: str, before: int, after: int) -> Segment:
    """Cover version `after` of a table of keyed files from what differs between its two versions.

    Only files that one version has and the other lacks are read; rows that are alike in
    both are no edits. A change of other columns than text and amount writes no postings.
    """
    columns = ["id", "text", "amount"]
    gone, fresh = (f.select(*columns) for f in keyed_files.replaced_rows(spark, table, before, after))
    removed, added = _differing(gone, fresh)
    return edit_index(spark, root, before, after, removed, added)


def _differing(gone: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows that only the first frame has, and that only the second has: found in one pass, and written."""
    sides = gone.withColumn("side", F.lit(1)).unionByName(fresh.withColumn("side", F.lit(2)))
    found = settle(sides.groupBy(*gone.columns).agg(F.bit_or("side").alias("side")).where("side < 3"), "edits")
    return tuple(found.where(F.col("side") == k).drop("side") for k in (1, 2))


def live_postings(spark: SparkSession, root: str, table_version: int) -> DataFrame:
    """All postings (trigram, field, id) that count for a table version."""
    held = segments(spark, root, table_version)
    return _living_postings(spark, root, held).select("trigram", "field", "id")


def search_segments(spark: SparkSession, root: str, rows: DataFrame, table_version: int, term: str) -> DataFrame:
    """The rows, read at `table_version`, that contain the term in text or amount.

    Terms below three characters have no trigram and scan the rows, also for a covered version only.
    """
    held = segments(spark, root, table_version)
    low = term.strip().lower()
    if len(low) < 3:
        return search(rows, term)
    wanted = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    candidates = (
        _postings(spark, root, held).where(F.col("trigram").isin(wanted))
        .groupBy("id", "field", "place").agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") == len(wanted)).select("id", "place").distinct()
    )
    living = _living(candidates, _tombstones(spark, root, held)).select("id").distinct()
    return rows.join(living, "id", "left_semi").where(contains_term(term))
