"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors become integers. They are put in the order of a Hilbert curve over all dimensions, cut
into blocks and written as Parquet, a row for each block: ids, labels, the matrix and, in columns
of their own, its zone map (each dimension's least and greatest value, the labels' too). For an
anchor a and a zone, interval arithmetic bounds every inner product: it lies between the sums of
the least and of the greatest of a_i * low_i and a_i * high_i. So a search for scores in a window
reads a block only if the block's interval meets the window.

Two searches run. Positives: the window begins at the fifth best score in the anchor's own block,
which was noted when the block was written. Negatives: each positive's score gives a window.
Zone maps of groups of blocks route packs of anchors to the groups that some of their windows
need; there each block's own zone map picks the anchors that are multiplied with it. A group's
blocks come first in its sorted stream and stay in memory; packs of anchors stream past them. What
a group finds is reduced to the first rows of each window before it is shuffled.

Anchors are a stated share of the rows, so that the work grows with their product where windows
are wide; with the zones, only blocks whose bounds meet a window add to it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .chunks import rows_of

#: Rows of a block, blocks of a group, anchors of a pack, groups of a zone pack.
BLOCK_ROWS, GROUP_BLOCKS, PACK_ANCHORS, ZONE_GROUPS = 512, 16, 1024, 256
#: Bits of a Hilbert coordinate.
CURVE_BITS = 4
#: Components are whole numbers up to this, so that a score of 8,192 dimensions is a 64-bit number.
MOST = 1 << 25
POSITIVES, NEGATIVES = 5, 10
_EXACT = 2.0**53
_NO_ID = np.iinfo(np.int64).max  # stands for a missing id, which comes last in ties
_LEAST = np.iinfo(np.int64).min


def hilbert_key(grid: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place of each row of `grid` (rows x dimensions, values below 2 ** bits) on the Hilbert curve.

    Gray-coded axes are untangled from the highest bit to the lowest; their bits, interleaved by
    significance, are the place, here as bytes that sort alike.
    """
    x = np.array(grid.T, np.uint32)
    n = len(x)
    if n == 0:
        return [b""] * grid.shape[0]
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint32(b)) & np.uint32(1), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec): components floor(scale * x) of the rows that take part.

    Rows with a null label, a null vector, or a component that is null, not finite or at least
    MOST in size don't. Where vec_id is divisible by 7, the label l becomes (l + 1) % 10.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double") * scale) < MOST, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where("label IS NOT NULL AND embedding IS NOT NULL").where(fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.cast("array<long>").alias("vec"))


# ---- blocks -------------------------------------------------------------------------
#: A block's row, or without a block the zone of a group.
_BLOCK = pa.schema([
    ("grp", pa.int64()), ("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
    ("data", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())),
    ("places", pa.list_(pa.int32())), ("floors", pa.list_(pa.int64()))])
_BLOCK_SQL = ("grp long, block long, dim int, ids array<long>, labels array<long>, data binary, low array<long>, high array<long>, "
              "places array<int>, floors array<long>")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _vectors(row: dict) -> np.ndarray:
    """The matrix of a block or pack."""
    return np.frombuffer(row["data"], "<i4").reshape(len(row["ids"]), row["dim"])


def _names(ids: list) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in ids], np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _keys(reach: int):
    """Add the place on the curve; the grid's cells span -reach to reach."""
    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            out = np.empty(batch.num_rows, object)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                grid = (_matrix(batch.column("vec").take(pa.array(at)), dim) + reach) * (1 << CURVE_BITS) // (2 * reach + 1)
                out[at] = hilbert_key(grid)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "vec")], pa.array(sizes, pa.int32()),
                                              pa.array(out, pa.binary())], names=["vec_id", "label", "vec", "dim", "key"])
    return run


def _block(ids: list, labels: list, vec: np.ndarray, every: int) -> dict:
    """A block, with its anchors and the score that their last positive has if the block is all there is."""
    at = [i for i, v in enumerate(ids) if v is not None and v % every == 0]
    names, kinds, floors = _names(ids), np.array(labels), []
    for i, row in zip(at, scores(vec[at], vec)):
        same = np.sort(row[(kinds == kinds[i]) & (names != names[i])])
        floors.append(int(same[-POSITIVES]) if len(same) >= POSITIVES else _LEAST)
    return {"dim": vec.shape[1], "ids": ids, "labels": labels, "data": vec.astype("<i4").tobytes(),
            "low": vec.min(axis=0).tolist(), "high": vec.max(axis=0).tolist(), "places": at, "floors": floors}


def _pieces(batches):
    """Sorted rows as pieces of BLOCK_ROWS vectors of one length; the last of each length may be shorter."""
    held = None
    for batch in batches:
        for dim, places in groupby(range(batch.num_rows), key=batch.column("dim").to_pylist().__getitem__):
            places = list(places)
            piece = batch.slice(places[0], len(places))
            new = (piece.column("vec_id").to_pylist(), piece.column("label").to_pylist(), _matrix(piece.column("vec"), dim))
            if held is not None and held[2].shape[1] == dim:
                new = (held[0] + new[0], held[1] + new[1], np.concatenate((held[2], new[2])))
            elif held is not None:
                yield held
            while len(new[0]) > BLOCK_ROWS:
                yield tuple(c[:BLOCK_ROWS] for c in new)
                new = tuple(c[BLOCK_ROWS:] for c in new)
            held = new
    if held is not None:
        yield held


def _blocks(every: int):
    def run(batches):
        part, seq, zone = TaskContext.get().partitionId(), 0, None
        for piece in _pieces(batches):
            row = _block(*piece, every)
            if zone and (zone["n"] == GROUP_BLOCKS or zone["dim"] != row["dim"]):
                yield pa.RecordBatch.from_pylist([zone], _BLOCK)
                zone = None
            if zone is None:
                zone = {"grp": part << 32 | seq, "n": 0, **{k: row[k] for k in ("dim", "low", "high")}}
            zone["low"], zone["high"] = list(map(min, zone["low"], row["low"])), list(map(max, zone["high"], row["high"]))
            zone["n"] += 1
            yield pa.RecordBatch.from_pylist([{"grp": zone["grp"], "block": part << 32 | seq, **row}], _BLOCK)
            seq += 1
        if zone:
            yield pa.RecordBatch.from_pylist([zone], _BLOCK)
    return run


def hilbert_blocks(vectors: DataFrame, every: int) -> DataFrame:
    """Blocks of (vec_id, label, vec) in the order of length and Hilbert curve, and the zones of groups, as Parquet."""
    size = F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))
    reach, n = vectors.agg(size, F.count(F.lit(1))).first()
    keyed = settle(vectors.mapInArrow(_keys(int(reach or 0)), "vec_id long, label long, vec array<long>, dim int, key binary"), "vectors")
    dealt = keyed.repartitionByRange(max(1, n // (BLOCK_ROWS * GROUP_BLOCKS)), "dim", "key", "vec_id")
    return settle(dealt.sortWithinPartitions("dim", "key", "vec_id").mapInArrow(_blocks(every), _BLOCK_SQL), "hilbert-blocks")


# ---- searches -----------------------------------------------------------------------
_ANCHOR = "dim int, anchor long, id long, label long, data binary, no array<int>, wlow array<long>, whigh array<long>"
_PACK = pa.schema([
    ("pack", pa.int64()), ("dim", pa.int32()), ("anchors", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
    ("data", pa.binary()), ("owner", pa.list_(pa.int32())), ("no", pa.list_(pa.int32())), ("wlow", pa.list_(pa.int64())), ("whigh", pa.list_(pa.int64()))])
_PACK_SQL = ("pack long, dim int, anchors array<long>, ids array<long>, labels array<long>, data binary, owner array<int>, no array<int>, "
             "wlow array<long>, whigh array<long>")
_HIT = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("no", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _anchors(batches):
    """The anchors of blocks, with one window each: from what their own block offers upwards."""
    fields = pa.schema([("dim", pa.int32()), ("anchor", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("data", pa.binary()),
                        ("no", pa.list_(pa.int32())), ("wlow", pa.list_(pa.int64())), ("whigh", pa.list_(pa.int64()))])
    for row in rows_of(batches):
        vec = _vectors(row)
        out = [{"dim": row["dim"], "anchor": row["block"] * BLOCK_ROWS + i, "id": row["ids"][i], "label": row["labels"][i],
                "data": vec[i].tobytes(), "no": [0], "wlow": [floor], "whigh": [_NO_ID]} for i, floor in zip(row["places"], row["floors"])]
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)


def _packs(batches):
    """Sorted anchors as packs of vectors of one length."""
    part, seq, held = TaskContext.get().partitionId(), 0, []

    def packed():
        many = range(len(held))
        return pa.RecordBatch.from_pylist([{
            "pack": part << 32 | seq, "dim": held[0]["dim"], "anchors": [a["anchor"] for a in held], "ids": [a["id"] for a in held],
            "labels": [a["label"] for a in held], "data": b"".join(a["data"] for a in held),
            "owner": [i for i in many for _ in held[i]["no"]],
            **{k: [x for a in held for x in a[k]] for k in ("no", "wlow", "whigh")}}], _PACK)

    for row in rows_of(batches):
        if held and (len(held) == PACK_ANCHORS or held[0]["dim"] != row["dim"]):
            yield packed()
            seq, held = seq + 1, []
        held.append(row)
    if held:
        yield packed()


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most the least and at least the greatest inner product of each row of `a` with vectors of each zone."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = (np.asarray(x, np.float64).reshape(len(x), a.shape[1]).T for x in (low, high))
    # exact below 2 ** 53; the slack covers what larger sums lose
    slack = np.abs(a).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)) * 2.0**-40
    return np.floor(up @ low + down @ high - slack), np.ceil(up @ high + down @ low + slack)


def _meets(row: dict, low, high) -> np.ndarray:
    """Which windows of a pack (rows) may hold scores with vectors of which zones (columns)."""
    least, most = bounds(_vectors(row), low, high)
    owner = np.array(row["owner"], np.int64)
    wlow, whigh = (np.array(row[k], np.int64).astype(np.float64)[:, None] for k in ("wlow", "whigh"))
    return (most[owner] >= wlow) & (least[owner] <= whigh)


def _route(batches):
    """(pack, grp) of every group whose zone meets a window of the pack."""
    schema = pa.schema([("pack", pa.int64()), ("grp", pa.int64())])
    for row in rows_of(batches):
        zones = [z for z in row["zones"] if z["dim"] == row["dim"]]
        if zones:
            wanted = _meets(row, [z["low"] for z in zones], [z["high"] for z in zones]).any(axis=0)
            found = [z["grp"] for z, yes in zip(zones, wanted) if yes]
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=schema)


def _first(masked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first `most` entries of each row above _LEAST: greatest first, ties by column."""
    if masked.shape[1] > most:
        kth = np.partition(masked, -most, axis=1)[:, -most]
    else:
        kth = np.full(len(masked), _LEAST)
    r, c = np.nonzero((masked >= kth[:, None]) & (masked > _LEAST))
    order = np.lexsort((c, -masked[r, c], r))
    r, c = r[order], c[order]
    begin = np.searchsorted(r, np.arange(len(masked)))
    keep = np.arange(len(r)) - begin[r] < most
    return r[keep], c[keep]


def _scan(same: bool, most: int):
    """Hits of the packs of anchors that follow each group's blocks in the sorted stream."""
    def run(batches):
        grp, blocks, names, kinds = None, [], None, None
        for row in rows_of(batches):
            if row["grp"] != grp:
                grp, blocks, names = row["grp"], [], None
            if row["kind"] == 0:
                blocks.append(row)
                continue
            if names is None:
                names = np.concatenate([_names(b["ids"]) for b in blocks])
                kinds = np.concatenate([b["labels"] for b in blocks])
                by_id = np.argsort(names, kind="stable")
            wanted = _meets(row, [b["low"] for b in blocks], [b["high"] for b in blocks])
            owner, no = np.array(row["owner"], np.int64), np.array(row["no"])
            low, high = np.array(row["wlow"], np.int64), np.array(row["whigh"], np.int64)
            vec, own = _vectors(row), _names(row["ids"])
            label = np.array(row["labels"])
            starts = np.searchsorted(owner, np.arange(len(own) + 1))
            for begin in range(0, len(own), 128):  # anchors at once: their scores with a group are some 8 MB
                mine = slice(begin, min(begin + 128, len(own)))
                w = slice(starts[mine.start], starts[mine.stop])
                table = np.full((mine.stop - mine.start, len(names)), _LEAST)
                at = 0
                for k, b in enumerate(blocks):
                    need = np.unique(owner[w][wanted[w, k]]) - begin
                    if len(need):
                        table[need, at: at + len(b["ids"])] = scores(vec[mine][need], _vectors(b))
                    at += len(b["ids"])
                fits = (kinds[None, :] == label[mine, None]) == same
                fits &= names[None, :] != own[mine, None]
                table = np.where(fits, table, _LEAST)[:, by_id]
                for n in np.unique(no[w]):  # the windows of one number, one for each anchor at most
                    which = np.flatnonzero(no[w] == n) + w.start
                    t = table[owner[which] - begin]
                    t = np.where((t >= low[which, None]) & (t <= high[which, None]), t, _LEAST)
                    r, c = _first(t, most)
                    if len(r):
                        who = owner[which][r]
                        ids = names[by_id][c]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.array(row["anchors"], np.int64)[who]), pa.array(own[who]), pa.array(np.full(len(r), n), pa.int32()),
                            pa.array(t[r, c]), pa.array(ids, mask=ids == _NO_ID)], schema=_HIT)
    return run


def search(blocks: DataFrame, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """(anchor, anchor_id, no, score, vec_id, rank): the first `most` rows of each window of the anchors.

    blocks: of `hilbert_blocks`; anchors: dim, anchor, id, label, data and windows (no, wlow, whigh,
    both ends included). A row fits if its label is the anchor's (`same`) or not, its vec_id is
    another and its vector as long.
    """
    spark = blocks.sparkSession
    n_anchors = anchors.count()
    ordered = anchors.repartitionByRange(max(1, n_anchors // PACK_ANCHORS), "dim", "anchor").sortWithinPartitions("dim", "anchor")
    packs = settle(ordered.mapInArrow(_packs, _PACK_SQL), "anchor-packs")
    zones = blocks.where("block IS NULL").select("grp", "dim", "low", "high")
    zone_packs = max(1, -(-zones.count() // ZONE_GROUPS))
    zoned = zones.groupBy(F.pmod(F.xxhash64("grp"), F.lit(zone_packs)).alias("zpack")).agg(
        F.collect_list(F.struct("grp", "dim", "low", "high")).alias("zones"))
    asked = packs.withColumn("zpack", F.explode(F.sequence(F.lit(0), F.lit(zone_packs - 1)).cast("array<long>")))
    routes = settle(asked.join(zoned, "zpack").mapInArrow(_route, "pack long, grp long"), "routes")
    read = blocks.where("block IS NOT NULL").join(routes.select("grp").distinct(), "grp", "left_semi").withColumns(
        {"kind": F.lit(0), "seq": F.col("block")}).drop("block", "places", "floors")
    sent = packs.join(routes, "pack").withColumn("kind", F.lit(1)).withColumnRenamed("pack", "seq")
    stream = read.unionByName(sent, allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", "kind", "seq")
    hits = stream.mapInArrow(_scan(same, most), "anchor long, anchor_id long, no int, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("anchor", "no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", place).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, every: int = 100, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `embeddings`.

    embeddings: vec_id, label, embedding (more columns are ignored); see `integer_vectors` for the
    rows that take part. Anchors are those whose vec_id is divisible by `every`; scores are inner
    products with the anchor, higher first, ties by vec_id, missing ids last. An anchor's positives
    are its first 5 other rows of the same label; each brings the first 10 rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score.

    Other rows are those of another vec_id; repeated rows count each, anchors too. Vectors of
    different length have no score. Anchors without positives, and positives without negatives,
    give no rows; an empty table gives an empty result.
    """
    blocks = hilbert_blocks(integer_vectors(embeddings), every)
    own = blocks.where("block IS NOT NULL AND size(places) > 0").select("block", "dim", "ids", "labels", "data", "places", "floors")
    anchors = settle(own.mapInArrow(_anchors, _ANCHOR), "anchors")
    positives = settle(search(blocks, anchors, True, POSITIVES), "positives")
    wide = F.col("score").cast("decimal(24,0)")
    windows = positives.where("score >= 0").select(
        "anchor", F.struct(F.col("rank").alias("no"), F.ceil(wide * low / 100).cast("long").alias("wlow"),
                           F.floor(wide * high / 100).cast("long").alias("whigh")).alias("w")).groupBy("anchor").agg(
        F.array_sort(F.collect_list("w")).alias("w"))
    asked = settle(anchors.drop("no", "wlow", "whigh").join(windows, "anchor").select(
        "dim", "anchor", "id", "label", "data", *[F.col(f"w.{c}").alias(c) for c in ("no", "wlow", "whigh")]), "windows")
    negatives = search(blocks, asked, False, NEGATIVES)
    first = positives.select("anchor", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(first, ["anchor", "no"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
