"""Benchmark passages in training documents, found by spaced seeds.

A seed is a fixed mask over word positions: the words under its ones are hashed, the others are
ignored, so that a replaced word only breaks the seeds that look at it. The masks below hit
every window of WINDOW words of which at most MISSES are replaced, and every shorter item of
which at most a fifth is. Seeds of the benchmark and
of the documents are joined on their hashes; each hit aligns an item with a document, and the
words around it are compared: an overlap is a window (the whole item, if it is shorter) in
which at least 80 % of the words agree.

Documents send only what can match: a bitmap of fixed size over the benchmark's seeds is
broadcast first, and stretches of words around seeds that are in it go on, with their seeds.
A full bitmap lets all seeds pass; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text_arrays import flat, mix, powers, slices, words

WINDOW, MISSES = 20, 4
#: Lossless for WINDOW and MISSES, and for items of 8, 9, 12 to 14 and 16 to 19 words with a fifth of them replaced.
MASKS = ((0, 1, 7, 8, 9, 10), (0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 4, 6), (0, 1, 2, 3, 4))
#: Further masks, each for items of just these lengths, which make those lossless too. Of up to 4
#: words, 80 % are all of them.
SHORT_MASKS = {(0, 1, 2, 3): (4, 5, 6, 7, 10, 11, 15), (0, 2, 3, 4): (5, 10), (0, 1, 3, 4): (5, 6), (0, 1, 2, 4): (5,),
               (0,): (1,), (0, 1): (2,), (0, 1, 2): (3,)}
ALL_MASKS = (*MASKS, *SHORT_MASKS)
#: The share of equal words that the masks are lossless for.
LEAST_SHARE = 0.8
BITMAP_BITS = 24
_BLOCK_BITS = 18
_SEEDS = "array<struct<hash: long, at: int>>"


def seeds(h: np.ndarray, doc: np.ndarray, masks=ALL_MASKS, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every seed of `masks`, some of ALL_MASKS; none reaches over the end of its document.

    With the length of each document, SHORT_MASKS make seeds only where they are for that length.
    """
    step, out, at = powers(np.uint64(0xA24BAED4963EE407), max(map(max, masks)) + 1), [], []
    for mask in masks:
        number = ALL_MASKS.index(mask)
        n = max(len(h) - mask[-1], 0)
        total = np.full(n, (number + 1) * 0x9FB21C651E98DF25 % 2**64, np.uint64)
        for j in mask if n else ():
            total += h[j: j + n] * step[j]
        whole = np.flatnonzero(doc[:n] == doc[mask[-1]: mask[-1] + n])
        if length is not None and mask in SHORT_MASKS:
            whole = whole[np.isin(length[doc[whole]], SHORT_MASKS[mask])]
        out.append(mix(total[whole]))
        at.append(whole)
    return np.concatenate(out), np.concatenate(at)


def _lists(values: np.ndarray, sizes, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))


def _seed_lists(h, at, sizes) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))], ["hash", "at"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _item_words(batches):
    for batch in batches:
        buf, off = flat(batch.column("text"))
        h, _, _, doc = words(buf, off, letters=True)
        begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        s, at = seeds(h, doc, length=np.diff(begin))
        owner = doc[at] if len(at) else at
        order = np.argsort(owner, kind="stable")
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("item"), _lists(h.view(np.int64), np.diff(begin), pa.int64()),
             _seed_lists(s[order], (at - begin[owner])[order], np.bincount(owner, minlength=batch.num_rows))],
            names=["item_id", "item", "words", "seeds"])


def _block(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
    bits[table["bit"].to_numpy() & ((1 << _BLOCK_BITS) - 1)] = 1
    return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _bitmap(items: DataFrame) -> bytes:
    """One bit for each value of the leading BITMAP_BITS of a seed's hash: 2 MB at any size."""
    bit = F.shiftrightunsigned(F.col("s.hash"), 64 - BITMAP_BITS)
    found = items.select(F.explode("seeds").alias("s")).select(bit.alias("bit")).distinct().withColumn(
        "block", F.shiftright("bit", _BLOCK_BITS)).groupBy("block").applyInArrow(_block, "block long, bits binary")
    size = 1 << (_BLOCK_BITS - 3)
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in found.collect():
        out[r.block * size: (r.block + 1) * size] = r.bits
    return bytes(out)


def _stretches(bitmap, masks):
    """Stretches of a document's words around seeds that the bitmap has."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())),
                        ("seeds", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))])
    reach = WINDOW + max(map(max, ALL_MASKS))

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                buf, off = flat(batch.column("text"))
                h, _, _, doc = words(buf, off, letters=True)
                s, at = seeds(h, doc, masks)
                place = (s >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                hit = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
                s, at = s[hit], at[hit]
                if not len(s):
                    continue
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                owner = doc[at]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > WINDOW)]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(at)] - 1
                begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lo = np.maximum(at[first] - WINDOW, begin[owner[first]])
                hi = np.minimum(at[last] + reach, begin[owner[first] + 1])
                size = hi - lo
                inner = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(owner[first])) for c in ("row", "doc_id", "digest")],
                     pa.array((lo - begin[owner[first]]).astype(np.int32)), _lists(h[inner].view(np.int64), size, pa.int64()),
                     _seed_lists(s, at - np.repeat(lo, last - first + 1), last - first + 1)], schema=schema)
    return run


def _verify(share: float, least: int):
    """Compare a stretch with an item whose first word is `shift` words into it."""
    top = round(share * 100)

    def run(batches):
        for batch in batches:
            shifts, rows, found = batch.column("shift").to_numpy(), [], []
            for i in range(batch.num_rows):
                item, span = (batch.column(c)[i].values.to_numpy() for c in ("item_words", "words"))
                need, shift = min(len(item), WINDOW), int(shifts[i])
                a, b = max(0, -shift), min(len(item), len(span) - shift)
                if need < least or b - a < need:
                    continue
                same = np.concatenate(([0], np.cumsum(item[a:b] == span[a + shift: b + shift])))
                full = same[need:] - same[:-need]
                best = int(full.argmax())
                if 100 * full[best] >= top * need:
                    rows.append(i)
                    found.append((a + shift + best, need, int(full[best])))
            kept = batch.select(["key", "item", "item_id"]).take(pa.array(rows, pa.int64()))
            at, n, equal = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(equal, pa.int64())],
                                             names=["key", "item", "item_id", "at_word", "n_words", "n_equal"])
    return run


def _overlaps(documents: DataFrame, benchmark: DataFrame, share: float, least_words: int) -> DataFrame:
    """`leaks` with the digest of the document's text, which tells rows of one doc_id apart."""
    if share < LEAST_SHARE or least_words < 1:
        raise ValueError(f"the masks find all overlaps of {LEAST_SHARE:.0%} equal words or more, of items with words")
    spark = documents.sparkSession
    items = settle(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
                                    F.monotonically_increasing_id().alias("item"))
                   .mapInArrow(_item_words, f"item_id long, item long, words array<long>, seeds {_SEEDS}"), "benchmark-seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    # masks for lengths that no item has find nothing; there are fewer lengths than WINDOW
    lengths = {r[0] for r in items.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect()}
    masks = tuple(m for m in ALL_MASKS if m in MASKS or lengths.intersection(SHORT_MASKS[m]))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            F.xxhash64(F.col("text").cast("string")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    spans = settle(rows.mapInArrow(_stretches(bitmap, masks), f"row long, doc_id long, digest long, start int, words array<long>, seeds {_SEEDS}"),
                   "seed-stretches")
    # texts that share a passage send equal stretches: each different one is compared once
    key = F.struct(F.xxhash64("words").alias("a"), F.hash("words").alias("b"), F.size("words").alias("n"))
    keyed = spans.withColumn("key", key)
    alike = keyed.groupBy("key").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"))
    asked = items.select("item", F.explode("seeds").alias("s")).select("item", F.col("s.hash").alias("hash"), F.col("s.at").alias("at"))
    lines = (alike.select("key", F.explode("seeds").alias("d")).join(asked, F.col("d.hash") == F.col("hash"))
             .select("key", "item", (F.col("d.at") - F.col("at")).alias("shift")).distinct())
    pairs = lines.join(alike.select("key", "words"), "key").join(
        items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    checked = pairs.select("key", "item", "item_id", "shift", "words", "item_words").mapInArrow(
        _verify(share, least_words), "key struct<a: long, b: int, n: int>, item long, item_id long, at_word long, n_words long, n_equal long")
    best = checked.groupBy("key", "item", "item_id").agg(F.max(F.struct(
        F.col("n_equal"), (-F.col("at_word")).alias("first"), "n_words")).alias("m"))
    each = keyed.select("row", "doc_id", "digest", "start", "key").join(best, "key").groupBy("row", "doc_id", "digest", "item", "item_id").agg(
        F.max(F.struct("m.n_equal", (F.col("m.first") - F.col("start")).alias("first"), "m.n_words")).alias("m"))
    return each.select("doc_id", "digest", "item_id", (-F.col("m.first")).cast("long").alias("at_word"), "m.n_words", "m.n_equal")


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = LEAST_SHARE, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, at_word, n_words, n_equal): the best overlap of a document and an item.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs
    of letters and digits, in lower case; texts that differ in marks and spaces only are equal.
    Items of under `least_words` words are not looked for, nor are those without words. Items of
    under WINDOW words are compared whole. No overlap of `share` is lost; a share of under
    LEAST_SHARE is refused. Null texts are empty. Rows with equal or missing ids are told apart
    while they are compared; the result has a row for each. Equal items each give a row. Empty
    tables give no rows.
    """
    return _overlaps(documents, benchmark, share, least_words).drop("digest")


def without_leaks(documents: DataFrame, benchmark: DataFrame, share: float = LEAST_SHARE, least_words: int = 1) -> DataFrame:
    """The documents that overlap with no item; others of the same doc_id, or without one, stay."""
    found = _overlaps(documents, benchmark, share, least_words).select(F.struct("doc_id", "digest").alias("__leak")).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    return documents.join(found, own == F.col("__leak"), "left_anti")
