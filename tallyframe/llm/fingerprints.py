"""Document fingerprints as homomorphic multiset hashes.

A document is a multiset of paragraphs: its lines, long ones cut at words that their own hash
picks, some eight words apart, so that an edit changes few of them. Every paragraph has a wide
vector, drawn from its hash: LANES entries of +1 or -1, STRONG entries of 64 random bits, and a
one. A fingerprint is the sum of the vectors, modulo 2 ** 32, 2 ** 64 and 2 ** 32. The order of
paragraphs doesn't matter, and one is inserted or deleted by adding or subtracting its vector.

Equal multisets have equal sums; the 64-bit lanes make others differ. The mean product of two
fingerprints' +-1 lanes estimates the scalar product of the documents' paragraph counts; likeness
is twice that over the sum of their squares, 0 for documents that share nothing (up to a
deviation of some 1 / sqrt(LANES)) and 1 for equal ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .text_arrays import _BASE, _BYTE, _UNBASE, flat, mix, powers, slices, words

LANES, STRONG = 128, 4
#: A word ends a paragraph if this many low bits of its hash are zero.
CUT_BITS = 3
_COUNT = np.uint64(2**32 - 1)
#: Modulus of each entry of a vector: lanes, strong entries, number of paragraphs.
MODULI = [2**32] * LANES + [2**64] * STRONG + [2**32]


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every paragraph; together they hold every byte of the texts."""
    buf, off = flat(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, start, end, doc = words(buf, off, lower=False)
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    # a paragraph begins where a document does, and at the word after a cut
    begins = [off[:-1][np.diff(off) > 0]]
    if len(h) > 1:
        cut = ((h[:-1] & np.uint64((1 << CUT_BITS) - 1)) == 0) | (lines[start[1:]] > lines[end[:-1]])
        begins.append(start[1:][cut & (doc[1:] == doc[:-1])])
    begin = np.sort(np.concatenate(begins))
    stop = np.r_[begin[1:], len(buf)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)))))
    value = (total[stop] - total[begin]) * powers(_UNBASE, len(buf))[begin] + (stop - begin).astype(np.uint64)
    return mix(value), np.searchsorted(off, begin, "right") - 1


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes (int64, not yet reduced), strong entries and counts (uint64) of every text."""
    h, doc = paragraphs(texts)
    lanes, strong = np.zeros((len(texts), LANES), np.int64), np.zeros((len(texts), STRONG), np.uint64)
    count = np.bincount(doc, minlength=len(texts)).astype(np.uint64)
    for at in range(0, len(h), 1 << 15):
        own, who = h[at: at + (1 << 15)], doc[at: at + (1 << 15)]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        seed = [mix(own + np.uint64(k * int(_BASE) % 2**64)) for k in range(1, LANES // 64 + 1)]
        bits = np.unpackbits(np.stack(seed, axis=1).astype("<u8").view(np.uint8), axis=1)
        size = np.diff(np.r_[first, len(own)])
        lanes[who[first]] += (2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) - size[:, None])
        wide = np.stack([mix(own ^ np.uint64((k + 77) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(STRONG)], axis=1)
        strong[who[first]] += np.add.reduceat(wide, first, axis=0)
    return lanes, strong, count & _COUNT


def encode(lanes: np.ndarray, strong: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Fingerprints: lanes of 4 bytes, strong entries of 8, the count of 4; as text, in hexadecimal digits."""
    rows = np.concatenate((lanes.astype(np.uint32).astype(">u4").view(np.uint8).reshape(-1, 4 * LANES),
                           strong.astype(">u8").view(np.uint8).reshape(-1, 8 * STRONG),
                           count.astype(">u4").view(np.uint8).reshape(-1, 4)), axis=1)
    return [r.tobytes() for r in rows]


def decode(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `encode` was given, lanes with their sign."""
    rows = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), 4 * LANES + 8 * STRONG + 4)
    lanes, strong, count = (np.ascontiguousarray(x) for x in np.split(rows, (4 * LANES, 4 * LANES + 8 * STRONG), axis=1))
    return lanes.view(">i4").astype(np.int64), strong.view(">u8").astype(np.uint64), count.view(">u4").astype(np.uint64).ravel()


def likeness(a, b) -> np.ndarray:
    """0 to 1 for each pair of decoded fingerprints: 1 for equal ones, and for two empty texts."""
    x, y = (v[0].astype(np.float64) for v in (a, b))
    square = (x * x + y * y).sum(axis=1)
    out = np.clip(2 * (x * y).sum(axis=1) / np.maximum(square, 1), 0, 1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1) & (a[2] == b[2])
    # other texts are never quite alike
    return np.where(same, 1.0, np.minimum(out, 1 - 2.0**-20))


def _combine(a: Column, b: Column, sign: int) -> Column:
    """Fingerprint text of the sum (sign 1) or difference (-1) of two, entry by entry; JVM only."""
    spots, at = [], 1
    for m in MODULI:
        digits = (m.bit_length() - 1) // 4
        spots.append((at, digits))
        at += digits

    def entry(col, at, digits):
        return F.conv(F.substring(col, at, digits), 16, 10).cast("decimal(38,0)")

    out = []
    for (at, digits), m in zip(spots, MODULI):
        value = F.pmod(entry(a, at, digits) + sign * entry(b, at, digits), F.lit(str(m)).cast("decimal(38,0)"))
        out.append(F.lower(F.lpad(F.conv(value.cast("string"), 10, 16), digits, "0")))
    return F.concat(*out)


def inserted(fingerprint: Column, more: Column) -> Column:
    """The fingerprint of a document with another's paragraphs added."""
    return _combine(fingerprint, more, 1)


def deleted(fingerprint: Column, less: Column) -> Column:
    """The fingerprint of a document with another's paragraphs taken away."""
    return _combine(fingerprint, less, -1)


def _print(batches):
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode(*vectors(batch.column("text"))), pa.binary())],
                                             names=["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of `documents` (doc_id, text; more columns are ignored).

    A null text is empty; empty texts have the fingerprint zero. One pass, no shuffle.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_print, "doc_id long, fingerprint binary").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"))


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], following: list[str]) -> dict:
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - k] + f[:k] for t, k, f in zip(texts, half, following)]
    prints = [encode(*vectors(pa.array(x, pa.string()))) for x in (texts, edited, following)]
    own, changed, after = map(decode, prints)
    return {"doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": prints[0], "edited_fingerprint": prints[1],
            "near_edited": likeness(own, changed), "near_next": likeness(own, after)}


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                     ("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string()), ("last_id", pa.int64())])


def _in_order(batches):
    """Compare each row of a sorted partition with the next; the first and last texts go on as they are."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            if first is None:
                first = texts[0]
            if last is not None:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            if len(ids) > 1:
                out = _compare(ids[:-1], texts[:-1], texts[1:])
                none = [None] * (len(ids) - 1)
                yield pa.RecordBatch.from_pydict({**out, "part": none, "first_text": none, "last_text": none, "last_id": none}, _FIELDS)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "first_text": first, "last_text": last[1], "last_id": last[0]}], _FIELDS)


def _borders(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("last_id", "last_text", "next_text")}
            yield pa.RecordBatch.from_pydict(_compare([row["last_id"]], [row["last_text"]], [row["next_text"]]),
                                             pa.schema(list(_FIELDS)[:7]))


def edit_probe(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents beside those of an edited text and of the next document.

    Likeness is that of the fingerprints as they are returned.

    documents: doc_id, text; other columns are ignored. The next document is the next by
    descending doc_id (missing ids last, equal ids by text); after the last comes the first. In
    the edited text the last floor(n_chars / 2) code points are replaced by as many of the next
    document's first, or all it has. A single row is its own next. No rows give no rows.

    Texts are range-partitioned once. Where a partition ends, its last text and the first of the
    next go to a second, small step: two texts a partition.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
    dealt = slim.repartitionByRange(parts, order).sortWithinPartitions(order, F.coalesce("text", F.lit("")))
    out = settle(dealt.mapInArrow(_in_order, _ROW + ", part long, first_text string, last_text string, last_id long"), "fingerprints")
    names = [c.split()[0] for c in _ROW.split(", ")]
    edge = out.where("part IS NOT NULL")
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first_text").over(line), F.first("first_text").over(whole))
    borders = edge.select("last_id", "last_text", following.alias("next_text"))
    rows = out.where("part IS NULL").select(*names).union(borders.mapInArrow(_borders, _ROW))
    # the texts of fingerprints are twice as long as what was stored
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
