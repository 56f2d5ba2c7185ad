"""Removal of long repeated byte strings, found as intervals of a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller doc_id. The corpus is too large for one suffix array, and no string that matters is
longer than `length`, so the work is split by content:

1. Every window of `length` bytes has an anchor, the run of ANCHOR bytes in it with the least
   hash. Equal windows have equal anchors. Neighbouring windows with the same anchor are one
   segment, some 70 bytes long. Whole copies of a text go first and send no segments.
2. Anchors travel as packed hashes, with a byte each about what stands left and right of them.
   Those that another document has too are told so; only their segments are sent on, to the
   task of their anchor, each different one once from a chunk.
3. There the different segments are concatenated, a suffix array gives the Burrows-Wheeler
   transform, and intervals of the strings that occur are extended backwards, breadth first: the
   right end of an interval of strings of m + 1 bytes that is met for the first time has a
   common prefix of m bytes with what follows. Values so come out in increasing order, and the
   search stops at `length`: what is not yet separated then are the repeated windows.
4. The least doc_id of each repeated window goes back to the chunks, which cut their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import chunks as ch
from .text_arrays import ByteRuns, mix

ANCHOR = 16
#: Bytes of text whose windows are looked at together.
PIECE = 1 << 18
#: Bytes of a chunk. Anchors and segments travel as a row for each chunk and bucket, whose number is
#: a product: large chunks and buckets keep it small.
CHUNK = 16 << 20
#: Bytes of text for each bucket of anchors, and of segments.
ANCHOR_BUCKET, SEGMENT_BUCKET = 8 << 20, 4 << 20
#: Bytes of segments that are searched for repeats together.
CELL = 1 << 17
#: Bits of a place in a suffix order that is sorted in place.
_SMALL = 21
_POSITION = np.uint64((1 << 23) - 1)
_LAST_ID = np.int64(2**63 - 1)
_SHA = "uid long, doc_id long, n long, sha binary"


def _digests(batches):
    for row in ch.rows_of(batches):
        buf, off, uids = ch.unpack(row)
        raw = buf.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(uids), pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(off)),
             pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1], off[1:])], pa.binary())],
            names=["uid", "doc_id", "n", "sha"])


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span:]) if width > span else h


def segments(buf: np.ndarray, off: np.ndarray, active: np.ndarray, length: int):
    """Segments of the active documents: first and last + 1 window start, anchor's hash and its contexts,
    document, and a hash of the segment's bytes.

    Column `left` (`right`) is a byte of hash over what stands before (after) the anchor in the
    windows that reach that far; 0 if none does. One of them is part of any window.
    """
    width, side = length - ANCHOR + 1, (length - ANCHOR) // 2
    size = np.diff(off)
    # starts of windows that end in their document; no two documents' windows are neighbours
    whole = np.repeat(active, size)
    tail = np.minimum(size, length - 1)
    whole[np.repeat(off[1:] - np.cumsum(tail), tail) + np.arange(tail.sum())] = False
    parts = []
    for at in range(0, max(len(buf) - length + 1, 0), PIECE):
        piece = buf[at: at + PIECE + length - 1]
        n = len(piece) - length + 1
        runs = ByteRuns(piece)
        h = runs.every(ANCHOR)
        least = _sliding_least(h & ~_POSITION | np.arange(len(h), dtype=np.uint64), width)[:n]
        anchor = least & _POSITION
        good = whole[at: at + n]
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
        begin = np.flatnonzero(edge)
        first, stop = begin[:-1], begin[1:]
        keep = good[first]
        first, stop = first[keep], stop[keep]
        spot = anchor[first].astype(np.int64)
        left, right = np.zeros(len(first), np.uint8), np.zeros(len(first), np.uint8)
        # the first window begins `side` bytes before the anchor; the last ends `side` after it
        for context, far, where in ((left, spot - first >= side, spot - side),
                                    (right, stop - 1 + length >= spot + ANCHOR + side, spot + ANCHOR)):
            x = where[far]
            context[far] = (runs.between(x, x + side) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        # least hashes are small numbers: mixed again, they fill the buckets evenly
        parts.append((first + at, stop + at, mix(h[spot]), left, right, np.searchsorted(off, first + at, "right") - 1,
                      runs.between(first, stop - 1 + length)))
    if not parts:
        none = np.zeros(0, np.int64)
        return (none, none, none.astype(np.uint64), none.astype(np.uint8), none.astype(np.uint8), none, none.astype(np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _chunk(row: dict, length: int):
    """Segments of a chunk, its different anchors with contexts, and which of those each segment has."""
    buf, off, uids = ch.unpack(row)
    active = np.ones(len(uids), bool)
    active[np.array([x & 0xFFFF for x in row.get("copies") or []], np.int64)] = False
    first, stop, key, left, right, doc, content = segments(buf, off, active, length)
    order = np.lexsort((left.astype(np.uint16) << np.uint16(8) | right, key))
    fresh = np.ones(len(order), bool)
    k, a, b = key[order], left[order], right[order]
    fresh[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return buf, off, active, (first, stop, key, doc, content, kind), (k[fresh], a[fresh], b[fresh], order, fresh)


def _anchors(length: int, bits: int):
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("bucket", pa.int64()),
                        ("keys", pa.binary()), ("sides", pa.binary())])

    def run(batches):
        for row in ch.rows_of(batches):
            _, _, _, (_, _, _, doc, _, _), (key, left, right, order, fresh) = _chunk(row, length)
            if not len(key):
                continue
            begin = np.flatnonzero(fresh)
            several = np.maximum.reduceat(doc[order], begin) > np.minimum.reduceat(doc[order], begin)
            sides = np.stack([left, right, several.astype(np.uint8)], axis=1)
            low = (key << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :5]
            yield pa.RecordBatch.from_pylist([
                {"part": row["part"], "seq": row["seq"], "bucket": bucket,
                 "keys": ch.squeeze(np.ascontiguousarray(low[i:j]).view("V5").ravel()),
                 "sides": ch.squeeze(np.ascontiguousarray(sides[i:j]).view("V3").ravel())}
                for bucket, i, j in ch.cut(key, bits)], schema)
    return run


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: which anchors stand, with one of their contexts, in more than one document."""
    keys = [ch.unsqueeze(x.as_py(), "V5").view(np.uint8).reshape(-1, 5) for x in table["keys"]]
    size = np.array([len(k) for k in keys])
    wide = np.zeros((size.sum(), 8), np.uint8)
    wide[:, :5] = np.concatenate(keys)
    value = wide.view(">u8").ravel().astype(np.uint64)
    side = np.concatenate([ch.unsqueeze(x.as_py(), "V3").view(np.uint8).reshape(-1, 3) for x in table["sides"]])
    live = side[:, 2] > 0
    for k in (0, 1):  # the low 24 bits of `value` are free
        tag = value | side[:, k].astype(np.uint64)
        order = np.argsort(tag)
        t = tag[order]
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        count = np.diff(np.r_[begin, len(t)])
        # two entries of one chunk may be of one document: then its segments go for nothing
        many = (count > 1) | (np.maximum.reduceat(side[order, 2], begin) > 0)
        live[order] |= np.repeat(many & (side[order[begin], k] > 0), count)
    ends = np.cumsum(size)
    return pa.table({"part": table["part"], "seq": table["seq"], "bucket": table["bucket"],
                     "live": pa.array([np.packbits(live[e - n: e]).tobytes() for e, n in zip(ends, size)], pa.binary())})


def _gather(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many pieces, one after the other."""
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    i = 0
    while i < len(size):
        at = ends[i] - size[i]
        j = max(i + 1, int(np.searchsorted(ends, at + (4 << 20), "right")))
        out[at: ends[j - 1]] = buf[np.repeat(begin[i:j] - (ends[i:j] - size[i:j]), size[i:j]) + np.arange(at, ends[j - 1])]
        i = j
    return out


def _numbered_texts(buf: np.ndarray, first: np.ndarray, size: np.ndarray, content: np.ndarray):
    """A number for each different text, in order of first places, and those places.

    Texts with equal hashes are compared; one that differs from the first of its hash has its own number.
    """
    _, place, same = np.unique(content, return_index=True, return_inverse=True)
    place = place[same]  # first place with this hash
    twin = np.flatnonzero((place != np.arange(len(place))) & (size[place] == size))
    equal = _gather(buf, first[twin], size[twin]) == _gather(buf, first[place[twin]], size[twin])
    if len(twin):
        twin = twin[np.logical_and.reduceat(equal, np.cumsum(size[twin]) - size[twin])]
    own = np.arange(len(place))
    own[twin] = place[twin]
    alone = own == np.arange(len(own))
    return (np.cumsum(alone) - 1)[own], np.flatnonzero(alone)


def _live_segments(row: dict, length: int, bits: int):
    """Where the segments of a chunk stand whose anchors are shared, and the numbers of their different
    texts; start, size and anchor of each of those, in the order of anchors."""
    buf, off, active, (first, stop, key, doc, content, kind), (keys, *_) = _chunk(row, length)
    live = np.zeros(len(keys), bool)
    for (_, i, j), x in zip(ch.cut(keys, bits), row["found"] or []):
        live[i:j] = np.unpackbits(np.frombuffer(x["live"], np.uint8), count=j - i).astype(bool)
    at = np.flatnonzero(live[kind]) if len(kind) else np.zeros(0, np.int64)
    at = at[np.argsort(key[at], kind="stable")]
    first, size = first[at], stop[at] - 1 + length - first[at]
    which, place = _numbered_texts(buf, first, size, content[at])
    return buf, off, active, first, doc[at], which, (first[place], size[place], key[at][place])


def _ids(row: dict) -> np.ndarray:
    return np.array([_LAST_ID if x is None else x for x in row["doc_ids"]], np.int64)


def _send(length: int, bits: int, places: int):
    """bits: of the buckets that anchors were compared in. places: of those that segments go to."""
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("bucket", pa.int64()), ("base", pa.int64()),
                        ("sizes", pa.binary()), ("cells", pa.binary()), ("least", pa.binary()), ("most", pa.binary()),
                        ("text", pa.binary())])

    def run(batches):
        for row in ch.rows_of(batches):
            buf, _, _, _, doc, which, (first, size, key) = _live_segments(row, length, bits)
            if not len(size):
                continue
            ids = _ids(row)[doc]
            least, most = np.full(len(size), _LAST_ID), np.full(len(size), -_LAST_ID)
            np.minimum.at(least, which, ids)
            np.maximum.at(most, which, ids)
            cell = (key << np.uint64(places) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_pylist([
                {"part": row["part"], "seq": row["seq"], "bucket": bucket, "base": i,
                 "sizes": ch.squeeze(size[i:j].astype(np.int32)), "cells": ch.squeeze(cell[i:j]),
                 "least": ch.squeeze(least[i:j]), "most": ch.squeeze(most[i:j]),
                 "text": ch.compress(_gather(buf, first[i:j], size[i:j]).tobytes())}
                for bucket, i, j in ch.cut(key, places)], schema)
    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` or more bytes that follow, by doubling of ranks.

    Up to 2^21 positions, two ranks and the position fit a word, and words are sorted in place,
    which takes a fraction of an indirect sort.
    """
    n = len(text)
    small = n < 1 << _SMALL
    present = np.zeros(256, bool)
    present[text] = True
    code = np.cumsum(present).astype(np.uint64)  # from 1; 0 stands after the end
    width = int(code[-1]).bit_length() if n else 1
    known = (64 - _SMALL if small else 64) // width
    padded = np.concatenate((code[text], np.zeros(known, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key = key << np.uint64(width) | padded[j: j + n]
    position = np.arange(n, dtype=np.uint64)
    while True:
        if small:
            word = np.sort(key << np.uint64(_SMALL) | position)
            order, k = (word & np.uint64((1 << _SMALL) - 1)).astype(np.int64), word >> np.uint64(_SMALL)
        else:
            order = np.argsort(key)  # equal keys may stand in any order
            k = key[order]
        if known > depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]]).astype(np.uint64)
        follow = np.zeros(n, np.uint64)
        follow[: max(n - known, 0)] = rank[known:] + np.uint64(1)
        key = rank << np.uint64(_SMALL if small else 32) | follow
        known *= 2


def separated(text: np.ndarray, order: np.ndarray, depth: int, stop: np.ndarray) -> np.ndarray:
    """Where neighbours in the suffix order share less than `depth` bytes.

    text: cyclic. stop marks positions of terminators, which no string is extended by. Returns
    a flag for each place in the order: it differs from the place before within `depth` bytes
    (at terminators not always; strings without terminators are separated from each other).
    """
    n, small = len(text), np.int32 if len(text) < 2**31 - 1 else np.int64
    before = order - 1  # -1 is the last position
    # terminators sort last: their symbol is above all bytes
    symbol = text[before].astype(np.int16)
    symbol[stop[before]] = 256
    by_symbol = np.argsort(symbol, kind="stable").astype(small)
    step = np.empty(n, small)  # of each place to that of the string one byte longer
    step[by_symbol] = np.arange(n, dtype=small)
    same = symbol[by_symbol[1:]] == symbol[by_symbol[:-1]]
    earlier, later = np.full(n, -1, small), np.full(n, n, small)
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    usable = symbol < 256
    del by_symbol, same, symbol, before
    met = np.zeros(n + 1, bool)
    low, high, known = np.array([0], small), np.array([n], small), 0
    if depth > 8 and n > 8:  # the first 8 levels lie in words of 8 bytes: those that end where only the last byte differs
        known = 8
        around = np.concatenate((text, text[:7]))
        word = np.zeros(n, np.uint64)
        for j in range(8):
            word = word << np.uint64(8) | around[j: j + n]
        word = word[order]
        met[1:n], met[n] = word[1:] != word[:-1], True
        high = np.flatnonzero(met).astype(small)
        low = np.concatenate((np.zeros(1, small), high[:-1]))
        new = np.ones(len(high), bool)
        new[:-1] = word[high[:-1]] >> np.uint64(8) == word[high[:-1] - 1] >> np.uint64(8)
        new[-1] = False  # nothing comes after the last, which a terminator begins
        ends = np.concatenate(([0], np.cumsum(np.concatenate((stop, stop[:7])))))
        first = order[low]
        new &= ends[first + 8] == ends[first]
        low, high = low[new], high[new]
        del word, around, ends
    for _ in range(known, depth):
        size = high - low
        begin = np.cumsum(size, dtype=small) - size
        place = np.repeat(low - begin, size)
        place += np.arange(len(place), dtype=small)
        good = usable[place]
        head = place[good & (earlier[place] < np.repeat(low, size))]
        tail = place[good & (later[place] >= np.repeat(high, size))]
        del place, good
        low, high = np.sort(step[head]), np.sort(step[tail]) + small(1)
        new = ~met[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        met[high] = True
    flags = met[:n].copy()
    flags[0] = True
    return flags


def _cells(table: pa.Table):
    """The segments of a bucket by ranges of their anchors, of some `CELL` bytes each.

    Equal windows have equal anchors, so each range is searched alone. Yields (row of the table, first
    segment, texts) for all rows that have a segment in the range.
    """
    sizes = [ch.unsqueeze(x.as_py(), np.int32).astype(np.int64) for x in table["sizes"]]
    cells = [ch.unsqueeze(x.as_py(), np.uint8) for x in table["cells"]]
    raw = [ch.decompress(x.as_py()) for x in table["text"]]
    ends = [np.concatenate(([0], np.cumsum(x))) for x in sizes]
    held = np.zeros(256, np.int64)
    for size, cell in zip(sizes, cells):
        np.add.at(held, cell, size)
    low = 0
    while low < 256:
        high = max(low + 1, int(np.searchsorted(np.cumsum(held[low:]), CELL, "right")) + low)
        if held[low:high].any():
            found = []
            for row, (cell, end) in enumerate(zip(cells, ends)):
                i, j = np.searchsorted(cell, low), np.searchsorted(cell, high)
                if i < j:
                    cuts = end[i: j + 1].tolist()
                    found.append((row, int(i), [raw[row][a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
            yield found
        low = high


def _repeated(parts: list, least: list, most: list, length: int):
    """Runs of windows of each row's segments that a smaller doc_id has too: (row, segment, from, to, doc_id)."""
    number, texts, which, owners = {}, [], [], []
    for row, i, own in parts:
        for text in own:
            if text not in number:
                number[text] = len(texts)
                texts.append(text)
            which.append(number[text])
        owners.append(least[row][i: i + len(own)])
    which = np.array(which, np.int64)
    owner = np.full(len(texts), _LAST_ID)
    np.minimum.at(owner, which, np.concatenate(owners))
    # 255 does not occur in UTF-8: it ends every segment and sorts after all other bytes
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    order = suffix_order(text, length)
    flags = separated(text, order, length, text == 255)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(flags) - 1
    windows = size - length + 1
    seg = np.repeat(np.arange(len(texts)), windows)
    rank = np.arange(len(seg)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
    g = group[begin[seg] + rank]
    first = np.full(len(text), _LAST_ID)
    np.minimum.at(first, g, owner[seg])
    first = first[g]  # least doc_id of each window
    edge = np.ones(len(seg) + 1, bool)
    edge[1:-1] = (first[1:] != first[:-1]) | (seg[1:] != seg[:-1])
    a, b = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:]) + 1
    run_seg, run_from, run_to, run_id = seg[a], rank[a], rank[b - 1] + 1, first[a]
    run_begin = np.searchsorted(run_seg, np.arange(len(texts) + 1))
    # all rows at once: a segment's runs, kept where a document of the row has a greater id
    count = run_begin[which + 1] - run_begin[which]
    item = np.repeat(np.arange(len(which)), count)
    r = np.repeat(run_begin[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    hit = run_id[r] < np.concatenate([most[row][i: i + len(own)] for row, i, own in parts])[item]
    item, r = item[hit], r[hit]
    place = np.repeat([row for row, _, _ in parts], [len(own) for _, _, own in parts])
    inside = np.concatenate([np.arange(i, i + len(own)) for _, i, own in parts])
    return place[item], np.stack([inside[item], run_from[r], run_to[r], run_id[r]], axis=1)


def _intervals(length: int):
    def run(table: pa.Table) -> pa.Table:
        least, most = ([ch.unsqueeze(x.as_py(), np.int64) for x in table[c]] for c in ("least", "most"))
        base = table["base"].to_numpy()
        cuts = [[] for _ in range(table.num_rows)]
        for parts in _cells(table):
            row, found = _repeated(parts, least, most, length)
            bounds = np.searchsorted(row, np.arange(table.num_rows + 1))
            for i in np.unique(row):
                own = found[bounds[i]: bounds[i + 1]]
                own[:, 0] += base[i]
                cuts[i].append(own)
        rows = [{"part": part, "seq": seq, "cuts": ch.squeeze(np.concatenate(own).ravel())}
                for part, seq, own in zip(table["part"].to_pylist(), table["seq"].to_pylist(), cuts) if own]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("cuts", pa.binary())]))
    return run


def _cut(length: int, bits: int, with_text: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", span)] + [("kept", pa.binary())] * with_text)

    def run(batches):
        for row in ch.rows_of(batches):
            buf, off, active, first, doc, which, _ = _live_segments(row, length, bits)
            raw = buf.tobytes()
            change = np.zeros(len(raw) + 1, np.int32)
            ids = _ids(row)
            if row["cuts"]:
                cuts = np.concatenate([ch.unsqueeze(x, np.int64).reshape(-1, 4) for x in row["cuts"]])
                cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
                lo, hi = (np.searchsorted(cuts[:, 0], which, x) for x in ("left", "right"))
                count = hi - lo
                place = np.repeat(np.arange(len(which)), count)
                c = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
                gone = ids[doc[place]] > cuts[c, 3]
                place, c = place[gone], c[gone]
                np.add.at(change, first[place] + cuts[c, 1], 1)
                np.add.at(change, first[place] + cuts[c, 2] - 1 + length, -1)
            removed = np.cumsum(change[:-1], out=change[:-1]) > 0
            removed[np.repeat(~active, np.diff(off))] = True
            out = []
            for i, doc_id in enumerate(row["doc_ids"]):
                a, b = int(off[i]), int(off[i + 1])
                own = np.flatnonzero(np.diff(np.concatenate(([0], removed[a:b].view(np.int8), [0]))))
                spans = own.reshape(-1, 2).tolist()
                at, kept = a, []
                for s, e in spans:
                    kept.append(raw[at: a + s])
                    at = a + e
                kept = b"".join([*kept, raw[at:b]])
                out.append({"doc_id": doc_id, "n_bytes": b - a, "n_removed": b - a - len(kept), "n_spans": len(spans),
                            "kept_sha256": hashlib.sha256(kept).hexdigest(),
                            "spans": [{"start": s, "end": e} for s, e in spans], "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def remove_repeats(documents: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """What of each document is left without the byte strings that earlier documents have.

    documents: doc_id, text; other columns are ignored. Returns for each row doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and spans (start, end in bytes), and the kept bytes if
    asked for; a cut may fall inside a character. Texts are UTF-8. Matches never cross documents.
    A null text is empty; texts shorter than `length` stay whole. Rows with equal ids do not remove each
    other. A missing doc_id is greater than all others, and such rows remove nothing. An empty
    table gives an empty result. length: over ANCHOR + 2.
    """
    spark, name = documents.sparkSession, ch.pack(documents, CHUNK)
    packed = spark.table(name)
    bits = ch.bucket_bits(packed, SEGMENT_BUCKET)
    wide = ch.bucket_bits(packed, ANCHOR_BUCKET)
    shas = settle(packed.select("part", "seq", "doc_ids", "sizes", "data").mapInArrow(_digests, _SHA).where(F.col("n") >= length), "digests")
    key = F.coalesce("doc_id", F.lit(int(_LAST_ID)))
    first = shas.groupBy("sha").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = (shas.join(first, "sha").where(key > F.col("least"))
              .select(F.shiftright("uid", 40).alias("part"), F.expr("shiftright(uid, 16) & 16777215L").alias("seq"), "uid")
              .groupBy("part", "seq").agg(F.collect_list("uid").alias("copies")))
    copies = settle(copies, "copies")
    anchors = ch.join_chunks(packed, copies).mapInArrow(
        _anchors(length, wide), "part long, seq long, bucket long, keys binary, sides binary")
    live = anchors.groupBy("bucket").applyInArrow(_shared, "part long, seq long, bucket long, live binary")
    found = live.groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("bucket", "live"))).alias("found"))
    notes = settle(found.join(copies, ["part", "seq"], "full"), "shared-anchors")
    sent = ch.join_chunks(packed, notes, "inner").mapInArrow(
        _send(length, wide, bits),
        "part long, seq long, bucket long, base long, sizes binary, cells binary, least binary, most binary, text binary")
    cuts = sent.groupBy("bucket").applyInArrow(_intervals(length), "part long, seq long, cuts binary")
    marks = settle(cuts.groupBy("part", "seq").agg(F.collect_list("cuts").alias("cuts")), "cuts")
    known = notes.join(marks, ["part", "seq"], "left")
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start: long, end: long>>" + ", kept binary" * with_text)
    out = settle(ch.join_chunks(packed, known).mapInArrow(_cut(length, wide, with_text), schema), "suffix-dedup")
    ch.drop(spark, name)
    return out
