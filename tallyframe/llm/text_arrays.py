"""Arrow text columns as flat byte arrays: words, rolling hashes and distinct shingles.

Everything works on one buffer for many documents, with offsets, so that a batch costs a few
passes of numpy and no Python step per word. Hashes are 64 bits wide and the same on every
machine. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_WORD = np.where(_SEPARATORS, np.uint64(0), _BYTE)
_WORD_LOWER = np.where(_SEPARATORS, np.uint64(0), _BYTE_LOWER)
# letters and digits only: ASCII, and all bytes of wider characters; capitals of two bytes from
# U+00C0 on have the small letter 32 further on
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTERS_LOWER = np.where(_MARKS, np.uint64(0), _BYTE_LOWER)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept = _powers[int(base)] = np.multiply.accumulate(steps)
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len + 1 offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Cut a batch so that no piece holds more than `most` bytes of text, one long row aside."""
    _, off = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True, letters: bool = False):
    """Hash, start, end and document of every run of non-separators; A-Z may count as a-z.

    With `letters`, marks of ASCII separate words too and Latin capitals count as small letters.
    """
    if letters and len(buf):
        capital = np.zeros(len(buf), bool)
        capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        buf = np.where(capital, buf + np.uint8(32), buf)
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~(_MARKS if letters else _SEPARATORS)[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    value = (_LETTERS_LOWER if letters else _WORD_LOWER if lower else _WORD)[buf] * powers(_BASE, len(buf))
    h = np.add.reduceat(value, start) * powers(_UNBASE, len(buf))[start]
    doc = np.searchsorted(off, start, "right") - 1
    return mix(h + (end - start).astype(np.uint64) * _BASE), start, end, doc


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of `size` words; a shorter document counts as one run."""
    n = len(h)
    if n == 0:
        return h, doc
    count = np.bincount(doc)
    short = (count > 0) & (count < size)
    step = powers(np.uint64(0xC2B2AE3D27D4EB4F), size)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size if len(total) else 0):
        total += h[j: j + len(total)] * step[j]
    whole = doc[: len(total)] == doc[size - 1: size - 1 + len(total)]
    out, at = mix(total[whole]), doc[: len(total)][whole]
    if short.any():
        begin = np.concatenate(([0], np.cumsum(count)))
        ids = np.flatnonzero(short)
        extra = np.zeros(len(ids), np.uint64)
        for j in range(size - 1):
            have = count[ids] > j
            extra[have] += h[begin[ids[have]] + j] * step[j]
        extra = mix(extra + count[ids].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        out, at = np.concatenate((out, extra)), np.concatenate((at, ids))
    return out, at


def distinct_by_document(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, sorted by document and hash."""
    if len(h) == 0:
        return h, doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


class ByteRuns:
    """Hashes of runs of bytes, from one prefix sum; equal runs have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=self.total[1:])

    def every(self, size: int) -> np.ndarray:
        """Hash of the `size` bytes from each position on (len - size + 1 of them)."""
        n = max(len(self.total) - size, 0)
        return mix((self.total[size:] - self.total[:n]) * powers(_UNBASE, n))

    def between(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[first]) * powers(_UNBASE, len(self.total))[first])
