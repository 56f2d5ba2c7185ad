from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import chunks, suffix_dedup
from tallyframe.llm.suffix_dedup import remove_repeats, separated, suffix_order

LAST = 2**63 - 1


def brute(rows, length=50):
    first = {}
    data = [(LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    for key, _, b in data:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            first[w] = min(key, first.get(w, LAST))
    out = []
    for key, d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum()) if len(b) else 0
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_given_documents_as_brute_force(spark, given):
    frame = given("documents")
    assert got(remove_repeats(frame)) == brute([(r.doc_id, r.text) for r in frame.collect()])


@pytest.mark.parametrize("piece", [2 << 20, 300])
def test_shared_passages(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abé ç\n") for _ in range(rng.choice((30, 49, 50, 51, 120)))) for _ in range(12)]
    rows = [(rng.randrange(10**6), "".join(rng.choice(pool) if rng.random() < 0.6 else chr(97 + rng.randrange(26)) * rng.randrange(1, 60)
                                           for _ in range(rng.randrange(12)))) for _ in range(120)]
    rows += [(10**7 + i, rows[5][1]) for i in range(30)]
    frame = remove_repeats(docs(*rows), with_text=True)
    assert got(frame) == brute(rows)
    for r in frame.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_edges(spark, docs):
    long = "the same words " * 9000
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 49), (6, "x" * 300), (7, long), (8, "y" + long),
            (None, long), (None, "x" * 50), (9, "twice " * 20), (9, "twice " * 20), (10, "twice " * 20)]
    assert got(remove_repeats(docs(*rows))) == brute(rows)
    assert got(remove_repeats(docs())) == []


def test_intervals_are_the_equal_windows():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.r_[rng.integers(97, 99, n), 255] for n in rng.integers(1, 60, 40)]).astype(np.uint8)
    depth = 7
    order = suffix_order(text, depth)
    group = np.cumsum(separated(text, order, depth, text == 255))
    raw, seen = text.tobytes(), {}
    for place, i in zip(group, order):
        w = raw[i:i + depth]
        if len(w) == depth and 255 not in w:
            seen.setdefault(w, set()).add(int(place))
    assert all(len(x) == 1 for x in seen.values())
    assert len({min(x) for x in seen.values()}) == len(seen)


@pytest.mark.parametrize("small", [21, 4])
def test_intervals_beyond_the_first_words(monkeypatch, small):
    """Depths over 8 begin with whole words, and long texts are sorted by place."""
    monkeypatch.setattr(suffix_dedup, "_SMALL", small)
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 90)
    text = np.concatenate([np.r_[base[i:i + n] if n % 2 else rng.integers(97, 99, n), 255]
                           for i, n in zip(rng.integers(0, 60, 60), rng.integers(1, 60, 60))]).astype(np.uint8)
    for depth in (9, 17, 30):
        order = suffix_order(text, depth)
        group = np.cumsum(separated(text, order, depth, text == 255))
        raw, seen = text.tobytes(), {}
        for place, i in zip(group, order):
            w = raw[i:i + depth]
            if len(w) == depth and 255 not in w:
                seen.setdefault(w, set()).add(int(place))
        assert seen and all(len(x) == 1 for x in seen.values())
        assert len({min(x) for x in seen.values()}) == len(seen)


def test_texts_of_one_hash_keep_their_own_numbers():
    buf = np.frombuffer(b"abcabdabcab", np.uint8)
    first, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    which, place = suffix_dedup._numbered_texts(buf, first, size, np.full(4, 7, np.uint64))
    assert which.tolist() == [0, 1, 0, 2] and place.tolist() == [0, 1, 3]


@pytest.mark.parametrize("cell", [1, 1 << 17])
def test_cells_are_searched_alone(spark, docs, monkeypatch, cell):
    monkeypatch.setattr(suffix_dedup, "CELL", cell)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(40)]
    rows = [(i, "".join(rng.sample(pool, 5))) for i in range(200)]
    assert got(remove_repeats(docs(*rows))) == brute(rows)


def test_chunks_are_filled_from_many_batches(spark, docs):
    """Rows travel for each chunk and bucket: small batches must not make small chunks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        name = chunks.pack(docs(*[(i, "some words " * 9) for i in range(2000)]).coalesce(1), suffix_dedup.CHUNK)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.table(name).count() == 1
    chunks.drop(spark, name)
