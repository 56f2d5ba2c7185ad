from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tallyframe.llm.fingerprints import deleted, edit_probe, fingerprints, inserted


def check(frame, rows):
    """Returns the result by id, after comparing all that has one right value."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (d, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        k = len(t) // 2
        edited = t[:len(t) - k] + f[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = edit_probe(frame).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    alone = {}
    for (d, t), r in zip(rows, fingerprints(frame).collect()):
        assert alone.setdefault(t or "", r.fingerprint) == r.fingerprint  # equal texts, equal fingerprints
    assert len(set(alone.values())) == len(alone)
    assert sorted(r.fingerprint for r in got) == sorted(alone[t or ""] for _, t in rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    return got


def test_given_documents(spark, given):
    frame = given("documents")
    got = check(frame, [(r.doc_id, r.text) for r in frame.collect()])
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    assert 0.3 < sum(r.near_edited for r in long) / len(long) < 0.8


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "é"), (4, "ab"), (5, "one\ntwo\n"), (5, "one\ntwo\n"), (5, "a"), (None, "x y z"), (None, None),
            (6, "w " * 70000), (7, "same"), (8, "same")]
    got = {(r.doc_id, r.n_chars): r for r in check(docs(*rows), rows)}
    assert got[8, 4].near_next == 1.0  # its next has the same text
    assert edit_probe(docs()).collect() == []
    only = edit_probe(docs((1, "alone here"))).collect()
    assert only[0].near_next == 1.0 and only[0].edited_sha256 == hashlib.sha256(b"aloneaalon"[:5] + b"alone").hexdigest()


def test_order_and_increments(spark, docs):
    rng = random.Random(1)
    lines = [" ".join(f"w{rng.randrange(99)}" for _ in range(5)) + "\n" for _ in range(30)]
    mixed = lines[:]
    rng.shuffle(mixed)
    frame = docs((1, "".join(lines)), (2, "".join(mixed)), (3, "".join(lines[:20])), (4, "".join(lines[20:])), (5, ""))
    p = {r.doc_id: r.fingerprint for r in fingerprints(frame).collect()}
    assert p[1] == p[2] != p[3]
    row = spark.range(1).select(*[F.lit(p[i]).alias(f"p{i}") for i in p]).select(
        inserted(F.col("p3"), F.col("p4")).alias("sum"), deleted(F.col("p1"), F.col("p4")).alias("rest"),
        deleted(F.col("p1"), F.col("p2")).alias("none")).first()
    assert (row["sum"], row.rest, row.none) == (p[1], p[3], p[5])


def product(a, b):
    """Likeness of two returned fingerprints, from their digits."""
    x, y = ([int.from_bytes(bytes.fromhex(p[8 * i: 8 * i + 8]), "big", signed=True) for i in range(128)] for p in (a, b))
    if a == b:
        return 1.0
    return min(max(2 * sum(map(int.__mul__, x, y)) / max(sum(v * v for v in x + y), 1), 0), 1 - 2.0**-20)


def test_likeness_can_be_recomputed_from_the_returned_fingerprints(spark, docs):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(6)) for _ in range(rng.randrange(30)))) for i in range(40)]
    rows += [(40, "w " * 4000), (41, "w " * 70000), (42, "line\n" * 60000), (43, "line\n" * 70000), (44, None), (45, "")]
    got = sorted(edit_probe(docs(*rows)).collect(), key=lambda r: -r.doc_id)
    for r, after in zip(got, got[1:] + got[:1]):
        assert abs(r.near_edited - product(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - product(r.fingerprint, after.fingerprint)) < 1e-9
    repeats = {r.doc_id: r.near_next for r in got}
    assert 0.98 < repeats[43] < 1 and repeats[41] < 0.2


def test_likeness_of_very_repetitive_texts():
    import pyarrow as pa

    from tallyframe.llm.fingerprints import decode, encode, likeness, vectors
    rows = [decode(encode(*vectors(pa.array(["line\n" * n])))) for n in (60000, 30000, 65536)]
    assert abs(likeness(rows[0], rows[1])[0] - 0.8) < 1e-9
    assert likeness(rows[2], rows[0])[0] > 0.99
