from __future__ import annotations

import os

import numpy as np
import pytest

from tallyframe.llm import token_scan
from tallyframe.llm.queries import END_ID, VOCABULARY
from tallyframe.llm.token_scan import PATTERN, count_tokens, document_tokens, read_files, read_vocabulary, write_flat

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")


def brute(tokens, end_id):
    out, n = [], 0
    for t in tokens:
        if t == end_id:
            out.append((len(out), n, True))
            n = 0
        else:
            n += 1
    return out + ([(len(out), n, False)] if n else [])


@pytest.mark.parametrize("width, block, group", [(2, 64, 4), (4, 16, 2), (2, 2, 3)])
def test_blocks_are_stitched(spark, monkeypatch, width, block, group):
    monkeypatch.setattr(token_scan, "GROUP", group)
    rng = np.random.default_rng(block)
    rows, want = [], []
    for file, (n, p) in enumerate([(0, 0), (1, 1), (1, 0), (300, 0.02), (500, 0.3), (256, 0), (64, 1), (97, 0.01)]):
        tokens = np.where(rng.random(n) < p, 7, rng.integers(8, 60000, n)).astype("<u2" if width == 2 else "<u4")
        raw = tokens.tobytes()
        rows += [(f"f{file}", i // block, raw[i:i + block], "x") for i in range(0, len(raw), block)]
        want += [(f"f{file}", *r) for r in brute(tokens.tolist(), 7)]
    rows.append(("empty", 0, None, "x"))
    blocks = spark.createDataFrame(rows, "file string, block long, data binary, ends string")
    assert sorted(tuple(r) for r in count_tokens(blocks, 7, width).collect()) == sorted(want)
    assert count_tokens(blocks.limit(0), 7, width).collect() == []


def test_plain_binary_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "BLOCK_BYTES", 32)
    rng = np.random.default_rng(0)
    for name in "ab":
        rng.integers(0, 9, 1000).astype("<u2").tofile(tmp_path / f"{name}.bin")
    got = count_tokens(read_files(spark, str(tmp_path)), 0).collect()
    for name in "ab":
        tokens = np.fromfile(tmp_path / f"{name}.bin", "<u2").tolist()
        assert sorted((r.ordinal, r.n_tokens, r.closed) for r in got if r.file.endswith(f"{name}.bin")) == brute(tokens, 0)


def encoder():
    import tiktoken

    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=read_vocabulary(VOCABULARY), special_tokens={})


@needs_vocabulary
def test_given_documents(spark, given, monkeypatch):
    monkeypatch.setattr(token_scan, "BLOCK_BYTES", 1 << 12)  # long documents cross blocks
    frame, encode = given("documents"), encoder().encode_ordinary
    assert sorted(tuple(r) for r in document_tokens(frame, VOCABULARY, END_ID).collect()) == sorted(
        (r.doc_id, len(encode(r.text))) for r in frame.collect())


@needs_vocabulary
def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (4, "word " * 100000), (5, "<|endoftext|>"), (6, " \n\t ")]
    encode = encoder().encode_ordinary
    key = lambda r: (r[0] is None, r)
    want = sorted(((d, len(encode(t or ""))) for d, t in rows), key=key)
    assert sorted((tuple(r) for r in document_tokens(docs(*rows), VOCABULARY, END_ID).collect()), key=key) == want
    assert document_tokens(docs(), VOCABULARY, END_ID).collect() == []
    blocks, ids = write_flat(docs(*rows), VOCABULARY, END_ID)
    stream = {}
    for r in blocks.orderBy("file", "block").collect():
        stream[r.file] = stream.get(r.file, b"") + bytes(r.data)
    tokens = np.concatenate([np.frombuffer(b, "<u2") for b in stream.values()])
    assert (tokens == END_ID).sum() == len(rows) and len(tokens) == sum(n for _, n in want) + len(rows)
