from __future__ import annotations

import random
import tracemalloc
import zlib
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm.toxicity import DECAY, FLOOR, SPAN, Model, _clean, _dense, _distinct_units, _score, _witnesses, toxicity, without_toxic

INSULTS = ["grumblefex", "snotwick", "flarkmoudel"]


def kernel(a: str, b: str) -> float:
    """The triples of two words by plain loops, normalised."""
    def triples(w):
        w, out = "".join(c for c in w if c.isalpha()), {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < SPAN:
                out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + DECAY ** (k - i + 1)
        return out
    x, y = triples(a), triples(b)
    dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_kernel_is_that_of_the_plain_loops():
    landmarks = [b"idiot", b"grumblefex", b"banana"]
    model = Model(landmarks, _dense(landmarks))
    for word in ["idiot", "i-d-i-o-t", "i---d.i*o**t", "i -- d . i  o t", "idxiot", "banana", "bananas", "grumxblefex", "nothing", "ab", "aaaaaa"]:
        doc, _, sim = model.similarities(pa.array([word]))
        want = np.array([kernel(word, m.decode()) for m in landmarks])
        want[want < FLOOR] = 0
        got = sim[0] if len(doc) else np.zeros(3)
        assert np.allclose(got, want, atol=1e-4), word
    assert kernel("i-d--i-o-t", "idiot") > 0.999 and kernel("idxiot", "idiot") > FLOOR


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    syllables = ["ta", "mo", "ri", "len", "so", "kap", "du", "vi", "ner", "osh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randrange(5, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            insult = rng.choice(INSULTS)
            at = rng.randrange(1, len(insult))
            if rng.random() < 0.3:
                insult = insult[:at] + rng.choice("-*x") + insult[at:]  # an inserted character
            text.insert(rng.randrange(len(text)), insult + rng.choice(["", ".", "!\n"]))
        rows.append((i, " ".join(text), "en", f"src{i % 3}", 1, "x"))
        labels.append((i, 1, toxic))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    return spark.createDataFrame(rows, schema).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), labels


def test_held_out_accuracy(corpus):
    documents, labels, truth = corpus
    got = {r.doc_id: r for r in toxicity(documents, labels).collect()}
    assert len(got) == len(truth)
    held = [(got[i], t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(r.predicted == t for r, t in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = without_toxic(documents, labels)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_read(spark, corpus):
    documents, labels, truth = corpus
    turned = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in truth],
                                   "doc_id long, quality int, toxic int")
    pick = lambda frame: sorted((r.doc_id, round(r.score, 9)) for r in frame.collect())
    assert pick(toxicity(documents, labels)) == pick(toxicity(documents, turned))


def test_edges(spark, corpus, docs):
    _, labels, _ = corpus
    documents = corpus[0].withColumnRenamed("score", "bucket")
    extra = [(None, None), (5000, ""), (5001, "  \n"), (5002, "clean " * 40000 + INSULTS[0]), (5002, "fine"), (5003, "s n o t w i c k"),
             (5004, "x" * 50000), (5005, "word " * 3 + "-" * 200 + INSULTS[1] + "=" * 200)]
    both = documents.union(docs(*extra))
    got = toxicity(both, labels).collect()
    assert len(got) == 900 + len(extra)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].held_out is False and by[None][0].predicted == by[5000][0].predicted == by[5001][0].predicted == by[5004][0].predicted == 0
    assert sorted(r.predicted for r in by[5002]) == [0, 1] and by[5005][0].predicted == 1
    assert by[5003][0].score > by[5001][0].score  # single letters are seen together
    assert toxicity(docs(), labels).collect() == []
    nothing = toxicity(docs((1, INSULTS[0])), labels.limit(0)).collect()
    assert nothing[0].predicted == 0


def test_spaced_insults_between_short_words_of_neighbours():
    model = Model([b"idiot"], _dense([b"idiot"]))
    model.weights += 1.0
    spaced = "i d i o t"
    alone = model.margins(pa.array([spaced]))[0][0]
    assert alone > model.bias
    for before in ("", "it is so", "plain words"):
        for after in ("", "I am", "plain words"):
            assert model.margins(pa.array([before, spaced, after]))[0][1] == alone, (before, after)
    for text in ("y o u i d i o t! I am here", "so it is\ni d i o t", "is it so? i d i o t\nI am"):
        assert model.margins(pa.array([text]))[0][0] > model.bias, text


def test_marks_and_blanks_between_letters_change_no_decision(spark, corpus, docs):
    documents, labels, _ = corpus
    gaps = ["", "-", "--", "---", ".", " . ", " ", "  ", "   ", "*_*"]
    forms = {5000 + 100 * k + i: gap.join(w) for k, w in enumerate(INSULTS) for i, gap in enumerate(gaps)}
    texts = [(d, f"Riner soptamo {w} and that is all") for d, w in forms.items()]
    got = {r.doc_id: r for r in toxicity(documents.withColumnRenamed("score", "bucket").union(docs(*texts)), labels).collect()}
    assert {d: got[d].predicted for d in forms} == dict.fromkeys(forms, 1)


@pytest.mark.parametrize("step", ["score", "clean", "witnesses", "units"])
def test_memory_of_a_large_batch(step):
    rng, letters = np.random.default_rng(5), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz  ", np.uint8)
    texts = [letters[rng.integers(0, len(letters), 100_000)].tobytes().decode() for _ in range(20)]
    model = SimpleNamespace(value=Model([b"idiot", b"grumblefex"], _dense([b"idiot", b"grumblefex"])))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(20), "held_out": [False] * 20, "toxic": [i % 2 for i in range(20)], "text": texts})
    run = {"score": _score(model), "clean": _clean(model, "text"), "witnesses": _witnesses(model), "units": _distinct_units}[step]
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 1)]))) > 0  # what is made once isn't counted
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 20 or step == "units" and rows > 20
    assert peak < 24e6
