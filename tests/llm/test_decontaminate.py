from __future__ import annotations

import itertools
import random
import re

import pytest

from tallyframe.llm.decontaminate import ALL_MASKS, MASKS, MISSES, SHORT_MASKS, WINDOW, leaks, without_leaks


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(
        c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in text or ""))


def brute(docs, items):
    """Best overlaps by sliding every item along every document."""
    out = set()
    for (d, t), (i, x) in itertools.product(docs, items):
        a, b = words(t), words(x)
        need = min(len(b), WINDOW)
        if not need:
            continue
        best = 0
        for shift in range(need - len(b), len(a) - need + 1):
            same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
            for j in range(len(b) - need + 1):
                if 0 <= shift + j and shift + j + need <= len(a):
                    best = max(best, sum(same[j:j + need]))
        if 100 * best >= 80 * need:
            out.add((d, i, best))
    return out


def test_masks_hit_every_window():
    for gone in itertools.combinations(range(WINDOW), MISSES):
        assert any(not any(o + j in gone for j in m) for m in MASKS for o in range(WINDOW - m[-1]))


def test_replaced_words(spark, docs):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((5, 9, 15, 20, 21, 40))))) for i in range(30)]
    rows = []
    for d in range(150):
        text = [word() for _ in range(rng.randrange(60))]
        if d % 2:
            part = items[d % 30][1].split()
            lo = rng.randrange(max(1, len(part) - WINDOW))
            part = part[lo:]
            for j in rng.sample(range(len(part)), min(len(part), rng.randrange(0, 7)) if len(part) >= WINDOW else 0):
                part[j] = "other"
            text[len(text) // 2: len(text) // 2] = [p.upper() + rng.choice(["", "!", " -", "\n"]) for p in part]
        rows.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    frame = docs(*rows)
    found = leaks(frame, bench).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id, r.n_equal) for r in found} == want and len(found) == len(want)
    assert {r.doc_id for r in without_leaks(frame, bench).collect()} == set(range(150)) - {d for d, *_ in want}


def test_given_tables(spark, given):
    documents, benchmark = given("documents"), given("benchmark")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    # only documents that share five words with an item can overlap by 80 %
    runs = {tuple(w[j:j + 4]) for _, t in items for w in [words(t)] for j in range(len(w) - 3)}
    near = [(d, t) for d, t in rows for w in [words(t)] if any(tuple(w[j:j + 4]) in runs for j in range(len(w) - 3))]
    assert {(r.doc_id, r.item_id, r.n_equal) for r in leaks(documents, benchmark).collect()} == brute(near, items)


def test_edges(spark, docs):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "one two"), (5, passage), (None, "é É è f g")],
                                  "item_id long, text string")
    rows = [(1, None), (2, ""), (3, passage * 1), (3, "x " + passage), (None, passage), (4, "one two three"), (5, "a " * 50000 + passage),
            (6, "É, é; È f-g")]
    found = leaks(docs(*rows), bench).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.item_id, r.at_word) for r in found), key=key)
    assert got == sorted([(3, 1, 0), (3, 5, 0), (3, 1, 1), (3, 5, 1), (None, 1, 0), (None, 5, 0), (5, 1, 50000), (5, 5, 50000), (6, None, 0)], key=key)
    assert sorted(r.doc_id for r in without_leaks(docs(*rows), bench).collect()) == [1, 2, 4]
    assert leaks(docs(), bench).collect() == [] and leaks(docs(*rows), bench.limit(0)).collect() == []
    assert without_leaks(docs(*rows), bench.limit(0)).count() == len(rows)


def test_replaced_words_at_every_length(spark, docs):
    items = [(m, " ".join(f"q{m}x{j}" for j in range(m))) for m in range(5, WINDOW)]
    rows, want = [], set()
    for m, text in items:
        gone = list(itertools.combinations(range(m), m // 5))
        # the patterns that the masks for long windows miss, and some others
        missed = [g for g in gone if not any(not any(o + j in g for j in k) for k in MASKS for o in range(m - k[-1]))]
        for g in missed + gone[:: len(gone) // 5]:
            part = ["other" if j in g else w for j, w in enumerate(text.split())]
            rows.append((len(rows), " ".join(["before it", *part, "behind it"])))
            want.add((len(rows) - 1, m, m - m // 5))
        rows.append((len(rows), " ".join(["other"] * (m // 5 + 1) + text.split()[m // 5 + 1:])))  # one too many
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_equal) for r in leaks(docs(*rows), bench).collect()} == want


def test_short_items_are_found_whole(spark, docs):
    items = [(1, "Forty"), (2, "forty two"), (3, "is forty two"), (4, "answer is forty two"), (5, "the answer is forty two"), (6, ""), (7, "...")]
    rows = [(1, "The answer is: forty two!"), (2, "answer was forty two"), (3, "nothing"), (4, "two forty"), (5, "forty"), (None, "is forty two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_equal) for r in leaks(docs(*rows), bench).collect()}
    assert got == brute(rows, items) and (1, 4, 4) in got
    assert {r.item_id for r in leaks(docs(*rows), bench, least_words=4).collect()} == {4, 5}
    for wrong in ({"share": 0.7}, {"least_words": 0}):
        with pytest.raises(ValueError, match="masks"):
            leaks(docs(*rows), bench, **wrong)


def test_masks_are_lossless_at_every_length():
    for n in range(1, WINDOW):
        fit = [m for m in ALL_MASKS if m[-1] < n and (m in MASKS or n in dict(SHORT_MASKS)[m])]
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not any(o + j in gone for j in m) for m in fit for o in range(n - m[-1])), (n, gone)


def test_clean_rows_that_share_an_id_with_a_leak_stay(spark, docs):
    leak = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, leak), (None, "clean"), (4, "x " + leak), (4, "clean too"), (5, None)]
    kept = without_leaks(docs(*rows), bench)
    assert kept.columns == docs().columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, "clean"), (4, "clean too"), (5, None)}
