from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyframe.llm import ngram_join
from tallyframe.llm.ngram_join import PrefixTree, keep_one, ngram_components


def grams(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(rows, size, top):
    """(id, set size, component) by comparing all pairs that share an n-gram."""
    sets = [grams(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    tried = set()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                        root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def got(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("size, top", [(4, 85), (5, 80)])
def test_given_documents_as_brute_force(spark, given, size, top):
    frame = given("documents")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert got(ngram_components(frame, size, top / 100)) == brute(rows, size, top)


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_near_copies_in_whole_and_cut_blocks(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", limit)
    rng = random.Random(5)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (30, 60, 200)]
    rows = [(i, edited(rng, bases[i % 3], rng.randrange(4))) for i in range(90)]
    rows += [(200 + i, bases[1]) for i in range(40)]  # copies
    rows += [(300 + i, " ".join(f"u{i}x{j}" for j in range(20)) + " " + bases[2][:200]) for i in range(20)]  # a shared passage
    assert got(ngram_components(docs(*rows), 4, 0.85)) == brute(rows, 4, 85)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "x " * 60000), (7, "x x x x"), (8, "é É")]
    assert got(ngram_components(docs(*rows), 4, 0.85)) == brute(rows, 4, 85)
    assert got(ngram_components(docs(), 4, 0.85)) == []
    # ids may be missing or repeat: each row is one of its own
    twice = ngram_components(docs((None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (9, "q r s t"), (None, "only")), 4, 0.85)
    assert sorted(repr(tuple(r)[:3]) for r in twice.collect()) == sorted(
        map(repr, [(None, 1, 9), (9, 1, 9), (9, 1, 9), (9, 1, 9), (None, 1, None)]))


def test_keep_one(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    frame = docs((5, text), (3, text + " more"), (4, "other"), (6, None), (7, ""), (7, ""))
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 7]


def test_tree_finds_exactly_the_similar_sets():
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 2**40, 500, dtype=np.uint64))
    sets = []
    for _ in range(120):
        n = int(rng.integers(1, 150))
        start = int(rng.integers(0, 8)) * 40
        s = set(pool[start:start + n].tolist())
        s ^= set(rng.choice(pool, int(rng.integers(0, 6))).tolist())
        if s:
            sets.append(np.array(sorted(s), np.uint64))
    tree = PrefixTree([s.astype(">u8") for s in sets])
    for i, probe in enumerate(sets):
        near = {int(tree.order[j]) for j in tree.partners(probe, np.ones(len(sets), bool), 0.85)}
        want = {j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 85 * len(np.union1d(s, probe))}
        assert near == want, i


def degrees(rows, size, top):
    sets = [grams(t, size) for _, t in rows]
    return sorted((d, sum(1 for j, s in enumerate(sets) if j != i and s and 100 * len(s & sets[i]) >= top * len(s | sets[i])))
                  for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_every_link_is_counted_once(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", limit)
    rng = random.Random(6)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (60, 120)]
    rows = [(i, edited(rng, bases[i % 2], rng.randrange(3))) for i in range(50)]  # each links with many
    rows += [(100 + i, bases[0]) for i in range(10)] + [(200, None), (201, ""), (202, "alone in the corpus here")]
    out = ngram_components(docs(*rows), 4, 0.85).collect()
    assert sorted((r.doc_id, r.n_links) for r in out) == degrees(rows, 4, 85)
    assert max(r.n_links for r in out) > 15


def test_links_as_the_comparison_sql(spark):
    import compare
    from tallyframe.llm.queries import ORACLES, QUERIES
    folder, name = "/root/testdata/sf0.001", "op1_ngram_jaccard_links"
    cursor = compare.connect(folder).execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert "n_links" in columns
    want = sorted(cursor.fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*columns).collect())) == want


def test_keep_one_keeps_one_row_of_each_component_whatever_the_ids(spark, docs):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))

    def left(*rows):
        return sorted(((r.doc_id, r.text) for r in keep_one(docs(*rows)).collect()), key=repr)

    assert left((1, a), (1, a)) == [(1, a)]
    assert left((3, a), (9, a), (9, b), (12, b)) == [(3, a), (9, b)]
    assert left((None, a), (None, a), (1, a)) == [(1, a)]
    assert left((None, a), (None, a), (None, b)) == sorted([(None, a), (None, b)], key=repr)
    assert left((2, a), (2, a + " more"), (5, a)) in ([(2, a)], [(2, a + " more")])
