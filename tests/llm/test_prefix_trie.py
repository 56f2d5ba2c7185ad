from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm.prefix_trie import conversation_trie, numbered_turns, prefix_trie, trie_ends, with_shared_starts

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def table(spark, *rows):
    """Conversations with one more column that clashes."""
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(rows):
    """Every node's row, from the sets of members of all prefixes."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    sum(len(x) == len(node) + 1 for x in below), len(childless),
                    sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(frame):
    out = conversation_trie(frame)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_given_conversations(spark, given):
    rows = [tuple(r) for r in given("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert run(given("conversations")) == brute(rows)


def test_missing_values_ties_and_repeats(spark):
    rows = [(0, 1, "user", "a b"), (0, None, None, None), (0, 2, "user", "c"), (0, 2, "user", "c"), (0, 2, None, "zz"),
            (1, 0, "user", ""), (7, 5, "user", "x " * 30000), (7, -5, "", "a b"), (21, 0, "user", "a b"), (41, 0, "user", "a b"),
            (-3, 0, "user", "a b"), (-3, 1, "user", "é"), (-20, 3, "user", "a b"), (None, 0, "user", "never seen"), (None, None, None, None)]
    assert run(table(spark, *rows)) == brute(rows)
    assert run(table(spark, *rows, *rows)) == brute(rows * 2)
    # roles and texts that read alike together are different turns
    rows = [(c, 0, r, t) for c, r, t in ((1, "ab", "c"), (2, "a", "bc"), (3, None, "abc"))]
    assert run(table(spark, *rows)) == brute(rows)


def test_empty_and_turnless(spark):
    assert run(table(spark)) == [] and run(table(spark, (None, 0, "user", "x"))) == []
    # one short conversation whose donor is absent keeps no turn if it takes more than it has
    short = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    assert run(table(spark, (short, 0, "user", "only"))) == brute([(short, 0, "user", "only")]) == [
        (short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b c", "d e f"]))
            for c in range(70) for t in range(draw.choice([0, 1, 2, 3, 5, 8, 17]))]
    assert run(table(spark, *rows).repartition(3)) == brute(rows)


def test_deep_conversation_and_group_of_copies(spark):
    long = [(40, t, "user", f"turn {t} {t % 3}") for t in range(150)]
    rows = long + [(60 + 20 * i, t, r, x) for i in range(40) for _, t, r, x in long[:9]] + [(41, 0, "user", "other")]
    assert run(table(spark, *rows)) == brute(rows)


def test_ends_name_every_member_once(spark):
    rows = [(c, t, "user", "same") for c in range(45) for t in range(c % 4)]
    turns, members = with_shared_starts(numbered_turns(table(spark, *rows)))
    ends = trie_ends(turns, members, prefix_trie(turns, members)).collect()
    assert {(r.member, r.depth) for r in ends} == {(c, len(t)) for c, t in rebuilt(rows).items()} and len(ends) == len(rebuilt(rows))
