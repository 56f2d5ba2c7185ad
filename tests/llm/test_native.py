from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from tallyframe.llm import mixing
from tallyframe.llm.mixing import mixed, mixture
from tallyframe.llm.sharding import shard_documents, with_shards
from tallyframe.llm.url_filter import judge_pages

# ---- shards


def check_shards(frame, rows, shards):
    out = frame.collect()
    data = [(t or "").encode() for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (d is None, d or 0, len(b) + 1, zlib.crc32(b)) for (d, _), b in zip(rows, data))
    total, most = sum(len(b) + 1 for b in data), max((len(b) + 1 for b in data), default=0)
    by = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for s, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= most
    # contiguous in doc_id
    order = [r.doc_id for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert order == sorted(order, key=lambda d: (d is None, d))


def test_shards_of_given_documents(spark, given):
    frame = given("documents")
    check_shards(shard_documents(frame, 16), [(r.doc_id, r.text) for r in frame.collect()], 16)


def test_shard_edges(spark, docs):
    rows = [(3, None), (1, ""), (2, "x" * 5000), (2, "x" * 5000), (2, "y"), (None, "é"), (-5, "a b")]
    check_shards(shard_documents(docs(*rows), 4), rows, 4)
    assert shard_documents(docs(), 4).collect() == []
    check_shards(shard_documents(docs((1, "one")), 16), [(1, "one")], 16)
    many = [(i % 7, "same") for i in range(400)]
    check_shards(shard_documents(docs(*many), 8), many, 8)


def test_documents_with_shards(spark, docs):
    rows = [(i % 5, "ab" * (i % 3)) for i in range(60)] + [(None, None)]
    for shuffled in (False, True):
        out = with_shards(docs(*rows), 3, shuffled)
        assert out.columns == [*docs().columns, "shard", "slot"]
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
        assert len({(r.shard, r.slot) for r in got}) == len(rows)
    repeats = sorted((r.shard, r.slot) for r in got if (r.doc_id, r.text) == (1, ""))
    assert all(b != (a[0], a[1] + 1) for a, b in zip(repeats, repeats[1:])) or len({s for s, _ in repeats}) > 1


# ---- url filter

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def parts(url):
    m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")


def ruled(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_of_given_pages(spark, given):
    frame = given("pages")
    urls = {r.page_id: r.url for r in frame.collect()}
    for r in judge_pages(frame).collect():
        rule, verdict = ruled(urls[r.page_id])
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule
        assert r.verdict == (verdict or "allow")


def test_verdicts_pass_along_aliases(spark):
    canon = '<head><LINK href="{}" rel="canonical"></head>'
    jump = "<meta content='0; URL={}' http-equiv=Refresh>"
    pages = [
        (1, "http://shop.net/a", None),                                   # blocked by rule
        (2, "https://mirror.test/x#top", canon.format("http://Shop.net/a")),  # follows 1
        (3, "https://other.test/y", jump.format("https://mirror.test/x")),    # follows 2
        (4, "http://news.org/fr/z", canon.format("https://shop.net/a")),      # allowed by its own rule, and makes the rest allowed
        (5, "https://bad.test/p", canon.format("//x.net/q")),             # blocked through a target that is no page
        (6, "https://bad.test/dir/r", canon.format("../p")),
        (7, "https://bad.test/dir/s", canon.format("/p")),                # follows 5
        (8, None, canon.format("http://a.net/")), (9, "no scheme net/", ""), (10, "HTTP://A.NET", ""), (11, "http://a.net?x", None),
        (12, "http://clean.test/", canon.format("mailto:x@y.net")), (5, "https://bad.test/p", ""),
    ]
    got = {(r.page_id, r.rule, r.verdict) for r in judge_pages(
        spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, node string")).collect()}
    assert got == {(1, "net/", "block"), (2, None, "allow"), (3, None, "allow"), (4, "org/fr/", "allow"), (5, None, "block"),
                   (6, None, "allow"), (7, None, "block"), (8, None, "allow"), (9, None, "allow"), (10, None, "block"),
                   (11, None, "allow"), (12, None, "allow")}
    without = [p for p in pages if p[0] != 4]
    got = {r.page_id: r.verdict for r in judge_pages(spark.createDataFrame(without, "page_id long, url string, html string")).collect()}
    assert got[2] == got[3] == "block"
    assert judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- mixing


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(frame, rows, shards=16):
    plan, draws = mixture(frame, shards)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, got, taken, largest = targets(sizes), plan.collect(), Counter(), Counter()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, size(t), s) for d, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.times * r.size and 0 <= r.times <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixture(frame, shards)[0].collect()))
    drawn = draws.collect()
    assert Counter(r.doc_id for r in drawn) == Counter(d for r in got for d in [r.doc_id] * r.times)
    assert all(0 <= r.shard < shards for r in drawn)
    return got, drawn


def test_mix_of_given_documents(spark, given):
    frame = given("documents")
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    check_mix(frame, rows)
    out = mixed(frame)
    assert out.columns == frame.columns and out.count() > len(rows)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, target string, bucket int"
    rows = [(i, "w " * (i % 9), ["a", "b", None, "é", "A"][i % 5]) for i in range(120)] + [
        (500, None, "a"), (501, "", None), (502, "x y", "a"), (502, "x y", "a"), (None, "z", "b"), (503, " ", "empty")]
    check_mix(spark.createDataFrame([(*r, "x", 1) for r in rows], schema), rows, 3)
    assert mixture(spark.createDataFrame([], schema))[0].collect() == []
    nothing = [(1, None, "a"), (2, "", None)]
    check_mix(spark.createDataFrame([(*r, "x", 1) for r in nothing], schema), nothing)
    hot = [(i, "a b c", "big" if i % 10 else f"s{i}") for i in range(500)]
    check_mix(spark.createDataFrame([(*r, "x", 1) for r in hot], schema), hot, 5)


def test_tree_keeps_quotas_and_fills_shards(spark):
    quotas = spark.createDataFrame([("a", 200), (None, 7), ("b", 5 * mixing.BLOCKS_PER_SHARD - 207)], "source string, quota long")
    out = mixing.splitting_tree(quotas, 5, 1).collect()
    assert Counter(r.shard for r in out) == {s: mixing.BLOCKS_PER_SHARD for s in range(5)}
    assert Counter(r.source for r in out) == {r.source: r.quota for r in quotas.collect()}
    assert all(sorted(r.turn for r in out if r.source == s) == list(range(n)) for s, n in ((None, 7), ("a", 200)))


def test_documents_are_taken_as_often_as_the_tree_deals_their_blocks(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 50), "big" if i % 4 else f"s{i % 7}") for i in range(600)] + [(900, "x", "tiny"), (901, "", "none")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, draws = mixture(frame, 4)
    shards = Counter(r.shard for r in draws.collect())
    assert set(shards) == {0, 1, 2, 3} and min(shards.values()) > 100
    # the least source has a block of its own, not just the last shard's
    assert next(r.times for r in plan.collect() if r.doc_id == 900) in (1, 2)
    # without the blocks of a shard its documents are not taken
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: tree(*a).where("shard <> 3"))
    fewer, rest = mixture(frame, 4)
    assert Counter(r.shard for r in rest.collect()) == Counter({s: n for s, n in shards.items() if s != 3})
    assert sum(r.times for r in fewer.collect()) == sum(shards.values()) - shards[3]


def test_blocks_grow_with_the_corpus_and_every_source_has_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 1000)
    sizes = spark.createDataFrame([("a", 10**6), ("b", 10**4), ("c", 1), ("d", 0)], "source string, source_size long")
    quota = {r.source: r.quota for r in mixing._quotas(mixing.source_targets(sizes), 4, 1.5).collect()}
    assert quota["a"] > 1000 and quota["c"] == quota["d"] == 1
    out = Counter(r.shard for r in mixing.splitting_tree(spark.createDataFrame(list(quota.items()), "source string, quota long"), 4, 7).collect())
    assert max(out.values()) - min(out.values()) <= 1


def test_shards_keep_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, f"t{i} " * (1 + i % 9), ["a", "b"][i % 2]) for i in range(300)]
    mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4).write.parquet(str(tmp_path / "mix"))
    files = sorted(str(p) for p in (tmp_path / "mix").glob("*.parquet"))
    order = [r.doc_id for f in files for r in spark.read.parquet(f).collect()]
    out = with_shards(spark.read.parquet(str(tmp_path / "mix")), 4, kept=True).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))] == order != sorted(order)
