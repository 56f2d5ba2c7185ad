"""N-gram Jaccard join with prefix trees.

1. Documents are packed into chunks and reduced to sets of distinct word n-grams (hashes of 64
   bits). The frequency class of every n-gram, the logarithm of the number of documents that
   hold it, is counted over the whole corpus and sent back to the chunks. (class, hash) is the
   global order: rare n-grams first, the same for every document.
2. Equal sets form a class, of which one member goes on. Two sets with Jaccard similarity t or
   more share an n-gram within their first n - ceil(t n) + 1. Those that no other document
   holds cannot be it, so most documents drop out; the others name candidates, and candidates
   that hang together form a block.
3. A block's ordered sets are stored in a prefix tree: sets that begin alike share their path.
   A set that looks for partners walks down the tree level by level with the overlap so far,
   shared by all sets below a node, and leaves a subtree once even the remaining n-grams on
   both sides could not reach the overlap that is needed. Overlaps are exact.

Every set walks once, for the partners behind it in the tree's order, so that every link is found
and counted once. What leaves a task is not the links but a row for each set: the first set that
links reach within the task, and the number of its partners, each as often as its class has
members. A block of more than BLOCK_NGRAMS is cut into pieces and every pair of pieces is joined
in a task of its own; a pair within one piece counts in the task of that piece with itself only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import chunks as ch
from .components import components
from .text_arrays import distinct_by_document, mix, shingles, words

#: N-grams of one task's prefix tree, about 100 bytes each while it is built.
BLOCK_NGRAMS = 1 << 20
#: Longest run of n-grams that a tree node holds; bounds are tested between runs.
RUN = 48


def _sets(row: dict, size: int):
    """Distinct n-grams of a chunk by document, and the chunk's distinct n-grams with counts."""
    buf, off, uids = ch.unpack(row)
    h, _, _, doc = words(buf, off)
    h, doc = distinct_by_document(*shingles(h, doc, size))
    return h, doc, uids


def _counts(size: int, bits: int):
    def run(batches):
        for row in ch.rows_of(batches):
            grams, count = np.unique(_sets(row, size)[0], return_counts=True)
            low = (grams << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :5]
            out = [(b, ch.squeeze(np.ascontiguousarray(low[i:j]).view("V5").ravel()), ch.squeeze(count[i:j].astype(np.uint32)))
                   for b, i, j in ch.cut(grams, bits)]
            yield pa.RecordBatch.from_pylist(
                [{"part": row["part"], "seq": row["seq"], "bucket": b, "grams": g, "counts": c} for b, g, c in out],
                pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("bucket", pa.int64()),
                           ("grams", pa.binary()), ("counts", pa.binary())]))
    return run


def _classes(table: pa.Table) -> pa.Table:
    """One bucket: the frequency class of each n-gram, back to the chunks that sent it."""
    grams = [ch.unsqueeze(x.as_py(), "V5").view(np.uint8).reshape(-1, 5) for x in table["grams"]]
    sizes = [len(g) for g in grams]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, 3:] = np.concatenate(grams)
    value = wide.view(">u8").ravel().astype(np.uint64)
    count = np.concatenate([ch.unsqueeze(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
    order = np.argsort(value)
    value = value[order]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    total = np.add.reduceat(count[order], begin)
    level = np.ceil(np.log2(total)).astype(np.uint8)
    out = np.empty(len(value), np.uint8)
    out[order] = np.repeat(level, np.diff(np.r_[begin, len(value)]))
    ends = np.cumsum(sizes)
    return pa.table({"part": table["part"], "seq": table["seq"], "bucket": table["bucket"],
                     "levels": pa.array([ch.squeeze(out[e - n: e]) for e, n in zip(ends, sizes)], pa.binary())})


def _ordered(row: dict, size: int):
    """Each document's set in the global order: keys of 6 class bits and 58 hash bits."""
    h, doc, uids = _sets(row, size)
    if len(h):
        grams, back = np.unique(h, return_inverse=True)
        level = np.concatenate([ch.unsqueeze(x["levels"], np.uint8) for x in row["found"]])
        assert len(level) == len(grams)
        key = level[back].astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)
        order = np.lexsort((key, doc))
        h, key, doc = h[order], key[order], doc[order]
    else:
        key = h
    return h, key, doc, uids


def _prefixes(size: int, threshold: float):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()),
                        ("fp2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        for row in ch.rows_of(batches):
            h, key, doc, uids = _ordered(row, size)
            n = np.bincount(doc, minlength=len(uids)) if len(doc) else np.zeros(len(uids), np.int64)
            begin = np.concatenate(([0], np.cumsum(n)))
            fp1, fp2 = (np.zeros(len(uids), np.uint64) for _ in range(2))
            full = n > 0
            if len(h):
                fp1[full] = np.add.reduceat(mix(h), begin[:-1][full])
                fp2[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin[:-1][full])
            cutoff = prefix_size(n, threshold)
            ids, prefixes = row["doc_ids"], []
            for i in range(len(uids)):
                own = key[begin[i]: begin[i] + cutoff[i]]
                prefixes.append(own[own >> np.uint64(58) > 0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), pa.array(ids, pa.int64()), pa.array(n), pa.array(fp1.view(np.int64)),
                 pa.array(fp2.view(np.int64)), pa.array(prefixes, pa.list_(pa.int64()))], schema=schema)
    return run


def needed(nx, ny, threshold: float):
    """Least overlap of sets of these sizes with the given Jaccard similarity, exactly."""
    top = round(threshold * 100)
    return -((-top * (nx + ny)) // (100 + top))


def prefix_size(n, threshold: float):
    """How many leading n-grams a set of n must show."""
    top = round(threshold * 100)
    return np.where(n > 0, n + (-top * n) // 100 + 1, 0)


def _members(size: int):
    """The ordered sets of the documents that are in a block."""
    def run(batches):
        schema = pa.schema([("task", pa.int64()), ("uid", pa.int64()), ("copies", pa.int64()), ("side", pa.int64()),
                            ("keys", pa.list_(pa.int64()))])
        for row in ch.rows_of(batches):
            _, key, doc, uids = _ordered(row, size)
            begin = np.searchsorted(doc, np.arange(len(uids) + 1))
            out = {name: [] for name in schema.names}
            for x in row["wanted"]:
                i = x["uid"] & 0xFFFF
                for name in ("task", "uid", "copies", "side"):
                    out[name].append(x[name])
                out["keys"].append(key[begin[i]: begin[i + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    return run


class PrefixTree:
    """Ordered sets that share their leading runs, laid out in arrays, level by level.

    A node is a run of at most RUN n-grams; it covers the sets `left` to `right` of the
    lexicographic order. Sets that end at a node are its leaves.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        shared = [0] * (len(sets) + 1)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        self.shared = np.array(shared, np.int64)
        nodes, children, ends = [], [], []  # (set, from, to, left, right), parent's number, (set, node)
        front = [(0, len(sets), 0, -1)]
        while front:
            later = []
            for left, right, depth, parent in front:
                at = left
                while at < right and self.size[at] == depth:
                    ends.append((at, parent))
                    at += 1
                inner = np.flatnonzero(self.shared[at + 1: right] <= depth) + at + 1 if at < right else []
                for lo, hi in zip([at, *inner], [*inner, right]) if at < right else ():
                    common = int(self.shared[lo + 1: hi].min()) if hi - lo > 1 else int(self.size[lo])
                    # a set that ends inside the group ends at a node's end
                    to = min(common, depth + RUN) if common > depth else depth + 1
                    nodes.append((lo, depth, to, lo, hi))
                    children.append(parent)
                    later.append((lo, hi, to, len(nodes) - 1))
            front = later
        self.parent = np.array(children, np.int64)
        self.left, self.right = (np.array([x[k] for x in nodes], np.int64) for k in (3, 4))
        self.depth = np.array([x[2] for x in nodes], np.int64)
        self.run = np.array([x[2] - x[1] for x in nodes], np.int64)
        flat = np.concatenate([self.sets[s][a:b] for s, a, b, _, _ in nodes])
        self.last = np.array([self.sets[s][b - 1] for s, _, b, _, _ in nodes])
        self.least = np.array([self.size[lo:hi].min() for *_, lo, hi in nodes])
        self.most = np.array([self.size[lo:hi].max() for *_, lo, hi in nodes])
        self.end = np.zeros(len(sets), np.int64)
        self.end[[s for s, _ in ends]] = [n for _, n in ends]
        self.offset = np.concatenate(([0], np.cumsum(self.run)))
        self.grams, self.flat = np.unique(flat, return_inverse=True)
        by_parent = np.argsort(self.parent, kind="stable")
        self.kids = by_parent
        self.kid_from = np.searchsorted(self.parent[by_parent], np.arange(-1, len(nodes) + 1))
        self.leaf_order = np.argsort(self.end, kind="stable")
        self.leaf_from = np.searchsorted(self.end[self.leaf_order], np.arange(len(nodes) + 1))

    def partners(self, probe: np.ndarray, open_sets: np.ndarray, threshold: float) -> np.ndarray:
        """Positions of the open sets whose similarity to `probe` reaches the threshold."""
        has = np.zeros(len(self.grams), np.int64)
        at = np.searchsorted(self.grams, probe)
        at = at[(at < len(self.grams))]
        has[at[np.isin(self.grams[at], probe, assume_unique=True)]] = 1
        n, left = len(probe), np.concatenate(([0], np.cumsum(open_sets)))
        top = round(threshold * 100)
        found = []
        node, before = self._below(np.array([-1])), None
        overlap = np.zeros(len(node), np.int64)
        while len(node):
            # any open set below, of a size that can be similar
            keep = (left[self.right[node]] > left[self.left[node]]) & (100 * self.most[node] >= top * n) & (top * self.least[node] <= 100 * n)
            node, overlap = node[keep], overlap[keep]
            if not len(node):
                break
            overlap = overlap + _sums(has[self.flat], self.offset[node], self.run[node])
            rest = n - np.searchsorted(probe, self.last[node], "right")
            # the sets below a node differ in size: the bound must hold for the smallest that is large enough
            small = np.maximum(self.least[node], -(-top * n // 100))
            best = overlap + np.minimum(rest, self.most[node] - self.depth[node])
            keep = best >= needed(n, small, threshold)
            node, overlap = node[keep], overlap[keep]
            count = self.leaf_from[node + 1] - self.leaf_from[node]
            if count.any():
                sets = self.leaf_order[_ranges(self.leaf_from[node], count)]
                good = open_sets[sets] & (np.repeat(overlap, count) >= needed(n, self.size[sets], threshold))
                found.append(sets[good])
            kids = self.kid_from[node + 2] - self.kid_from[node + 1]
            node, overlap = self.kids[_ranges(self.kid_from[node + 1], kids)], np.repeat(overlap, kids)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _below(self, node: np.ndarray) -> np.ndarray:
        count = self.kid_from[node + 2] - self.kid_from[node + 1]
        return self.kids[_ranges(self.kid_from[node + 1], count)]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of count[0] numbers, then those of start[1], ..."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)


def _sums(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of runs of values; every run has at least one."""
    inner = np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.add.reduceat(values[_ranges(start, count)], inner)


def _join_block(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        uids = table["uid"].to_numpy()
        keys = table["keys"].combine_chunks()
        off = keys.offsets.to_numpy()
        values = keys.values.to_numpy().view(np.uint64).astype(">u8")  # sorts as bytes
        sets = [values[off[i]: off[i + 1]] for i in range(len(uids))]
        tree = PrefixTree(sets)
        copies, side = table["copies"].to_numpy()[tree.order], table["side"].to_numpy()[tree.order]
        names, first, n_links = uids[tree.order], np.arange(len(uids)), np.zeros(len(uids), np.int64)
        # side 0 and 1: of two pieces, only sets of different ones are compared; 2: one piece with itself
        still = side != 0
        for x in np.flatnonzero(side != 1):
            if side[x] == 2:
                still[x] = False  # from now on open for none: pairs with the sets before are counted
            if not still.any():
                break
            near = tree.partners(tree.sets[x].astype(np.uint64), still, threshold)
            if len(near):
                n_links[x] += copies[near].sum()
                n_links[near] += copies[x]
                met = np.unique(first[np.append(near, x)])
                if len(met) > 1:
                    first[np.isin(first, met)] = met[0]
        linked = np.flatnonzero(n_links)
        return pa.table({"a": names[linked], "b": names[first[linked]], "n": n_links[linked]}, schema=schema)
    return run


def ngram_components(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every row of `documents`.

    documents: doc_id, text; other columns are ignored. A document's set is its distinct
    n-grams of `size` words (A-Z lower-cased); one with fewer words has its whole sequence as
    one; null and empty texts have none, link with nothing and are components of their own.
    Rows link when their Jaccard similarity is at least `threshold` (whole hundredths).
    component_id is the least doc_id that links reach, class_id the least doc_id with the same
    set, n_links the number of other rows that the row links with, equal sets included. A row
    without doc_id takes part and gets its component's least id, null if none has
    one. Repeated rows and ids are rows of their own. An empty table gives an empty result.
    """
    spark, name = documents.sparkSession, ch.pack(documents)
    packed = spark.table(name)
    bits = ch.bucket_bits(packed)
    counted = packed.mapInArrow(_counts(size, bits), "part long, seq long, bucket long, grams binary, counts binary")
    levels = counted.groupBy("bucket").applyInArrow(_classes, "part long, seq long, bucket long, levels binary")
    found = settle(levels.groupBy("part", "seq").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("found")), "levels")
    shown = settle(ch.join_chunks(packed, found).mapInArrow(
        _prefixes(size, threshold), "uid long, doc_id long, n long, fp1 long, fp2 long, prefix array<long>"), "sets")
    sets = shown.select("uid", "doc_id", "n", F.when(F.col("n") > 0, F.struct("fp1", "fp2", "n")).alias("fp"))
    classes = (shown.where("n > 0").groupBy(F.struct("fp1", "fp2", "n").alias("fp"))
               .agg(F.min("uid").alias("rep"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"),
                    F.min_by("prefix", "uid").alias("prefix")))
    classes = settle(classes, "classes")
    shows = classes.select("rep", F.col("fp.n").alias("n"), F.explode("prefix").alias("gram"))
    hubs = shows.groupBy("gram").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    stars = shows.join(hubs, "gram").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    blocks = components(stars, "blocks").withColumnsRenamed({"node": "rep", "root": "block"})
    blocks = settle(blocks.join(classes.select("rep", "copies", F.col("fp.n").alias("n")), "rep"), "blocks")
    pieces = blocks.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_NGRAMS).alias("k"))
    cut = blocks.join(pieces, "block").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")))
    pairs = cut.select("rep", "copies", "block", "own", F.explode(F.expr(
        "transform(sequence(0L, k - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j))")).alias("pair"))
    wanted = (pairs.select(F.shiftright("rep", 40).alias("part"), F.expr("shiftright(rep, 16) & 16777215L").alias("seq"),
                           F.struct(F.col("rep").alias("uid"), F.xxhash64("block", "pair.i", "pair.j").alias("task"), "copies",
                                    F.expr("CASE WHEN pair.i = pair.j THEN 2L WHEN own = pair.i THEN 0L ELSE 1L END").alias("side")).alias("x"))
              .groupBy("part", "seq").agg(F.collect_list("x").alias("wanted")))
    asked = settle(wanted.join(found, ["part", "seq"]), "asked")
    members = ch.join_chunks(packed, asked, "inner").mapInArrow(_members(size), "task long, uid long, copies long, side long, keys array<long>")
    links = settle(members.groupBy("task").applyInArrow(_join_block(threshold), "a long, b long, n long"), "links")
    reached = components(links, "reached")
    degrees = links.groupBy("a").agg(F.sum("n").alias("n_partners"))
    named = classes.join(reached, classes["rep"] == reached["node"], "left").join(
        degrees, classes["rep"] == degrees["a"], "left").select(
        "fp", "class_id", F.coalesce("root", "rep").alias("root"),
        (F.coalesce("n_partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labelled = named.join(least, "root").select("fp", "class_id", "component_id", "n_links")
    out = settle(sets.join(labelled, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "ngram-join")
    ch.drop(spark, name)
    return out


def keep_one(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without all but the first row of each component: the least doc_id, missing ones last.

    Rows without n-grams stay, repeated ones too. Other rows that repeat doc_id and text stay once,
    with the columns of any of them; of several texts with one doc_id, or without one, each is a
    document of its own.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = documents.withColumn("__key", F.xxhash64(doc_id, text))
    # the key stands for the row, so that a component names rows and not ids that may repeat
    found = ngram_components(keyed.select(F.col("__key").alias("doc_id"), text.alias("text")), size, threshold)
    labels = settle(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__key")).agg(
        F.min("component_id").alias("least"), F.max("component_id").alias("most"), F.count(F.lit(1)).alias("copies")), "labels")
    ids = keyed.select("__key", doc_id.alias("__id")).distinct()
    known = labels.where("least = most")  # else two different rows have one hash: both stay
    # written, so that the join below is of plain shuffles, whose hot partitions are split
    first = settle(known.join(ids, "__key").groupBy("least").agg(
        F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__key")).alias("f")).select(
        F.col("least").alias("__component"), F.col("f.__key").alias("__first")), "firsts")
    fate = known.join(first, F.col("least") == F.col("__component")).select(
        "__key", (F.col("__key") != F.col("__first")).alias("__gone"), (F.col("copies") > 1).alias("__again"))
    fate = settle(fate.where("__gone OR __again"), "fates")
    out = keyed.join(fate.where("__gone"), "__key", "left_anti")
    again = fate.where("__again AND NOT __gone").select("__key")
    if again.isEmpty():  # as a rule: then texts are shuffled for the first join only
        return out.select(documents.columns)
    once = out.join(again, "__key", "left_anti").unionByName(out.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.select(documents.columns)
