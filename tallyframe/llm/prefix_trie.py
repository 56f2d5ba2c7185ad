"""The trie of conversations' prefixes, by van Emde Boas recursion.

A problem is a set of sequences below one node, over a range of positions. Each round cuts every
problem at half its depth: a sequence's upper half gets a name, which is the name of the whole
prefix up to the cut. Sequences with one name meet in the upper problem, where the least of them
goes on and carries their number; what lies below the cut goes on in a lower problem under that
name. All problems of a round are rows of one table, so uppers and lowers are solved in parallel,
and after log2(depth) rounds each problem is one turn deep: its distinct turns are the nodes.

Sums over subtrees go back up the same cuts. A round's cut separates a node from its ancestors
above it in exactly one round, so the values of the nodes in a lower problem are summed under the
name of its cut, grafted onto the sequence that leads to it in the upper problem, and handed down
its rounds to all nodes on that sequence.

A name is the exclusive or of 128-bit hashes of (position, turn): built in any order, summed
before shuffling, so that a conversation with a third of all turns is spread like any other rows.
Texts never leave the scan.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import in_ranges, numbered
from ..session import settle

_STEP = ["blk", "t1", "t2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, k1, k2, words): every turn's place from 0, the hash of role and text, its words.

    By turn, null first; equal turns by role, then by the hash. Null roles and texts are empty;
    rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2")]
    placed = numbered(in_ranges(slim, ["conv_id"], order), ["conv_id"], [F.col("__range")], order, "at")
    return placed.select("conv_id", (F.col("at") - 1).alias("at"), "k1", "k2", "words")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, members) with every conversation's first turns replaced by its donor's.

    A conversation c takes the first h = crc32(c as text) % (most + 1) turns of conversation
    c - c % every (the remainder has c's sign), all if that has fewer, none if it is absent;
    its own turns follow, without its first h. Members are all conv_ids, turnless ones too.
    """
    convs = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1),
        "donor": F.col("conv_id") - F.col("conv_id") % every}), "conversations")
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    plan = convs.join(donors, "donor", "left").select(
        "conv_id", "donor", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    heads = turns.where((F.col("at") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "donor")
    given = plan.join(heads, "donor").where("at < taken").select("conv_id", "at", "k1", "k2", "words")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("at >= h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "k1", "k2", "words")
    return settle(given.union(own), "rebuilt"), convs.select("conv_id")


def _item(seed: int):
    return F.xxhash64(F.lit(seed), "at", "k1", "k2")


def _cut(state: DataFrame, j: int) -> tuple[DataFrame, DataFrame]:
    """One round: blocks of 2 ** (j + 1) positions are cut into halves.

    Returns the cuts (a row for each sequence of a problem: its name at the cut, c1 and c2, the
    sequence that goes on above it and how many it stands for) and the rows of the halves.
    """
    low = F.shiftright("at", j).bitwiseAND(1) == 1
    rows = state.withColumn("blk", F.shiftright("at", j + 1))
    seqs = rows.groupBy(*_STEP, "conv_id").agg(
        *[F.coalesce(F.bit_xor(F.when(~low, _item(s))), F.lit(0)).bitwiseXOR(F.first(f"t{s}")).alias(f"c{s}") for s in (1, 2)],
        F.max(low).alias("has_low"), F.max("w").alias("w"))
    seqs = settle(seqs, "trie-sequences")
    # written, so that both sides of the join are plain shuffles, whose hot partitions are split
    reps = settle(seqs.groupBy(*_STEP, "c1", "c2").agg(F.min("conv_id").alias("rep"), F.sum("w").alias("w_up")), "trie-names")
    cuts = settle(seqs.drop("w").join(reps, [*_STEP, "c1", "c2"]), "trie-cuts")
    both = rows.join(cuts.drop("has_low"), [*_STEP, "conv_id"]).where(low | (F.col("conv_id") == F.col("rep")))
    cut = F.struct(F.lit(j).alias("level"), "c1", "c2")
    state = settle(both.select(
        "at", *[F.when(low, F.col(f"c{s}")).otherwise(F.col(f"t{s}")).alias(f"t{s}") for s in (1, 2)], "conv_id",
        F.when(low, F.col("w")).otherwise(F.col("w_up")).alias("w"), "k1", "k2", "words",
        F.when(low, F.array_append("cuts", cut)).otherwise(F.col("cuts")).alias("cuts")), "trie-rows")
    return cuts, state


def _graft(cuts: list[tuple[int, DataFrame]], below: DataFrame) -> DataFrame | None:
    """(blk, t1, t2, conv_id, saved, leaves): what the sequences of one-turn problems bring from below them."""
    g = None
    for j, cut in cuts:
        if g is None:
            now = cut.withColumns({"saved": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
        else:
            now = cut.join(g, [*_STEP, "conv_id"], "left").fillna(0, ["saved", "leaves"])
        own = below.where(F.col("level") == j).select("c1", "c2", F.col("saved").alias("s"), F.col("leaves").alias("l"))
        up = now.groupBy(*_STEP, "c1", "c2", "rep").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        up = up.join(own, ["c1", "c2"], "left").select(
            (F.col("blk") * 2).alias("blk"), "t1", "t2", F.col("rep").alias("conv_id"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        down = now.where("has_low").select((F.col("blk") * 2 + 1).alias("blk"), F.col("c1").alias("t1"), F.col("c2").alias("t2"),
                                           "conv_id", "saved", "leaves")
        g = settle(up.union(down).where("saved <> 0 OR leaves <> 0"), "trie-grafts")
    return g


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n1, n2) of every node.

    turns: conv_id, at (from 0, without gaps), k1, k2, words; members: all conv_ids, once each.
    A node is a distinct sequence of first turns, the root is the empty one; conv_id is the least
    member that starts with it, n_leaves counts childless nodes of its subtree and saved_tokens
    sums (n_convs - 1) * words of the last turn over it. n1 and n2 are the node's name. Without
    members there are no nodes; members without turns are the root's alone.
    """
    deepest = turns.agg(F.max("at")).first()[0]
    rounds = 0 if deepest is None else int(deepest).bit_length()
    zero = F.lit(0).cast("long")
    state = turns.select("at", zero.alias("t1"), zero.alias("t2"), "conv_id", F.lit(1).cast("long").alias("w"), "k1", "k2", "words",
                         F.expr("CAST(array() AS array<struct<level: int, c1: bigint, c2: bigint>>)").alias("cuts"))
    cuts = []
    for j in reversed(range(rounds)):
        cut, state = _cut(state, j)
        cuts.append((j, cut))
    turn = ["at", "t1", "t2", "k1", "k2"]
    nodes = state.groupBy(*turn).agg(F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.first("words").alias("words"),
                                     F.first("cuts").alias("cuts"))
    nodes = settle(nodes.select("*", *[_item(s).bitwiseXOR(F.col(f"t{s}")).alias(f"n{s}") for s in (1, 2)]), "trie-nodes")
    above = nodes.select(F.col("t1").alias("n1"), F.col("t2").alias("n2"), (F.col("at") - 1).alias("at"))
    kids = above.groupBy("n1", "n2", "at").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["n1", "n2", "at"], "left").fillna(0, ["n_children"]).withColumns({
        "saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("long")})
    nodes = settle(nodes, "trie-counted")
    below = settle(nodes.select(F.explode("cuts").alias("cut"), "saved", "leaves").select("cut.*", "saved", "leaves").groupBy(
        "level", "c1", "c2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-below")
    grafts = _graft(cuts, below)
    if grafts is not None:
        brought = state.join(grafts.withColumnRenamed("blk", "at"), ["at", "t1", "t2", "conv_id"]).groupBy(*turn).agg(
            F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
        nodes = nodes.join(brought, turn, "left").fillna(0, ["saved_below", "leaves_below"])
    else:
        nodes = nodes.withColumns({"saved_below": zero, "leaves_below": zero})
    parents = nodes.select(F.col("n1").alias("t1"), F.col("n2").alias("t2"), (F.col("at") + 1).alias("at"), F.col("conv_id").alias("parent"))
    tops = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))  # one row
    inner = nodes.where("at > 0").join(parents, ["t1", "t2", "at"])
    first = nodes.where("at = 0").join(F.broadcast(tops.select(F.col("conv_id").alias("parent"))))
    out = [part.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                       (F.col("leaves") + F.col("leaves_below")).alias("n_leaves"),
                       (F.col("saved") + F.col("saved_below")).alias("saved_tokens"), "n1", "n2") for part in (first, inner)]
    sums = nodes.agg(F.sum((F.col("at") == 0).cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = tops.where("n_convs > 0").join(F.broadcast(sums)).select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), zero.alias("n1"), zero.alias("n2"))
    return root.unionByName(out[0]).unionByName(out[1])


def trie_ends(turns: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, member): the node at which each member ends, by the names of whole conversations."""
    whole = turns.groupBy("conv_id").agg(F.bit_xor(_item(1)).alias("n1"), F.bit_xor(_item(2)).alias("n2"), (F.max("at") + 1).alias("depth"))
    ends = members.withColumnRenamed("conv_id", "member").join(whole.withColumnRenamed("conv_id", "member"), "member", "left")
    ends = ends.fillna(0, ["n1", "n2", "depth"])
    return ends.join(nodes.select("conv_id", "depth", "n1", "n2"), ["depth", "n1", "n2"]).select("conv_id", "depth", "member")


def _digest(batches):
    """SHA-256 of the comma-joined members of each node; the rows come sorted, a node's in one stream."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist()))
        texts, done, at = pc.cast(batch.column("member"), pa.string()).to_pylist(), [], 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = keys[at], hashlib.sha256(",".join(texts[at:end]).encode())
            else:
                state.update(("," + ",".join(texts[at:end])).encode())
            at = end
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, state.hexdigest()), schema)], schema=schema)


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with `ends_sha256`, of the conv_ids that end there: in order, decimal, with commas between.

    A digest is a chain over one node's members; they are streamed in order, never held.
    """
    streamed = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    digests = streamed.mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")
    return nodes.join(digests, ["conv_id", "depth"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of `conversations` (conv_id, turn, role, text) with shared starts, and its end digests.

    More columns are ignored; see `numbered_turns` and `with_shared_starts` for missing values. An
    empty table gives an empty result.
    """
    turns, members = with_shared_starts(settle(numbered_turns(conversations), "turns"))
    nodes = settle(prefix_trie(turns, members), "trie")
    return with_end_digests(nodes, trie_ends(turns, members, nodes)).drop("n1", "n2")
