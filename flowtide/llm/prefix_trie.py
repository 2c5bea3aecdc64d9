"""The trie of conversations that begin alike, by digests of blocks of turns refined where they part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.functions.ordered import position, prefix

#: Turns whose digests are compared at once.
BLOCK_TURNS = 4
#: Neighbouring ids that are joined into one text before they are hashed.
CHUNK_IDS = 4096

_KEY = ["depth", "a", "b"]


def turn_keys(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, digest, words)``: what the trie needs of each turn, turns numbered from 0 in each conversation.

    Turns are ordered by ``turn_col``, nulls first, ties by the digest of role and text, so that the order never depends on
    how rows are stored; repeated rows are turns of their own.  Null role or text becomes empty; rows without a conversation
    id are in no conversation and dropped.  Extra columns are ignored.  Texts are read once and not shuffled; a long
    conversation is numbered block by block.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    keys = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("at"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    blocks = keys.withColumns({"block": F.expr("at div 256"), "tied": F.when(F.col("at").isNull(), F.substring("digest", 1, 2)).otherwise("")})
    return position(blocks, ["conv_id"], ["block", "tied"], [F.col("at"), F.col("digest")], "turn").select("conv_id", F.col("turn").cast("bigint"), "digest", "words")


def graft_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``(turns, ids)`` of all conversations, those left without turns included.

    Conversation c takes the first h turns of conversation c - c % ``every`` (all if it has fewer, none if it does not
    exist), then its own turns after its first h; h is the unsigned CRC-32 of the decimal c, modulo ``most``.  At most
    ``most`` turns of one conversation are held in a row.
    """
    ids = turns.select("conv_id").distinct()
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("turn") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("head"))
    shift = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    grafts = ids.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": shift}).join(heads, "base", "left")
    grafts = grafts.select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(array(struct(0L AS turn, '' AS digest, 0L AS words)), 1, 0)")).alias("head"))
    own = turns.join(grafts.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").where("turn >= h").select("conv_id", (F.col("turn") - F.col("h") + F.col("taken")).alias("turn"), "digest", "words")
    taken = grafts.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.turn", "t.digest", "t.words")
    return own.union(taken), ids


def _xor(turns: Column, upto: Column, field: str) -> Column:
    return F.aggregate(F.slice(turns, F.lit(1), upto), F.lit(0).cast("bigint"), lambda all_, t: all_.bitwiseXOR(t[field]))


def turn_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation and block of turns: ``conv_id, k, m`` turns, the key ``pa, pb`` of all turns before it, the
    digest ``ea, eb`` of its own, and for each of its turns the words, and the digest up to and before it.

    The key of a sequence of turns is the exclusive or of 128-bit hashes of (turn, position), so the key of any prefix is the
    key of the blocks before it combined with a part of one block.
    """
    hashed = turns.select(
        "conv_id", F.expr(f"turn div {block_turns}").alias("k"), "turn", "words",
        F.xxhash64("digest", "turn").alias("x"), F.xxhash64(F.lit("second"), "turn", "digest").alias("y"),
    )
    blocks = hashed.groupBy("conv_id", "k").agg(
        F.sort_array(F.collect_list(F.struct("turn", "words", "x", "y"))).alias("t"), F.bit_xor("x").alias("ea"), F.bit_xor("y").alias("eb"), F.count("*").alias("m"),
    )
    inner = F.transform("t", lambda t, i: F.struct(
        t["words"].alias("words"), _xor(F.col("t"), i + 1, "x").alias("ia"), _xor(F.col("t"), i + 1, "y").alias("ib"), _xor(F.col("t"), i, "x").alias("qa"), _xor(F.col("t"), i, "y").alias("qb"),
    ))
    blocks = blocks.select("conv_id", "k", F.expr("k div 256").alias("far"), "m", "ea", "eb", inner.alias("turns"))
    return prefix(blocks, ["conv_id"], ["far"], [F.col("k")], {"pa": ("xor", "ea"), "pb": ("xor", "eb")}).drop("far")


def _nodes(groups: DataFrame, names: list[str], block_turns: int) -> DataFrame:
    """A row for each turn of each block, with the keys of its prefix and of the prefix before it."""
    each = groups.select("k", "pa", "pb", *names, F.posexplode("turns").alias("j", "t"))
    xor = lambda p, i: F.col(p).bitwiseXOR(F.col(f"t.{i}"))
    return each.select(
        (F.col("k") * block_turns + F.col("j") + 1).cast("bigint").alias("depth"), xor("pa", "ia").alias("a"), xor("pb", "ib").alias("b"),
        xor("pa", "qa").alias("up_a"), xor("pb", "qb").alias("up_b"), F.col("t.words").alias("words"), *names,
    )


def over_members(blocks: DataFrame, measures: dict[str, tuple[str, Column]], block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``(depth, a, b, up_a, up_b, words, measures)`` per node but the root: sums or minima over the conversations below it.

    Blocks are grouped by all that comes before them and their own digest, so copies shrink to one row before anything else
    is shuffled.  Where all that goes on from a place goes on with one and the same block, its nodes have the same members
    and are written out at once; only blocks whose siblings differ are taken apart and grouped turn by turn.
    """
    agg = {"sum": F.sum, "min": F.min}
    again = [agg[kind](name).alias(name) for name, (kind, _) in measures.items()]
    names = list(measures)
    groups = blocks.groupBy("k", "pa", "pb", "ea", "eb", "m").agg(*[agg[kind](c).alias(name) for name, (kind, c) in measures.items()], F.first("turns").alias("turns"))
    groups = cut(groups)
    single = groups.groupBy("k", "pa", "pb").agg(F.count("*").alias("n_blocks")).where("n_blocks = 1").drop("n_blocks")
    place = ["k", "pa", "pb"]
    alone = _nodes(groups.join(single, place, "left_semi"), names, block_turns)
    parted = _nodes(groups.join(single, place, "left_anti"), names, block_turns)
    refined = parted.groupBy(*_KEY).agg(F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.first("words").alias("words"), *again)
    return alone.unionByName(refined)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each key; the rows of a key follow each other, across batches too."""
    key, state = None, None

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for *now, text in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "text")), strict=True):
            if now == key:
                state.update(b"," + text.encode())
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
        if done:
            yield out(done)
    if key is not None:
        yield out([(*key, state.hexdigest())])


def _ends(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)`` of the sequences at which conversations end.

    Neighbouring ids are joined into texts first; the texts of a sequence then pass through one hash in order, which keeps
    nothing but its state however many conversations end there.
    """
    ended = blocks.groupBy("conv_id").agg(F.sum("m").alias("depth"), F.bit_xor("ea").alias("a"), F.bit_xor("eb").alias("b"))
    ended = ids.join(ended, "conv_id", "left").fillna(0, _KEY).withColumn("chunk", F.expr(f"conv_id div {CHUNK_IDS}"))
    joined = ended.groupBy(*_KEY, "chunk").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    return joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").mapInArrow(_digests, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one (the root) included.

    ``turns`` is what ``turn_keys`` returns; ``ids`` lists all conversations where some have no turns.  Columns: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members: conversations that begin with
    it), ``n_children``, ``n_leaves`` (childless nodes in its subtree), ``saved_tokens`` (sum over its subtree of each node's
    members but one times the words of its last turn) and ``ends_sha256`` (of the comma-joined ascending ids of the members
    that end there).  No conversations, no rows.

    Runs jobs.  No step follows the depth of the trie: a node's value is booked on its smallest member, whose nodes are the
    end of its path; what lies below any node is then the sum over its members, less what its own smallest member has above.
    """
    turns = cut(turns)
    ids = cut(turns.select("conv_id").union(ids) if ids is not None else turns.select("conv_id")).distinct()
    blocks = cut(turn_blocks(turns, block_turns))
    nodes = over_members(blocks, {"n_convs": ("sum", F.lit(1).cast("bigint")), "conv_id": ("min", F.col("conv_id"))}, block_turns)
    children = lambda n: n.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes)
    nodes = nodes.join(children(nodes), _KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "value": (F.col("n_convs") - 1) * F.col("words")})
    nodes = cut(nodes)

    booked = nodes.groupBy("conv_id").agg(F.sum("value").alias("value"), F.count_if(F.col("n_children") == 0).alias("leaf")).where("value > 0 or leaf > 0")
    below = over_members(blocks.join(booked, "conv_id"), {"all_value": ("sum", F.col("value")), "n_leaves": ("sum", F.col("leaf"))}, block_turns).select(*_KEY, "all_value", "n_leaves")
    # What the smallest member of a node has booked above it.
    above = prefix(nodes.withColumn("far", F.expr("depth div 256")), ["conv_id"], ["far"], [F.col("depth")], {"above": ("sum", "value")}).drop("far")

    total = nodes.agg(F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.coalesce(F.sum("value"), F.lit(0).cast("bigint")).alias("saved_tokens"), F.count_if(F.col("depth") == 1).alias("n_children"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.crossJoin(total).select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"), "saved_tokens",
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    whole = above.join(below, _KEY).withColumn("saved_tokens", F.col("all_value") - F.col("above"))
    first = whole.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))
    deeper = whole.where("depth > 1").join(parents, ["depth", "up_a", "up_b"])
    columns = [*_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = first.select(columns).union(deeper.select(columns)).union(root.select(columns))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return every.join(_ends(blocks, ids), _KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
