"""The prefix trie of conversations, from whole sequences.

Identical conversations become one weighted sequence with a list of those that end there. A sequence that is a proper prefix of another
is no leaf: an anti-join on what continues tells. Nodes are then sums over the prefixes of weighted sequences, never over conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Conversation ids in one row of an end list.
CHUNK = 4096


def _root() -> Column:
    """The key of the root: no bytes."""
    return F.unhex(F.lit(""))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, nth, digest, n_chars) of conversations (conv_id, turn, role, text): turns numbered from 1 in order of turn, null first, equal
    ones in order of digest (SHA-256 of role and text). Texts are read once and go no further.

    A null role or text is empty; rows of a null conv_id belong to no conversation; other columns are ignored."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    t = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(own.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    w = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return t.filter("conv is not null").select("conv", F.row_number().over(w).cast("long").alias("nth"), "digest", "n_chars")


def share_heads(own: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first turns of another: (turns, conv of every conversation, turnless ones too).

    base and head are expressions of conv: whose turns come first, and how many (all, if it has fewer; none, if it isn't there). The
    conversation's own turns follow, less as many of its first."""
    each = stored(own.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", base.cast("long").alias("base"), head.cast("long").alias("head")), "conversations")
    other = each.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = each.join(other, "base", "left").select("conv", "head", F.least("head", F.coalesce("n_base", F.lit(0))).alias("taken"))
    most = each.agg(F.coalesce(F.max("head"), F.lit(0)).alias("m")).first()["m"]
    first = own.filter(F.col("nth") <= most).withColumnRenamed("conv", "base").join(each.select("conv", "base", "head"), "base").filter("nth <= head").select("conv", "nth", "digest", "n_chars")
    rest = own.join(taken, "conv").filter("nth > head").select("conv", (F.col("taken") + F.col("nth") - F.col("head")).alias("nth"), "digest", "n_chars")
    return first.unionByName(rest), each.select("conv")


def _chained(t: DataFrame) -> DataFrame:
    """t with key, which tells a conversation's turns up to each one (SHA-256 of the key before and the turn's digest), parent, the key
    before, and last, whether no turn follows. Turns of a conversation are read in order by one task, one batch at a time."""
    dealt = t.repartition("conv").withColumn("last", F.lead("nth").over(Window.partitionBy("conv").orderBy("nth")).isNull()).sortWithinPartitions("conv", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key = None, b""
        for batch in batches:
            parents, keys = [], []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != last:
                    last, key = conv, b""
                parents.append(key)
                key = hashlib.sha256(key + digest).digest()
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(parents, pa.binary()), pa.array(keys, pa.binary())], names=["conv", "nth", "n_chars", "last", "parent", "key"])

    return dealt.select("conv", "nth", "digest", "n_chars", "last").mapInArrow(run, "conv long, nth long, n_chars long, last boolean, parent binary, key binary")


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, first, n, ids) of (key, conv): the conversations that end at each key in ascending order, as rows of at most CHUNK ids joined
    by commas. Ids are dealt by range, so that a key that very many conversations end at is several tasks' work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            rows = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and (k != key or len(own) == CHUNK):
                    rows.append((key, own[0], len(own), ",".join(map(str, own))))
                    own = []
                key = k
                own.append(conv)
            yield _rows(rows)
        if own:
            yield _rows([(key, own[0], len(own), ",".join(map(str, own)))])

    return ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(run, "key binary, first long, n long, ids string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"key": pa.binary(), "first": pa.int64(), "n": pa.int64(), "ids": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def end_digests(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's whole end list, comma-joined. Rows of a list are read in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])
        for batch in batches:
            rows = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        rows.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield make(rows)
        if state is not None:
            yield make([(key, state.hexdigest())])

    return lists.select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends_sha256 string")


def trie(t: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, end lists) of turns (conv, nth, digest, n_chars). every: conv of all conversations, where some may have no turn.

    nodes: key, conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens: summed over the subtree,
    (n_convs - 1) times the code points of each node's text. The root has an empty key and a null parent_conv_id. No conversations
    give no nodes. Repeated conversations count each for themselves.

    What is shuffled grows with turns: digests, and prefixes of distinct sequences. A node belongs to the least leaf under it, and the
    nodes of one leaf lie in a row on its path; so a subtree's sum is the whole sum of each leaf under it, save that of the node's own
    leaf, of which only the part below counts. A conversation's own turns are one task's work, in order."""
    keyed = stored(_chained(t), "keyed")
    ends = keyed.filter("last").select("key", "conv")
    if every is not None:
        ends = ends.unionByName(every.join(keyed.select("conv").distinct(), "conv", "left_anti").select(_root().alias("key"), "conv"))
    lists = stored(end_lists(ends), "end-lists")
    sequences = stored(lists.groupBy(F.col("key").alias("sequence")).agg(F.sum("n").alias("weight"), F.min("first").alias("conv")), "sequences")
    prefixes = stored(keyed.drop("last").join(sequences, "conv"), "prefixes")  # those of one conversation of each sequence
    inner = prefixes.groupBy("key").agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("nth").alias("depth"), F.first("parent").alias("parent"), F.first("n_chars").alias("n_chars"))
    root = sequences.agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs is not null")
    root = root.select(_root().alias("key"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_chars"))
    nodes = stored(inner.unionByName(root), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    leaves = sequences.join(children, sequences["sequence"] == children["key"], "left_anti").select(F.col("sequence").alias("leaf"))
    paths = prefixes.select(F.col("sequence").alias("leaf"), "key").join(leaves, "leaf", "left_semi").unionByName(leaves.select("leaf", _root().alias("key")))
    paths = stored(paths, "paths")
    under = paths.groupBy("key").agg(F.min("leaf").alias("leaf"), F.count("*").alias("n_leaves"))
    own = Window.partitionBy("leaf")
    below = F.sum("value").over(own.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
    valued = nodes.join(under, "key").withColumn("value", (F.col("n_convs") - 1) * F.col("n_chars"))
    valued = stored(valued.withColumns({"below": below, "whole": F.sum("value").over(own)}), "valued")
    whole = valued.groupBy("leaf").agg(F.first("whole").alias("sum"))
    summed = paths.join(whole, "leaf").groupBy("key").agg(F.sum("sum").alias("all_leaves"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = valued.join(children, "key", "left").join(summed, "key").join(parents, "parent", "left")
    zero = F.lit(0).cast("long")
    return out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("below") - F.col("whole") + F.col("all_leaves")).alias("saved_tokens")), lists
