"""Sharding by a permutation-filled lookup table: each shard has an order of preference over the slots of a prime-sized table, and the
shards take turns at claiming their next free slot. Losing a shard moves little but its own keys."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS

SLOTS, SHARDS = 65_537, 64


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in `shards`) that owns each slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + skip[k]) % slots
            owner[slot], at[k] = k, (slot + skip[k]) % slots
            left -= 1
            if not left:
                break
    return np.array(owner)


def _names(shards: list[str] | None) -> list[str]:
    return shards or [f"shard-{k:03d}" for k in range(SHARDS)]


def _slot(docs: DataFrame, slots: int, key: str, spread: str | None) -> Column:
    """A row's slot: by its key, or by the column `spread` where the key is null."""
    own = F.xxhash64(F.col(key))
    if spread and spread in docs.columns:
        own = F.when(F.col(key).isNull(), F.xxhash64(F.col(spread))).otherwise(own)
    return F.pmod(own, F.lit(slots)).cast("int")


def _owners(docs: DataFrame, names: list[str], slots: int, slot: str, shard: str) -> DataFrame:
    """(slot, shard), as large as `slots` says (checked)."""
    if slots > MAX_BROADCAST_ROWS:
        raise ValueError(f"a lookup table may have {MAX_BROADCAST_ROWS} slots at most")
    owner = lookup_table(names, slots)
    return docs.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(owner.tolist())], f"`{slot}` int, `{shard}` string")


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id", spread: str | None = "text") -> DataFrame:
    """Key, slot and shard of every row.

    The table is as large as `slots` says (checked) and is broadcast, so a row is placed by one lookup and none is shuffled. A null key
    is placed by the column `spread`, so that rows without a key don't all meet in one shard (null there too: one slot). Repeated rows
    go to the same shard. An empty table gives no rows; other columns are ignored."""
    table = _owners(docs, _names(shards), slots, "slot", "shard")
    placed = docs.select(F.col(key), _slot(docs, slots, key, spread).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id", spread: str | None = "text", folder: str = "shard") -> None:
    """Write docs as one folder of Parquet files for each shard, `folder`=name, with the shards that `place` gives.

    Rows are dealt by shard and a hash of key and `spread`, so that a large shard is several tasks' work. Nulls and repeated rows are
    placed as in `place`. Folders need a column name of their own: where docs has a column `folder` already, the folder's name takes
    underscores until it is new, and the column stays in the files. An empty table writes no folder."""
    while folder in docs.columns:
        folder += "_"
    slot = folder + "_slot"
    table = _owners(docs, _names(shards), slots, slot, folder)
    placed = docs.withColumn(slot, _slot(docs, slots, key, spread)).join(F.broadcast(table), slot).drop(slot)
    more = [F.col(c) for c in (key, spread) if c and c in docs.columns]
    placed.repartition(folder, F.pmod(F.hash(*more), F.lit(8))).write.partitionBy(folder).parquet(path)
