"""Near copies of whole texts: SimHash near-dedup with links of a five-word Jaccard of at least 0.8, verified on the sets themselves.

Fingerprints of five-word sets link within four bits by deletion variants (simhash.links). At 0.8 they differ in about ten of 64 bits, too
many for segments with one bit wiped out, so texts meet under 16 of their 64 min-hashes as well: under an equal one, texts whose 64
min-hashes agree loosely are joined. A pair of 0.8 shares no key with a chance of 0.2^16 and agrees too rarely with one below 1e-7. Both
kinds of candidates make loose groups; inside a loose group, the sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_least, salt_of, salted, stored
from .simhash import links as fingerprint_links
from .simhash import majority

SHINGLE, LEAST = 5, (4, 5)
#: Min-hashes of a text, those of them that are keys, and how many must agree loosely.
HASHES, KEYS, LOOSE = 64, 16, 29
SEED = 42
#: Members of a key above which it is dealt anew by pairs of min-hashes; members and shingles of a block that one task verifies.
HOT, BLOCK, BLOCK_SHINGLES = 20_000, 256, 1 << 21
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**64, (HASHES, 1), np.uint64)
_TIMES = _rng.integers(0, 2**64, (HASHES, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five words in a row (all the words where they are fewer); words as in simhash.fingerprint."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def min_hashes(own: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(own), 4096):
        h = (own[None, k : k + 4096] ^ _XOR) * _TIMES
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(1))
    return least


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text: with doc_id, it names a row), node (of the set: equal sets are one node), fp (the set's SimHash), mins and
    sketch (empty for texts without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, mins, sketch = [], [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py())
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fp.append(majority(own))
                h = min_hashes(own) if len(own) else own
                mins.append(h[:KEYS].view(np.int64))
                sketch.append((h & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            made += [pa.array(mins, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "hash", "node", "fp", "mins", "sketch"])

    return docs.select("doc_id", _hash(), "text").mapInArrow(run, f"doc_id {kind}, hash long, node long, fp long, mins array<long>, sketch binary")


def _hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")


def _loose_links(nodes: DataFrame, hot: int) -> DataFrame:
    """(a, b): links that join all nodes of a key whose sketches agree loosely, as a forest, so that a dense group makes few. Keys come in
    order; members of a key of more than `hot` are passed on unread and meet again under pairs of min-hashes."""

    def run(limit: int | None):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(a, b, passed_on):
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), passed_on))], names=["a", "b", "hot"])

            old_k, old_n, old_s, passed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint16), None
            for batch in _with_end(batches):
                key, node, sketch = old_k, old_n, old_s
                if batch is not None:
                    own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, HASHES)
                    key, node, sketch = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()]), np.concatenate([sketch, own])
                if not len(key):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(begin, len(key)))
                open_ = batch is not None  # the last key may go on
                edges = []
                for at, n in zip(begin.tolist(), size.tolist(), strict=True):
                    last = at + n == len(key)
                    if limit and (n > limit or key[at] == passed):
                        passed = key[at]
                        yield out(key[at : at + n], node[at : at + n], True)
                    elif last and open_:
                        continue
                    elif n > 1:
                        edges += [(node[at + i], node[at + j]) for i, j in _forest(sketch[at : at + n])]
                if edges:
                    e = np.array(edges, np.int64)
                    yield out(e[:, 0], e[:, 1], False)
                keep = begin[-1] if open_ and not (limit and key[-1] == passed) else len(key)
                old_k, old_n, old_s = key[keep:], node[keep:], sketch[keep:]

        return read

    schema = "a long, b long, hot boolean"
    keyed = nodes.select(F.posexplode("mins").alias("i", "m"), "node", "sketch").select(F.xxhash64("i", "m").alias("key"), "node", "sketch")
    first = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run(hot), schema), "loose")
    again = first.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("node")).join(nodes, "node")
    again = again.select("key", F.posexplode("mins").alias("i", "m"), "node", "sketch").filter(F.xxhash64("i", "m") != F.col("key")).select(F.xxhash64("key", "i", "m").alias("key"), "node", "sketch")
    second = again.repartition("key").sortWithinPartitions("key").mapInArrow(run(None), schema)
    return first.filter("not hot").unionByName(second).select("a", "b").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _reach(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what links join: each reached member is compared with those not reached yet only. near(at, left): which of
    `left` link to `at`."""
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = near(at, left)
            out += [(at, int(x)) for x in left[close]]
            queue += left[close].tolist()
            left = left[~close]
    return out


def _forest(sketch: np.ndarray) -> list[tuple[int, int]]:
    return _reach(len(sketch), lambda at, left: (sketch[left] == sketch[at]).sum(1) >= LOOSE)


def verified(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect all sets which links of Jaccard >= 4/5 join."""
    size = np.array([len(s) for s in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(values) + 1, np.int64)

    def near(at: int, left: np.ndarray) -> np.ndarray:
        own = code[begin[at] : begin[at + 1]]
        held[own] = 1
        both = np.add.reduceat(held[code], begin[:-1])[left]
        held[own] = 0
        return LEAST[1] * both >= LEAST[0] * (size[at] + size[left] - both)

    return _reach(len(sets), near)


def _candidates(nodes: DataFrame, hot: int) -> DataFrame:
    """(a, b): links between nodes whose fingerprints or min-hashes are near."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "by-print")
    same = nodes.select("node", "fp").join(first, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = fingerprint_links(first.select("fp"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    return _loose_links(nodes, hot).unionByName(same).unionByName(near.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def _sets(docs: DataFrame, prints: DataFrame, label: DataFrame) -> DataFrame:
    """node, label, n and own (the set's hashes) of every node in a loose group, from one of its rows."""
    row = F.min(F.struct("doc_id", "hash"))
    firsts = prints.groupBy("node").agg(row.alias("r"))  # partly before the shuffle: many copies of one text are one row a task
    chosen = firsts.join(label, "node").select("node", "label", F.col("r.doc_id").alias("__id"), F.col("r.hash").alias("__hash"))
    texts = docs.select("doc_id", _hash(), "text")
    found = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).select("node", "label", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py()) for t in batch.column(2)]
            made = [pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["node", "label", "n", "own"])

    return found.mapInArrow(sets, "node long, label long, n long, own binary").dropDuplicates(["node"])


def _near_hub(own: DataFrame, large: DataFrame) -> DataFrame:
    """node, label, n, own, hub, linked: the members of large groups, and whether each links to its group's hub (the member of most
    words). A group of near copies is so done in one pass over it; the hub goes to its members once for each salt."""
    hub = own.join(large.select("label"), "label").groupBy("label").agg(F.max_by(F.struct("node", "own"), F.struct("n", "node")).alias("h"))
    hub = salted(hub.select("label", F.col("h.node").alias("hub"), F.col("h.own").alias("set")))
    both = own.withColumn("salt", salt_of("node")).join(hub, ["label", "salt"]).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(3), batch.column(5), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(linked, pa.bool_())], names=["label", "node", "n", "own", "hub", "linked"])

    return both.select("label", "node", "n", "own", "hub", "set").mapInArrow(run, "label long, node long, n long, own binary, hub long, linked boolean")


def links(docs: DataFrame, prints: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between nodes.

    A loose group that fits a block is one task's. Of a larger one, the members that link to its hub are told in a pass; the others, in
    blocks, meet each other and those members, each two blocks in one task, so that no link between different components is lost."""
    nodes = stored(prints.filter(F.size("mins") > 0).groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "mins", "sketch"))), "nodes")
    label = components(_candidates(nodes, hot))
    own = stored(_sets(docs, prints, label), "shingles")
    blocks = lambda count, size: F.greatest(F.ceil(count / F.lit(block)), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")

    def decide(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        e = np.array(verified([np.frombuffer(b, np.uint64) for b in t["own"].to_pylist()]), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[e[:, 0]], pa.int64()), "b": pa.array(node[e[:, 1]], pa.int64())})

    sizes = stored(own.groupBy("label").agg(blocks(F.count("*"), F.sum("n")).alias("blocks")), "groups")
    large = sizes.filter("blocks > 1")
    small = own.join(large, "label", "left_anti").groupBy("label").applyInArrow(decide, "a long, b long")
    if large.isEmpty():
        return small
    told = stored(_near_hub(own, large), "hubs")
    count = told.groupBy("label").agg(*(blocks(F.count_if(c), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))).alias(k) for k, c in (("out", ~F.col("linked")), ("in", F.col("linked")))))
    cut = told.withColumn("salt", salt_of("node")).join(salted(count.filter("out > 0")), ["label", "salt"])
    at = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("in")).otherwise(F.col("out"))).cast("int")
    cut = cut.withColumn("at", at)
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("out") - 1), lambda k: k != F.col("at")), lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j")))
    inner = F.transform(F.sequence(F.lit(0), F.col("in") - 1), lambda k: F.struct(F.col("at").alias("i"), (F.col("out") + k).alias("j")))
    outer = F.transform(F.sequence(F.lit(0), F.col("out") - 1), lambda k: F.struct(k.alias("i"), (F.col("out") + F.col("at")).alias("j")))
    cut = cut.withColumn("task", F.explode(F.when(F.col("linked"), outer).otherwise(F.concat(others, inner))))
    rest = cut.select("label", "task.i", "task.j", "node", "own").groupBy("label", "i", "j").applyInArrow(decide, "a long, b long")
    direct = told.filter("linked and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return small.unionByName(direct).unionByName(rest)


def drop_near_copies(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, less those whose text links, over links of five-word Jaccard >= 0.8, to one of a smaller
    doc_id. Texts without words (null among them) are copies of each other. Rows with a null doc_id stay. Rows are told by doc_id and
    text, so another text under a repeated id stays or goes by itself. An empty table gives no rows."""
    prints = stored(_prints(docs), "prints")
    least = group_least(prints, "node", "doc_id", components(links(docs, prints, hot, block)))
    gone = prints.select("doc_id", "hash", "node", salt_of("doc_id")).join(least, ["node", "salt"]).filter("doc_id <> least")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__hash"]), "left_anti")
