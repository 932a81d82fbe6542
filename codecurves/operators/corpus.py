"""Corpus construction: census, duplicates, order, packing, tokens and positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graphs import components, salt_of, salted
from ..functions.parity import r6, total, words
from ..functions.storage import discard, new_path, stored


def corpus_census(files: DataFrame, base: str) -> DataFrame:
    """Files, bytes, characters, lines, tokens and median line bytes by codebase, language and overall; share of all bytes, and ratio to
    the base language's."""
    f = files.select("language", "codebase", "content", F.octet_length("content").alias("b"), F.length("content").alias("c"), F.size(words(F.col("content"))).alias("t"))
    lines = f.select("language", "codebase", "b", "c", "t", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    first = lambda c: total(F.when(F.col("k") == 0, F.col(c)))
    rolled = lines.rollup("language", "codebase").agg(
        F.grouping_id().cast("int").alias("level"), total(F.when(F.col("k") == 0, 1)).alias("n_files"), first("b").alias("n_bytes"), first("c").alias("n_chars"),
        F.count("*").alias("n_lines"), first("t").alias("n_tokens"), F.percentile(F.octet_length("line"), F.lit(0.5)).alias("median_line_bytes"),
    )
    all_bytes = files.agg(F.sum(F.octet_length("content")).alias("all_bytes"), F.sum(F.when(F.col("language") == base, F.octet_length("content"))).alias("base_bytes"))
    out = rolled.crossJoin(F.broadcast(all_bytes))  # one row
    return out.select(*rolled.columns, r6(F.col("n_bytes") / F.col("all_bytes")).alias("share"), r6(F.col("n_bytes") / F.col("base_bytes")).alias("ratio"))


def duplicate_census(files: DataFrame) -> DataFrame:
    """Exact duplicate files and repeated lines by language: all but one of each, and their bytes."""
    same = files.groupBy("language", F.md5(F.col("content").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.max(F.octet_length("content")).alias("b"))
    by_file = same.groupBy("language").agg(total("n").alias("n_files"), total(F.col("n") - 1).alias("n_dup_files"), total((F.col("n") - 1) * F.col("b")).alias("dup_file_bytes"), total(F.col("n") * F.col("b")).alias("n_bytes"))
    lines = files.select("language", F.explode(F.split("content", "\n")).alias("line")).groupBy("language", "line").agg(F.count("*").alias("n"))
    by_line = lines.groupBy("language").agg(total("n").alias("n_lines"), total(F.col("n") - 1).alias("n_dup_lines"), total((F.col("n") - 1) * F.octet_length("line")).alias("dup_line_bytes"))
    return by_file.join(by_line, "language").withColumn("dup_share", r6(F.col("dup_file_bytes") / F.col("n_bytes")))


def shingles(w: Column, k: int) -> Column:
    """Distinct k-word shingles of a column of words (a column, so that it isn't cut anew for every shingle)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, k))))


def _banded(files: DataFrame, k: int, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first file of each distinct text of a language (language, h, content, file_id), the shingles s of those with words, and their
    min-hash m in each band. Shingles are many times the text, so they are made and hashed inside a row and never
    leave it."""
    rep = files.groupBy("language", F.md5(F.col("content").cast("binary")).alias("h")).agg(F.min_by("content", "file_id").alias("content"), F.min("file_id").alias("file_id"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = stored(rep.repartition(tasks, "file_id"), "first-files")  # hashing is the work: not in the few tasks that texts of this size would get
    s = text.select("language", "file_id", words(F.col("content")).alias("w")).filter(F.size("w") > 0).select("language", "file_id", shingles(F.col("w"), k).alias("s"))
    least = lambda b: F.array_min(F.transform("s", lambda x: F.md5(F.concat(F.lit(f"{b}:"), x).cast("binary"))))
    mins = s.select("language", "file_id", F.posexplode(F.array(*[least(b) for b in range(bands)])).alias("band", "m"))
    return text, s, stored(mins, "min-hashes")


def near_duplicate_pairs(files: DataFrame, k: int = 5, bands: int = 8, threshold: float = 0.8) -> DataFrame:
    """Pairs of near copies inside a language: an equal md5 min-hash of word k-shingles in one of `bands`, then exact Jaccard.

    Pairs are between the first files of each distinct text (copies carry no further pair); a text without words has no shingle. A pair of
    similarity j is missed with a chance of (1 - j)^bands: 2.6e-6 at 0.8 with eight. n near copies of each other are n^2 / 2 pairs:
    `near_duplicate_groups` says the same in n rows."""
    text, _, keyed = _banded(files, k, bands)
    sets, keyed = _shared(text, keyed, k)
    sized = keyed.join(sets.select("file_id", F.size("s").alias("size")), "file_id")
    a, b = sized.alias("a"), sized.alias("b")
    same = (F.col("a.language") == F.col("b.language")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.file_id") < F.col("b.file_id"))
    like = F.least("a.size", "b.size") >= F.lit(threshold - 1e-6) * F.greatest("a.size", "b.size")  # no other sizes have that much in common
    cand = a.join(b, same & like).select(F.col("a.language").alias("language"), F.col("a.file_id").alias("hub"), F.col("b.file_id").alias("file_id")).distinct()
    got = _compared(stored(cand, "candidates"), sets, threshold)
    return got.select("language", F.col("hub").alias("file_a"), F.col("file_id").alias("file_b"), "jaccard")


def _shared(text: DataFrame, keyed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of the files that share a key with another, who meet nobody else: their shingles as 64-bit hashes (file_id, s), and the rows of keyed."""
    shared = keyed.groupBy("language", "band", "m").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = stored(keyed.join(shared, ["language", "band", "m"], "left_semi"), "shared-keys")
    met = text.join(keyed.select("file_id").distinct(), "file_id", "left_semi").select("file_id", words(F.col("content")).alias("w"))
    return stored(met.select("file_id", F.transform(shingles(F.col("w"), k), lambda x: F.xxhash64(x)).alias("s")), "hashed-shingles"), keyed


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float, hot: int = 256) -> DataFrame:
    """The pairs (file_id, hub and more) whose shingle sets (file_id, s) have a Jaccard similarity of `threshold` or more, with it. Many files may
    have one hub: its set goes out once for each `hot` of them."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("parts"))
    hub = sets.withColumnsRenamed({"file_id": "hub", "s": "hs"}).join(parts, "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("hub", "hs", "salt")
    dealt = pairs.join(parts, "hub").withColumn("salt", F.pmod(F.xxhash64("file_id"), "parts").cast("int")).drop("parts")
    got = dealt.join(sets.select("file_id", "s"), "file_id").join(hub, ["hub", "salt"])
    got = got.select(*pairs.columns, F.size("s").alias("a"), F.size("hs").alias("b"), F.size(F.array_intersect("s", "hs")).alias("both"))
    return got.select(*pairs.columns, r6(F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    return _compared(pairs, sets, threshold).select("file_id", "hub")


def near_duplicate_links(sets: DataFrame, keyed: DataFrame, threshold: float = 0.8, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(file_id, hub): links of the threshold between files that share a key, enough of them to join all that such links join; and
    (file_id, hub) of the pairs that were compared for them in the second pass. keyed: language, key, file_id; sets: file_id, s.

    The least file of a key is its hub, and every other member is compared with it: n near copies make n links for a key. Only members
    that no link puts in the component of their key's hub go on, and meet those members of the key that are in another component than
    theirs. A key's members are then dealt to blocks, each a task of its own. Files whose set sizes rule the threshold out aren't
    compared."""
    size = sets.select("file_id", F.size("s").alias("size"))
    keyed = keyed.join(size, "file_id")
    hubs = keyed.groupBy("language", "key").agg(F.min(F.struct("file_id", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("language", "key", "hub.*", "n").withColumnsRenamed({"file_id": "hub", "size": "hub_size"})
    members = stored(keyed.withColumn("salt", salt_of("file_id")).join(salted(hubs), ["language", "key", "salt"]).drop("salt"), "members")
    near = lambda a, b: F.least(a, b) >= F.lit(threshold - 1e-6) * F.greatest(a, b)
    first = members.filter("file_id <> hub").filter(near(F.col("size"), F.col("hub_size"))).select("file_id", "hub").distinct()
    direct = stored(_linked(first, sets, threshold), "hub-links")
    label = components(direct, "file_id", "hub")
    named = lambda d, node, name: d.join(label.select(F.col("node").alias(node), F.col("label").alias("__l")), node, "left").withColumn(name, F.coalesce("__l", node)).drop("__l")
    told = stored(named(named(members, "file_id", "own"), "hub", "core"), "told")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    left = told.filter("own <> core").select("language", "key", F.col("file_id").alias("u"), F.col("own").alias("u_own"), F.col("size").alias("u_size"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("at"))
    right = told.join(left.select("language", "key").distinct(), ["language", "key"], "left_semi").withColumn("at", F.pmod(F.xxhash64("file_id"), blocks).cast("int"))
    met = left.join(right, ["language", "key", "at"]).filter((F.col("u_own") != F.col("own")) & near(F.col("u_size"), F.col("size")))
    second = stored(met.select(F.greatest("u", "file_id").alias("file_id"), F.least("u", "file_id").alias("hub")).distinct().join(first, ["file_id", "hub"], "left_anti"), "second-pass")
    return direct.unionByName(_linked(second, sets, threshold)), second


def near_duplicate_groups(files: DataFrame, k: int = 5, bands: int = 8, threshold: float = 0.8) -> DataFrame:
    """language, file_id, group_id of every file: files are in one group if copies and pairs of `near_duplicate_pairs` join them, and the
    group is named by its least file. A text without words is in a group with its copies only; a null content is one with other nulls.

    Output and links grow with files, not with pairs. Shingles are compared as 64-bit hashes."""
    text, _, keyed = _banded(files, k, bands)
    rep = text.select("language", "h", "file_id")
    sets, keyed = _shared(text, keyed, k)
    links, _ = near_duplicate_links(sets, keyed.select("language", F.xxhash64("band", "m").alias("key"), "file_id"), threshold)
    label = components(links, "file_id", "hub").select(F.col("node").alias("rep"), F.col("label").alias("group_id"))
    of_text = stored(rep.select("language", "h", F.col("file_id").alias("rep")).join(label, "rep", "left").select("language", "h", F.coalesce("group_id", "rep").alias("group_id")), "of-text")
    own = files.select("language", "file_id", F.md5(F.col("content").cast("binary")).alias("h"), salt_of("file_id")).alias("f")
    to = salted(of_text).alias("t")
    on = F.col("f.language").eqNullSafe(F.col("t.language")) & F.col("f.h").eqNullSafe(F.col("t.h")) & (F.col("f.salt") == F.col("t.salt"))
    return own.join(to, on).select("f.language", "f.file_id", "t.group_id")


def order_shuffled(files: DataFrame, seed: str = "s0") -> DataFrame:
    """A reproducible shuffle of each codebase's files. Only names are sorted, never content."""
    w = Window.partitionBy("codebase").orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("file_id").cast("string")).cast("binary")), "file_id")
    return files.select("codebase", "file_id").withColumn("seq", F.row_number().over(w))


def definition_use_edges(files: DataFrame, min_chars: int = 20) -> DataFrame:
    """A symbol (a line of min_chars or more) is defined in the first file that holds it and used in later ones: edges src to dst."""
    held = files.select("codebase", "file_id", F.explode(F.array_distinct(F.split("content", "\n"))).alias("symbol")).filter(F.length("symbol") >= min_chars)
    defs = held.groupBy("codebase", "symbol").agg(F.min("file_id").alias("src"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return held.join(defs, ["codebase", "symbol"]).filter("file_id > src").select("codebase", "src", F.col("file_id").alias("dst"), F.md5(F.col("symbol").cast("binary")).alias("symbol"))


#: Per language: what defines a symbol and what uses one; each pattern's first group is the symbol.
RULES = {
    "python": (r"(?m)^\s*(?:def|class)\s+(\w+)", r"(?m)^\s*(?:from\s+\S+\s+)?import\s+(\w+)"),
    "javascript": (r"(?m)^\s*(?:export\s+)?(?:function|class|const)\s+(\w+)", r"(?m)import\s+\{?\s*(\w+)"),
    "coq": (r"(?m)^\s*(?:Theorem|Lemma|Definition)\s+(\w+)", r"(?m)(?:exact|apply|rewrite)\s+(\w+)"),
}


def code_edges(files: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Edges of source code: a file that uses a symbol depends on every other file of the codebase that defines it."""
    rules = rules or RULES
    pick = lambda i: F.coalesce(*[F.when(F.col("language") == k, F.regexp_extract_all("content", F.lit(v[i]), 1)) for k, v in rules.items()])
    defs = files.select("codebase", F.col("file_id").alias("src"), F.explode(F.array_distinct(pick(0))).alias("symbol"))
    uses = files.select("codebase", F.col("file_id").alias("dst"), F.explode(F.array_distinct(pick(1))).alias("symbol"))
    return defs.join(uses, ["codebase", "symbol"]).filter("src <> dst").select("codebase", "src", "dst", "symbol")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that are on a cycle or behind one."""
    told = longest_paths(edges)
    left = edges.join(told, edges["dst"] == told["node"], "left_anti")
    return left.join(told, left["src"] == told["node"], "left_anti")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def in_cycles(edges: DataFrame) -> DataFrame:
    """node of every file on a cycle of edges (src, dst). What hangs in front of or behind cycles is peeled away from both ends; of the
    rest, the greatest name that reaches a file colours it, and the files of a colour that reach the file of that name are on a cycle with
    it. They go, and the rest is done again."""
    found, e = None, edges
    while True:
        for _ in range(2):
            e = stored(_turned(_trimmed(e)), "core")
        if e.isEmpty():
            return found if found is not None else e.select(F.col("src").alias("node"))
        colour = stored(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().select("node", F.col("node").alias("c")), "colours")
        while True:
            new = e.join(colour, e["src"] == colour["node"]).select(F.col("dst").alias("node"), "c").unionByName(colour).groupBy("node").agg(F.max("c").alias("c"))
            old, colour = colour, stored(new, "colours")
            if old.exceptAll(colour).isEmpty():
                break
        own = stored(e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), "c"), "dst").filter("cs = c").select("src", "dst", "c"), "coloured")
        reached = stored(own.filter("dst = c").select(F.col("src").alias("node")).unionByName(own.filter("dst = c").select(F.col("dst").alias("node"))).distinct(), "reached")
        while True:
            more = own.join(reached, own["dst"] == reached["node"]).select(F.col("src").alias("node")).unionByName(reached).distinct()
            old, reached = reached, stored(more, "reached")
            if reached.count() == old.count():
                break
        found = reached if found is None else found.unionByName(reached)
        e = stored(e.join(reached, e["src"] == reached["node"], "left_anti").join(reached, e["dst"] == reached["node"], "left_anti"), "core")


def _jumped(p: DataFrame, rounds: int) -> DataFrame:
    """Rows (node, up, w): up is w levels above node. Each round goes from a node's up to that one's up, so the way of 2^rounds steps is
    done in `rounds`; it ends early where no up has an up. Stored; what is replaced is deleted."""
    p = stored(p, "ways")
    for _ in range(rounds):
        above = p.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"), F.lit(True).alias("moved"))
        far = p.filter("up is not null").join(above, "up", "left").select("node", F.when(F.col("moved"), F.col("next")).otherwise(F.col("up")).alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), "moved")
        new = stored(far.unionByName(p.filter("up is null").withColumn("moved", F.lit(None).cast("boolean"))), "ways")
        done = new.filter("moved").isEmpty()
        discard(p)
        p = new.drop("moved")
        if done:
            break
    return p


def longest_paths(edges: DataFrame) -> DataFrame:
    """(node, level) for the nodes of edges (src, dst): edges of the longest path that ends there. Nodes on a cycle, or behind one, are
    left out.

    Nodes that depend on one other node alone, directly or through each other, hang below it by a known number of levels. In each round all
    of them are found by doubling and go, their edges move up to where they hang, and of parallel edges the longest stays; nodes without
    dependencies count as one. So chains, trees and whatever is made of them in series or in parallel go in a few rounds of log(depth) steps
    each; a lattice that never narrows takes a round a level. The plan doesn't grow: rounds append to one table, and tables that a
    round replaced are deleted."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    path = new_path(spark, "levels")
    sources = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    sources = stored(sources.withColumn("top", F.lit(True)), "sources")
    nothing = F.lit(None).cast(kind)
    sources.select("node", nothing.alias("up"), F.lit(0).cast("long").alias("w")).write.parquet(path)
    e = edges.join(sources.withColumnRenamed("node", "src"), "src", "left").select(F.when(F.col("top").isNull(), F.col("src")).alias("src"), "dst")
    e = stored(e.distinct().withColumn("w", F.lit(1).cast("long")), "edges")
    while True:
        one = e.groupBy("dst").agg(F.count("*").alias("n"), F.max("src").alias("up"), F.max("w").alias("w")).filter("n = 1").select(F.col("dst").alias("node"), "up", "w")
        one = stored(one, "single")
        ways = _jumped(one, one.count().bit_length() + 1)
        # a cycle's own ways lead round and round
        hung = ways.join(one.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up", "w")
        hung = stored(hung.unionByName(ways.filter("up is null")).distinct(), "hung")
        discard(one, ways)
        if hung.isEmpty():
            break
        hung.write.mode("append").parquet(path)
        left = e.join(hung.select(F.col("node").alias("dst")), "dst", "left_anti")
        above = hung.select(F.col("node").alias("src"), F.col("up"), F.col("w").alias("more"))
        moved = left.filter("src is not null").join(above, "src", "left").select(F.when(F.col("more").isNotNull(), F.col("up")).otherwise(F.col("src")).alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        new = stored(moved.unionByName(left.filter("src is null").select("src", "dst", "w")).groupBy("src", "dst").agg(F.max("w").alias("w")), "edges")
        discard(e, hung)
        e = new
    discard(e, sources)
    every = spark.read.schema(f"node {kind.simpleString()}, up {kind.simpleString()}, w long").parquet(path)
    ways = _jumped(every, 64)
    discard(every)
    return ways.filter("up is null").select("node", F.col("w").cast("int").alias("level"))


def order_dependency(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files after what they use: codebase, file_id, seq, level, in_cycle. level is the longest path from a file that uses nothing.

    Files on a cycle have no such path: they follow all that has one, at the next level of their codebase, and what hangs behind them has
    its longest path from there. Edges to files that aren't there are ignored."""
    names = files.select("codebase", "file_id").distinct()
    node = lambda c: F.struct("codebase", F.col(c).alias("file_id"))
    e = stored(edges.filter("src <> dst").select(node("src").alias("src"), node("dst").alias("dst")).distinct(), "edges")
    level = longest_paths(e)
    told = level.select("node")
    stuck = stored(e.join(told, e["dst"] == told["node"], "left_anti").join(told, e["src"] == told["node"], "left_anti"), "stuck")
    if not stuck.isEmpty():
        cyclic = stored(in_cycles(stuck).distinct(), "cyclic")
        behind = stored(stuck.join(cyclic, stuck["dst"] == cyclic["node"], "left_anti"), "behind")  # edges into cycles no longer count
        more = cyclic.withColumn("level", F.lit(0)).unionByName(longest_paths(behind)).groupBy("node").agg(F.max("level").alias("above"))
        deep = names.join(level.select("node.*", "level"), ["codebase", "file_id"], "left").groupBy("codebase").agg(F.coalesce(F.max("level"), F.lit(0)).alias("deepest"))
        later = more.select("node.*", "above").join(deep, "codebase").select(F.struct("codebase", "file_id").alias("node"), (F.col("deepest") + F.col("above") + 1).alias("level"))
        level = level.unionByName(later)
        in_cycle = cyclic.select("node.*", F.lit(True).alias("in_cycle"))
    else:
        in_cycle = names.limit(0).withColumn("in_cycle", F.lit(True))
    out = names.join(level.select("node.*", "level"), ["codebase", "file_id"], "left").join(in_cycle, ["codebase", "file_id"], "left")
    out = out.select("codebase", "file_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    w = Window.partitionBy("codebase").orderBy("level", "file_id")
    return out.select("codebase", "file_id", F.row_number().over(w).alias("seq"), "level", "in_cycle")


def pack_corpus(files: DataFrame, order: DataFrame) -> DataFrame:
    """Header and body of each file with running byte offsets; rows, never one giant text. Offsets are summed over sizes alone."""
    header = F.format_string("=== %s %s %d\n", F.col("path"), F.col("language"), F.octet_length("content"))
    f = files.join(order, ["codebase", "file_id"]).select("language", "codebase", "file_id", "seq", header.alias("header"), F.concat("content", F.lit("\n")).alias("body"))
    size = F.octet_length("header") + F.octet_length("body")
    ends = f.select("codebase", "file_id", "seq", size.cast("long").alias("size")).withColumn("byte_end", F.sum("size").over(Window.partitionBy("codebase").orderBy("seq")))
    return f.join(ends.select("codebase", "file_id", (F.col("byte_end") - F.col("size")).alias("byte_start"), "byte_end"), ["codebase", "file_id"])


def _cut(tokenizer: str) -> Column:
    return {"word": words(F.col("content")), "char": F.filter(F.split("content", ""), lambda c: c != ""), "line": F.split("content", "\n")}[tokenizer]


def pack_tokens(files: DataFrame, tokenizer: str = "word", lines: bool = False) -> DataFrame:
    """Tokens of each file in one row: language, codebase, file_id, behind, n, text. Words and lines (behind: 1, the blank that counts as part
    of each) stand with a line end after each, characters (behind: 0, lossless) in a row. Stored, since cutting texts is much of the work.
    lines: also marks, the line of each word."""
    line_of = F.flatten(F.transform(F.split("content", "\n"), lambda x, k: F.array_repeat(k, F.size(words(x)))))
    t = files.select("language", "codebase", "file_id", _cut(tokenizer).alias("tokens"), *([line_of.alias("marks")] if lines else [])).filter(F.size("tokens") > 0)
    text = F.array_join("tokens", "") if tokenizer == "char" else F.concat(F.array_join("tokens", "\n"), F.lit("\n"))
    return stored(t.select("language", "codebase", "file_id", F.lit(0 if tokenizer == "char" else 1).alias("behind"), F.size("tokens").alias("n"), text.alias("text"), *(["marks"] if lines else [])), "packed")


def tokens_of(behind: Column, n: Column, text: Column) -> Column:
    """The tokens of a row of pack_tokens as an array."""
    return F.when(behind == 1, F.slice(F.split(text, "\n"), F.lit(1), n)).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))


def last_of(behind: Column, text: Column) -> Column:
    """The last token of a row of pack_tokens."""
    return F.when(behind == 1, F.substring_index(F.substring_index(text, "\n", -2), "\n", 1)).otherwise(F.right(text, F.lit(1)))


def unpack_tokens(packed: DataFrame) -> DataFrame:
    """One row a token, with its index in the file; with its position (pos) where `packed` has an offset."""
    at = [F.col("offset")] if "offset" in packed.columns else []
    t = packed.select("language", "codebase", "file_id", "behind", *at, F.posexplode(tokens_of(F.col("behind"), F.col("n"), F.col("text"))).alias("i", "token"))
    return t.select("language", "codebase", "file_id", "i", "token", *sizes_of(F.col("token"), F.col("behind")), *[(o + F.col("i") + 1).alias("pos") for o in at])


def sizes_of(token: Column, behind: Column) -> list[Column]:
    return [(f(token) + behind).cast("int").alias(n) for n, f in (("n_bytes", F.octet_length), ("n_chars", F.length))]


def tokenize(files: DataFrame, tokenizer: str = "word") -> DataFrame:
    """Word tokens (bytes and the blank behind), characters (lossless) or lines, with their index in the file."""
    t = files.select("language", "codebase", "file_id", F.posexplode(_cut(tokenizer)).alias("i", "token"))
    return t.select("*", *sizes_of(F.col("token"), F.lit(0 if tokenizer == "char" else 1)))


def _offsets(sizes: DataFrame, order: DataFrame) -> DataFrame:
    """codebase, file_id, offset: tokens of a codebase before each file. sizes: codebase, file_id, n."""
    w = Window.partitionBy("codebase").orderBy("seq")
    return sizes.join(order, ["codebase", "file_id"]).select("codebase", "file_id", (F.sum("n").over(w) - F.col("n")).alias("offset"))


def place_tokens(packed: DataFrame, order: DataFrame, bytes: bool = False) -> DataFrame:
    """pack_tokens with offset, the tokens of the codebase before the file; with bytes, also byte_offset, their bytes. Files are joined, never
    tokens."""
    own = ["codebase", "file_id"]
    size = packed.groupBy(*own).agg(F.sum("n").alias("n"), *([F.sum(F.octet_length("text")).alias("n_bytes")] if bytes else []))
    if not bytes:
        return packed.join(_offsets(size, order), own)
    upto = F.sum("n_bytes").over(Window.partitionBy("codebase").orderBy("seq"))
    before = size.join(order, own).select(*own, (upto - F.col("n_bytes")).alias("byte_offset"))
    return packed.join(_offsets(size, order).join(before, own), own)


def assign_positions(tokens: DataFrame, order: DataFrame) -> DataFrame:
    """1-based position in the codebase: tokens are counted by file, files summed up in order, and the offset joined back; no sort of
    tokens. Where tokens come from files, unpack_tokens(place_tokens(...)) gives the same and joins files in place of tokens."""
    n = tokens.groupBy("codebase", "file_id").agg(F.count("*").alias("n"))
    return tokens.join(_offsets(n, order), ["codebase", "file_id"]).withColumn("pos", F.col("offset") + F.col("i") + 1).drop("offset")


def packed_windows(placed: DataFrame, size: int) -> DataFrame:
    """language, codebase, window, tokens: `context_windows` without overlap, cut out of files (place_tokens). A window's part of a file goes out as
    one text, not as tokens."""
    cols = ["language", "codebase", "behind", "offset", "n", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            rows = []
            for language, codebase, behind, offset, n, text in zip(*(got[c].to_pylist() for c in cols), strict=True):
                t, part = (text.split("\n")[:n], "\n") if behind else (text, "")
                for w in range(offset // size, (offset + n - 1) // size + 1):
                    own = t[max(w * size - offset, 0) : (w + 1) * size - offset]
                    rows.append((language, codebase, w, offset + max(w * size - offset, 0), behind, len(own), part.join(own)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            made = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=["language", "codebase", "window", "first", "behind", "n", "text"])

    p = placed.select(*cols).mapInArrow(cut, "language string, codebase string, window long, first long, behind int, n int, text string")
    g = p.groupBy("language", "codebase", "window").agg(F.array_sort(F.collect_list(F.struct("first", "behind", "n", "text"))).alias("p"))
    return g.select("language", "codebase", "window", F.flatten(F.transform("p", lambda x: tokens_of(x["behind"], x["n"], x["text"]))).alias("tokens"))


def context_windows(tokens: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows of `size` positions every `stride`; a token is in each window over it, with its place in the window."""
    p = F.col("pos") - 1
    first = F.greatest(F.floor((p - size) / stride) + 1, F.lit(0)).cast("long")
    w = tokens.withColumn("window", F.explode(F.sequence(first, F.floor(p / stride).cast("long"))))
    return w.withColumn("pos_in_window", F.col("pos") - F.col("window") * stride)
