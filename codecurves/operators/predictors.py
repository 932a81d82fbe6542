"""Losses: count-based stand-ins for a language model, an interface for real ones, and a compressor."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parity import bucket, r6, total, ubits
from ..functions.storage import stored
from .corpus import last_of, sizes_of, tokens_of, unpack_tokens

KEYS = ["language", "codebase", "file_id", "i", "pos", "token", "n_bytes", "n_chars"]


def code_length(n: Column, cw: Column, cc: Column, ccw: Column, n_bytes: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Bits of a token under smoothed bigram counts that back off to unigrams and then to its bytes, in log space."""
    u = F.when(cw == 0, 9 * n_bytes + F.log2(n + F.lit(beta)) - F.log2(F.lit(beta))).otherwise(F.log2(n + F.lit(beta)) - F.log2(cw + F.lit(beta) * F.pow(F.lit(2.0), -9.0 * n_bytes)))
    return F.when(ccw == 0, u + F.log2(cc + F.lit(alpha)) - F.log2(F.lit(alpha))).otherwise(F.log2(cc + F.lit(alpha)) - F.log2(ccw + F.lit(alpha) * F.pow(F.lit(2.0), -u)))


def _with_context(tokens: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ctx, the token before in the codebase ('' at its start). Inside a file that is the token before; a file's first token follows
    the last of the file before, found among files. So tokens are dealt by file, and a codebase of any size spreads over tasks."""
    own = [*scope, "file_id"]
    placed = "offset" in tokens.columns  # corpus.place_tokens: files are joined and cut after that, so no token is dealt
    place, last = ("offset", last_of(F.col("behind"), F.col("text"))) if placed else ("pos", F.col("token"))
    ends = tokens.groupBy(*own).agg(F.min(place).alias("first"), F.max_by(last, place).alias("last"))
    before = ends.select(*own, F.coalesce(F.lag("last").over(Window.partitionBy(*scope).orderBy("first")), F.lit("")).alias("before"))
    if not placed:
        within = F.lag("token").over(Window.partitionBy(*own).orderBy("pos"))
        return tokens.join(before, own).withColumn("ctx", F.coalesce(within, "before")).drop("before")
    kept = [c for c in tokens.columns if c not in ("n", "text", "offset", "behind")]
    t = tokens.join(before, own).withColumn("t", tokens_of(F.col("behind"), F.col("n"), F.col("text")))
    ctx = F.concat(F.array("before"), F.slice("t", F.lit(1), F.col("n") - 1))
    t = t.select(*kept, "offset", "behind", F.posexplode(F.arrays_zip(ctx.alias("ctx"), F.col("t").alias("token"))).alias("i", "x"))
    return t.select(*kept, "i", (F.col("offset") + F.col("i") + 1).alias("pos"), "x.token", *sizes_of(F.col("x.token"), F.col("behind")), "x.ctx")


#: Positions of a codebase that one task ranks at a time.
BLOCK = 1 << 18


def _ranks(code: np.ndarray) -> np.ndarray:
    """How many equal numbers stand before each."""
    order = np.argsort(code, kind="stable")
    new = np.append(True, code[order][1:] != code[order][:-1])[: len(code)]
    out = np.empty(len(code), np.int64)
    out[order] = np.arange(len(code)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def _spread(pieces: pa.Table, keep: list[str]) -> pa.Table:
    """One row a token of pieces of files, in order of position: token, and what keep names of the rest (byte_pos and mark among it, where
    pieces have byte_first and marks)."""
    pieces = pieces.sort_by("first").combine_chunks()
    n, behind = pieces["n"].to_numpy().astype(np.int64), pieces["behind"][0].as_py()
    text = np.frombuffer(b"".join(t.as_buffer() for t in pieces["text"].combine_chunks().cast(pa.binary())), np.uint8)
    if behind:
        ends = np.flatnonzero(text == 10)
        length, text = np.diff(ends, prepend=-1) - 1, text[text != 10]
    else:
        length = np.diff(np.flatnonzero((text & 0xC0) != 0x80), append=len(text))
    if len(length) != n.sum():
        raise ValueError("a token holds what parts tokens")
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    token = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(text)).cast(pa.string())
    made = {
        "i": pa.array((pieces["i"].to_numpy()[row] + k).astype(np.int32)), "pos": pa.array(pieces["first"].to_numpy()[row] + k), "token": token,
        "n_bytes": pa.array((length + behind).astype(np.int32)),
    }
    if "n_chars" in keep:
        made["n_chars"] = pa.array((pc.utf8_length(token).to_numpy() + behind).astype(np.int32))
    if "byte_pos" in keep:
        size = length + behind
        upto, first = np.cumsum(size) - size, np.cumsum(n) - n
        made["byte_pos"] = pa.array((pieces["byte_first"].to_numpy() - upto[first])[row] + upto)
    if "mark" in keep:
        mark = pieces["marks"].combine_chunks().flatten().to_numpy().astype(np.int64)
        if "mark_offset" in pieces.column_names:
            mark = np.where(mark < 0, mark, mark + pieces["mark_offset"].to_numpy()[row])
        made["mark"] = pa.array(mark)
    made, at = {**made, "scope_pos": made["pos"]}, pa.array(row)
    kept = {c: pieces[c].combine_chunks().take(at) for c in keep if c not in made and c in pieces.column_names}
    return pa.table({**kept, **made})


def _coded(tokens: pa.Table, before: str) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the token before the block and of the block's tokens, and the words they stand for."""
    words = pa.chunked_array([pa.array([before], pa.string()), *tokens["token"].chunks]).combine_chunks().dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def _names(code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of _coded and of the pairs of neighbours."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[code]
    return h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)


def _count_block(tokens: pa.Table, ends: pa.Table, key: list[str]) -> pa.Table:
    """How often each word and pair comes in a block, by parts of their names: key, part, before, name, n. The token before the block is
    named too. Nothing where a codebase has one block."""
    made = pa.schema([*(ends.schema.field(c) for c in key), ("part", pa.int32()), ("before", pa.string()), ("name", pa.binary()), ("n", pa.binary())])
    if not len(ends):
        return made.empty_table()
    before, parts = ends["before"][0].as_py(), np.uint64(ends["parts"][0].as_py())
    code, words = _coded(tokens, before)
    word, pair = _names(code, words)
    name, at = np.unique(np.append(word, pair), return_inverse=True)
    n = np.bincount(at, minlength=len(name))
    n[at[0]] -= 1
    part = name % parts
    own = {c: ends[c][0].as_py() for c in key}
    rows = [{**own, "part": int(p), "before": before, "name": name[part == p].tobytes(), "n": n[part == p].astype(np.int32).tobytes()} for p in range(int(parts))]
    return pa.Table.from_pylist(rows, made)


def _sum_blocks(counted: pa.Table, key: list[str]) -> pa.Table:
    """_count_block's rows of one part with off, how often each name came in earlier blocks, in place of name and n."""
    counted = counted.sort_by("block")
    held = [np.frombuffer(b.as_py(), np.uint64) for b in counted["name"]]
    name, n = np.concatenate(held), np.concatenate([np.frombuffer(b.as_py(), np.int32) for b in counted["n"]]).astype(np.int64)
    order = np.argsort(name, kind="stable")
    upto = np.cumsum(n[order]) - n[order]
    new = np.append(True, name[order][1:] != name[order][:-1])[: len(name)]
    off = np.empty(len(name), np.int64)
    off[order] = upto - upto[np.flatnonzero(new)[np.cumsum(new) - 1]]
    cut = np.split(off, np.cumsum([len(h) for h in held])[:-1])
    return counted.select([*key, "part", "before"]).append_column("off", pa.array([c.tobytes() for c in cut], pa.binary()))


def _rank_block(tokens: pa.Table, told: pa.Table | None, keep: list[str]) -> pa.Table:
    """keep, ctx, and the counts cw, cc and ccw before each token of a block. told: _sum_blocks' rows of the block, none where a codebase has
    one block."""
    many = told is not None and len(told) > 0
    code, words = _coded(tokens, told["before"][0].as_py() if many else "")
    token, ctx, n, seen = code[1:], code[:-1], len(words), 0
    cw, ccw = _ranks(token), _ranks(ctx * n + token)
    if many:
        told = told.sort_by("part")
        word, pair = _names(code, words)
        name, at = np.unique(np.append(word, pair), return_inverse=True)
        part, off = name % np.uint64(len(told)), np.empty(len(name), np.int64)
        for p, b in enumerate(told["off"]):
            off[part == p] = np.frombuffer(b.as_py(), np.int64)
        off = off[at]
        cw, ccw, seen = cw + off[1 : len(word)], ccw + off[len(word) :], max(off[0] - 1, 0)
    cc = np.append(seen, cw[:-1])
    # an empty context also stands at the codebase's start, where no empty token came before
    at_start = tokens["scope_pos"].to_numpy() == 1
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)[ctx]
    cc = np.where(at_start, 0, cc + (empty & ~at_start))
    made = {"cw": pa.array(cw), "cc": pa.array(cc), "ccw": pa.array(ccw)}
    if "ctx" in keep:
        made["ctx"] = words.take(pa.array(ctx))
    return pa.table({**{c: tokens[c] for c in keep if c not in made}, **made}).select([*keep, "cw", "cc", "ccw"])


def _pieces(placed: DataFrame, by: list[str], block: int) -> DataFrame:
    """Files of corpus.place_tokens cut at the ends of blocks: block, i and first (index in the file and position of the piece's first token),
    n and text; byte_first (its first token's byte of the codebase, from 1 on) and marks where files have byte_offset and marks."""
    n, offset, first = F.col("n"), F.col("offset"), F.col("i")
    p = placed.withColumn("block", F.explode(F.sequence(F.floor(offset / block).cast("long"), F.floor((offset + n - 1) / block).cast("long"))))
    p = p.withColumn("i", F.greatest(F.col("block") * block - offset, F.lit(0)).cast("int")).withColumn("upto", F.least((F.col("block") + 1) * block - offset, n).cast("int"))
    part = F.slice(tokens_of(F.col("behind"), n, F.col("text")), first + 1, F.col("upto") - first)
    cut = F.when(F.col("behind") == 1, F.concat(F.array_join(part, "\n"), F.lit("\n"))).otherwise(F.array_join(part, ""))
    more = []
    if "byte_offset" in placed.columns:
        head = F.octet_length(F.array_join(F.slice(tokens_of(F.col("behind"), n, F.col("text")), F.lit(1), first), "")) + F.col("behind") * first
        more.append((F.col("byte_offset") + F.when(first == 0, 0).otherwise(head) + 1).alias("byte_first"))
    if "marks" in placed.columns:
        more += [F.slice("marks", first + 1, F.col("upto") - first).alias("marks"), *(c for c in placed.columns if c == "mark_offset")]
    text = F.when(F.col("upto") - first == n, F.col("text")).otherwise(cut)
    return p.select(*dict.fromkeys([*by, "language", "codebase", "file_id"]), "behind", "block", "i", (F.col("upto") - first).alias("n"), (offset + first + 1).alias("first"), text.alias("text"), *more)


def score_adaptive(tokens: DataFrame, alpha: float = 1.0, beta: float = 1.0, by: list[str] | None = None, window: int | None = None, block: int = BLOCK, words: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Online order-1 predictor: each token is predicted from what came before it in its codebase, then learnt. tokens: a row a token, or
    `corpus.place_tokens`, a row a file, which costs far less to deal. by: more columns that part codebases (variants, revisions). window:
    forget everything every so many positions. words: give the columns token and ctx too. columns: give only
    these of KEYS, and ubits, so that less leaves a task's Python for each token; of files also byte_pos (`corpus.place_tokens` with bytes) and
    mark, a number of each token that files bring in an array `marks` (those from 0 on are raised by mark_offset, if files have it). What is told by them is summed without a join of tokens.

    Counts before a token have two levels: those of earlier blocks of positions, summed over blocks, and ranks inside the block. So tokens are
    dealt by block, and neither a large codebase, a large file nor a word that is a third of it is one task's work. Words and pairs of a block
    go to the sums as 64-bit names, one row a block and part of the names. How often a context came before is how often its token had
    come before itself, one place up."""
    by, scope = by or [], [*(by or []), "codebase"]
    placed = "offset" in tokens.columns
    if placed and not window:
        key = [*scope, "block"]
        t = stored(_pieces(tokens, by, block), "blocks")
        last = F.max_by(last_of(F.col("behind"), F.col("text")), "first")
        types = {**{c: t.schema[c].dataType.simpleString() for c in t.columns}, "i": "int", "pos": "long", "scope_pos": "long", "token": "string", "n_bytes": "int", "n_chars": "int", "byte_pos": "long", "mark": "long"}
        each = _spread
    else:
        pos = F.col("pos")
        tokens = unpack_tokens(tokens) if placed else tokens
        if window:
            tokens = tokens.withColumn("window", F.floor((pos - 1) / window).cast("long"))
            scope, pos = [*scope, "window"], (pos - 1) % window + 1
        key = [*scope, "block"]
        cols = list(dict.fromkeys([*by, *KEYS, *scope]))
        t = stored(tokens.select(*cols, F.floor((F.col("pos") - 1) / block).cast("long").alias("block"), pos.cast("long").alias("scope_pos")), "blocks")
        last = F.max_by("token", "pos")
        types = {f.name: f.dataType.simpleString() for f in t.schema}
        each = lambda a, _: a.sort_by("pos")
    out = [*by, *(columns if columns is not None else [*(c for c in KEYS if words or c != "token"), *(["ctx"] if words else [])])]
    keep = [*dict.fromkeys([*out, "n_bytes"]), "scope_pos"]
    schema = ", ".join([f"`{c}` {types.get(c, 'string')}" for c in keep] + ["cw long, cc long, ccw long"])
    over = Window.partitionBy(*scope)
    ends = t.groupBy(*key).agg(last.alias("last"))
    ends = ends.select(*key, F.coalesce(F.lag("last").over(over.orderBy("block")), F.lit("")).alias("before"), F.count("*").over(over).alias("blocks"))
    ends = stored(ends.withColumn("parts", F.ceil(F.col("blocks") / 4).cast("int")).filter("blocks > 1"), "ends")
    if ends.isEmpty():
        ranked = t.groupBy(*key).applyInArrow(lambda a: _rank_block(each(a, keep), None, keep), schema)
    else:
        named = ", ".join(f"`{c}` {ends.schema[c].dataType.simpleString()}" for c in key) + ", part int, before string"
        count = lambda a, b: _count_block(each(a, []) if len(b) else a, b, key)
        counted = t.groupBy(*key).cogroup(ends.groupBy(*key)).applyInArrow(count, f"{named}, name binary, n binary")  # shuffled as below, once
        told = counted.groupBy(*scope, "part").applyInArrow(lambda a: _sum_blocks(a, key), f"{named}, off binary")
        ranked = t.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(lambda a, b: _rank_block(each(a, keep), b, keep), schema)
    count = lambda c: F.col(c).cast("double")
    bits = code_length((F.col("scope_pos") - 1).cast("double"), count("cw"), count("cc"), count("ccw"), F.col("n_bytes"), alpha, beta)
    return ranked.select(*out, ubits(bits).alias("ubits"))


def score_limited_context(tokens: DataFrame, rungs: list[int], block: int = BLOCK) -> DataFrame:
    """Losses of the same tokens when only the last W positions are visible, for each W of rungs (columns KEYS, rung, ubits).

    What a token may see lies in its own block of positions and the last max(W) of the block before. So tokens are dealt once, by block,
    with that margin, and a task counts words, contexts and pairs for all windows by searches in sorted places. A group holds a block
    and its margin at most, whatever its words."""
    wide = max(rungs)
    block = max(block, wide)
    t = _with_context(tokens, ["codebase"]).select(*KEYS, "ctx").withColumn("own", F.floor((F.col("pos") - 1) / block).cast("long"))
    near = (F.col("pos") - 1) % block >= block - wide
    t = t.withColumn("part", F.explode(F.when(near, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    cols = [f"{n}_{r}" for n in ("cw", "cc", "ccw") for r in rungs]

    def run(got: pa.Table) -> pa.Table:
        pos = got["pos"].to_numpy()
        code = lambda c: got[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        word, ctx = code("token"), code("ctx")
        pair = np.unique(word * (len(pos) + 1) + ctx, return_inverse=True)[1]
        mine = got["own"].to_numpy() == got["part"].to_numpy()
        low, made = pos.min() - wide, []
        for own in (word, ctx, pair):
            place = own * (pos.max() - low + 1) + (pos - low)  # windows of one never reach into the places of another
            every = np.sort(place)
            at = np.searchsorted(every, place[mine])
            made += [at - np.searchsorted(every, place[mine] - r) for r in rungs]
        kept = got.select(KEYS).filter(pa.array(mine))
        return pa.table([*kept.columns, *(pa.array(m.astype(np.int64)) for m in made)], names=[*KEYS, *cols])

    types = {f.name: f.dataType.simpleString() for f in t.schema}
    schema = ", ".join([f"{k} {types[k]}" for k in KEYS] + [f"{c} long" for c in cols])
    t = t.groupBy("codebase", "part").applyInArrow(run, schema)
    seen = F.array(*[F.struct(F.lit(r).alias("rung"), *[F.col(f"{n}_{r}").cast("double").alias(n) for n in ("cw", "cc", "ccw")]) for r in rungs])
    own = t.select(*KEYS, F.explode(seen).alias("w")).select(*KEYS, "w.*")
    bits = code_length(F.least(F.col("pos") - 1, F.col("rung")).cast("double"), F.col("cw"), F.col("cc"), F.col("ccw"), F.col("n_bytes"))
    return own.select("rung", *KEYS, ubits(bits).alias("ubits"))


def train_ngram(tokens: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frozen counts by language: (ctx, token, ccw), (token, cw), (n). Tokens need pos. Pairs are counted once and stored, since all else is
    summed from them."""
    by = by or ["language"]
    t = _with_context(tokens, ["codebase", *[c for c in by if c != "language"]])
    two = stored(t.groupBy(*by, "ctx", "token").agg(F.count("*").alias("ccw")), "pairs")
    one = two.groupBy(*by, "token").agg(total("ccw").alias("cw"))
    return two, one, one.groupBy(*by).agg(total("cw").alias("n_train"))


def frozen_pairs(tokens: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame], by: list[str] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Losses under frozen counts of each distinct (language, ctx, token): the model's columns of by, language, keep, ctx, token, n_bytes,
    n (how often it occurs) and ubits. keep: more columns to tell occurrences by.

    A loss depends on nothing but the pair, so tokens are first counted (partly before the shuffle) and only distinct pairs meet the
    models: a common word costs as many rows as it has contexts, not as it has occurrences."""
    two, one, all_ = counts
    by = by or ["language"]
    pair, keep = ["language", "ctx", "token"], keep or {}
    t = _with_context(tokens, ["codebase"]).withColumns(keep).groupBy(*pair, *keep, "n_bytes").agg(F.count("*").alias("n"))
    on = [c for c in by if c == "language"]
    extra = [c for c in by if c not in on]
    ctx = two.groupBy(*by, "ctx").agg(total("ccw").alias("cc"))
    num = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    if not extra:
        t = t.join(F.broadcast(all_), on) if on else t.crossJoin(F.broadcast(all_))  # one row a language
        t = t.join(one, [*by, "token"], "left").join(ctx, [*by, "ctx"], "left").join(two, [*by, "ctx", "token"], "left")
        bits = code_length(F.col("n_train").cast("double"), num(F.col("cw")), num(F.col("cc")), num(F.col("ccw")), F.col("n_bytes"))
        return t.select(*pair, *keep, "n_bytes", "n", ubits(bits).alias("ubits"))
    # several models: a pair's row is dealt once for all of them, with the counts of each, and told apart when nothing is dealt any more
    model = F.struct(*extra)
    held = lambda d, c, *k: d.groupBy(*on, *k).agg(F.map_from_entries(F.collect_list(F.struct(model.alias("model"), F.col(c)))).alias(c))
    t = t.join(held(two, "ccw", "ctx", "token"), [*on, "ctx", "token"], "left").join(held(one, "cw", "token"), [*on, "token"], "left").join(held(ctx, "cc", "ctx"), [*on, "ctx"], "left")
    models = all_.groupBy(*on).agg(F.collect_list(F.struct(*extra, "n_train")).alias("m"))
    t = (t.join(F.broadcast(models), on) if on else t.crossJoin(F.broadcast(models))).withColumn("m", F.explode("m")).select("*", *[F.col(f"m.{c}").alias(c) for c in [*extra, "n_train"]])
    bits = code_length(F.col("n_train").cast("double"), *[num(F.col(c)[model]) for c in ("cw", "cc", "ccw")], F.col("n_bytes"))
    return t.select(*extra, *pair, *keep, "n_bytes", "n", ubits(bits).alias("ubits"))


def _preceded(placed: DataFrame, scope: list[str]) -> DataFrame:
    """Files with before, the last token of the file before in the scope ('' for the first)."""
    own = [*scope, "file_id"]
    ends = placed.groupBy(*own).agg(F.min("offset").alias("first"), F.max_by(last_of(F.col("behind"), F.col("text")), "offset").alias("last"))
    return placed.join(ends.select(*own, F.coalesce(F.lag("last").over(Window.partitionBy(*scope).orderBy("first")), F.lit("")).alias("before")), own)


def _bigrams(files: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of whole files (offset, behind, n, text, before), and 64-bit names of each token, of its context and of the pair."""
    files = files.sort_by("offset")
    pieces = files.append_column("first", pc.add(files["offset"], 1)).append_column("i", pa.array(np.zeros(len(files), np.int32)))
    tokens = _spread(pieces, [])
    words = pa.chunked_array([*tokens["token"].chunks, *files["before"].chunks]).combine_chunks().dictionary_encode()
    code = words.indices.to_numpy()
    token, before = code[: len(tokens)], code[len(tokens) :]
    ctx = np.append(before[:1], token[:-1])
    n = files["n"].to_numpy().astype(np.int64)
    ctx[np.cumsum(n) - n] = before
    h = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    w, c = h[token], h[ctx]
    return tokens, w, c * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), c * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)


def _by_part(name: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Names (in order) of each part that has any, with their places."""
    part = (name % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _look_up(trained: pa.Table, asked: pa.Table, languages: list[str | None]) -> pa.Table:
    """For the names that a block asked for, how often each model saw them: one row a block, with the counts of its models, one after the
    other. languages: of each model, null where it scores all."""
    models = {}
    for m in range(len(languages)):
        rows = trained.filter(pc.equal(trained["model"], m)) if len(trained) else trained
        name = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b.as_py(), np.uint64) for b in rows["name"])])
        n = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(b.as_py(), np.int32) for b in rows["n"])]).astype(np.int64)
        order = np.argsort(name, kind="stable")
        name, n = name[order], np.append(0, np.cumsum(n[order]))
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        models[m] = name[first], np.diff(n[np.append(first, len(name))])
    counts = []
    for language, b in zip(asked["language"].to_pylist(), asked["name"], strict=True):
        want, held = np.frombuffer(b.as_py(), np.uint64), []
        for m, (name, n) in models.items():
            if languages[m] is None or languages[m] == language:
                at = np.minimum(np.searchsorted(name, want), max(len(name) - 1, 0))
                held.append(np.where(name[at] == want, n[at], 0) if len(name) else np.zeros(len(want), np.int64))
        counts.append(np.concatenate([np.zeros(0, np.int64), *held]).tobytes())
    return asked.select(["language", "codebase", "block", "part"]).append_column("counts", pa.array(counts, pa.binary()))


def frozen_blocks(test: DataFrame, train: DataFrame, by: list[str] | None = None, more: list[dict] | None = None, buckets: bool = False, block: int = BLOCK) -> DataFrame:
    """`frozen_pairs` of files (`corpus.place_tokens`) in place of tokens: the model's columns of by, language, bucket (of positions, with buckets),
    n_bytes, n and ubits, for each distinct pair of a block. train: files with the columns of by, a file once for each model that learns from
    it. more: models that learnt nothing (their values of by).

    Words, contexts and pairs go to the counts as 64-bit names, of training files by some 1,000,000 tokens, of files to score by block of
    positions, and counts come back; the text of a block is dealt once, and no pair is a row before it has all its counts. At n names
    about n²/2⁶⁵ are expected to collide. Models are few: one row each is collected."""
    by = by or ["language"]
    extra = [c for c in by if c != "language"]
    known = train.groupBy(*by).agg(F.sum("n").alias("n")).dropna(subset=by).collect()
    models = sorted([{c: r[c] for c in by} | {"n_train": float(r["n"])} for r in known] + [{c: m[c] for c in by} | {"n_train": 0.0} for m in more or []], key=str)
    languages = [m.get("language") for m in models]
    is_model = lambda m: reduce(and_, [F.col(c) == F.lit(m[c]) for c in by])
    number = F.coalesce(F.lit(None).cast("int"), *[F.when(is_model(m), F.lit(k)) for k, m in enumerate(models)])
    parts = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    learnt = _preceded(train, ["codebase", *extra]).withColumn("model", number).filter("model is not null").select("model", "offset", "behind", "n", "text", "before")

    def count(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = pa.Table.from_batches(held)
            for m in pc.unique(files["model"]).to_pylist():
                names = np.concatenate(_bigrams(files.filter(pc.equal(files["model"], m)))[1:])
                name, n = np.unique(names, return_counts=True)
                rows = [(m, p, name[at].tobytes(), n[at].astype(np.int32).tobytes()) for p, at in _by_part(name, parts)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["model", "part", "name", "n"])

        held, size = [], 0
        for got in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            held.append(got)
            size += pc.sum(got["n"]).as_py()
            if size >= at_once:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    trained = learnt.mapInArrow(count, "model int, part int, name binary, n binary")
    key = ["language", "codebase", "block"]
    t = _preceded(test.filter("language is not null") if "language" in by else test, ["codebase"])
    t = stored(t.select("language", "codebase", F.floor(F.col("offset") / block).cast("long").alias("block"), "offset", "behind", "n", "text", "before"), "frozen-blocks")

    def ask(got: pa.Table) -> pa.Table:
        name = np.unique(np.concatenate(_bigrams(got)[1:]))
        own = {c: got[c][0].as_py() for c in key}
        made = [{**own, "part": p, "name": name[at].tobytes()} for p, at in _by_part(name, parts)]
        return pa.Table.from_pylist(made, pa.schema([("language", pa.string()), ("codebase", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("name", pa.binary())]))

    own = "language string, codebase string, block long"
    asked = t.groupBy(*key).applyInArrow(ask, f"{own}, part int, name binary")
    told = trained.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda a, b: _look_up(a, b, languages), f"{own}, part int, counts binary")

    def score(got: pa.Table, told: pa.Table) -> pa.Table:
        tokens, *names = _bigrams(got)
        language, size = got["language"][0].as_py(), tokens["n_bytes"].to_numpy().astype(np.int64)
        place = np.floor(np.log2(tokens["pos"].to_numpy().astype(float)) + 1e-9).astype(np.int64) if buckets else np.zeros(len(size), np.int64)
        own = [m for m, x in enumerate(languages) if x is None or x == language]
        name, at = np.unique(np.concatenate(names), return_inverse=True)
        counts, held = np.zeros((len(own), len(name)), np.int64), dict(zip(told["part"].to_pylist(), told["counts"], strict=True))
        for p, k in _by_part(name, parts):
            counts[:, k] = np.frombuffer(held[p].as_py(), np.int64).reshape(len(own), len(k))
        cw, cc, ccw = (counts[:, x] for x in np.split(at, 3))
        first, n = np.unique(np.stack([at[2 * len(size) :], place]), axis=1, return_index=True, return_counts=True)[1:]
        whole = lambda x: np.tile(x[first], len(own))
        cols = {"model": np.repeat(np.array(own, np.int32), len(first)), "bucket": whole(place).astype(np.int32), "n_bytes": whole(size).astype(np.int32), "n": np.tile(n, len(own)), "cw": cw[:, first].ravel(), "cc": cc[:, first].ravel(), "ccw": ccw[:, first].ravel()}
        return pa.table({"language": pa.array([language] * len(cols["n"]), pa.string()), **cols})

    got = t.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(score, "language string, model int, bucket int, n_bytes int, n long, cw long, cc long, ccw long")
    kinds = {c: train.schema[c].dataType for c in by}
    value = lambda c, kind: F.element_at(F.array(*[F.lit(m[c]).cast(kind) for m in models]) if models else F.array().cast(f"array<{kind if isinstance(kind, str) else kind.simpleString()}>"), F.col("model") + 1)
    num = lambda c: F.col(c).cast("double")
    bits = code_length(value("n_train", "double"), num("cw"), num("cc"), num("ccw"), F.col("n_bytes"))
    return got.select(*[value(c, kinds[c]).alias(c) for c in extra], "language", *(["bucket"] if buckets else []), "n_bytes", "n", ubits(bits).alias("ubits"))


def score_frozen(tokens: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame], by: list[str] | None = None) -> DataFrame:
    """Losses under frozen counts; what training never saw backs off. by: columns of the counts that name the model (all models score all
    tokens of their language, or all tokens if by has no language). The losses of distinct pairs, one row a pair with all its models, meet
    the tokens in one join."""
    pair = ["language", "ctx", "token"]
    extra = [c for c in by or ["language"] if c != "language"]
    each = frozen_pairs(tokens, counts, by).groupBy(*pair).agg(F.collect_list(F.struct(*extra, "ubits")).alias("m"))
    t = _with_context(tokens, ["codebase"]).join(each, pair)
    return t.withColumn("m", F.explode("m")).select(*[F.col(f"m.{c}").alias(c) for c in extra], *KEYS, F.col("m.ubits").alias("ubits"))


def score_with_model(windows: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """Losses from a caller's batch scorer. windows: language, codebase, window, tokens (array). load runs once a task and returns a
    function from a window's tokens to their bits. Windows are what bounds a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for got in batches:
            rows = [(lang, code, win, k, int(round(b * 1e6))) for lang, code, win, toks in got.itertuples(index=False) for k, b in enumerate(score(list(toks)))]
            yield pd.DataFrame(rows, columns=["language", "codebase", "window", "k", "ubits"])

    return windows.select("language", "codebase", "window", "tokens").mapInPandas(run, "language string, codebase string, window long, k int, ubits long")


def score_compression(files: DataFrame, rungs: list[int]) -> DataFrame:
    """Bits that zlib needs for the second half of each file given the last W bytes of the first half, for each W (32 KB at most)."""
    if max(rungs) > 1 << 15:
        raise ValueError("a zlib dictionary holds 32768 bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            rows = []
            for lang, file_id, text in got.itertuples(index=False):
                raw = (text or "").encode()
                head, tail = raw[: len(raw) // 2], raw[len(raw) // 2 :]
                for w in rungs:
                    z = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=head[-w:]) if head and w else zlib.compressobj(9, zlib.DEFLATED, -15)
                    rows.append((lang, file_id, w, len(tail), 8 * len(z.compress(tail) + z.flush())))
            yield pd.DataFrame(rows, columns=["language", "file_id", "rung", "n_bytes", "n_bits"])

    return files.select("language", "file_id", "content").mapInPandas(run, "language string, file_id long, rung int, n_bytes long, n_bits long")


def normalise_units(losses: DataFrame, by: list[str]) -> DataFrame:
    """Bits per token, per byte and per character, and perplexity of tokens."""
    s = losses.groupBy(*by).agg(F.count("*").alias("n"), total("ubits").alias("ubits"), total("n_bytes").alias("n_bytes"), total("n_chars").alias("n_chars"))
    bits = F.col("ubits") / F.lit(1e6)
    x = r6(bits / F.col("n"))
    whole = F.floor(x).cast("double")
    perplexity = r6(F.pow(F.lit(2.0), x - whole)) * F.pow(F.lit(2.0), whole)  # six digits, however large
    return s.select(*by, "n", "ubits", x.alias("bits_per_token"), r6(bits / F.col("n_bytes")).alias("bpb"), r6(bits / F.col("n_chars")).alias("bpc"), perplexity.alias("perplexity"))


def normalise_line_length(losses: DataFrame, files: DataFrame) -> DataFrame:
    """Bits per line, with positions in lines of each language's median length in tokens, by power-of-two line bucket."""
    per_line = files.select("language", F.explode(F.split("content", "\n")).alias("line"))
    n = F.size(F.filter(F.split(F.trim(F.regexp_replace("line", "[ \t\r\n]+", " ")), " "), lambda w: w != ""))
    typical = per_line.withColumn("n", n).filter("n > 0").groupBy("language").agg(F.percentile("n", F.lit(0.5)).alias("tokens_per_line"))
    at = losses.join(F.broadcast(typical), "language")  # one row a language
    line = F.greatest(F.floor((F.col("pos") - 1) / F.col("tokens_per_line")) + 1, F.lit(1))
    at = at.withColumn("line_bucket", F.floor(F.log2(line.cast("double")) + F.lit(1e-9)).cast("int"))
    s = at.groupBy("language", "line_bucket", "tokens_per_line").agg(F.count("*").alias("n"), total("ubits").alias("ubits"))
    return s.select("language", "line_bucket", "n", "ubits", r6(F.col("ubits") / F.lit(1e6) / F.col("n") * F.col("tokens_per_line")).alias("bits_per_line"))


def byte_positions(losses: DataFrame, order: DataFrame) -> DataFrame:
    """losses with byte_pos, the 1-based byte of its codebase at which a token begins: bytes are summed up in each file, and files in
    order, so tokenizers can be compared at equal places."""
    own = ["codebase", "file_id"]
    n = losses.groupBy(*own).agg(F.sum("n_bytes").alias("size")).join(order.select(*own, "seq"), own)
    n = n.select(*own, (F.sum("size").over(Window.partitionBy("codebase").orderBy("seq")) - F.col("size")).alias("offset"))
    within = F.sum("n_bytes").over(Window.partitionBy(*own).orderBy("i")) - F.col("n_bytes")
    return losses.withColumn("within", within).join(n, own).withColumn("byte_pos", F.col("offset") + F.col("within") + 1).drop("offset", "within")


def tokenizer_bias(losses: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """losses: tokenizer and the usual columns. Bits per byte of each tokenizer by language and power-of-two bucket of byte position, which
    `byte_positions` finds where losses don't bring it (byte_pos)."""
    if "byte_pos" not in losses.columns:
        at = [byte_positions(losses.filter(F.col("tokenizer") == t), order) for t in ("word", "char")]
        losses = at[0].unionByName(at[1])
    b = losses.withColumn("bucket", bucket(F.col("byte_pos")))
    s = b.groupBy("language", "tokenizer", "bucket").agg(F.count("*").alias("n"), total("ubits").alias("ubits"), total("n_bytes").alias("n_bytes"))
    return s.withColumn("bpb", r6(F.col("ubits") / F.lit(1e6) / F.col("n_bytes")))
