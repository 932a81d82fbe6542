"""The registered queries opN_<name>, each applying its operator to a whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, packing, periodic, quality, sharding, simhash, suffix_dedup, toxicity, trie, url_filters, warc
from .common import stored, table


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels.filter(~_held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "place")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted).drop("ratio")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).drop("matched_rules")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each tenth document (by crc32 of doc_id) repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tenth = F.coalesce(h % 10 == 0, F.lit(False))
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(tenth, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w"))
    cut = cut.withColumns({"n": F.size("w"), "g": F.expr("h div 10")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(planted(table(spark, sf_dir, "documents")))
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast(periodic.RUN), better)  # runs are in order of start and period, so the first of equals stays
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(F.array_join(each, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(trie.turns(table(spark, sf_dir, "conversations")), "turns")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    nodes, ends = trie.trie(*trie.share_heads(own, F.col("conv") - F.col("conv") % 100, head))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(trie.end_digests(ends), "key", "left").drop("key").withColumn("ends_sha256", F.coalesce("ends_sha256", none))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_suffix_dedup, op4_simhash, op5_html_text, op6_sharding, op7_warc, op8_quality, op9_packing, op10_url_filters, op11_periodic_runs, op12_bpe, op13_prefix_trie)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({_LOW}, '{_WORDS}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op10_url_filters": r"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
patterns(p) AS (VALUES @PATTERNS@),
m AS (SELECT u.*, (SELECT arg_max(struct_pack(rule := h || p, v := v), length(h || p)) FROM rules
    WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, rules.p)) AS best,
  EXISTS (SELECT 1 FROM patterns WHERE regexp_matches(u.url, patterns.p)) AS bad FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM m""".replace("@PATTERNS@", ", ".join(f"('{r.pattern}')" for r in url_filters.PATTERN_RULES)),
    "op13_prefix_trie": """
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS nth
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, n, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM o GROUP BY c), t),
b AS (SELECT n.*, least(n.h, coalesce(m.n, 0)) AS k FROM n LEFT JOIN n m ON m.c = n.base),
r AS (SELECT b.c, o.nth AS d, role, text FROM b JOIN o ON o.c = b.base AND o.nth <= b.h UNION ALL SELECT b.c, k + nth - h, role, text FROM b JOIN o ON o.c = b.c AND nth > h),
q AS (SELECT b.c, coalesce(path, []) AS path FROM b LEFT JOIN (SELECT c, list(struct_pack(r := role, x := text) ORDER BY d) AS path FROM r GROUP BY c) USING (c)),
m AS (SELECT c, list_slice(path, 1, depth) AS node, depth, depth = len(path) AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM q)),
v AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
  (count(*) - 1) * coalesce(length(node[depth].x), 0) AS saved FROM m GROUP BY node, depth),
ch AS (SELECT list_slice(node, 1, depth - 1) AS node, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN ch USING (node, depth)),
s AS (SELECT list_slice(node, 1, d) AS node, d AS depth, sum(saved) AS saved_tokens, count_if(n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (node, depth) LEFT JOIN v p ON p.depth = w.depth - 1 AND p.node = list_slice(w.node, 1, w.depth - 1)""",
}
