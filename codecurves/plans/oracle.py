"""DuckDB SQL for the registered queries, written on its own from the definitions."""

from __future__ import annotations


def _words(c: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g')), ' '), lambda z: z <> '')"


def _u32(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


BUCKET = "CAST(floor(log2(pos) + 1e-9) AS INTEGER)"
BPB = "round(ubits / 1e6 / n_bytes, 6)"


def sums(*cols: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cols)


def _tokens(src: str, dst: str, by: str = "") -> str:
    """Tokens with positions from a table of files; by: more columns that part codebases."""
    return f"""
{dst}_w AS (SELECT {by} language, codebase, file_id, {_words('content')} AS w FROM {src}),
{dst}_f AS (SELECT {by} language, codebase, file_id, w, sum(len(w)) OVER (PARTITION BY {by} codebase ORDER BY seq) - len(w) AS off FROM {dst}_w JOIN ord USING (codebase, file_id)),
{dst}_u AS (SELECT {by} language, codebase, file_id, off, unnest(range(len(w))) AS i, unnest(w) AS token FROM {dst}_f),
{dst} AS (SELECT {by} language, codebase, file_id, CAST(i AS INTEGER) AS i, CAST(off + i + 1 AS BIGINT) AS pos, token, CAST(strlen(token) + 1 AS INTEGER) AS n_bytes, CAST(length(token) + 1 AS INTEGER) AS n_chars FROM {dst}_u)"""


def _bits(n: str, cw: str, cc: str, ccw: str) -> str:
    u = f"(CASE WHEN {cw} = 0 THEN 9e0 * n_bytes + log2({n} + 1e0) ELSE log2({n} + 1e0) - log2({cw} + pow(2e0, -9e0 * n_bytes)) END)"
    return f"CAST(round((CASE WHEN {ccw} = 0 THEN {u} + log2({cc} + 1e0) ELSE log2({cc} + 1e0) - log2({ccw} + pow(2e0, -{u})) END) * 1e6) AS BIGINT)"


def _adaptive(src: str, dst: str, by: str = "") -> str:
    part = f"PARTITION BY {by} codebase"
    return f"""
{dst}_c AS (SELECT *, coalesce(lag(token) OVER ({part} ORDER BY pos), '') AS ctx FROM {src}),
{dst}_n AS (SELECT *, row_number() OVER ({part}, token ORDER BY pos) - 1 AS cw, row_number() OVER ({part}, ctx ORDER BY pos) - 1 AS cc, row_number() OVER ({part}, ctx, token ORDER BY pos) - 1 AS ccw FROM {dst}_c),
{dst} AS (SELECT *, {_bits('(pos - 1)', 'cw', 'cc', 'ccw')} AS ubits FROM {dst}_n)"""


def _fit(src: str, dst: str, by: str, y: str = "bpb", k: int = 5) -> str:
    ln2 = "0.6931471805599453e0 * bucket"
    return f"""{dst}_r AS (SELECT {by}, regr_intercept(ln({y}), {ln2}) AS c, regr_slope(ln({y}), {ln2}) AS d, regr_r2(ln({y}), {ln2}) AS r2, CAST(count(*) AS INTEGER) AS n_points FROM {src} WHERE bucket >= {k} GROUP BY {by} HAVING count(*) >= 2),
{dst} AS (SELECT {by}, round(exp(c), 6) AS a, round(-d, 6) AS b, round(r2, 6) AS r2, n_points FROM {dst}_r)"""


def _frozen_counts(src: str, dst: str, by: str) -> str:
    scope = ", ".join([c.strip() for c in by.split(",") if c.strip() != "language"] + ["codebase"])
    return f"""
{dst}_t AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY {scope} ORDER BY pos), '') AS ctx FROM {src}),
{dst}2 AS (SELECT {by}, ctx, token, count(*) AS ccw FROM {dst}_t GROUP BY ALL),
{dst}1 AS (SELECT {by}, token, count(*) AS cw FROM {dst}_t GROUP BY ALL),
{dst}x AS (SELECT {by}, ctx, count(*) AS cc FROM {dst}_t GROUP BY ALL),
{dst}0 AS (SELECT {by}, count(*) AS n_train FROM {dst}_t GROUP BY ALL)"""


def _frozen(test: str, counts: str, dst: str, by: str, on: str) -> str:
    """on: how a model meets a token's language."""
    match = " AND ".join(f"m.{c.strip()} = k.{c.strip()}" for c in by.split(","))
    keys = ", ".join(f"m.{c.strip()}" for c in by.split(",") if c.strip() != "language")
    keys = keys + ", " if keys else ""
    zero = lambda c: f"coalesce({c}, 0)"
    return f"""
{dst}_t AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY codebase ORDER BY pos), '') AS ctx FROM {test}),
{dst} AS (SELECT {keys} t.language, t.codebase, t.file_id, t.i, t.pos, t.n_bytes, {_bits('m.n_train', zero('k1.cw'), zero('kx.cc'), zero('k2.ccw'))} AS ubits
  FROM {dst}_t t JOIN {counts}0 m ON {on}
  LEFT JOIN {counts}1 k1 ON {match.replace('k.', 'k1.')} AND t.token = k1.token
  LEFT JOIN {counts}x kx ON {match.replace('k.', 'kx.')} AND t.ctx = kx.ctx
  LEFT JOIN {counts}2 k2 ON {match.replace('k.', 'k2.')} AND t.ctx = k2.ctx AND t.token = k2.token)"""


FILES = "files AS (SELECT lang AS language, lang || '/' || source AS codebase, doc_id AS file_id, lang || '/' || source || '/' || doc_id AS path, text AS content FROM documents)"
ORD = "ord AS (SELECT codebase, file_id, row_number() OVER (PARTITION BY codebase ORDER BY md5('s0:' || file_id), file_id) AS seq FROM files)"
TOK = _tokens("files", "tok")
B1 = _adaptive("tok", "b1")
CURVE = f"curve AS (SELECT language, {BUCKET} AS bucket, count(*) AS n, {sums('ubits', 'n_bytes')}, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb, round(stddev_samp(ubits / 1e6) / sqrt(count(*)), 6) AS stderr FROM b1 GROUP BY ALL)"
CB = f"cb AS (SELECT language, codebase, {BUCKET} AS bucket, count(*) AS n, {sums('ubits', 'n_bytes')} FROM b1 GROUP BY ALL)"
FIT = _fit("curve", "fit", "language")
LINES = "lines AS (SELECT language, codebase, file_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM files))"
HELD = "held AS (SELECT DISTINCT language, codebase, file_id, line AS symbol FROM lines WHERE length(line) >= 20)"
EDGES = "edges AS (SELECT codebase, src, file_id AS dst, md5(symbol) AS symbol FROM held JOIN (SELECT codebase, symbol, min(file_id) AS src FROM held GROUP BY ALL) USING (codebase, symbol) WHERE file_id > src)"
TRAITS = "traits(language, typing, strength) AS (VALUES ('de', 'static', 'strong'), ('en', 'dynamic', 'weak'), ('es', 'dynamic', 'strong'), ('fr', 'static', 'weak'))"
TRAIN, TEST = f"{_u32('t0', 'file_id')} % 2 = 0", f"{_u32('t0', 'file_id')} % 2 <> 0"
SPLIT = f"train AS (SELECT * FROM tok WHERE {TRAIN}), test AS (SELECT * FROM tok WHERE {TEST})"
RUNGS = lambda ks: f"rungs AS (SELECT train.*, rung FROM train, (SELECT unnest({ks}) AS rung) WHERE {_u32('r0', 'file_id')} % 8 < rung)"
FROZEN = [SPLIT, _frozen_counts("train", "k", "language"), _frozen("test", "k", "frozen", "language", "m.language = t.language")]
NOISE = [
    f"lead_ AS (SELECT *, lead(token, 7) OVER (PARTITION BY codebase, file_id ORDER BY i) AS donor, {_u32('n0', chr(39).join(['file_id || ', ':', ' || i']))} % 100 < 2 AS drawn FROM tok)",
    "hit AS (SELECT *, coalesce(drawn AND donor <> token, false) AS hit FROM lead_)",
    "ntok AS (SELECT language, codebase, file_id, i, pos, new AS token, CAST(strlen(new) + 1 AS INTEGER) AS n_bytes FROM (SELECT *, CASE WHEN hit THEN donor ELSE token END AS new FROM hit))",
    "mut AS (SELECT codebase, file_id, i, token AS original, donor AS mutated FROM hit WHERE hit)",
]
NB1 = _adaptive("ntok", "nb1")
FLOSS = f"floss AS (SELECT language, file_id, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM b1 GROUP BY ALL)"
TERMS = [
    "tf AS (SELECT DISTINCT language, codebase, file_id, token FROM tok)",
    "nf AS (SELECT codebase, count(DISTINCT file_id) AS n_files FROM tf GROUP BY ALL)",
    "df AS (SELECT codebase, token, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2)",
    "terms AS (SELECT codebase, file_id, token, CAST(round(log2(n_files / df) * 1e6) AS BIGINT) AS ubits FROM tf JOIN df USING (codebase, token) JOIN nf USING (codebase) WHERE df < n_files)",
]
VEC = "vec AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PAIRS = [
    "items AS (SELECT language, codebase, file_id, label AS topic, embedding FROM files JOIN embeddings ON vec_id = file_id)",
    """cand AS (SELECT a.topic, a.language AS lang_a, b.language AS lang_b, a.file_id AS file_a, b.file_id AS file_b,
  round(list_sum(list_transform(range(1, 65), lambda k: (CAST(a.embedding[k] AS DOUBLE) - CAST(b.embedding[k] AS DOUBLE)) * (CAST(a.embedding[k] AS DOUBLE) - CAST(b.embedding[k] AS DOUBLE)))), 6) AS distance
  FROM items a JOIN items b ON a.topic = b.topic AND a.language < b.language)""",
    """pairs AS (SELECT topic, lang_a, lang_b, file_a, file_b, distance FROM (SELECT *, row_number() OVER (PARTITION BY file_a, lang_a, lang_b ORDER BY distance, file_b) AS ra,
  row_number() OVER (PARTITION BY file_b, lang_a, lang_b ORDER BY distance, file_a) AS rb FROM cand) WHERE ra = 1 AND rb = 1)""",
]
CONTRAST = """SELECT lang_a, lang_b, n, CAST(sign(s) * ((2 * abs(s) + n) // (2 * n)) AS DOUBLE) / 1e6 AS mean_difference,
  CASE WHEN n * q > s * s THEN round(CAST(s AS DOUBLE) * sqrt(CAST(n - 1 AS DOUBLE)) / sqrt(CAST(n * q - s * s AS DOUBLE)), 4) END AS t, n_a_lower FROM (
  SELECT lang_a, lang_b, count(*) AS n, CAST(sum(d) AS HUGEINT) AS s, sum(CAST(d AS HUGEINT) * d) :: HUGEINT AS q, CAST(count_if(d < 0) AS BIGINT) AS n_a_lower FROM (
    SELECT lang_a, lang_b, CAST(round(x.bpb * 1e6) AS BIGINT) - CAST(round(y.bpb * 1e6) AS BIGINT) AS d
    FROM {pairs} JOIN floss x ON x.file_id = file_a JOIN floss y ON y.file_id = file_b) GROUP BY ALL)"""


#: Documents written out as code, by language of code: definition, use and three statements around the word @.
CODE_LINES = {
    "en": ("python", "def @(n):", "from lib import @", "    y = @ + 1000", "    if n < @:", "    except @:"),
    "fr": ("python", "def @(n):", "from lib import @", "    y = @ + 1000", "    if n < @:", "    except @:"),
    "de": ("javascript", "export function @(n) {", "import { @ }", "    y = @ + 1000;", "    if (n < @)", "    let y = @;"),
    "es": ("coq", "Lemma @ : t.", "apply @.", "Definition n := @ + 1000.", "exact @.", "Qed @."),
}
CODE = [
    "cl AS (SELECT lang, source, doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS i, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))",
    f"cw AS (SELECT *, {_u32('code', chr(39).join(['doc_id || ', ':', ' || i']))} % 5 AS kind FROM (SELECT *, lower(regexp_extract(line, '([A-Za-z]{{3,}})', 1)) AS w FROM cl) WHERE w <> '')",
    "cc AS (SELECT *, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in CODE_LINES.items()) + " END AS language, replace(CASE lang " + " ".join(f"WHEN '{k}' THEN CASE kind " + " ".join(f"WHEN {n} THEN '{v[n + 1]}'" for n in range(5)) + " END" for k, v in CODE_LINES.items()) + " END, '@', w) AS code FROM cw)",
    "code AS (SELECT language, language || '/' || source AS codebase, doc_id AS file_id, string_agg(code, chr(10) ORDER BY i) AS content FROM cc WHERE language IS NOT NULL GROUP BY language, source, doc_id)",
]
DEFINES = {"python": r"(?m)^\s*(?:def|class)\s+(\w+)", "javascript": r"(?m)^\s*(?:export\s+)?(?:function|class|const)\s+(\w+)", "coq": r"(?m)^\s*(?:Theorem|Lemma|Definition)\s+(\w+)"}
USES = {"python": r"(?m)^\s*(?:from\s+\S+\s+)?import\s+(\w+)", "javascript": r"(?m)import\s+\{?\s*(\w+)", "coq": r"(?m)(?:exact|apply|rewrite)\s+(\w+)"}
BUGS = [("bounds check dropped", r"if \(?\w+ < \w+\)?:?", "if (1):"), ("sign flipped", r" \+ ", " - "), ("constant changed", r"\b1000\b", "1024"), ("handler broadened", r"except \w+:", "except:"), ("cast inserted", r"= (\w+)\b", r"= int(\1)")]


def _symbols(name: str, rules: dict[str, str]) -> str:
    return f"{name} AS (SELECT DISTINCT codebase, file_id, unnest(CASE language " + " ".join(f"WHEN '{k}' THEN regexp_extract_all(content, '{v}', 1)" for k, v in rules.items()) + " END) AS symbol FROM code)"


def sql(*parts: str) -> str:
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body if ctes else body


TK = [FILES, ORD, TOK]
L = [*TK, B1]
C = [*L, CURVE]
WCURVE = "SELECT language, bucket, n, ubits, n_bytes, bpb, stderr FROM curve"
SWEEP = [*TK, SPLIT, RUNGS("[2, 4, 8]"), _frozen_counts("rungs", "k", "rung, language"), _frozen("test", "k", "fz", "rung, language", "m.language = t.language"),
         f"sc AS (SELECT rung, language, {BUCKET} AS bucket, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM fz GROUP BY ALL)", _fit("sc", "sf", "rung, language"),
         "sweep AS (SELECT sf.*, n_train FROM sf JOIN k0 USING (rung, language))"]

OFFSET = [
    "p AS (SELECT language, bucket, 0.6931471805599453e0 * bucket AS x, bpb, 0.95e0 * min(bpb) OVER (PARTITION BY language) * g / 19e0 AS e, g FROM curve, range(20) r(g) WHERE bucket >= 5)",
        "f AS (SELECT language, g, e, regr_intercept(ln(bpb - e), x) AS c, regr_slope(ln(bpb - e), x) AS d, CAST(count(*) AS INTEGER) AS n_points FROM p GROUP BY ALL HAVING count(*) >= 2)",
        "s AS (SELECT language, g, e, c, d, n_points, round(sum(pow(bpb - e - exp(c + d * x), 2)), 9) AS sse FROM p JOIN f USING (language, g, e) GROUP BY ALL)",
    "ofit AS (SELECT language, round(exp(c), 6) AS a, round(-d, 6) AS b, round(e, 6) AS e, n_points, g IN (0, 19) AS at_boundary FROM s QUALIFY row_number() OVER (PARTITION BY language ORDER BY sse, g) = 1)",
]

ORACLE = {
    "a1_read_corpus": sql(FILES, "SELECT language, codebase, file_id, path, CAST(strlen(content) AS BIGINT) AS n_bytes FROM files"),
    "a2_corpus_census": sql(FILES, f"""f AS (SELECT language, codebase, strlen(content) AS b, length(content) AS c, len({_words('content')}) AS t, string_split(content, chr(10)) AS l FROM files)""",
        "l AS (SELECT language, codebase, b, c, t, unnest(range(len(l))) AS k, unnest(l) AS line FROM f)",
        """SELECT language, codebase, CAST(grouping(language, codebase) AS INTEGER) AS level, count_if(k = 0) :: BIGINT AS n_files, CAST(sum(CASE WHEN k = 0 THEN b END) AS BIGINT) AS n_bytes,
        CAST(sum(CASE WHEN k = 0 THEN c END) AS BIGINT) AS n_chars, count(*) AS n_lines, CAST(sum(CASE WHEN k = 0 THEN t END) AS BIGINT) AS n_tokens, quantile_cont(strlen(line), 0.5) AS median_line_bytes,
        round(sum(CASE WHEN k = 0 THEN b END) / (SELECT sum(b) FROM f), 6) AS share, round(sum(CASE WHEN k = 0 THEN b END) / (SELECT sum(b) FROM f WHERE language = 'en'), 6) AS ratio
        FROM l GROUP BY ROLLUP (language, codebase)"""),
    "a3_duplicate_census": sql(FILES, LINES, "s AS (SELECT language, content, count(*) AS n FROM files GROUP BY ALL)", "t AS (SELECT language, line, count(*) AS n FROM lines GROUP BY ALL)",
        f"""a AS (SELECT language, {sums('n').replace('AS n', 'AS n_files')}, CAST(sum(n - 1) AS BIGINT) AS n_dup_files, CAST(sum((n - 1) * strlen(content)) AS BIGINT) AS dup_file_bytes, CAST(sum(n * strlen(content)) AS BIGINT) AS n_bytes FROM s GROUP BY ALL)""",
        "b AS (SELECT language, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * strlen(line)) AS BIGINT) AS dup_line_bytes FROM t GROUP BY ALL)",
        "SELECT a.*, b.* EXCLUDE (language), round(dup_file_bytes / n_bytes, 6) AS dup_share FROM a JOIN b USING (language)"),
    "a4_near_duplicate_pairs": sql(FILES, "rep AS (SELECT language, content, min(file_id) AS file_id FROM files GROUP BY ALL)",
        f"w AS (SELECT language, file_id, w FROM (SELECT *, {_words('content')} AS w FROM rep) WHERE len(w) > 0)",
        "s AS (SELECT DISTINCT language, file_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w))",
        "m AS (SELECT language, file_id, band, min(md5(band || ':' || s)) AS m FROM s, range(8) r(band) GROUP BY ALL)",
        "c AS (SELECT DISTINCT a.language, a.file_id AS file_a, b.file_id AS file_b FROM m a JOIN m b USING (language, band, m) WHERE a.file_id < b.file_id)",
        "n AS (SELECT file_id, count(*) AS n FROM s GROUP BY ALL)",
        "i AS (SELECT language, file_a, file_b, count(*) AS i FROM c JOIN s a ON a.file_id = file_a AND a.language = c.language JOIN s b ON b.file_id = file_b AND a.s = b.s GROUP BY language, file_a, file_b)".replace("SELECT language, file_a", "SELECT c.language, file_a").replace("GROUP BY language", "GROUP BY c.language"),
        "SELECT language, file_a, file_b, round(i / (x.n + y.n - i), 6) AS jaccard FROM i JOIN n x ON x.file_id = file_a JOIN n y ON y.file_id = file_b WHERE round(i / (x.n + y.n - i), 6) >= 0.8"),
    "a5_order_shuffled": sql(FILES, ORD, "SELECT codebase, file_id, CAST(seq AS INTEGER) AS seq FROM ord"),
    "a6_definition_use_edges": sql(FILES, LINES, HELD, EDGES, "SELECT * FROM edges"),
    "a7_order_dependency": sql(FILES, LINES, HELD, EDGES, "e AS (SELECT DISTINCT codebase, src, dst FROM edges)",
        "p AS (SELECT codebase, file_id, 0 AS level FROM files UNION SELECT e.codebase, e.dst, p.level + 1 FROM p JOIN e ON e.codebase = p.codebase AND e.src = p.file_id)",
        "lv AS (SELECT codebase, file_id, max(level) AS level FROM p GROUP BY ALL)",
        "SELECT codebase, file_id, CAST(row_number() OVER (PARTITION BY codebase ORDER BY level, file_id) AS INTEGER) AS seq, CAST(level AS INTEGER) AS level, false AS in_cycle FROM lv"),
    "a8_pack_corpus": sql(FILES, ORD, "p AS (SELECT codebase, CAST(seq AS INTEGER) AS seq, file_id, '=== ' || path || ' ' || language || ' ' || strlen(content) || chr(10) AS header, content || chr(10) AS body FROM files JOIN ord USING (codebase, file_id))",
        "e AS (SELECT *, CAST(sum(strlen(header) + strlen(body)) OVER (PARTITION BY codebase ORDER BY seq) AS BIGINT) AS byte_end FROM p)",
        "SELECT codebase, seq, file_id, header, md5(body) AS body_md5, CAST(byte_end - strlen(header) - strlen(body) AS BIGINT) AS byte_start, byte_end FROM e"),
    "a9_tokenize": sql(*TK, "SELECT file_id, i, token, n_bytes FROM tok"),
    "a10_assign_positions": sql(*TK, "SELECT codebase, file_id, min(pos) AS first, max(pos) AS last, count(*) AS n, CAST(sum(pos * n_bytes) AS BIGINT) AS weight FROM tok GROUP BY ALL"),
    "a11_context_windows": sql(*TK, "w AS (SELECT codebase, file_id, pos, unnest(range(greatest(CAST(floor((pos - 1 - 1024) / 512) AS BIGINT) + 1, 0), (pos - 1) // 512 + 1)) AS win FROM tok)",
        "SELECT codebase, CAST(win AS BIGINT) AS window, count(*) AS n, count(DISTINCT file_id) AS n_files, CAST(min(pos - win * 512) AS BIGINT) AS first, CAST(max(pos - win * 512) AS BIGINT) AS last FROM w GROUP BY codebase, win"),
    "a12_write_curves": sql(*C, "SELECT language, bucket, n, ubits, bpb FROM curve"),
    "b1_score_adaptive": sql(*L, "SELECT codebase, file_id, count(*) AS n, CAST(sum(ubits) AS BIGINT) AS ubits FROM b1 GROUP BY ALL"),
    "b2_train_ngram": sql(*TK, _frozen_counts("tok", "k", "language"), "SELECT language, n_pairs, n_once, most, n_words, n_train FROM (SELECT language, count(*) AS n_pairs, count_if(ccw = 1) :: BIGINT AS n_once, max(ccw) AS most FROM k2 GROUP BY ALL) JOIN (SELECT language, count(*) AS n_words FROM k1 GROUP BY ALL) USING (language) JOIN k0 USING (language)"),
    "b3_score_frozen": sql(*TK, *FROZEN, f"SELECT language, {BUCKET} AS bucket, count(*) AS n, {sums('ubits', 'n_bytes')} FROM frozen GROUP BY ALL"),
    "b4_ingest_losses": sql(*L, f"""d AS (SELECT *, {_u32('dump', "file_id || ':' || i")} % 1000 AS u FROM b1)""",
        "g AS (SELECT language, count(*) AS n_tokens, CAST(count_if(u >= 10) AS BIGINT) AS n_matched, CAST(count_if(u < 10) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_orphan, CAST(count_if(u BETWEEN 20 AND 22) AS BIGINT) AS n_duplicate, CAST(coalesce(sum(CASE WHEN u >= 10 THEN ubits END), 0) AS BIGINT) AS ubits FROM d GROUP BY ALL)",
        "SELECT * FROM g UNION ALL SELECT NULL, 0, 0, 0, CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d WHERE u BETWEEN 10 AND 11 HAVING count(*) > 0"),
    "b7_score_limited_context": sql(*TK, "c AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY codebase ORDER BY pos), '') AS ctx FROM tok)",
        *[f"""r{w} AS (SELECT *, {w} AS rung, count(*) OVER (PARTITION BY codebase, token ORDER BY pos RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS cw, count(*) OVER (PARTITION BY codebase, ctx ORDER BY pos RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS cc,
        count(*) OVER (PARTITION BY codebase, ctx, token ORDER BY pos RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS ccw FROM c)""" for w in (64, 1024, 16384)],
        "a AS (SELECT * FROM r64 UNION ALL SELECT * FROM r1024 UNION ALL SELECT * FROM r16384)", f"b AS (SELECT *, {_bits('least(pos - 1, rung)', 'cw', 'cc', 'ccw')} AS ubits FROM a)",
        f"SELECT CAST(rung AS INTEGER) AS rung, language, count(*) AS n, {sums('ubits', 'n_bytes')} FROM b GROUP BY rung, language"),
    "b8_normalise_units": sql(*L, f"s AS (SELECT language, count(*) AS n, {sums('ubits', 'n_bytes', 'n_chars')} FROM b1 GROUP BY ALL)",
        "SELECT language, n, ubits, round(ubits / 1e6 / n, 6) AS bits_per_token, round(ubits / 1e6 / n_bytes, 6) AS bpb, round(ubits / 1e6 / n_chars, 6) AS bpc, round(pow(2e0, round(ubits / 1e6 / n, 6) - floor(round(ubits / 1e6 / n, 6))), 6) * pow(2e0, floor(round(ubits / 1e6 / n, 6))) AS perplexity FROM s"),
    "b9_normalise_line_length": sql(*L, LINES, f"w AS (SELECT language, quantile_cont(n, 0.5) AS t FROM (SELECT language, len({_words('line')}) AS n FROM lines) WHERE n > 0 GROUP BY ALL)",
        "a AS (SELECT b1.language, t, ubits, CAST(floor(log2(greatest(floor((pos - 1) / t) + 1, 1)) + 1e-9) AS INTEGER) AS line_bucket FROM b1 JOIN w ON w.language = b1.language)",
        "SELECT language, line_bucket, count(*) AS n, CAST(sum(ubits) AS BIGINT) AS ubits, round(sum(ubits) / 1e6 / count(*) * t, 6) AS bits_per_line FROM a GROUP BY language, line_bucket, t"),
    "b10_tokenizer_bias": sql(*L, """ch_f AS (SELECT language, codebase, file_id, l, sum(len(l)) OVER (PARTITION BY codebase ORDER BY seq) - len(l) AS off FROM (SELECT *, string_split(content, '') AS l FROM files) JOIN ord USING (codebase, file_id))""",
        "ch_u AS (SELECT language, codebase, file_id, off, unnest(range(len(l))) AS i, unnest(l) AS token FROM ch_f)", "ch AS (SELECT language, codebase, file_id, i, CAST(off + i + 1 AS BIGINT) AS pos, token, strlen(token) AS n_bytes FROM ch_u)", _adaptive("ch", "cb1"),
        f"s AS (SELECT language, 'word' AS tokenizer, count(*) AS n, {sums('ubits', 'n_bytes')} FROM b1 GROUP BY ALL UNION ALL SELECT language, 'char', count(*), {sums('ubits', 'n_bytes')} FROM cb1 GROUP BY ALL)",
        f"SELECT language, tokenizer, n, ubits, round(ubits / 1e6 / n, 6) AS bits_per_token, {BPB} AS bpb FROM s"),
    "c1_loss_by_position": sql(*C, WCURVE),
    "c2_loss_by_position_balanced": sql(*L, CB, "full_ AS (SELECT codebase FROM cb WHERE bucket <= 10 GROUP BY ALL HAVING count(*) = 11)",
        "SELECT language, bucket, count(*) AS n_codebases, round(avg(ubits / 1e6 / n_bytes), 6) AS bpb FROM cb WHERE bucket <= 10 AND codebase IN (SELECT codebase FROM full_) GROUP BY language, bucket"),
    "c3_curve_by_factors": sql(*L, f"x AS (SELECT language, string_split(codebase, '/')[2] AS source, {BUCKET} AS bucket, ubits, n_bytes FROM b1)",
        f"SELECT language, source, bucket, CAST(grouping(language, source, bucket) AS INTEGER) AS level, count(*) AS n, CAST(sum(ubits) AS BIGINT) AS ubits, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM x GROUP BY GROUPING SETS ((language, bucket), (source, bucket), (bucket))"),
    "c4_context_gain": sql(*C, "g AS (SELECT language, lag(bpb) OVER (PARTITION BY language ORDER BY bucket) - bpb AS gain FROM curve WHERE bucket >= 5)",
        "SELECT language, count(*) AS n_steps, CAST(count_if(gain > 0) AS BIGINT) AS n_falling, bool_and(gain > 0) AS always_falling, round(sum(gain), 6) AS total_gain FROM g WHERE gain IS NOT NULL GROUP BY ALL"),
    "c5_prefix_loss": sql(*C, "p AS (SELECT language, bucket, CAST(sum(ubits) OVER w AS BIGINT) AS ubits, CAST(sum(n_bytes) OVER w AS BIGINT) AS n_bytes FROM curve WINDOW w AS (PARTITION BY language ORDER BY bucket))", f"SELECT *, {BPB} AS bpb FROM p"),
    "d1_fit_power_law": sql(*C, FIT, "SELECT * FROM fit"),
    "d2_fit_power_law_offset": sql(*C, *OFFSET, "SELECT * FROM ofit"),
    "d3_fit_codebase_exponents": sql(*L, CB, "cbb AS (SELECT *, ubits / 1e6 / n_bytes AS bpb FROM cb)", _fit("cbb", "cf", "language, codebase"),
        "SELECT language, count(*) AS n_codebases, round(avg(b), 6) AS mean_b, round(stddev_samp(b), 6) AS sd_b, round(quantile_cont(b, 0.25), 6) AS q1, round(quantile_cont(b, 0.5), 6) AS q2, round(quantile_cont(b, 0.75), 6) AS q3 FROM cf WHERE n_points >= 3 GROUP BY ALL"),
    "d4_bootstrap_exponents": sql(*L, CB, f"""dr AS (SELECT cb.*, rep, {_u32('boot', "rep || '/' || codebase")} / 4294967296e0 AS u FROM cb, range(20) r(rep))""",
        "w AS (SELECT *, (u >= 0.36787944117144233e0) :: INT + (u >= 0.7357588823428847e0) :: INT + (u >= 0.9196986029286058e0) :: INT + (u >= 0.9810118431238462e0) :: INT + (u >= 0.9963401531726563e0) :: INT + (u >= 0.9994058151824183e0) :: INT AS w FROM dr)",
        "b AS (SELECT rep, language, bucket, sum(ubits * w) / 1e6 / sum(n_bytes * w) AS bpb FROM w WHERE w > 0 GROUP BY ALL)", _fit("b", "bf", "rep, language"),
        "SELECT language, count(*) AS n_reps, round(quantile_cont(b, 0.05), 6) AS lo, round(quantile_cont(b, 0.5), 6) AS mid, round(quantile_cont(b, 0.95), 6) AS hi FROM bf GROUP BY ALL"),
    "d5_forecast_holdout": sql(*C, "early AS (SELECT * FROM curve WHERE bucket <= 9)", _fit("early", "ef", "language"),
        "SELECT language, count(*) AS n_held_out, round(avg(abs(a * pow(2e0, -b * bucket) - bpb)), 6) AS mean_abs_error FROM curve JOIN ef USING (language) WHERE bucket > 9 GROUP BY ALL"),
    "d6_compare_languages": sql(*C, FIT, TRAITS, "k AS (SELECT min(m) AS bucket FROM (SELECT max(bucket) AS m FROM curve GROUP BY language))",
        """SELECT language, strength, CAST(dense_rank() OVER (ORDER BY b DESC) AS INTEGER) AS rank_b, CAST(dense_rank() OVER (ORDER BY a) AS INTEGER) AS rank_a, CAST(dense_rank() OVER (ORDER BY bpb) AS INTEGER) AS rank_bpb,
        round(avg(b) OVER (PARTITION BY strength), 6) AS strength_mean_b FROM fit JOIN traits USING (language) JOIN (SELECT language, bpb FROM curve JOIN k USING (bucket)) USING (language)"""),
    "e1_extrapolate": sql(*C, FIT, "SELECT language, CAST(size AS BIGINT) AS size, round(a * pow(CAST(size AS DOUBLE), -b), 6) AS bpb FROM fit, (SELECT unnest([1000, 100000, 10000000]) AS size)"),
    "e2_crossovers": sql(*C, FIT, "p AS (SELECT x.language AS lang_a, y.language AS lang_b, CASE WHEN x.b <> y.b THEN round((ln(x.a) - ln(y.a)) / (x.b - y.b) / 2.302585092994046e0, 6) END AS log10_n_star FROM fit x JOIN fit y ON x.language < y.language)",
        "SELECT *, CASE WHEN log10_n_star IS NULL OR log10_n_star <= log10(32) THEN 'never' WHEN log10_n_star <= log10(131072) THEN 'in_range' WHEN log10_n_star <= 12 THEN 'beyond_data' ELSE 'beyond_horizon' END AS verdict FROM p"),
    "e3_required_model_size": sql(*TK, SPLIT, _frozen_counts("train", "t", "language"), "v AS (SELECT unnest([100, 1000, 10000, 100000]) AS model_size)",
        "top AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ccw DESC, ctx, token) AS r FROM t2)", "k2 AS (SELECT model_size, language, ctx, token, ccw FROM top, v WHERE r <= model_size)",
        "k1 AS (SELECT model_size, t1.* FROM t1, v)", "kx AS (SELECT model_size, language, ctx, sum(ccw) AS cc FROM k2 GROUP BY ALL)", "k0 AS (SELECT model_size, t0.* FROM t0, v)",
        _frozen("test", "k", "fz", "model_size, language", "m.language = t.language"),
        "s AS (SELECT language, model_size, sum(ubits) / 1e6 / sum(n_bytes) AS y FROM fz GROUP BY ALL)", "r AS (SELECT language, count(*) AS n_sizes, regr_slope(y, ln(model_size)) AS d, regr_intercept(y, ln(model_size)) AS c FROM s GROUP BY ALL)",
        "SELECT language, n_sizes, round(d, 6) AS slope, round(c, 6) AS intercept, round((5e0 - c) / d / 2.302585092994046e0, 4) AS log10_size FROM r"),
    "e4_train_size_sweep": sql(*SWEEP, "SELECT language, count(*) AS n_rungs, round(regr_slope(b, ln(n_train)), 6) AS slope_b, round(regr_intercept(b, ln(n_train)), 6) AS intercept_b FROM sweep GROUP BY ALL"),
    "e5_data_to_crossover": sql(*SWEEP, "law AS (SELECT language, regr_slope(ln(a), ln(n_train)) AS d, regr_intercept(ln(a), ln(n_train)) AS c, arg_max(a, rung) AS a, arg_max(b, rung) AS b FROM sweep GROUP BY ALL)",
        "SELECT p.language, q.language AS against, round(CASE WHEN abs(p.d) > 1e-9 THEN (ln(q.a) + (p.b - q.b) * ln(1e5) - p.c) / p.d / 2.302585092994046e0 END, 3) AS log10_tokens FROM law p JOIN law q ON p.language <> q.language"),
    "e6_exchange_rates": sql(*TK, SPLIT, RUNGS("[2, 8]"), "rl AS (SELECT * EXCLUDE (language), language AS train_lang FROM rungs)", _frozen_counts("rl", "k", "rung, train_lang"), _frozen("test", "k", "fz", "rung, train_lang", "true"),
        "prices(train_lang, price) AS (VALUES ('de', 3e0), ('en', 1e0), ('es', 2e0), ('fr', 2.5e0))",
        "s AS (SELECT rung, train_lang, language AS test_lang, sum(ubits) / 1e6 / sum(n_bytes) AS y FROM fz GROUP BY ALL)", "t AS (SELECT s.*, n_train FROM s JOIN k0 USING (rung, train_lang))",
        "own AS (SELECT test_lang, regr_slope(y, ln(n_train)) AS d, regr_intercept(y, ln(n_train)) AS c FROM t WHERE train_lang = test_lang GROUP BY ALL)",
        "r AS (SELECT train_lang, test_lang, y, round((y - c) / d - ln(n_train), 4) + 0e0 AS ln_rate FROM t JOIN own USING (test_lang) WHERE rung = 8)",
        "z AS (SELECT train_lang, test_lang, round(y, 6) AS bpb, ln_rate, round(ln(price) - ln_rate, 4) + 0e0 AS ln_cost FROM r JOIN prices USING (train_lang))",
        "SELECT *, CAST(rank() OVER (PARTITION BY test_lang ORDER BY ln_cost, train_lang) AS INTEGER) AS rank FROM z"),
    "e7_best_of_k": sql("t AS (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS c FROM events GROUP BY ALL)", "k AS (SELECT unnest([1, 2, 4, 8]) AS k)",
        "s AS (SELECT k, count(*) AS n_tasks, round(avg(1 - list_product(list_transform(range(k), lambda j: greatest(n - c - j, 0) / (n - j)))), 6) AS pass_at_k FROM t, k WHERE n >= k GROUP BY ALL)",
        "SELECT CAST(k AS INTEGER) AS k, n_tasks, pass_at_k, round(regr_slope(pass_at_k, ln(k)) OVER (), 6) AS slope FROM s"),
    "f1_inject_noise": sql(*TK, *NOISE, "SELECT * FROM mut"),
    "f2_surprise_delta": sql(*L, *NOISE, NB1, "d AS (SELECT b1.language, codebase, file_id, i, b1.pos, nb1.ubits - b1.ubits AS delta FROM b1 JOIN nb1 USING (codebase, file_id, i))",
        "w AS (SELECT *, sum(delta) OVER (PARTITION BY codebase, file_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nxt FROM d)",
        f"SELECT language, {BUCKET} AS bucket, count(*) AS n, round(sum(delta) / 1e6 / count(*), 6) AS at_change, round(coalesce(sum(nxt), 0) / 1e6 / count(*) / 3e0, 6) AS after_change FROM w JOIN mut USING (codebase, file_id, i) GROUP BY ALL"),
    "f3_anomaly_quality": sql(*TK, *NOISE, NB1, f"l AS (SELECT {BUCKET} AS bucket, ubits, (mut.i IS NOT NULL) :: INT AS bad FROM nb1 LEFT JOIN mut USING (codebase, file_id, i))",
        "r AS (SELECT bucket, bad, rank() OVER (PARTITION BY bucket ORDER BY ubits) + (count(*) OVER (PARTITION BY bucket, ubits) - 1) / 2e0 AS r FROM l)",
        "s AS (SELECT bucket, CAST(sum(bad) AS BIGINT) AS n_pos, CAST(sum(1 - bad) AS BIGINT) AS n_neg, sum(CASE WHEN bad = 1 THEN r END) AS rs FROM r GROUP BY ALL HAVING sum(bad) > 0 AND sum(1 - bad) > 0)",
        "a AS (SELECT bucket, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2e0) / n_pos / n_neg, 6) AS auc FROM s)", "SELECT *, round(regr_slope(auc, CAST(bucket AS DOUBLE)) OVER (), 6) AS slope FROM a"),
    "f3_anomaly_top_k": sql(*TK, *NOISE, NB1, "l AS (SELECT nb1.language, (row_number() OVER (PARTITION BY codebase, file_id ORDER BY ubits DESC, i) <= 5) :: INT AS top, (mut.i IS NOT NULL) :: INT AS bad FROM nb1 LEFT JOIN mut USING (codebase, file_id, i))",
        "s AS (SELECT language, CAST(sum(top) AS BIGINT) AS n_top, CAST(sum(bad) AS BIGINT) AS n_bad, CAST(sum(top * bad) AS BIGINT) AS n_found FROM l GROUP BY ALL)", "SELECT *, round(n_found / n_top, 6) AS precision, round(n_found / n_bad, 6) AS recall FROM s"),
    "f4_rollout_pass_rate": sql(f"""r AS (SELECT lang AS language, CASE WHEN {_u32('c0', 'doc_id')} % 2 = 0 THEN 'full' ELSE 'signature' END AS condition, CAST(pow(2, floor(log2(greatest(n_chars, 1)) + 1e-9)) AS INTEGER) AS context_limit, quality = 1 AS ok FROM documents JOIN labels USING (doc_id))""",
        "s AS (SELECT language, condition, context_limit, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_passed, count_if(ok) / count(*) AS p FROM r GROUP BY ALL)",
        """SELECT language, condition, context_limit, n, n_passed, round(p, 6) AS rate, round((p + 3.8416e0 / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n), 6) AS lo,
        round((p + 3.8416e0 / (2 * n) + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n), 6) AS hi, round(regr_slope(p, log2(context_limit)) OVER (PARTITION BY language, condition), 6) + 0e0 AS slope FROM s"""),
    "f5_extract_signatures": sql(FILES, "SELECT codebase, file_id, md5(string_split(content, chr(10))[1]) AS signature_md5, md5(array_to_string(list_slice(string_split(content, chr(10)), 2, len(string_split(content, chr(10)))), chr(10))) AS body_md5 FROM files"),
    "f6_signature_determinism": sql(FILES, f"s AS (SELECT language, ({_words('string_split(content, chr(10))[1]')})[1] AS s, array_to_string(list_slice(string_split(content, chr(10)), 2, len(string_split(content, chr(10)))), chr(10)) AS b FROM files)",
        "c AS (SELECT language, s, b, count(*) AS c FROM s GROUP BY ALL)", "t AS (SELECT language, s, count(*) AS bodies, sum(c) AS n, sum(c * log2(c)) AS cl FROM c GROUP BY ALL)", "u AS (SELECT *, CAST(round((n * log2(n) - cl) * 1e6) AS BIGINT) AS uh FROM t)",
        "SELECT language, count(*) AS n_signatures, round(count_if(bodies = 1) / count(*), 6) AS share_single, round(sum(uh) / 1e6 / sum(n), 4) AS entropy FROM u GROUP BY ALL"),
    "g1_ablate": sql(FILES, LINES, "m AS (SELECT *, row_number() OVER (PARTITION BY codebase, file_id, line ORDER BY line_no) AS nth FROM lines)",
        """v AS (SELECT 'full' AS variant, language, line FROM m UNION ALL SELECT 'no_first_line', language, line FROM m WHERE line_no > 0 UNION ALL SELECT 'no_repeats', language, line FROM m WHERE nth = 1
        UNION ALL SELECT 'no_punctuation', language, regexp_replace(line, '[.,;:!?]', '', 'g') FROM m UNION ALL SELECT 'no_blank', language, line FROM m WHERE trim(line) <> '')""",
        "SELECT variant, language, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM v GROUP BY ALL"),
    "g2_ablation_effect": sql(FILES, ORD, LINES, "m AS (SELECT *, row_number() OVER (PARTITION BY codebase, file_id, line ORDER BY line_no) AS nth FROM lines)",
        "v AS (SELECT 'full' AS variant, * FROM m UNION ALL SELECT 'no_first_line', * FROM m WHERE line_no > 0 UNION ALL SELECT 'no_repeats', * FROM m WHERE nth = 1 UNION ALL SELECT 'no_punctuation', * REPLACE (regexp_replace(line, '[.,;:!?]', '', 'g') AS line) FROM m UNION ALL SELECT 'no_blank', * FROM m WHERE trim(line) <> '')",
        f"u AS (SELECT variant, codebase, file_id, line_no, unnest(range(len(w))) AS k, unnest(w) AS token FROM (SELECT *, {_words('line')} AS w FROM v))",
        "t AS (SELECT u.*, strlen(token) + 1 AS n_bytes, row_number() OVER (PARTITION BY variant, codebase ORDER BY seq, line_no, k) AS pos FROM u JOIN ord USING (codebase, file_id))", _adaptive("t", "vb", "variant,"),
        f"d AS (SELECT p.variant, codebase, CAST(floor(log2(f.pos) + 1e-9) AS INTEGER) AS bucket, count(*) AS n, sum(p.ubits - f.ubits) AS d FROM vb p JOIN vb f USING (codebase, file_id, line_no, k, token) WHERE p.variant <> 'full' AND f.variant = 'full' GROUP BY ALL)",
        "x AS (SELECT variant, bucket, CAST(round(d * 1e3 / n) AS BIGINT) AS x FROM d)", "s AS (SELECT variant, bucket, count(*) AS n, CAST(sum(x) AS HUGEINT) AS s, CAST(sum(CAST(x AS HUGEINT) * x) AS HUGEINT) AS q FROM x GROUP BY ALL)",
        "r AS (SELECT variant, bucket, n AS n_codebases, round(CAST(s AS DOUBLE) / 1e9 / n, 6) AS mean_bits, CASE WHEN n * q > s * s THEN round(CAST(s AS DOUBLE) * sqrt(CAST(n - 1 AS DOUBLE)) / sqrt(CAST(n * q - s * s AS DOUBLE)), 4) END AS t FROM s)",
        "h AS (SELECT *, bool_and(mean_bits > 0) OVER (PARTITION BY variant ORDER BY bucket DESC) AS tail FROM r)", "SELECT * EXCLUDE (tail), coalesce(min(CASE WHEN tail THEN bucket END) OVER (PARTITION BY variant), -1) AS helps_from FROM h"),
    "h1_component_loss": sql(*L, "c AS (SELECT language, ubits, CASE WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '[.,;:!?]$') THEN 'punctuated' WHEN regexp_matches(token, '^[A-Z]') THEN 'capitalised' ELSE 'word' END AS class FROM b1)",
        "SELECT language, class, count(*) AS n, CAST(sum(ubits) AS BIGINT) AS ubits, quantile_cont(ubits, 0.25) AS q1, quantile_cont(ubits, 0.5) AS q2, quantile_cont(ubits, 0.75) AS q3, round(sum(ubits) / sum(sum(ubits)) OVER (PARTITION BY language), 6) AS share FROM c GROUP BY language, class"),
    "h2_hotspots": sql(*L, FLOSS, "SELECT language, CAST(rank AS INTEGER) AS rank, file_id, bpb FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY bpb DESC, file_id) AS rank FROM floss) WHERE rank <= 10"),
    "h3_predictable_runs": sql(*L, "i AS (SELECT language, file_id, n_bytes, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM b1 WHERE ubits < 6000000)", "r AS (SELECT language, count(*) AS n, sum(n_bytes) AS b FROM i GROUP BY language, file_id, g HAVING count(*) >= 4)",
        """SELECT language, coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest, coalesce(rb, 0) AS run_bytes, round(coalesce(rb, 0) / nb, 6) AS share FROM (SELECT language, sum(n_bytes) AS nb FROM b1 GROUP BY ALL)
        LEFT JOIN (SELECT language, count(*) AS n_runs, max(n) AS longest, CAST(sum(b) AS BIGINT) AS rb FROM r GROUP BY ALL) USING (language)"""),
    "h4_inconsistent_identifiers": sql(*TK, "g AS (SELECT codebase, lower(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')) AS norm, count(DISTINCT token) AS k FROM tok GROUP BY ALL)", "SELECT codebase, count(*) AS n_names, CAST(sum(k) AS BIGINT) AS n_spellings, max(k) AS most FROM g WHERE k > 1 AND norm <> '' GROUP BY ALL"),
    "h5_repeat_learning": sql(*L, LINES, f"l AS (SELECT *, len({_words('line')}) AS n FROM lines)", "p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY codebase, file_id ORDER BY line_no) - n AS BIGINT) AS lo FROM l WHERE n > 0)",
        "c AS (SELECT p.language, p.codebase, p.file_id, p.line_no, regexp_replace(p.line, '[0-9]+', '0', 'g') AS template, sum(ubits) / 1e6 / count(*) AS bits FROM p JOIN b1 ON b1.file_id = p.file_id AND b1.codebase = p.codebase AND b1.i >= lo AND b1.i < lo + n GROUP BY ALL)",
        "n AS (SELECT c.*, ln(row_number() OVER (PARTITION BY codebase, template ORDER BY seq, line_no)) AS x FROM c JOIN ord USING (codebase, file_id))", "s AS (SELECT language, regr_slope(bits, x) AS s FROM n GROUP BY language, codebase, template HAVING count(*) >= 3)",
        "SELECT language, count(*) AS n_templates, round(avg(s), 6) AS mean_slope FROM s GROUP BY ALL"),
    "i1_context_contribution": sql(*TK, *TERMS, "SELECT b.codebase, b.file_id AS target, a.file_id AS context, count(*) AS n_terms, CAST(sum(b.ubits) AS BIGINT) AS ubits FROM terms a JOIN terms b ON a.codebase = b.codebase AND a.token = b.token AND a.file_id < b.file_id GROUP BY ALL"),
    "i3_signature_context_gap": sql(*TK, "sig AS (SELECT language, codebase, file_id, string_split(content, chr(10))[1] AS content FROM files)", _tokens("sig", "stok"), SPLIT,
        f"parts AS (SELECT 'full' AS context, * FROM train UNION ALL SELECT 'signatures', * FROM stok WHERE {TRAIN})", _frozen_counts("parts", "k_", "context, language"),
        "k2 AS (SELECT * FROM k_2)", "k1 AS (SELECT * FROM k_1)", "kx AS (SELECT * FROM k_x)", "k0 AS (SELECT * FROM k_0 UNION ALL SELECT 'none', language, 0 FROM k_0 WHERE context = 'full')",
        _frozen("test", "k", "fz", "context, language", "m.language = t.language"), "s AS (SELECT language, context, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS y FROM fz GROUP BY ALL)",
        "p AS (SELECT language, max(y) FILTER (context = 'none') AS none, max(y) FILTER (context = 'signatures') AS signatures, max(y) FILTER (context = 'full') AS \"full\" FROM s GROUP BY ALL)", "SELECT *, round((none - signatures) / (none - \"full\"), 6) AS share FROM p"),
    "i4_context_fanout": sql(FILES, LINES, HELD, EDGES, "e AS (SELECT DISTINCT codebase, src, dst FROM edges)", "r AS (SELECT * FROM e UNION SELECT a.codebase, b.src, a.dst FROM e a JOIN e b ON a.codebase = b.codebase AND a.src = b.dst)",
        "f AS (SELECT language, coalesce(d, 0) AS d, coalesce(w, 0) AS w FROM files LEFT JOIN (SELECT codebase, dst AS file_id, count(*) AS d FROM e GROUP BY ALL) USING (codebase, file_id) LEFT JOIN (SELECT codebase, dst AS file_id, count(*) AS w FROM r GROUP BY ALL) USING (codebase, file_id))",
        "SELECT language, count(*) AS n_files, CAST(sum(d) AS BIGINT) AS direct, CAST(sum(w) AS BIGINT) AS within, round(count_if(d = 0) / count(*), 6) AS share_alone FROM f GROUP BY ALL"),
    "j1_refactor_delta": sql(*L, LINES, "m AS (SELECT *, row_number() OVER (PARTITION BY codebase, file_id, line ORDER BY line_no) AS nth FROM lines)", "aft AS (SELECT language, codebase, file_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM m WHERE nth = 1 GROUP BY ALL)",
        _tokens("aft", "atok"), _adaptive("atok", "ab1"), "f AS (SELECT codebase, CAST(0 AS BIGINT) AS n_added, CAST(0 AS BIGINT) AS n_removed, CAST(count_if(x.content <> y.content) AS BIGINT) AS n_changed FROM files x JOIN aft y USING (codebase, file_id) GROUP BY ALL)",
        "p AS (SELECT codebase, CAST(sum(ubits) AS BIGINT) AS ub, sum(n_bytes) AS bb FROM b1 GROUP BY ALL)", "q AS (SELECT codebase, CAST(sum(ubits) AS BIGINT) AS ua, sum(n_bytes) AS ba FROM ab1 GROUP BY ALL)",
        "SELECT codebase, n_added, n_removed, n_changed, ub AS ubits_before, ua AS ubits_after, ub - ua AS gain, round(ua / 1e6 / ba - ub / 1e6 / bb, 6) AS bpb_change, CAST(rank() OVER (ORDER BY ub - ua DESC, codebase) AS INTEGER) AS rank FROM f LEFT JOIN p USING (codebase) LEFT JOIN q USING (codebase)"),
    "j2_revision_trend": sql("files AS (SELECT 'none' AS language, CAST(conv_id AS VARCHAR) AS codebase, turn AS file_id, text AS content FROM conversations)", "ord AS (SELECT codebase, file_id, file_id AS seq FROM files)", TOK, B1,
        "s AS (SELECT CAST(codebase AS BIGINT) AS project, file_id AS revision, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM b1 GROUP BY ALL)",
        "SELECT project, revision, bpb, round(bpb - lag(bpb) OVER (PARTITION BY project ORDER BY revision), 6) AS change, round(regr_slope(bpb, CAST(revision AS DOUBLE)) OVER (PARTITION BY project), 6) AS slope FROM s"),
    "k1_assign_topics": sql(VEC, "c AS (SELECT label, k, round(avg(x), 6) AS c FROM vec GROUP BY ALL)", "d AS (SELECT vec_id, c.label AS topic, round(sum((x - c) * (x - c)), 6) AS distance FROM vec JOIN c USING (k) GROUP BY ALL)".replace("c.label AS topic", "c.label AS topic"),
        "SELECT vec_id, topic, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic) = 1"),
    "k2_match_topic_pairs": sql(FILES, *PAIRS, "SELECT * FROM pairs"),
    "k3_paired_contrast": sql(*L, FLOSS, *PAIRS, CONTRAST.format(pairs="pairs")),
    "k3_spec_contrast": sql(*L, FLOSS, "sp AS (SELECT file_id // 4 AS spec, language, file_id, quality FROM files JOIN labels ON doc_id = file_id)",
        "sq AS (SELECT a.language AS lang_a, b.language AS lang_b, a.file_id AS file_a, b.file_id AS file_b FROM sp a JOIN sp b ON a.spec = b.spec AND a.language < b.language AND a.quality = b.quality)", CONTRAST.format(pairs="sq")),
    "k4_adjust_for_domain": sql(*L, FLOSS, "a AS (SELECT language, label AS topic, sum(CAST(round(bpb * 1e6) AS BIGINT)) AS s, count(*) AS n FROM floss JOIN embeddings ON vec_id = file_id GROUP BY ALL)",
        "b AS (SELECT topic, CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS t FROM a GROUP BY ALL)", "g AS (SELECT CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE) / 1e6 AS g FROM a)",
        "r AS (SELECT language, sum(s) AS s, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(round((CAST(s AS DOUBLE) - n * t) * 1e3) AS BIGINT)) AS r FROM a JOIN b USING (topic) GROUP BY ALL)",
        "z AS (SELECT language, round(CAST(s AS DOUBLE) / n / 1e6 - g, 6) AS naive, round(CAST(r AS DOUBLE) / 1e9 / n, 6) AS adjusted FROM r, g)", "SELECT *, sign(naive) * sign(adjusted) < 0 AS sign_changes FROM z"),
    "l1_icl_gain": sql(*L, *FROZEN, f"s AS (SELECT frozen.language, CAST(floor(log2(frozen.pos) + 1e-9) AS INTEGER) AS bucket, count(*) AS n, round(sum(frozen.ubits - b1.ubits) / 1e6 / count(*), 6) AS gain FROM frozen JOIN b1 USING (codebase, file_id, i) GROUP BY ALL)",
        "SELECT *, round(regr_slope(gain, CAST(bucket AS DOUBLE)) OVER (PARTITION BY language), 6) AS slope FROM s"),
    "l2_split_train_test": sql(FILES, f"p AS (SELECT language, file_id, content, CASE WHEN {_u32('split', 'file_id')} % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM files)",
        f"s AS (SELECT file_id, part, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT file_id, part, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT *, {_words('content')} AS w FROM p)))",
        f"q AS (SELECT array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {_words('text')} AS w FROM benchmark)))",
        "bad AS (SELECT g FROM s WHERE part = 'test' UNION SELECT g FROM q)", "x AS (SELECT DISTINCT file_id FROM s WHERE part = 'train' AND g IN (SELECT g FROM bad))",
        "SELECT language, file_id, part, file_id IN (SELECT file_id FROM x) AS dropped FROM p"),
    "m1_reuse_stats": sql(FILES, LINES, HELD, "u AS (SELECT language, codebase, symbol, count(DISTINCT file_id) - 1 AS uses FROM held GROUP BY ALL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY uses) AS k FROM u)", "s AS (SELECT language, count(*) AS n_defs, CAST(sum(uses) AS BIGINT) AS n_uses, count_if(uses = 0) AS z, sum(uses * k) AS rk FROM r GROUP BY ALL)",
        "SELECT language, n_defs, n_uses, round(z / n_defs, 6) AS share_unused, round(CASE WHEN n_uses > 0 THEN 2 * rk / n_defs / n_uses - (n_defs + 1) / n_defs END, 6) AS gini FROM s"),
    "m2_repair_locality": sql("r AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS f, count(DISTINCT p_brand) AS m, arg_min(p_brand, l_partkey) AS module FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)",
        "SELECT module, count(*) AS n_repairs, round(avg(f), 6) AS mean_files, round(avg(m), 6) AS mean_modules, round(count_if(m = 1) / count(*), 6) AS share_local FROM r GROUP BY ALL"),
    "m3_library_compression": sql(*L, LINES, "m AS (SELECT lines.*, row_number() OVER (PARTITION BY lines.codebase, line ORDER BY seq, line_no) AS nth FROM lines JOIN ord ON ord.codebase = lines.codebase AND ord.file_id = lines.file_id)",
        f"n AS (SELECT language, codebase, file_id, line_no, CASE WHEN nth > 1 AND len({_words('line')}) >= 2 THEN '@' || substr(md5(line), 1, 16) ELSE line END AS line FROM m)", "new AS (SELECT language, codebase, file_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM n GROUP BY ALL)",
        _tokens("new", "ltok"), _adaptive("ltok", "lb1"), "SELECT language, r AS raw_ubits, l AS library_ubits, round(l / r, 6) AS ratio FROM (SELECT language, CAST(sum(ubits) AS BIGINT) AS r FROM b1 GROUP BY ALL) JOIN (SELECT language, CAST(sum(ubits) AS BIGINT) AS l FROM lb1 GROUP BY ALL) USING (language)"),
    "m4_variance_decomposition": sql(*L, CB, TRAITS, "cbb AS (SELECT *, ubits / 1e6 / n_bytes AS bpb FROM cb)", _fit("cbb", "cf", "language, codebase"), "sz AS (SELECT codebase, sum(n) AS nt FROM cb GROUP BY ALL)",
        "e AS (SELECT cf.language, strength, b, nt FROM cf JOIN sz USING (codebase) JOIN traits ON traits.language = cf.language WHERE n_points >= 3)", "g AS (SELECT *, avg(b) OVER () AS gm, avg(b) OVER (PARTITION BY language) AS lm, avg(b) OVER (PARTITION BY strength) AS sm FROM e)",
        "SELECT count(*) AS n_codebases, round(sum(pow(b - gm, 2)), 5) AS ss_total, round(sum(pow(lm - gm, 2)), 5) AS ss_between, round(sum(pow(b - gm, 2)) - sum(pow(lm - gm, 2)), 5) AS ss_within, round(regr_r2(b, ln(nt)), 4) AS r2_size, round(sum(pow(sm - gm, 2)) / sum(pow(b - gm, 2)), 4) AS r2_strength FROM g"),
    "b10_position_bias": sql(*L, "ch_f AS (SELECT language, codebase, file_id, l, sum(len(l)) OVER (PARTITION BY codebase ORDER BY seq) - len(l) AS off FROM (SELECT *, string_split(content, '') AS l FROM files) JOIN ord USING (codebase, file_id))",
        "ch_u AS (SELECT language, codebase, file_id, off, unnest(range(len(l))) AS i, unnest(l) AS token FROM ch_f)", "ch AS (SELECT language, codebase, file_id, i, CAST(off + i + 1 AS BIGINT) AS pos, token, strlen(token) AS n_bytes FROM ch_u)", _adaptive("ch", "cb1"),
        "u AS (SELECT language, 'word' AS tokenizer, codebase, pos, n_bytes, ubits FROM b1 UNION ALL SELECT language, 'char', codebase, pos, n_bytes, ubits FROM cb1)",
        "p AS (SELECT *, sum(n_bytes) OVER (PARTITION BY tokenizer, codebase ORDER BY pos) - n_bytes + 1 AS byte_pos FROM u)",
        f"s AS (SELECT language, tokenizer, CAST(floor(log2(byte_pos) + 1e-9) AS INTEGER) AS bucket, count(*) AS n, {sums('ubits', 'n_bytes')} FROM p GROUP BY ALL)", f"SELECT *, {BPB} AS bpb FROM s"),
    "g1_code_components": sql(FILES, LINES, r"""v AS (SELECT 'full' AS variant, language, line FROM lines UNION ALL SELECT 'no_comments', language, line FROM lines WHERE NOT regexp_matches(line, '^\s*(#|//|--|/\*|\*|\(\*)')
        UNION ALL SELECT 'no_signatures', language, line FROM lines WHERE NOT regexp_matches(line, '^\s*(def \w+\(.*\).*:|\w+ :: .*|(Theorem|Lemma|Definition) \w+.*|fn \w+\(.*\).*)$')
        UNION ALL SELECT 'no_licence', language, line FROM lines WHERE NOT regexp_matches(line, '(?i)(licen[cs]e|copyright|all rights reserved|spdx)'))""",
        "SELECT variant, language, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM v GROUP BY ALL"),
    "h2_hotspot_lines": sql(*L, LINES, f"l AS (SELECT *, len({_words('line')}) AS n FROM lines)", "p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY codebase, file_id ORDER BY line_no) - n AS BIGINT) AS lo FROM l WHERE n > 0)",
        "c AS (SELECT p.language, p.file_id, p.line_no, count(*) AS n, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM p JOIN b1 ON b1.file_id = p.file_id AND b1.codebase = p.codebase AND b1.i >= lo AND b1.i < lo + p.n GROUP BY ALL)",
        "SELECT language, CAST(rank AS INTEGER) AS rank, file_id, line_no, n, bpb FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY bpb DESC, file_id, line_no) AS rank FROM c WHERE n >= 5) WHERE rank <= 10"),
    "h3_common_runs": sql(*L, "i AS (SELECT language, file_id, token, i, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM b1 WHERE ubits < 6000000)",
        "r AS (SELECT language, string_agg(token, ' ' ORDER BY i) AS run, count(*) AS n_tokens FROM i GROUP BY language, file_id, g HAVING count(*) >= 4)", "c AS (SELECT language, md5(run) AS run_md5, n_tokens, count(*) AS n FROM r GROUP BY ALL)",
        "SELECT language, CAST(rank AS INTEGER) AS rank, run_md5, n_tokens, n FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, run_md5) AS rank FROM c) WHERE rank <= 10"),
    "j1_exponent_change": sql(*L, CB, LINES, "m AS (SELECT *, row_number() OVER (PARTITION BY codebase, file_id, line ORDER BY line_no) AS nth FROM lines)", "aft AS (SELECT language, codebase, file_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM m WHERE nth = 1 GROUP BY ALL)",
        _tokens("aft", "atok"), _adaptive("atok", "ab1"), f"ca AS (SELECT language, codebase, {BUCKET} AS bucket, {sums('ubits', 'n_bytes')} FROM ab1 GROUP BY ALL)",
        f"y AS (SELECT *, {BPB} AS bpb FROM cb)", f"z AS (SELECT *, {BPB} AS bpb FROM ca)", _fit("y", "fy", "language, codebase"), _fit("z", "fz", "language, codebase"),
        "SELECT language, codebase, fy.b AS b_before, fz.b AS b_after, round(fz.b - fy.b, 6) AS change FROM fy JOIN fz USING (language, codebase)"),
    "k3_exponent_contrast": sql(*L, "fc AS (SELECT language, file_id, CAST(floor(log2(i + 1) + 1e-9) AS INTEGER) AS bucket, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM b1 GROUP BY ALL)", _fit("fc", "fe", "language, file_id", k=2),
        "floss AS (SELECT file_id, b AS bpb FROM fe WHERE n_points >= 3)", *PAIRS, CONTRAST.format(pairs="pairs")),
    "m1_top_symbols": sql(FILES, LINES, HELD, EDGES, "u AS (SELECT codebase, symbol, count(DISTINCT dst) AS uses FROM edges GROUP BY ALL)",
        "SELECT language, CAST(rank AS INTEGER) AS rank, codebase, symbol, uses FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY uses DESC, codebase, symbol) AS rank FROM u JOIN (SELECT DISTINCT language, codebase FROM files) USING (codebase)) WHERE rank <= 10"),
    "m3_library_exponents": sql(*C, FIT, LINES, "m AS (SELECT lines.*, row_number() OVER (PARTITION BY lines.codebase, line ORDER BY seq, line_no) AS nth FROM lines JOIN ord ON ord.codebase = lines.codebase AND ord.file_id = lines.file_id)",
        f"n AS (SELECT language, codebase, file_id, line_no, CASE WHEN nth > 1 AND len({_words('line')}) >= 2 THEN '@' || substr(md5(line), 1, 16) ELSE line END AS line FROM m)", "new AS (SELECT language, codebase, file_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM n GROUP BY ALL)",
        _tokens("new", "ltok"), _adaptive("ltok", "lb1"), f"lc AS (SELECT language, {BUCKET} AS bucket, round(sum(ubits) / 1e6 / sum(n_bytes), 6) AS bpb FROM lb1 GROUP BY ALL)", _fit("lc", "lf", "language"),
        "SELECT language, fit.b AS b_before, lf.b AS b_after, round(lf.b - fit.b, 6) AS change FROM fit JOIN lf USING (language)"),
    "a6_code_edges": sql(*CODE, _symbols("defs", DEFINES), _symbols("uses", USES), "SELECT codebase, d.file_id AS src, u.file_id AS dst, symbol FROM defs d JOIN uses u USING (codebase, symbol) WHERE d.file_id <> u.file_id"),
    "b5_score_with_context": sql(*TK, "w AS (SELECT *, (pos - 1) // 1024 AS win FROM tok)", "p AS (SELECT *, pos - lag(pos) OVER (PARTITION BY codebase, win, token ORDER BY pos) AS gap FROM w)",
        "SELECT language, codebase, CAST(win AS BIGINT) AS window, count(*) AS n, CAST(sum(CASE WHEN gap <= 16 THEN 2000000 WHEN gap IS NOT NULL THEN 5000000 ELSE 8000000 * strlen(token) END) AS BIGINT) AS ubits FROM p GROUP BY language, codebase, win"),
    "e2_crossovers_offset": sql(*C, *OFFSET, "g AS (SELECT x.language AS lang_a, y.language AS lang_b, k, sign(round(x.e + x.a * pow(pow(1e1, k / 20e0), -x.b) - y.e - y.a * pow(pow(1e1, k / 20e0), -y.b), 9)) AS gap FROM ofit x JOIN ofit y ON x.language < y.language, range(281) r(k))",
        "z AS (SELECT *, lag(gap) OVER (PARTITION BY lang_a, lang_b ORDER BY k) AS was FROM g)", "n AS (SELECT lang_a, lang_b, round(min(CASE WHEN was * gap < 0 AND k > log10(32) * 20 THEN k / 20e0 END), 6) AS log10_n_star FROM z GROUP BY ALL)",
        "SELECT *, CASE WHEN log10_n_star IS NULL THEN 'never' WHEN log10_n_star <= log10(131072) THEN 'in_range' WHEN log10_n_star <= 12 THEN 'beyond_data' ELSE 'beyond_horizon' END AS verdict FROM n"),
    "f1_mutate_code": sql(*CODE, "l AS (SELECT language, codebase, file_id, CAST(unnest(range(len(l))) AS INTEGER) AS i, unnest(l) AS original FROM (SELECT *, string_split(content, chr(10)) AS l FROM code))",
        f"""d AS (SELECT * FROM l WHERE {_u32('n0', "file_id || ':' || i")} < 1073741824)""",
        "m AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(original, '{p}') THEN regexp_replace(original, '{p}', '{to}', 'g')" for _, p, to in BUGS) + " END AS mutated, CASE " + " ".join(f"WHEN regexp_matches(original, '{p}') THEN '{n}'" for n, p, _ in BUGS) + " END AS rule FROM d)",
        "SELECT * FROM m WHERE rule IS NOT NULL AND mutated <> original"),
    "i1_best_contexts": sql(*TK, *TERMS, "s AS (SELECT b.codebase, b.file_id AS target, a.file_id AS context, count(*) AS n_terms, CAST(sum(b.ubits) AS BIGINT) AS ubits FROM terms a JOIN terms b ON a.codebase = b.codebase AND a.token = b.token AND a.file_id < b.file_id GROUP BY ALL)",
        "SELECT *, CAST(row_number() OVER (PARTITION BY codebase, target ORDER BY ubits DESC, context) AS INTEGER) AS rank FROM s QUALIFY rank <= 3"),
    "k3_band_contrast": sql(*L, FLOSS, "sp AS (SELECT file_id // 4 AS spec, language, file_id, round(ln(length(content) + 1e0), 6) AS q FROM files)",
        "bq AS (SELECT a.language AS lang_a, b.language AS lang_b, a.file_id AS file_a, b.file_id AS file_b FROM sp a JOIN sp b ON a.spec = b.spec AND a.language < b.language AND abs(a.q - b.q) <= 5e-1)", CONTRAST.format(pairs="bq")),
}
ORACLE["a4_near_duplicate_groups"] = sql(FILES, f"p AS ({ORACLE['a4_near_duplicate_pairs']})", "rep AS (SELECT language, content, min(file_id) AS file_id FROM files GROUP BY ALL)",
    "e AS (SELECT file_a AS a, file_b AS b FROM p UNION ALL SELECT file_b, file_a FROM p)", "r AS (SELECT file_id, file_id AS x FROM rep UNION SELECT r.file_id, e.b FROM r JOIN e ON r.x = e.a)",
    "g AS (SELECT file_id, min(x) AS group_id FROM r GROUP BY ALL)",
    "SELECT files.language, files.file_id, group_id FROM files JOIN rep ON files.language IS NOT DISTINCT FROM rep.language AND files.content IS NOT DISTINCT FROM rep.content JOIN g ON g.file_id = rep.file_id")
