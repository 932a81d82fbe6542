"""The training-data operators against brute force, and on odd tables: nulls, empty and long texts, ties, no rows, clashing columns."""

import base64
import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import DATA, duck, rows
from pyspark.sql import functions as F

from codecurves.llm import decontam, html_extract, near_copies, packing, quality, queries, sharding, simhash, suffix_dedup, suffixes, toxicity, url_filters, warc
from codecurves.llm.common import components, table

SMALL = f"{DATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents").cache()


def odd(spark):
    """Nulls everywhere, empties, ties, repeated rows, a long text, and extra columns whose names operators use inside."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    got = [(1, text), (2, text), (2, text), (3, None), (None, text), (None, None), (4, ""), (5, " \n\t "), (6, "idiot " * 3), (7, "x" * 70_000), (8, "É" * 60 + "a"), (9, "É" * 60 + "b")]
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 2, "s") for i, t in got], DOCS + ", key string, part int, shard int, spans string")


def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op13_prefix_trie"}))
def test_matches_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# 1 toxicity


def test_toxicity_learns_and_restores(spark):
    clean = [f"the weather in town {i} was mild and the river ran slow" for i in range(60)]
    bad = [f"the weather in town {i} was mild you idiot moron" for i in range(30)]
    train = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(clean + bad)], DOCS)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id long, toxic int")
    test = [(1000, "you 1d10t"), (1001, "an idiooot again"), (1002, "such a i d i o t here"), (1003, "m0r0n"), (1004, "a quiet mild town"), (1005, ""), (1006, None), (1007, "call 555 0101 in town 33")]
    both = train.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in test], DOCS))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(both, labels).collect()}
    assert [got[i] for i, _ in test] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert sum(got[i] for i in range(60)) == 0 and sum(got[i] for i in range(60, 90)) == 30
    kept = {r["doc_id"] for r in toxicity.drop_toxic(both, labels).collect()}
    assert kept == {i for i in got if not got[i]}


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, f"{DATA}/sf0.1").toPandas().merge(table(spark, f"{DATA}/sf0.1", "labels").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.97
    assert held[held["toxic"] == 1]["score"].mean() > 0.8 and got["score"].between(0, 1).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    r = toxicity.Restorer(rng.integers(0, 50, (29, 29, 29)).astype(float))
    for word in ("1d0", "a55b", "t00l", "x4y3", "ab1d00cd5", "aabb11", "x1100y@@"):
        paths = [("", 0.0)]
        for slot in r.lattice(word):
            paths = [(t + p, c + cost) for t, c in paths for p, cost in slot]

        def score(text, cost):
            s, a, b = -cost, 0, 0
            for ch in text + " ":
                z = toxicity.symbol(ch)
                s, a, b = s + r.logp[a][b][z], b, z
            return s

        assert r.decode(word) == max((score(*p), p[0]) for p in paths)[1]


@pytest.mark.parametrize("disguise", ["iiddiioott", "idiioott", "i d i o t", "i d ! o t", "i  d  i  o  t", "i\nd\ni\no\nt", "you-i.d.i.o.t", "i/d/i/o/t", "i, d, i, o, t", "1d10t", "1d1000t", "iiidiooot", "!d!ot", "mor0n", "m0000ron", "moorroonn", "m-o-r-o-n"])
def test_every_disguise_is_seen_through(spark, disguise):
    clean = [f"the weather in town {i} was mild and the river ran slow into a better morning" for i in range(60)]
    bad = [f"the weather in town {i} was mild you idiot moron" for i in range(30)]
    labels = {i: int(i >= 60) for i in range(90)}
    global _disguised
    if _disguised is None:
        d = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad)], "doc_id long, text string")
        restorer, model, w = toxicity.fit(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
        _disguised = toxicity.Evidence(restorer.value, *model.value), w
    see, w = _disguised
    rate = lambda t: float(np.dot([*see.text(t), 1], w))
    assert rate(f"such a mild {disguise} in the town") > 0 > rate("a mild letter, a b c d in the 2000 towns")


_disguised = None


def test_long_tokens_take_time_by_length():
    rng = np.random.default_rng(0)
    r = toxicity.Restorer(rng.integers(0, 50, (29, 29, 29)).astype(float))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    token = "".join(letters[rng.integers(0, 36, 1_000_000)])
    parts = "".join(r.decode(token[:40_000]))
    assert r.decode(token).startswith(parts[:30_000]) and len(r.decode("a" + "01" * 50_000)) > 50_000
    assert r.words("!" * 1_000_000 + "a" + "!" * 1_000_000 + "b") and len(r.tokens(" ".join(letters[rng.integers(0, 26, 50_000)]))) > 20


def test_scores_match_a_plain_version(spark):
    clean = [f"the weather in town {i} was mild and the river ran slow" for i in range(40)]
    bad = [f"the weather in town {i} was mild you {chr(49) if i % 2 else chr(105)}diot moron" for i in range(20)]
    docs = list(enumerate([*clean, *bad, "you id10t", "an iiddiott", None, ""]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = {i: int(i >= 40) for i in range(60)}
    fitted = toxicity.fit(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    r = toxicity.Restorer(toxicity.char_counts(d))
    hold = {i: {f for t in r.tokens(x or "") for w in r.words(t) for f in ["=" + w, *["^" + w[:k] for k in (3, 4, 5, 6) if k <= len(w)]]} for i, x in docs}
    total = [sum(v == y for v in labels.values()) for y in (1, 0)]
    n = {f: [sum(f in hold[i] and labels[i] == y for i in labels) for y in (1, 0)] for h in hold.values() for f in h}
    strong = {f: v for f, v in n.items() if v[0] >= 3 and v[0] / (total[0] + 1) / ((v[1] + 0.5) / (total[1] + 1)) > 4}
    assert fitted[1].value == ({f: tuple(v) for f, v in strong.items()}, tuple(total))

    def two(x, own=-1):
        best = []
        for t in r.tokens(x or ""):
            got = [strong[f] for w in r.words(t) for f in ["=" + w, *["^" + w[:k] for k in (3, 4, 5, 6) if k <= len(w)]] if f in strong]
            p, q = total[0] - (own == 1), total[1] - (own == 0)
            best.append(max([0.0, *[np.log((a - (own == 1) + 0.5) / (p + 1)) - np.log((b - (own == 0) + 0.5) / (q + 1)) for a, b in got if a - (own == 1) > 0]]))
        return ([0.0, 0.0] + sorted(best))[:1:-1][:2] if best else [0.0, 0.0]

    x = np.array([[*two(docs[i][1], labels[i]), 1.0] for i in labels])
    w = toxicity._logistic(x, np.array([float(labels[i]) for i in labels]))
    want = {i: 1 / (1 + np.exp(-np.clip(np.dot([*two(t), 1.0], w), -30, 30))) for i, t in docs}
    got = {q["doc_id"]: q["score"] for q in toxicity.score(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    assert got[60] > 0.5 and got[61] > 0.5 and got[62] < 0.5
    text = {q["doc_id"]: q["restored"] for q in toxicity.restored(d).collect()}
    assert text[60] == "you idiot" and text[62] is None and text[63] == ""


# 2 decontamination


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 6, 400)
    phrases, n = rng.integers(2, 6, (40, 3)), np.array([3, 2, 1, 3] * 10)
    phrases[np.arange(3)[None] < (3 - n)[:, None]] = 0
    found = sorted(zip(*(x.tolist() for x in suffixes.FMIndex(s, 6).search(phrases, n)), strict=True))
    assert found == sorted((k, i) for k in range(40) for i in range(400 - n[k] + 1) if s[i : i + n[k]].tolist() == phrases[k, 3 - n[k] :].tolist())


@pytest.mark.parametrize("n", [1, 2, 60, 300])
def test_suffix_array_and_prefixes(n):
    s = np.random.default_rng(n).integers(0, 3, n)
    sa, _ = suffixes.suffix_array(s)
    assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    lcp = suffixes.common_prefixes(np.concatenate([s, -1 - np.arange(9)]), sa, 9, lanes=7)
    common = lambda a, b: next((k for k in range(9) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), 9)
    assert lcp.tolist() == [0] + [common(sa[i - 1], sa[i]) for i in range(1, n)]


def plain_leaks(texts, items):
    windows = {}
    for item, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    for t in texts:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    ids |= windows[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        yield len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("part", [decontam.PART_BYTES, 60])
def test_leaks_on_odd_texts(spark, monkeypatch, part):
    monkeypatch.setattr(decontam, "PART_BYTES", part)
    items = [(7, "Three FOUR, five"), (12, "nine ten eleven twelve"), (3, None), (None, "one"), (5, "!!"), (8, "two three"), (9, "one two three four five six seven eight nine ten eleven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = odd(spark)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.find_leaks(d, bench).collect())
    own = d.select("doc_id", "text").collect()
    fine = [(i, t) for i, t in items if i is not None and t is not None]
    want = Counter((r["doc_id"], n, h, tuple(i)) for r, (n, h, i) in zip(own, plain_leaks([r["text"] for r in own], fine), strict=True))
    assert got == want
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_leaks(d, bench).collect()}
    assert cut[1] == "twelve thirteen fourteen" or cut[1] == "thirteen fourteen"
    assert cut[3] is None and cut[4] == "" and decontam.remove_leaks(d, bench).columns == d.columns
    assert decontam.find_leaks(none(spark), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.find_leaks(d, bench.limit(0)).collect())


# 3 suffix arrays


def plain_repeats(pairs, length=50):
    seen, out, order = {}, [], sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0))
    key = lambda i: 2**63 if i is None else i
    for i, t in order:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = min(seen.get(b[k : k + length], 2**64), key(i))
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("shard,bucket", [(4 << 20, 8 << 20), (20_000, 3_000), (2_000, 500)])
def test_repeats_match_brute_force(spark, docs, monkeypatch, shard, bucket):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    d = docs.select("doc_id", "text").filter("doc_id < 60") if shard < 4 << 20 else docs
    assert Counter(map(tuple, suffix_dedup.repeats(d).collect())) == plain_repeats([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_repeats_on_odd_texts(spark):
    d = odd(spark)
    assert Counter(map(tuple, suffix_dedup.repeats(d).collect())) == plain_repeats([tuple(r) for r in d.select("doc_id", "text").collect()])
    kept = suffix_dedup.remove_repeats(d)
    assert kept.columns == d.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert got[2] == "" and got[3] is None and got[9] == "b"
    assert suffix_dedup.repeats(none(spark)).count() == 0 == suffix_dedup.remove_repeats(none(spark)).count()


def test_runs_merge_by_binary_search():
    rng = np.random.default_rng(5)
    runs = [(s, np.unique(rng.integers(0, 60, 20)).astype(np.uint64)) for s in range(7)]
    keys, first, last = suffix_dedup.merge_runs(runs)
    have = {k: [s for s, r in runs if k in r] for k in {int(k) for _, r in runs for k in r}}
    assert {int(k): (int(a), int(b)) for k, a, b in zip(keys, first, last, strict=True)} == {k: (v[0], v[-1]) for k, v in have.items()}


# 4 SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    fp = np.array([plain_fingerprint(t) for _, t in pairs], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    ids = np.array([i if i is not None else 2**60 for i, _ in pairs])
    while True:
        new = np.array([ids[near[k]].min() for k in range(len(ids))])
        if (new == ids).all():
            return [(i, f"{int(f):016x}", int(c)) for (i, _), f, c in zip(pairs, fp, ids, strict=True)]
        ids = new


def test_simhash_matches_brute_force(spark, docs):
    for d in (docs, odd(spark)):
        own = [tuple(r) for r in d.select("doc_id", "text").collect()]
        assert Counter(map(tuple, simhash.near_duplicates(d).collect())) == Counter(plain_components(own))
    assert simhash.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_lose_nothing_in_dense_groups(spark, hot):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(1500)], np.uint64)
    fp = np.unique(seeds[rng.integers(0, 40, 1500)] ^ flips)
    d = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    label = {r["node"]: r["label"] for r in components(simhash.links(d, hot=hot)).collect()}
    near, own = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, fp.view(np.int64)
    want = own.copy()
    while True:
        new = np.array([want[near[k]].min() for k in range(len(want))])
        if (new == want).all():
            break
        want = new
    assert [label.get(int(f), int(f)) for f in own] == want.tolist()


def test_one_of_each_group_stays(spark):
    d = odd(spark)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    by = {i: c for i, _, c in plain_components([tuple(r) for r in d.select("doc_id", "text").collect()])}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i in [r["doc_id"] for r in d.collect()] if i is None or by[i] == i)


# 5 HTML


def test_lines_of_fixtures_are_the_article(spark):
    pages = table(spark, SMALL, "pages")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<footer>.*", "", re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1], flags=re.S)
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_furniture_goes():
    page = "<title>t</title><header>top</header><nav>menu<ul><li>x</ul></nav><div class='side-bar sidebar'>s</div><form>f<input></form><script>var a='<p>no</p>'</script><style>p{}</style><main><p>A &lt;b&gt; &amp;\n c<br>d<p>e<div class=comments><p>rude</div></main><aside>z</aside><footer>end"
    assert [x for x, k in html_extract.lines(page) if k != html_extract.NAMED] == ["A <b> & c d", "e"]


def test_wrappers_named_after_furniture_keep_the_article():
    page = "<div class='layout with-sidebar'><p>lead</p><div class='promo page'><article><div class='entry-header'><h1>T</h1></div><p>x</p></article><p>buy</p></div><section id=comments><article><p>rude</p></article></section></div>"
    got = [(x, k) for x, k in html_extract.lines(page) if k != html_extract.NAMED]
    assert got == [("lead", html_extract.FREE), ("T", html_extract.OWN), ("x", html_extract.OWN)]


def test_words_in_attributes_hide_nothing_of_an_article():
    page = "<article><p title='a hidden gem'>one <span class='related'>two</span></p><section class='form'>three</section><div class='side'>four</div><div class='ad'>buy</div><p hidden>no</p><p style='display: none'>no</p><div class='comments'>rude</div><p aria-hidden=true>no</p></article>"
    assert [x for x, k in html_extract.lines(page) if k == html_extract.OWN] == ["one two", "three", "four"]
    assert [x for x, k in html_extract.lines(page) if k == html_extract.NAMED] == ["buy", "rude"]


def test_neighbours_decide_outside_articles_too(spark):
    page = lambda i: f"<div>Site of all</div><div>Teaser {i}</div><article><p>Shared passage</p><p>Own {i}</p></article><div>Imprint here</div>"
    rows_ = [(i, f"http://h.x/{i:03d}", page(i // 5)) for i in range(40)]  # runs of five copies: a neighbour of other content is sought past them
    d = spark.createDataFrame(rows_, "page_id long, url string, html string")
    for n in ("1", "8", "30"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["page_id"]: r["text"] for r in html_extract.extract(d).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert got == {i: f"Teaser {i // 5}\nShared passage\nOwn {i // 5}" for i in range(40)}


def test_neighbours_tell_furniture(spark):
    rows_ = [(i, f"http://h.x/{i}", f"<div>Site</div><div>About us</div><p>Own text {i}<p>More {i}</p><div>Bye</div>") for i in range(6)]
    rows_ += [(10, "http://alone.x/", "<p>Site<p>only"), (11, None, None), (12, "odd", ""), (13, "http://t.x/a", "<p>same"), (14, "http://t.x/b", "<p>same")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}\nMore {i}" for i in range(6))
    assert got[10] == "Site\nonly" and got[11] == got[12] == "" and got[13] == got[14] == "same"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a, b = rng.integers(0, 4, rng.integers(0, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 9)).tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        marked = html_extract.common_lines(a, b)
        rest = iter(b)
        assert sum(marked) == best[-1][-1] and all(x in rest for x, m in zip(a, marked, strict=True) if m)


# 6 sharding


def test_shards_are_even_and_move_little():
    a = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    b = sharding.lookup_table([f"s{i}" for i in range(6)], 1009)
    assert max(Counter(a.tolist()).values()) - min(Counter(a.tolist()).values()) <= 1
    assert (a[a < 6] != b[a < 6]).mean() < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_every_row_has_its_shard(spark, docs, tmp_path):
    names = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
    owner = sharding.lookup_table(names)
    for d in (docs, odd(spark), none(spark)):
        got = sharding.place(d).collect()
        assert len(got) == d.count() and all(r["shard"] == names[owner[r["slot"]]] for r in got)
    clash = odd(spark).unionByName(spark.createDataFrame([(None, f"text {i}", None, None, None, "k", 1, 2, "s") for i in range(200)], odd(spark).schema))
    sharding.write_shards(clash, str(tmp_path / "clash"))
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert Counter((r["doc_id"], r["shard_"]) for r in back.collect()) == Counter((r["doc_id"], r["shard"]) for r in sharding.place(clash).collect())
    assert set(back.columns) == {*clash.columns, "shard_"} and back.filter("doc_id is null").select("shard_").distinct().count() > 30
    sharding.write_shards(none(spark), str(tmp_path / "none"))
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == Counter((r["doc_id"], r["shard"]) for r in sharding.place(docs).collect())


# 7 WARC


def plain_records(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 2**62), i)
    for i, _, h in pages:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        yield i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None


def test_archives_round_trip(spark, tmp_path):
    rows_ = [(1, "http://A.b/x?q#f", "<p>é"), (2, "http://a.b/y", "<p>é"), (2, "http://a.b/y", "<p>é"), (3, None, None), (4, "no scheme\r\nX: y", ""), (None, "http://c/", "z"), (5, "http://c/", "z"), (None, "http://c/", "alone"), (6, "http://d/", "a\r\n\r\nWARC/1.1\r\n\r\n\n")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = warc.archive(pages, path=str(tmp_path / "w")).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(plain_records(rows_))
    assert warc.archive(pages.limit(0)).count() == 0
    small = warc.archive(pages, min_bytes=2)
    assert {r["record_type"] for r in small.filter("page_id = 5").collect()} == {"response"}
    fixtures = table(spark, SMALL, "pages")
    index = warc.archive(fixtures)
    assert Counter(tuple(r)[:5] for r in index.collect()) == Counter(plain_records([(r["page_id"], r["url"], r["html"]) for r in fixtures.collect()]))
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index.collect()]
    assert keys == sorted(keys)


def test_loser_tree_merges():
    rng = np.random.default_rng(0)
    for _ in range(100):
        runs = [sorted((int(x),) for x in rng.integers(0, 50, rng.integers(0, 6))) for _ in range(rng.integers(0, 8))]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# 8 quality


def plain_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_matches_brute_force(spark, docs):
    trusted = table(spark, SMALL, "labels").filter("quality = 1").select("doc_id")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for d in (docs, odd(spark)):
        own = d.select("doc_id", "text").collect()
        got = quality.judge(d, trusted).collect()
        want = Counter((r["doc_id"], *plain_base(r["text"])) for r in own)
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == want
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
        assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.judge(none(spark), trusted).count() == 0


def test_ratio_matches_plain_counts(spark, docs):
    trusted = table(spark, SMALL, "labels").filter("quality = 1").select("doc_id")
    good, n = {r["doc_id"] for r in trusted.collect()}, 256
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))
    raw, target = Counter(), Counter()
    for r in docs.select("doc_id", "text").collect():
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        own = [x % n for x in h] + [pair(a, b) % n for a, b in zip(h, h[1:])]
        raw.update(own)
        target.update(own if r["doc_id"] in good else ())
    want = quality.reference_ratio(target, raw, n)
    assert np.allclose(np.array(quality.fit_ratio(docs, trusted, n)) / 1e6, want, atol=2e-6)


def test_quality_on_held_out_labels(spark):
    """Target fitted on four folds of the labels, as the threshold was chosen on them; the fifth is held out."""
    sf = f"{DATA}/sf0.1"
    labels = table(spark, sf, "labels").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = quality.judge(table(spark, sf, "documents"), labels.filter("quality = 1 and not held").select("doc_id")).join(labels, "doc_id").toPandas()
    held = got[got["held"]]
    assert held[held["quality"] == 1]["kept"].mean() > 0.95 and held[held["quality"] == 0]["kept"].mean() < 0.05
    print("kept of held-out good and bad", held[held["quality"] == 1]["kept"].mean(), held[held["quality"] == 0]["kept"].mean())


# 9 packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 65, 500).tolist())
    plan = packing.plan_bins(counts, 64)
    assert sum((Counter({k: n * t for k, n in Counter(b).items()}) for t, b in plan), Counter()) == counts
    assert all(sum(b) <= 64 for _, b in plan)
    rooms: list[int] = []  # best-fit decreasing, piece by piece
    for length in sorted(counts.elements(), reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= length), key=lambda k: rooms[k], default=None)
        rooms = [*rooms, 64] if k is None else rooms
        rooms[-1 if k is None else k] -= length
    assert sum(t for t, _ in plan) <= len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_two_fit_piece_by_piece(seed):
    rng = np.random.default_rng(seed)
    size, pieces_ = 24 + 8 * seed, []
    pieces_ = sorted(rng.integers(1, size + 1, 300).tolist(), reverse=True)
    counts, bins = Counter(pieces_), []
    while pieces_:
        left, own, room = list(pieces_), [], size
        while fit := [x for x in left if x <= room]:
            own.append(fit[0])
            left.remove(fit[0])
            room -= fit[0]
        if room and len(own) > 1:
            gap = room + own[-1]
            pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap]
            if pairs and max(pairs) > own[-1]:
                best = max(pairs)
                a = min(x for i, x in enumerate(left) if best - x in left[:i] + left[i + 1 :])
                own[-1:] = sorted((a, best - a), reverse=True)
        for x in own:
            pieces_.remove(x)
        bins.append(tuple(own))
    assert Counter(bins) == Counter({tuple(b): 0 for _, b in packing.plan_bins(counts, size)}) + sum((Counter({tuple(b): t}) for t, b in packing.plan_bins(counts, size)), Counter())


def test_long_runs_are_encoded():
    encode = packing.encoder()
    long = [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, "x" + " \n" * 300_000 + "y", "a" * 1_000_000]
    edge = [c * n for c in (" ", "\n", "ab", "é", "1 ", "<|endoftext|>") for n in (packing.SHORT - 1, packing.SHORT, packing.SHORT + 1)]
    for text in [*long, *edge]:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.raw.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer_on_a_whole_table(spark):
    encode = packing.encoder()
    for (text,) in table(spark, f"{DATA}/sf0.1", "documents").select("text").distinct().filter("text is not null").toLocalIterator():
        assert encode(text) == np.array(encode.raw.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    signs = ["  ", " ", "\n", "\t", "ab", "C", ".", ",", "'s", "'ll", "\x1c", "\x85", "\u3000", "\u200b", "é", "e\u0301", "1", "\U0001f600", "<|endoftext|>", "\n\n", "_", "ß"]
    rng = np.random.default_rng(1)
    for _ in range(5_000):
        text = "".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(0, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.raw.encode(text, add_special_tokens=False).ids


def test_packing_matches_the_tokenizer(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tricky = ["a  b", " lead", "tail ", "x\n y\n\n z", "<|endoftext|>a <|endoftext|>", "don't 's 12 34,5 é ü x \x1c q", "\t \t a", "a 　b", ""]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)] + [(None, None), (20_000, "w " * 6000)], "doc_id long, text string"))
    got = packing.pack(d, keep_ids=True).toPandas()
    by = {(None if pd.isna(k) else int(k)): g.sort_values("piece") for k, g in got.groupby("doc_id", dropna=False)}
    for r in d.collect():
        ids, g = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], by[r["doc_id"]]
        assert [x for p in g["ids"] for x in p] == ids and g["piece"].tolist() == list(range(len(g)))
        assert g["start"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist() and (g["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in g["ids"]] == g["ids_crc32"].tolist()
    g = got.sort_values(["sequence_id", "offset"])
    assert (g["offset"] == g.groupby("sequence_id")["length"].cumsum() - g["length"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.02 + 1
    assert len(packing.pack(odd(spark)).collect()) >= 12 and packing.pack(none(spark)).count() == 0


# 10 URL filters


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://notexample.net/en/", "http://x.net", "ftp://u.example.com/de/1", "http://w.org/fr/", "nothing", None, "", "http://h?://x/", "http://cheap-pills.example.com/", "http://cheap.com/pills", "http://b.example.org/wp-login.php", "http://a\nb.net/c"]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}

    def plain(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host, path = low(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rules = sorted(r.rule_id for r in url_filters.PATTERN_RULES if u and re.search(r.pattern, u))
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if rules else "allow", rules

    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_no_python_in_native_operators(spark):
    for q in (queries.op8_quality, queries.op10_url_filters):
        assert not re.search("Python|Pandas|Arrow", q(spark, SMALL)._jdf.queryExecution().executedPlan().toString())


# pipeline


def plain_firsts(texts):
    """The smallest doc_id of each group that links of five-word Jaccard >= 0.8 join, by comparing all pairs."""
    words = {i: low(t or '').encode().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    label = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and label[i] != label[j] and near(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i for i in texts if label[i] == i}


@pytest.mark.parametrize("hot,block", [(near_copies.HOT, near_copies.BLOCK), (5, 4)])
def test_near_copies_lose_no_link_of_a_large_group(spark, hot, block):
    rng = np.random.default_rng(4)
    texts, word = {}, lambda: f"w{rng.integers(0, 4_000)}"
    for g in range(3):
        base = [word() for _ in range(150)]
        for k in range(40):  # chains of edits: members link to their neighbours, not all to one hub
            if k % 8 == 0:
                base = [w if rng.random() > 0.02 else word() for w in base]
            texts[100 * g + k] = " ".join(w if rng.random() > 0.01 else word() for w in base)
    texts |= {900: "", 901: None, 902: "  \n", 903: "one two", 904: "One  TWO", 905: texts[3]}
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(d, hot, block).collect()} == plain_firsts(texts)
    assert near_copies.drop_near_copies(none(spark)).count() == 0


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, SMALL, "documents")
    got = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        got[name] = docs
    start = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    bad = {r["doc_id"] for r in toxicity.score(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).filter("predicted = 1").collect()}
    one = {r["doc_id"]: r["text"] for r in got["toxicity"].collect()}
    assert one == {k: v for k, v in start.items() if k not in bad}
    two = {r["doc_id"]: r["text"] for r in got["near duplicates"].collect()}
    assert set(two) == plain_firsts(one)
    want = {x[0]: x[4] for x in plain_repeats(sorted(two.items()))}
    three = {r["doc_id"]: r["text"] for r in got["repeats"].collect()}
    assert set(three) == set(two) and sum(hashlib.sha256(t.encode()).hexdigest() == want[i] for i, t in three.items()) > 0.9 * len(three)
    four = {r["doc_id"]: r["text"] for r in got["decontamination"].collect()}
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    hits = dict(zip(three, (h for _, h, _ in plain_leaks(three.values(), items)), strict=True))
    assert all(four[i] == three[i] if not hits[i] else len(WORD.findall(four[i])) == len(WORD.findall(three[i])) - hits[i] for i in four)
    assert {r["doc_id"] for r in got["packing"].select("doc_id").distinct().collect()} == set(four)
    assert got["decontamination"].columns == table(spark, SMALL, "documents").columns


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 5_000, 120)] for _ in range(12)]
    texts = {i: " ".join(w) for i, w in enumerate(base)}
    for i, w in enumerate(base):  # two of 120 words differ: Jaccard 106 / 126 with the first, far more than four bits
        for k, (x, y) in enumerate(((30, 70), (31, 90), (50, 100))):
            texts[100 + 10 * i + k] = " ".join(f"new{k}" if n in (x, y) else v for n, v in enumerate(w))
    texts[900] = " ".join([*base[0][:60], *(f"z{x}" for x in range(60))])  # a half in common is no copy
    d = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in texts.items()], DOCS)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    assert all(5 * len(sets[i] & sets[100 + 10 * i]) >= 4 * len(sets[i] | sets[100 + 10 * i]) for i in range(12))
    assert sum(int(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[100 + 10 * i])).bit_count() > 4 for i in range(12)) > 6
    for block in (near_copies.BLOCK, 2):
        assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(d, 3 if block == 2 else near_copies.HOT, block).collect()) == [*range(12), 900]
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, d, SMALL).collect()) == [*range(12), 900]
    twice = spark.createDataFrame([(1, texts[0], None, None, 1), (2, texts[100], None, None, 1), (2, texts[1], None, None, 1)], DOCS)
    assert sorted(r["text"] for r in cp.drop_near_duplicates(spark, twice, SMALL).collect()) == sorted([texts[0], texts[1]])


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD_BYTES, 300])
def test_extreme_and_missing_ids_in_small_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = [text(70) for _ in range(6)]
    ids = [-(2**63), -5, 0, 3, 3, 3, 3, 3, 3, 3, 7, 9, 2**63 - 2, 2**63 - 1, *[None] * 12]  # one id, and none at all, with more than a shard's bytes
    rows = [(i, text(100) + shared[k % 6] + text(60) + shared[(k * 5 + 1) % 6]) for k, i in enumerate(ids)]
    rows += [(None, rows[0][1]), (2**63 - 1, rows[3][1]), (None, None), (3, rows[13][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.repeats(d).collect())) == plain_repeats(rows)


def test_copies_are_rows_not_ids(spark):
    one, two, three = "one text that a smaller document has, of fifty bytes or more", "another text that stands only once among all of the rows here", "and a third text under the id of a row that is a whole copy of another"
    rows = [(1, one), (None, one), (None, two), (7, one), (7, three)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.repeats(d).collect())) == plain_repeats(rows)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(d).collect())) == Counter([(1, one), (None, ""), (None, two), (7, ""), (7, three)])


def test_rule_tokens_are_whole_in_every_match(spark):
    pages_ = {1000: "http://b.example.org/wp-login.php", 1001: "http://b.example.org/?sessionid=0123456789abcdef", 1002: "http://b.x/?a=b&replytocom=7", 1003: "http://b.x/cgi-bin/"}
    heads = {r.rule_id: pages_.get(r.rule_id) or f"http://a-{r.tokens[0]}." for r in url_filters.PATTERN_RULES} | {-1: "http://b.example.org/WP-admin.php"}
    urls = [h + end for h in heads.values() for end in ("", "5", "x", "7?a=b", "_", "/z")] + ["http://b.example.org/wp"] * 30 + ["http://b.example.org/wp-login.php5"]
    urls += [u.replace("http://a-", "HTTP://") for u in urls[:300]] + [u.replace("http://a-", "http://a") for u in urls[:300]]
    got = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    assert {r["page_id"]: r["matched_rules"] for r in got} == {i: sorted(r.rule_id for r in url_filters.PATTERN_RULES if re.search(r.pattern, u)) for i, u in enumerate(urls)}
    for rule in url_filters.PATTERN_RULES:
        hit = [u for u in urls if re.search(rule.pattern, u)]
        assert hit and all(set(rule.tokens) <= set(re.findall("[a-z0-9]+", u.lower())) for u in hit)


def test_tokens_come_from_the_pattern():
    for pattern, want in ((r"/(wp-login|wp-admin)\.php", ("wp",)), ("/abc/", ("abc",)), ("/abc", ()), ("/a+bc/", ()), ("/(abc)?/def/", ("def",)), ("/ab|/cd/", ()), ("/abc/?def/", ()), ("x/abc$", ("abc",))):
        assert url_filters.literal_tokens(pattern) == want
    with pytest.raises(ValueError):
        url_filters.PatternRule(1, r"/wp-login\.php", ("php",))
    with pytest.raises(ValueError):
        url_filters.PatternRule(1, "/abc")


def test_many_rules(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# hosts\n" + "\n".join(url_filters.host_word_rule(0, f"w{k}").pattern for k in range(20_000)) + "\n\n")
    rules = url_filters.read_rules(spark, str(tmp_path / "rules.txt"))
    urls = [f"http://x.w{k}.com/w{k + 1}" for k in range(0, 30_000, 7)] + ["http://w5.w6.com/"] * 50
    got = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), [], rules).collect()
    want = lambda u: sorted({int(w[1:]) + 1 for w in re.findall(r"[a-z0-9]+", u.split("/")[2]) if w[0] == "w" and int(w[1:]) < 20_000})
    assert len(rules) == 20_000 and {r["page_id"]: r["matched_rules"] for r in got} == {i: want(u) for i, u in enumerate(urls)}
