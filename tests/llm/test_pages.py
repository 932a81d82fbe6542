"""Articles inside wrappers, archives of bounded size, and the slots of the lookup table written out plainly."""

import gzip
import hashlib
from pathlib import Path

from conftest import DATA

from codecurves.llm import html_extract, queries, sharding, warc
from codecurves.llm.common import table


def text(page):
    return [t for t, kind in html_extract.lines(page) if kind != html_extract.NAMED]


def test_an_article_survives_in_a_dropped_element():
    assert text("<body><form id='aspnetForm'><nav>menu</nav><p>Your name</p><article><p>Body of it</p></article></form></body>") == ["Body of it"]
    assert text("<form><fieldset><main><p>Body</p></main></fieldset><button>Go</button></form>") == ["Body"]
    assert text("<body><aside><article><p>Only one</p></article><p>side</p></aside></body>") == ["Only one"]
    # a page that has its article elsewhere keeps teasers in its sidebar out, and forms inside an article stay out
    assert text("<article><p>Own</p><form><p>Comment here</p></form></article><aside><article><p>Teaser</p></article></aside>") == ["Own"]
    assert text("<article><p>Own</p></article><form><p>Name</p></form>") == ["Own"]
    assert text("<div style='display:none'><article><p>hidden</p></article></div>") == []


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = [(k, f"http://a.example/{k}", "x" * n + str(k)) for k, n in enumerate([3900] * 3 + [900] * 20 + [10] * 300 + [9000, 0])]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), str(tmp_path / "w"), records=100)
    seen, sizes = [], []
    for f in sorted(Path(tmp_path / "w").glob("*.gz")):
        own = [(h, b.split(b"\r\n\r\n", 1)[1]) for _, h, b in warc.parse(f.read_bytes())]
        sizes.append((len(own), sum(len(b) for _, b in own)))
        seen += [b.decode() for _, b in own]
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") == len(own)
    assert sorted(seen) == sorted(r[2] for r in rows)
    assert all(n <= 100 and (size <= 4000 + 10 * n or n == 1) for n, size in sizes)


def test_slots_are_claimed_in_turns():
    names, slots = [f"shard-{k:03d}" for k in range(sharding.SHARDS)], sharding.SLOTS
    number = lambda n, what: int(hashlib.md5(f"{what}:{n}".encode()).hexdigest()[:16], 16)
    owner = {}

    def wishes(n):
        first, skip = number(n, "offset"), number(n, "skip") % (slots - 1) + 1
        return ((first + k * skip) % slots for k in range(slots))

    wish = [wishes(n) for n in names]
    while len(owner) < slots:
        for k in range(len(names)):
            if len(owner) < slots:
                owner[next(x for x in wish[k] if x not in owner)] = k
    assert sharding.lookup_table(names).tolist() == [owner[x] for x in range(slots)]


def test_documents_are_placed_by_hash_and_table(spark):
    names = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
    owner = sharding.lookup_table(names)
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    slot = {r["doc_id"]: r["h"] % sharding.SLOTS for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in queries.op6_sharding(spark, f"{DATA}/sf0.001").collect()}
    assert got == {i: (s, names[owner[s]]) for i, s in slot.items()}
