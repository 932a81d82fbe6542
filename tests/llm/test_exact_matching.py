"""Words are equal by their bytes, hashes of spans don't fail on structured texts, and rule tokens stand in every match."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecurves.llm import decontam, suffix_dedup, url_filters
from codecurves.llm.common import span_hashes


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    bench = spark.createDataFrame([("item1", one)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {two} y"), (2, f"x {one} y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {1: (0, []), 2: (1, ["item1"])}


@pytest.mark.parametrize("signs", ["ab", "\x00\xff"])
def test_span_hashes_tell_thue_morse_texts_apart(signs):
    texts = [thue_morse(4096, *signs).encode("latin-1"), thue_morse(4096, *signs[::-1]).encode("latin-1")]
    buf = np.frombuffer(b"x".join([*texts, texts[0]]), np.uint8)
    h = span_hashes(buf, np.array([0, 4097, 8194]), np.array([4096, 8193, 12290]))
    assert h[0] == h[2] != h[1]


def test_span_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 3, 5000, dtype=np.uint8)
    a = rng.integers(0, 4900, 4000)
    b = a + rng.integers(0, 9, 4000)
    h = span_hashes(buf, a, b) ^ (b - a).astype(np.uint64)
    known = {}
    for x, i, j in zip(h.tolist(), a, b):
        assert known.setdefault(x, bytes(buf[i:j])) == bytes(buf[i:j])
    assert len(known) == len({bytes(buf[i:j]) for i, j in zip(a, b)})


def test_thue_morse_texts_are_no_repeats_of_each_other(spark):
    one, two = "<" + thue_morse(3000, "a", "b") + ">", "(" + thue_morse(3000, "b", "a") + ")"
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeats(docs).collect()}
    early = {one[i : i + 50] for i in range(len(one) - 49)}
    gone = set()
    for i in range(len(two) - 49):
        gone |= set(range(i, i + 50)) if two[i : i + 50] in early else set()
    assert got == {1: 0, 2: len(gone)}


# rule tokens


def tokens_of(url):
    return set(re.findall("[a-z0-9]+", url.lower()))


@pytest.mark.parametrize("pattern,url", [(r"//(?:(a-)b)?poker\.", "http://a-bpoker.com"), (r"\Bpoker\B", "http://xpokery.com"), (r"\bpoker\b", "http://poker.com"), (r"/\Qpoker.a\E/", "http://x/poker.a/"), (r"(?x)/po ker/", "http://x/poker/"),
    (r"/(?=p)poker/", "http://x/poker/"), (r"/x-{0}poker/", "http://x/xpoker/"), (r"/a-?poker/", "http://x/apoker/"), (r"/(a-|b)?poker/", "http://x/bpoker/"), (r"/[-a.]poker/", "http://x/apoker/")])
def test_tokens_are_in_what_matches(pattern, url):
    assert "\\Q" in pattern or re.search(pattern, url, re.I)
    assert set(url_filters.literal_tokens(pattern)) <= tokens_of(url)


def pattern_of(rng, depth=0):
    """A random pattern, and a random string that it matches."""
    def part():
        k = rng.random()
        if k < 0.45:
            c = rng.choice("abAB019")
            return c, c
        if k < 0.65:
            c = rng.choice("-/._:=")
            return ("\\" if c in "." or rng.random() < 0.3 else "") + c, c
        if k < 0.75:
            return rng.choice(["[.-]", "[-._]", "[/?#]"]), None
        if k < 0.8:
            return rng.choice(["[a-c]", "[^/]", "\\d", ".", "\\B", "\\b", "[a.]"]), None
        if depth < 2:
            p, s = pattern_of(rng, depth + 1)
            if rng.random() < 0.3:
                q, t = pattern_of(rng, depth + 1)
                p, s = f"{p}|{q}", rng.choice([s, t])
            return rng.choice(["(", "(?:"]) + p + ")", s
        return "a", "a"

    out, text = "", ""
    for _ in range(rng.randint(1, 5 - 2 * depth)):
        p, s = part()
        s = {"[.-]": "-", "[-._]": "_", "[/?#]": "?", "[a-c]": "b", "[^/]": rng.choice("ab-"), "\\d": "7", ".": rng.choice("a-"), "\\B": "", "\\b": "", "[a.]": rng.choice("a.")}.get(p, "") if s is None else s
        counts = ["", "", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,}"] if not re.search(r"[*+?}]", p) else ["", "", "?", "{2}"]
        count = rng.choice(counts) if p not in ("\\B", "\\b") else ""
        n = {"": 1, "?": rng.randint(0, 1), "*": rng.randint(0, 2), "+": rng.randint(1, 3), "{2}": 2, "{0,2}": rng.randint(0, 2), "{1,}": rng.randint(1, 2)}[count]
        out, text = out + p + count, text + s * n
    return out, text


def test_generated_patterns_lose_no_url():
    rng, met, held = random.Random(4), 0, 0
    for _ in range(20_000):
        p, s = pattern_of(rng)
        p = rng.choice(["", "^", "(?i)"]) + p + rng.choice(["", "$", "/"])
        tokens = url_filters.literal_tokens(p)
        held += bool(tokens)
        for url in (s, s + "/", rng.choice("ab-/1") + s + rng.choice("ab-/1"), s.upper()):
            if re.search(p, url):
                met += 1
                assert set(tokens) <= tokens_of(url), (p, url, tokens)
    assert met > 10_000 and held > 1_000


def test_rules_of_odd_shapes_meet_their_urls_in_spark(spark):
    rules = [url_filters.PatternRule(k, p) for k, p in enumerate([r"//(?:(a-)b-)?poker\.", r"/(x-)*bingo/", r"_bet_", r"-slots$"])]
    urls = ["http://a-b-poker.com", "http://poker.com", "http://x/x-x-bingo/", "http://x/bingo/", "http://x/a_bet_b", "http://x/my-slots", "http://apoker.com", "http://x/y-bingo/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, host_rules=[], pattern_rules=rules).collect()}
    assert got == {k: "block" if any(re.search(r.pattern, u) for r in rules) else "allow" for k, u in enumerate(urls)}
    with pytest.raises(ValueError):
        url_filters.PatternRule(9, r"\Bpoker\B")
    assert pages.select(F.count("*")).first()[0] == 8
